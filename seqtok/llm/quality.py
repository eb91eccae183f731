"""Quality classifier: nearest-neighbour voting in a latent-semantic space.

Method: a text is a bag of terms: hashed words, three-grams of its character shape (runs
of lower- and upper-case letters and digits count as one; every ASCII mark is itself),
and words equal to the word before. Terms are weighted by square root of their share times
inverse document frequency, each family normalised. A singular value decomposition of the
labelled sample's term matrix gives the latent space. Every document is projected; its
cosines to all labelled vectors are computed exactly, block by block; the ``NEIGHBOURS``
nearest vote for their label with the weight ``cosine ** SHARPNESS``.

The labelled sample is bounded: up to ``SAMPLE_PER_LABEL`` labelled documents of each label,
in hash order. Their term vectors (not their texts) reach the driver; the broadcast model
has a fixed size bound. Documents are never shuffled; whole texts are scored.

Rows: null, empty and wordless texts without any term score 0.0; a text with no neighbour of
positive cosine scores the share of label 1 in the sample. Labels that are null or neither 0 nor 1
are ignored; of several labels of a document the least counts. Equal cosines go to the
smaller id. With nothing to learn from, every score is 0.5.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqtok.llm.common import append_columns, mix64, sample_by_hash, word_hashes

WORD_TERMS = 1024
SHAPE_TERMS = 1023
TERMS = WORD_TERMS + SHAPE_TERMS + 1      # the last: a word repeated at once
RANK = 64
NEIGHBOURS = 15
SHARPNESS = 4
SAMPLE_PER_LABEL = 2_000
WORD_WEIGHT = 0.3
REJECT_BELOW = 0.3

_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[ord("a"):ord("z") + 1] = 1
_SHAPE[128:] = 1
_SHAPE[ord("A"):ord("Z") + 1] = 2
_SHAPE[ord("0"):ord("9") + 1] = 3
_SHAPE[[9, 11, 12, 13]] = 32


def term_counts(texts: list[str | None]) -> np.ndarray:
    """Counts of every term, one row per text."""
    n = len(texts)
    out = np.zeros((n, TERMS), dtype=np.float32)
    words, bounds = word_hashes(texts)
    if len(words):
        text = np.repeat(np.arange(n), np.diff(bounds))
        term = (words % np.uint64(WORD_TERMS)).astype(np.int64)
        out[:, :WORD_TERMS] = np.bincount(text * WORD_TERMS + term, minlength=n * WORD_TERMS).reshape(n, -1)
        again = (words[1:] == words[:-1]) & (text[1:] == text[:-1])
        out[:, -1] = np.bincount(text[1:][again], minlength=n)
    raw = [(t or "").encode("utf-8", "replace") for t in texts]
    size = np.fromiter(map(len, raw), dtype=np.int64, count=n)
    buf = np.frombuffer(b"".join(raw), dtype=np.uint8)
    if len(buf):
        text = np.repeat(np.arange(n, dtype=np.int64), size)
        shape = _SHAPE[buf]
        run = np.empty(len(buf), dtype=bool)
        run[0] = False
        run[1:] = (shape[1:] == shape[:-1]) & (shape[1:] <= 3) & (text[1:] == text[:-1])
        shape, text = shape[~run].astype(np.int64), text[~run]
        gram = (shape[:-2] << 16) | (shape[1:-1] << 8) | shape[2:]
        same = text[:-2] == text[2:]
        term = (mix64(gram[same].astype(np.uint64)) % np.uint64(SHAPE_TERMS)).astype(np.int64)
        out[:, WORD_TERMS:-1] = np.bincount(text[:-2][same] * SHAPE_TERMS + term,
                                            minlength=n * SHAPE_TERMS).reshape(n, -1)
    return out


def term_shares(counts: np.ndarray) -> np.ndarray:
    """Square roots of each term's share in its family; a repeat's share is of all words."""
    words = counts[:, :WORD_TERMS].sum(axis=1, keepdims=True)
    shapes = counts[:, WORD_TERMS:-1].sum(axis=1, keepdims=True)
    out = np.empty_like(counts)
    out[:, :WORD_TERMS] = counts[:, :WORD_TERMS] / np.maximum(words, 1) * WORD_WEIGHT
    out[:, WORD_TERMS:-1] = counts[:, WORD_TERMS:-1] / np.maximum(shapes, 1)
    out[:, -1:] = counts[:, -1:] / np.maximum(words, 1)
    return np.sqrt(out)


class NeighbourModel:
    """Latent space, labelled vectors and labels."""

    def __init__(self, shares: np.ndarray, labels: np.ndarray, rank: int = RANK):
        n = len(shares)
        df = (shares > 0).sum(axis=0)
        self.idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)
        self.idf[-1] = 1.0
        weighted = shares * self.idf
        _, vectors = np.linalg.eigh(weighted.T @ weighted)    # right singular vectors, ascending
        self.basis = np.ascontiguousarray(vectors[:, ::-1][:, :rank]).astype(np.float32)
        self.vectors = _unit(weighted @ self.basis)
        self.labels = labels.astype(np.float32)
        self.prior = float(labels.mean()) if n else 0.0

    def score(self, texts: list[str | None]) -> np.ndarray:
        counts = term_counts(texts)
        out = np.zeros(len(texts))
        known = np.flatnonzero(counts.any(axis=1))
        if not len(self.labels):
            return np.full(len(texts), 0.5)
        if not len(known):
            return out
        latent = _unit((term_shares(counts[known]) * self.idf) @ self.basis)
        k = min(NEIGHBOURS, len(self.labels))
        for a in range(0, len(known), 512):
            cosine = latent[a:a + 512] @ self.vectors.T
            near = _nearest(cosine, k)
            weight = np.maximum(np.take_along_axis(cosine, near, axis=1), 0.0) ** SHARPNESS
            total = weight.sum(axis=1)
            vote = (weight * self.labels[near]).sum(axis=1) / np.maximum(total, 1e-12)
            out[known[a:a + 512]] = np.where(total > 1e-9, vote, self.prior)
        return np.clip(out, 0.0, 1.0)


def _nearest(cosine: np.ndarray, k: int) -> np.ndarray:
    """The k columns with the largest values of every row; of equal values those that come first."""
    edge = np.partition(cosine, cosine.shape[1] - k, axis=1)[:, cosine.shape[1] - k][:, None]
    above, level = cosine > edge, cosine == edge
    room = k - above.sum(axis=1, keepdims=True)
    return np.nonzero(above | (level & (np.cumsum(level, axis=1) <= room)))[1].reshape(-1, k)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def with_terms(df: DataFrame, text_col: str, out: str) -> DataFrame:
    def work(texts: list) -> list:
        shares = term_shares(term_counts(texts))
        offsets = np.arange(len(texts) + 1, dtype=np.int32) * TERMS
        return [pa.ListArray.from_arrays(pa.array(offsets), pa.array(shares.ravel()))]

    return append_columns(df, text_col, [T.StructField(out, T.ArrayType(T.FloatType()))],
                          lambda: work, rows=512)


def learn_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  label_col: str = "quality", per_label: int = SAMPLE_PER_LABEL):
    """Broadcast ``NeighbourModel`` from a bounded sample of the labelled documents."""
    spark = docs.sparkSession
    clean = (labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
                   .groupBy(F.col(id_col).alias("__lid")).agg(F.min(label_col).cast("int").alias("__label")))
    chosen = sample_by_hash(clean.withColumn("__h", F.xxhash64("__lid")), "__label", "__h", per_label, ("__lid",))
    # at most 2 * per_label ids: a proven bound
    sample = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(
        F.broadcast(chosen.drop("__h")), F.col("__id") == F.col("__lid"))
    one = Window.partitionBy("__id").orderBy(F.col("__text").asc_nulls_first())
    sample = sample.withColumn("__n", F.row_number().over(one)).where("__n = 1")
    got = (with_terms(sample.select("__id", "__label", "__text"), "__text", "__terms")
           .select("__id", "__label", "__terms").toArrow())
    order = np.argsort(got.column(0).to_numpy(), kind="stable")
    label = got.column(1).to_numpy()
    rows = [np.zeros((0, TERMS), dtype=np.float32)]
    rows += [c.flatten().to_numpy().reshape(-1, TERMS) for c in got.column(2).chunks if len(c)]
    shares = np.concatenate(rows)
    del got, rows
    order = order[shares[order].any(axis=1)]
    return spark.sparkContext.broadcast(NeighbourModel(shares[order], label[order]))


def with_quality(df: DataFrame, model, text_col: str = "text", out: str = "score") -> DataFrame:
    """``df`` with the quality score of each text."""

    def make():
        fitted = model.value
        return lambda texts: [pa.array(fitted.score(texts), pa.float64())]

    return append_columns(df, text_col, [T.StructField(out, T.DoubleType())], make, rows=1024)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose labels are not learned from: crc32 of the id's decimal text modulo 5 is 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """Id, ``held_out``, ``score`` and ``predicted`` of every document."""
    model = learn_quality(docs, labels.where(~held_out(id_col)), id_col, text_col)
    return with_quality(docs.select(id_col, text_col), model, text_col).select(
        id_col, held_out(id_col).alias("held_out"), "score",
        (F.col("score") >= REJECT_BELOW).cast("int").alias("predicted"))
