"""Document fingerprints: one-permutation MinHash, optimally densified, packed low bits.

Method: the hashes of a text's word five-grams are dealt once into ``BINS`` bins by their
top bits; each bin keeps its least hash. An empty bin copies the first non-empty bin of
its own fixed random probe sequence (optimal densification), so equal sets agree in every
bin and the share of agreeing bins estimates the Jaccard likeness. Each bin stores its
lowest ``BITS`` bits, packed and written as hex; the estimate is corrected for agreement
by chance: ``(agreeing - 2^-BITS) / (1 - 2^-BITS)``, at least 0.

Rows: null and empty texts, and texts without a word, have the empty fingerprint ``''``;
two empty fingerprints are alike (1.0), an empty and another are not (0.0). A text of one
to four words has one shingle of all its words. Repeated rows get equal fingerprints; further
columns pass through ``with_fingerprints``.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqtok.llm.common import append_columns, mix64, pieces, shingle_hashes, text_column

BINS = 512
BITS = 4
SPARSE_BINS = 48           # up to so many filled bins the probe order is looked up at once
PROBES = 1 << 13
RANGE_BYTES = 4 << 20      # text per id range in the neighbour pass
MAX_RANGES = 20_000
_NULL_ID = -(1 << 63)
_FULL = np.uint64(2**64 - 1)


class Sketcher:
    """Probe sequences and packed sketches of batches of texts."""

    def __init__(self, bins: int = BINS, bits: int = BITS):
        self.bins, self.bits = bins, bits
        self.shift = np.uint64(64 - int(math.log2(bins)))
        seed = np.arange(PROBES * bins, dtype=np.uint64).reshape(PROBES, bins)
        self.probe = (mix64(seed + np.uint64(0xA0761D6478BD642F)) >> self.shift).astype(np.int16)
        # first[i, j]: the attempt at which bin i probes bin j; bins never probed come last
        self.first = np.tile(PROBES + np.arange(bins, dtype=np.int32), (bins, 1))
        for t in range(PROBES - 1, -1, -1):
            self.first[np.arange(bins), self.probe[t]] = t

    def codes(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """``(codes, empty)``: the low bits of every bin per text; texts without words."""
        h, bounds = shingle_hashes(texts)
        n = len(texts)
        least = np.full(n * self.bins, _FULL, dtype=np.uint64)
        place = np.repeat(np.arange(n) * self.bins, np.diff(bounds)) + (h >> self.shift).astype(np.int64)
        np.minimum.at(least, place, h)
        least = least.reshape(n, self.bins)
        filled = least != _FULL
        count = filled.sum(axis=1)
        for i in np.flatnonzero((count > 0) & (count <= SPARSE_BINS)):
            have = np.flatnonzero(filled[i])
            source = have[self.first[:, have].argmin(axis=1)]
            source[have] = have
            least[i] = least[i, source]
        row, col = np.nonzero(~filled & (count > SPARSE_BINS)[:, None])
        t = 0
        while len(row):
            source = self.probe[t, col] if t < PROBES else np.full(len(col), t - PROBES)
            hit = filled[row, source]
            least[row[hit], col[hit]] = least[row[hit], source[hit]]
            row, col = row[~hit], col[~hit]
            t += 1
        codes = (least & np.uint64((1 << self.bits) - 1)).astype(np.uint8)
        codes[count == 0] = 0
        return codes, count == 0

    def pack(self, codes: np.ndarray, empty: np.ndarray) -> list[str]:
        """Hex of the packed codes; '' for an empty text."""
        wide = np.unpackbits(codes[:, :, None], axis=2)[:, :, 8 - self.bits:]
        packed = np.packbits(wide.reshape(len(codes), -1), axis=1)
        return ["" if e else p.tobytes().hex() for p, e in zip(packed, empty)]

    def likeness(self, a: np.ndarray, b: np.ndarray, a_empty: np.ndarray,
                 b_empty: np.ndarray) -> np.ndarray:
        """Corrected share of agreeing bins, row by row."""
        chance = 2.0 ** -self.bits
        alike = np.clip(((a == b).mean(axis=1) - chance) / (1 - chance), 0.0, 1.0)
        return np.where(a_empty | b_empty, (a_empty & b_empty).astype(float), alike)


def fingerprint_likeness(a: str, b: str, bits: int = BITS) -> float:
    """Estimated Jaccard likeness (0 to 1) of two fingerprints in hex."""
    if not a or not b:
        return float(a == b)
    x, y = (np.unpackbits(np.frombuffer(bytes.fromhex(s), dtype=np.uint8)).reshape(-1, bits)
            for s in (a, b))
    chance = 2.0 ** -bits
    return float(min(1.0, max(0.0, ((x == y).all(axis=1).mean() - chance) / (1 - chance))))


def with_fingerprints(df: DataFrame, text_col: str = "text", out: str = "fingerprint") -> DataFrame:
    """``df`` with the fingerprint of each text in ``out``."""

    def make():
        sketcher = Sketcher()
        return lambda texts: [pa.array(sketcher.pack(*sketcher.codes(texts)), pa.string())]

    return append_columns(df, text_col, [T.StructField(out, T.StringType())], make, rows=1024)


def _id_ranges(base: DataFrame) -> tuple[DataFrame, list[tuple[int, int]]]:
    """``base`` (``__key`` long, ``__text``) with ``__range``, ranges of ascending keys of
    about RANGE_BYTES of text, and ``(range, least key)`` of the ranges that have rows."""
    got = base.agg(F.sum(F.coalesce(F.octet_length("__text"), F.lit(0)) + 16).alias("b")).first()
    n = min(MAX_RANGES, max(1, math.ceil((got["b"] or 0) / RANGE_BYTES)))
    cuts = []
    if n > 1:
        share = [i / n for i in range(1, n)]
        cuts = base.agg(F.percentile_approx("__key", share, max(10_000, 20 * n)).alias("c")).first()["c"]
    splits = [float("-inf"), *sorted({float(c) for c in cuts}), float("inf")]
    if len(splits) > 2:
        keyed = base.withColumn("__wide", F.col("__key").cast("double"))
        ranged = (Bucketizer(splits=splits, inputCol="__wide", outputCol="__range")
                  .transform(keyed).drop("__wide").withColumn("__range", F.col("__range").cast("int")))
    else:
        ranged = base.withColumn("__range", F.lit(0))
    heads = ranged.groupBy("__range").agg(F.min("__key").alias("k")).collect()  # <= MAX_RANGES rows
    return ranged, sorted((r["__range"], r["k"]) for r in heads)


def with_next_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows ``(__range, __end, __key, __id, __text)`` dealt out by id range and sorted, so
    that each document is followed by the next by ascending id (null ids first, equal ids
    by text); the last of a range is followed by a copy of the next range's first row
    with ``__end`` set, the very last by the very first."""
    spark = docs.sparkSession
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_ID))
    base = docs.select(key.alias("__key"), F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    ranged, heads = _id_ranges(base)
    rows = ranged.select("__range", F.lit(False).alias("__end"), "__key", "__id", "__text")
    if heads:
        follows = [(heads[i][0], heads[i][1], heads[i - 1][0]) for i in range(len(heads))]
        table = spark.createDataFrame(follows, "__r int, __k long, __before int")
        first = (ranged.join(F.broadcast(table), (F.col("__range") == F.col("__r"))
                             & (F.col("__key") == F.col("__k")))
                       .groupBy("__before").agg(F.min(F.struct("__text")).alias("__first")))
        ends = first.select(F.col("__before").alias("__range"), F.lit(True).alias("__end"),
                            F.lit(_NULL_ID).alias("__key"),
                            F.lit(None).cast(docs.schema[id_col].dataType).alias("__id"),
                            F.col("__first.__text").alias("__text"))
        rows = rows.unionByName(ends)
    return rows.repartition("__range").sortWithinPartitions(
        "__range", "__end", "__key", F.col("__text").asc_nulls_first())


def edited_text(text: str, following: str) -> str:
    """The last quarter of ``text`` replaced by as much of the start of ``following``."""
    k = len(text) // 4
    return text[:len(text) - k] + following[:k]


def edit_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint of every text and of its edited text, and their likeness."""
    schema = T.StructType([
        T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_chars", T.LongType()),
        T.StructField("edited_sha256", T.StringType()), T.StructField("fingerprint", T.StringType()),
        T.StructField("edited_fingerprint", T.StringType()),
        T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher = Sketcher()
        ids, ends, texts = None, [], []
        for batch in batches:
            column = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: B023, E731
            key = column("__id")
            ids = key if ids is None else pa.concat_arrays([ids, key])
            ends += column("__end").to_pylist()
            texts += [t or "" for t in text_column(batch, "__text")]
            last = len(texts) - 1              # waits for the row that follows it
            for a, b in pieces(texts[:last], rows=1024):
                own, empty = sketcher.codes(texts[a:b + 1])
                live = [i for i in range(a, b) if not ends[i]]
                if not live:
                    continue
                edited = [edited_text(texts[i], texts[i + 1]) for i in live]
                new, new_empty = sketcher.codes(edited)
                at = np.array(live) - a
                yield pa.RecordBatch.from_arrays([
                    ids.take(pa.array(live)), pa.array([len(texts[i]) for i in live], pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
                    pa.array(sketcher.pack(own[at], empty[at])), pa.array(sketcher.pack(new, new_empty)),
                    pa.array(sketcher.likeness(own[at], new, empty[at], new_empty)),
                    pa.array(sketcher.likeness(own[at], own[at + 1], empty[at], empty[at + 1]))],
                    names=schema.names)
            ids, ends, texts = ids.slice(last), ends[last:], texts[last:]

    return with_next_text(docs, id_col, text_col).select("__id", "__end", "__text").mapInArrow(run, schema)
