"""Exact top-k search by inner product over integer vectors.

Method: exhaustive term-at-a-time accumulation. A vector component is a term; a block of
candidate rows is turned into postings (per term the rows with a non-zero weight). Each
query scatters ``weight * posting weights`` term by term into a dense score array of the
block, the k best are found by partition selection, and block results are merged: first
in the task, then by one window over at most k rows per query and task.

Queries are read in blocks of ``query_block`` rows (bounded bytes); every block is
broadcast and meets all candidate rows in place, so candidates are never shuffled.

Rows: vectors that are null or hold a null or non-finite component take no part, neither
as query nor as candidate; an empty vector is a row without terms (score 0 everywhere);
vectors of different lengths meet on their common terms. Equal scores go to the smaller
id. Rows with a null id take no part. If several rows bear one query id, the smallest
vector is the query; candidates bearing the query's id are not its partners.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERY_BLOCK = 20_000
CANDIDATE_BLOCK = 8_192


def integer_vectors(df: DataFrame, id_col: str, vec_col: str, scale: int = 256) -> DataFrame:
    """``(id long, v)``: ``floor(scale * x)`` of every component, without the rows that take no part. ``v`` is
    array<long>, or array<double> of whole numbers where scores may not fit 64 bits."""
    x = F.col(vec_col)
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e.cast("double")) == float("inf")))
    rows = df.where(x.isNotNull() & ~bad & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.transform(x, lambda e: e.cast("double") * F.lit(float(scale))).alias("v"))
    most = rows.agg(F.max(F.array_max(F.transform("v", lambda e: F.abs(e)))).alias("m"), F.max(F.size("v")).alias("n")).first()
    if (most["m"] or 0.0) < 2.0 ** 62 and (most["n"] or 0) * (int(most["m"] or 0) + 1) ** 2 < 1 << 63:
        return rows.select("id", F.transform("v", lambda e: F.floor(e)).alias("v"))
    # doubles from 2 ** 53 on are whole
    return rows.select("id", F.transform("v", lambda e: F.when(F.abs(e) < 2.0 ** 53, F.floor(e).cast("double")).otherwise(e)).alias("v"))


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, row bounds and flat components of a batch of (id, v)."""
    ids = batch.column(0).to_numpy(zero_copy_only=False)
    lists = batch.column(1)
    off = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.values.to_numpy(zero_copy_only=False)[off[0]:off[-1]]
    if flat.dtype != np.int64:
        flat = np.array([int(x) for x in flat], dtype=object)
    return ids, off - off[0], flat


def _postings(bounds: np.ndarray, flat: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Per term: the rows with a non-zero weight, and the weights."""
    term = np.arange(len(flat)) - np.repeat(bounds[:-1], np.diff(bounds))
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    live = flat != 0
    term, row, weight = term[live], row[live], flat[live]
    order = np.argsort(term, kind="stable")
    term, row, weight = term[order], row[order], weight[order]
    cut = np.flatnonzero(np.diff(term, prepend=-1))
    return {int(term[a]): (row[a:b], weight[a:b])
            for a, b in zip(cut, [*cut[1:], len(term)])}


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best by (score descending, id ascending)."""
    if score.dtype == object:
        order = sorted(range(len(score)), key=lambda i: (-score[i], ids[i]))[:k]
        return score[order], ids[order]
    if len(score) > k:
        edge = np.partition(score, len(score) - k)[len(score) - k]
        keep = np.flatnonzero(score >= edge)
        score, ids = score[keep], ids[keep]
    order = np.lexsort((ids, -score))[:k]
    return score[order], ids[order]


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 5,
          query_block: int = QUERY_BLOCK) -> DataFrame:
    """Best ``k`` candidates of every query: ``query_id, rank (from 1), vec_id, score``.
    Both inputs are ``(id long, v array<long>)`` (see ``integer_vectors``)."""
    spark = candidates.sparkSession
    wide = isinstance(candidates.schema["v"].dataType.elementType, T.DoubleType)
    schema = T.StructType([T.StructField("query_id", T.LongType()),
                           T.StructField("vec_id", T.LongType()),
                           T.StructField("score", T.StringType() if wide else T.LongType())])
    distinct = queries.groupBy("id").agg(F.min("v").alias("v"))
    parts = []
    for block in _query_blocks(distinct, query_block):
        shared = spark.sparkContext.broadcast(block)
        parts.append(candidates.select("id", "v").mapInArrow(_scan(shared, k, wide), schema))
    if not parts:
        return spark.createDataFrame([], T.StructType([
            schema[0], T.StructField("rank", T.IntegerType()), schema[1], T.StructField("score", T.LongType())]))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    if wide:
        return found.groupBy("query_id").applyInPandas(
            _merge_wide(k), "query_id long, rank int, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return (found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
                 .select("query_id", "rank", "vec_id", "score"))


def _query_blocks(queries: DataFrame, size: int) -> Iterator[dict]:
    """Blocks of at most ``size`` queries in id order, each bounded on the driver."""
    last = None
    while True:
        rest = queries if last is None else queries.where(F.col("id") > last)
        rows = rest.orderBy("id").limit(size).toArrow().to_batches()
        got = [_arrays(b) for b in rows if b.num_rows]
        if not got:
            return
        ids = np.concatenate([g[0] for g in got])
        vectors = [flat[bounds[i]:bounds[i + 1]] for _, bounds, flat in got
                   for i in range(len(bounds) - 1)]
        yield {"ids": ids, "vectors": vectors}
        if len(ids) < size:
            return
        last = int(ids[-1])


def _merge_wide(k: int):
    """The k best of a query's rows (at most k per task), scores as decimal strings."""
    def merge(group: pd.DataFrame) -> pd.DataFrame:
        score = np.array([int(s) for s in group["score"]], dtype=object)
        score, who = _best(score, group["vec_id"].to_numpy(), k)
        return pd.DataFrame({"query_id": group["query_id"].iloc[0], "rank": np.arange(1, len(who) + 1), "vec_id": who,
                             "score": pd.array([s if -(1 << 63) <= s < 1 << 63 else None for s in score], "Int64")})

    return merge


def _scan(shared, k: int, wide: bool = False):
    kind = object if wide else np.int64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors = shared.value["ids"], shared.value["vectors"]
        best = [(np.zeros(0, kind), np.zeros(0, np.int64))] * len(ids)
        for whole in batches:
            for at in range(0, whole.num_rows, CANDIDATE_BLOCK):
                own, bounds, flat = _arrays(whole.slice(at, CANDIDATE_BLOCK))
                postings = _postings(bounds, flat)
                for q, vector in enumerate(vectors):
                    score = np.zeros(len(own), dtype=kind)
                    for term in np.flatnonzero(vector):
                        if int(term) in postings:
                            rows, weight = postings[int(term)]
                            if len(rows) == len(own):      # every row has the term
                                score += vector[term] * weight
                            else:
                                score[rows] += vector[term] * weight
                    other = own != ids[q]
                    s, i = (score, own) if other.all() else (score[other], own[other])
                    top, who = _best(s, i, k)
                    best[q] = _best(np.concatenate([best[q][0], top]),
                                    np.concatenate([best[q][1], who]), k)
        sizes = [len(s) for s, _ in best]
        if sum(sizes):
            yield pa.RecordBatch.from_pandas(pd.DataFrame({
                "query_id": np.repeat(ids, sizes).astype(np.int64),
                "vec_id": np.concatenate([i for _, i in best]).astype(np.int64),
                "score": np.concatenate([s for s, _ in best]).astype(str if wide else np.int64)}),
                preserve_index=False)

    return run


def search_multiples(df: DataFrame, every: int = 50, k: int = 5, scale: int = 256,
                     id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Top ``k`` of every row whose id is divisible by ``every``, against all rows."""
    vectors = integer_vectors(df, id_col, vec_col, scale)
    is_query: Column = F.col("id") % every == 0
    return top_k(vectors.where(is_query), vectors, k)
