"""Packing into length buckets with least padding, and token-budget batches.

Method: one aggregate gives the exact histogram of lengths over all documents. Dynamic
programming over it (divide and conquer on the cuts, ``k n log n``) chooses at most
``n_buckets`` boundaries with the least total padding, at any number of distinct lengths n. The histogram goes
to the driver: documents with n distinct lengths hold ``n * n / 2`` words at least, so 100 TB of text
have at most a few million. A bucket of boundary L takes batches of
``max(1, token_budget // L)`` documents, so a batch padded to L stays in the budget; a
document longer than the budget is a batch of its own.

Batches form inside shards of a bucket: a bucket gets one shard per ``shard_rows``
documents (by a hash of the id), so one bucket with most of the rows is spread over many
tasks; only the last batch of a shard may be short.

The texts are read once: id, length and carried columns are written, and histogram and packing work on
that table.

Rows: null text, or a null length, has length 0 like an empty text; length-0 rows go to the first bucket and
are packed as all others; repeated rows and null ids are packed once per row; an empty table
gives an empty result; further columns pass only where named in ``carry``, and not if a column
of the result has that name (in any case of letters).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqtok.session import materialize

MAX_SHARDS = 20_000
RESULT = ("n_tokens", "bucket", "bucket_len", "shard", "batch", "slot", "padding")


def word_count(text: Column) -> Column:
    """Number of white-space-delimited tokens; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def length_histogram(lengths: DataFrame) -> list[tuple[int, int, int]]:
    """``(length, documents, sum of lengths)`` per length, ascending. ``lengths`` has one column ``__len``."""
    got = lengths.groupBy("__len").agg(F.count(F.lit(1)).alias("__n")).toArrow()
    size, n = (got.column(i).to_numpy() for i in (0, 1))
    order = np.argsort(size)
    return list(zip(size[order].tolist(), n[order].tolist(), (size * n)[order].tolist()))


def _best_cuts(before: np.ndarray, top: np.ndarray, count: np.ndarray,
               total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every j the least ``before[i] + padding of one bucket of the lengths i..j`` and its
    least i. That i never falls as j grows, so the middle j of a range halves its cuts; the
    middles of all ranges of one level are taken at once."""
    n = len(top)
    new, cut = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    lo, hi = np.array([0]), np.array([n - 1])                # ranges of j, and of their cuts
    left, right = np.array([0]), np.array([n - 1])
    while len(lo):
        mid = (lo + hi) // 2
        size = np.minimum(mid, right) - left + 1
        first = np.concatenate([[0], np.cumsum(size)[:-1]])
        j = np.repeat(mid, size)
        i = np.arange(len(j)) - np.repeat(first - left, size)
        cost = before[i] + (count[j + 1] - count[i]) * top[j] - (total[j + 1] - total[i])
        least = np.minimum.reduceat(cost, first)
        at = np.flatnonzero(cost == np.repeat(least, size))
        cut[mid] = i[at[np.searchsorted(at, first)]]
        new[mid] = least
        lo, hi, left, right = (np.concatenate(x) for x in ((lo, mid + 1), (mid - 1, hi), (left, cut[mid]),
                                                           (cut[mid], right)))
        some = lo <= hi
        lo, hi, left, right = lo[some], hi[some], left[some], right[some]
    return new, cut


def optimal_boundaries(histogram: list[tuple[int, int, int]], n_buckets: int) -> list[int]:
    """Boundaries (largest length of each bucket) with the least total padding; the last
    is the largest length. Among equal costs the fewest buckets, then the smallest cuts."""
    if not histogram:
        return []
    top = np.array([h[0] for h in histogram], dtype=np.int64)
    count = np.concatenate([[0], np.cumsum([h[1] for h in histogram])]).astype(np.int64)
    total = np.concatenate([[0], np.cumsum([h[2] for h in histogram])]).astype(np.int64)
    n = len(histogram)
    best = count[1:] * top - total[1:]
    choice = [np.zeros(n, dtype=np.int64)]
    for _ in range(1, min(n_buckets, n)):
        new, cut = _best_cuts(np.concatenate([[0], best]), top, count, total)
        if new[-1] >= best[-1]:
            break
        best = new
        choice.append(cut)
    bounds, j = [], n - 1
    for cut in reversed(choice):
        bounds.append(int(top[j]))
        j = int(cut[j]) - 1
        if j < 0:
            break
    return bounds[::-1]


def pack_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   length: Column | None = None, n_buckets: int = 16,
                   token_budget: int = 65_536, shard_rows: int = 100_000,
                   carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: id, ``n_tokens``, ``bucket`` (from 0), ``bucket_len``,
    ``shard``, ``batch`` (within bucket and shard), ``slot`` (within the batch),
    ``padding`` (bucket_len - n_tokens), then the columns in ``carry``."""
    if id_col.lower() in RESULT:
        raise ValueError(f"the id column cannot be called {id_col}")
    carry = tuple(c for c in carry if c.lower() not in (*RESULT, id_col.lower()))
    size = word_count(F.col(text_col)) if length is None else F.coalesce(length.cast("long"), F.lit(0))
    base = materialize(df.select(F.col(id_col), size.alias("__len"), *carry), "lengths")
    histogram = length_histogram(base.select("__len"))
    bounds = optimal_boundaries(histogram, n_buckets)
    if not bounds:
        bounds = [0]
    edge = F.array(*[F.lit(b).cast("long") for b in bounds])
    rows = [0] * len(bounds)
    for top, n, _ in histogram:
        rows[int(np.searchsorted(bounds, top))] += n
    shards = [int(min(MAX_SHARDS, max(1, -(-n // shard_rows)))) for n in rows]
    room = [max(1, token_budget // max(1, b)) for b in bounds]
    spread = F.xxhash64(F.col(id_col), F.col("__len"))
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]),
                                       F.col("bucket") + 1)
    placed = (base.withColumn("bucket", F.size(F.filter(edge, lambda b: b < F.col("__len"))))
                  .withColumn("shard", F.pmod(spread, pick(shards)).cast("int"))
                  .withColumn("__spread", spread))
    within = Window.partitionBy("bucket", "shard").orderBy("__spread", id_col, "__len")
    at = F.row_number().over(within) - 1
    return (placed.withColumn("__at", at)
                  .select(id_col, F.col("__len").alias("n_tokens"), "bucket",
                          pick([int(b) for b in bounds]).cast("long").alias("bucket_len"), "shard",
                          F.floor(F.col("__at") / pick(room)).cast("long").alias("batch"),
                          F.pmod(F.col("__at"), pick(room)).cast("int").alias("slot"),
                          (pick([int(b) for b in bounds]) - F.col("__len")).cast("long").alias("padding"),
                          *carry))
