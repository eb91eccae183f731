"""Token vectors learned from co-occurrence: positive PMI and its leading factors.

``positive_pmi`` turns token pairs within a window into a sparse symmetric table ``(token, context, n, ppmi)``.
``learn_vectors`` finds its leading eigenpairs by block subspace iteration (Halko, Martinsson and Tropp,
"Finding structure with randomness", 2011): the pair table, joined with a thin factor of k columns, gives the
next factor by a group sum; only k x k matrices (Gram matrices of the factor) meet on the
driver, where they are factored with NumPy. The factor is a table with one row per token, written after
every step, so a lost executor costs one step at most and no vocabulary is held anywhere.

A step moves no pairs. Those whose context is frequent (as many contexts as their factor rows fit a broadcast) lie
bucketed by token: the factor rows come by broadcast and a token's sum stays in its bucket. The others lie
bucketed by context: only the factor is shuffled, and as their tokens are mostly frequent ones, sums are
combined before they move.

The token vector is the eigenvector row scaled by the root of the singular value, as in factorised PMI embeddings.
In ``positive_pmi``, joins on a frequent token are handled by ``lookup``: broadcast by measured size, else salted.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqtok.config import Params
from seqtok.operators.learn import context_pairs
from seqtok.operators.lookup import fits_broadcast, lookup_column, table_stats
from seqtok.operators.vectors import double_array
from seqtok.session import materialize, materialize_bucketed

_DEFAULT = Params()
OVERSAMPLE = 8


def positive_pmi(sentences: DataFrame, tokens_col: str = "tokens", window_size: int = 5,
                 params: Params = _DEFAULT) -> DataFrame:
    """``(token, context, n, ppmi)`` of all pairs at most ``window_size`` places apart whose pointwise
    mutual information ``ln(n * total / (n_token * n_context))`` is above 0. NULL tokens take no part."""
    pairs = materialize(context_pairs(sentences, tokens_col, window_size).withColumnRenamed("__c", "context")
                        .withColumnRenamed("__n", "n"), "context-pairs")
    alone = materialize(pairs.groupBy("token").agg(F.sum("n").alias("m")), "context-totals")
    total = alone.agg(F.sum("m").alias("t")).first()["t"] or 0
    small = fits_broadcast(alone, params)
    both = lookup_column(pairs, F.col("token"), alone, "token", "m", "__mt", small, ["token", "context"], params)
    both = lookup_column(both, F.col("context"), alone, "token", "m", "__mc", small, ["token", "context"], params)
    pmi = F.log(F.col("n") * F.lit(float(total)) / (F.col("__mt").cast("double") * F.col("__mc")))
    return both.select("token", "context", "n", pmi.alias("ppmi")).where(F.col("ppmi") > 0)


def _matrix(m: np.ndarray) -> Column:
    return F.array(*[double_array([float(x) for x in row]) for row in m])


def _times(vector: Column, m: np.ndarray) -> Column:
    """Row vector times matrix (literal columns of the matrix)."""
    return F.transform(_matrix(m.T), lambda c: F.aggregate(
        F.zip_with(c, vector, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x))


def _outer_sum(rows: DataFrame, left: str, right: str, k: int) -> np.ndarray:
    """The k x k sum over all rows of left x right, one row on the driver."""
    outer = F.flatten(F.transform(left, lambda a: F.transform(right, lambda b: a * b)))
    got = rows.agg(Summarizer.sum(array_to_vector(outer)).alias("s")).first()["s"]
    return np.asarray(got.toArray()).reshape(k, k)


@dataclass(frozen=True)
class _Pairs:
    """The pair table as a step reads it: ``near`` (frequent contexts, bucketed by token) and ``far`` (the others,
    bucketed by context); ``frequent (__f)`` or None where all contexts are."""

    near: DataFrame
    far: DataFrame | None
    frequent: DataFrame | None


def _laid_out(pmi: DataFrame, k: int, params: Params) -> _Pairs:
    buckets = int(pmi.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def bucketed(rows: DataFrame, key: str) -> DataFrame:
        return materialize_bucketed(rows.repartition(buckets, key), f"pmi-by-{key}", buckets, key, key)

    # a measured context row and its k factors
    degrees = materialize(pmi.groupBy(F.col("context").alias("__f")).agg(F.count(F.lit(1)).alias("__d")), "degrees")
    n, size = table_stats(degrees)
    room = int(params.broadcast_max_bytes // (size / n + 8 * k + 16))
    if n <= room:
        return _Pairs(bucketed(pmi, "token"), None, None)
    least = sum_above = 0
    for row in degrees.groupBy("__d").agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("__d")).toLocalIterator():
        least, sum_above = row["__d"], sum_above + row["c"]
        if sum_above > room:                   # contexts of this many pairs are too many
            break
    frequent = materialize(degrees.where(F.col("__d") > least).select("__f"), "frequent-contexts")
    hot = F.broadcast(frequent)
    return _Pairs(bucketed(pmi.join(hot, F.col("context") == F.col("__f"), "left_semi"), "token"),
                  bucketed(pmi.join(hot, F.col("context") == F.col("__f"), "left_anti"), "context"), frequent)


def _multiply(pairs: _Pairs, factor: DataFrame, k: int) -> DataFrame:
    """``(token, y)``: the pair table times the factor ``(token, q)``."""
    rows = factor.select(F.col("token").alias("__k"), "q")

    def sums(part: DataFrame, q: DataFrame) -> DataFrame:
        joined = part.join(q, F.col("context") == F.col("__k"))
        return joined.groupBy("token").agg(*[F.sum(F.col("q")[d] * F.col("ppmi")).alias(f"__s{d}") for d in range(k)])

    if pairs.far is None:
        both = sums(pairs.near, F.broadcast(rows))
    else:
        hot = rows.join(F.broadcast(pairs.frequent), F.col("__k") == F.col("__f"), "left_semi")
        both = sums(pairs.near, F.broadcast(hot)).unionByName(sums(pairs.far, rows)).groupBy("token").agg(
            *[F.sum(f"__s{d}").alias(f"__s{d}") for d in range(k)])
    return materialize(both.select("token", F.array(*[f"__s{d}" for d in range(k)]).alias("y")), "factor")


def learn_vectors(pmi: DataFrame, dim: int = 40, iterations: int = 20, tolerance: float = 1e-7,
                  params: Params = _DEFAULT) -> tuple[DataFrame, Sequence[float]]:
    """``((token, vector array<double>), singular values)`` of a symmetric table ``(token, context, ppmi)``.

    ``dim + 8`` columns are iterated until the first ``dim`` singular values change by less than ``tolerance``
    (relative), ``iterations`` times at most. Start vectors come from a hash of the token, so runs agree;
    of a vector and its negative the one with the larger positive component sum is kept. With fewer
    independent directions than ``dim`` the other components are 0. Tokens without a pair have no row.
    """
    pmi = materialize(pmi.select("token", "context", "ppmi"), "pmi")
    if pmi.isEmpty():
        none = F.array_repeat(F.lit(0.0), dim)
        return pmi.select("token", none.alias("vector")), [0.0] * dim
    k = dim + OVERSAMPLE
    start = F.transform(F.sequence(F.lit(1), F.lit(k)), lambda d: F.xxhash64("token", d) / F.lit(float(1 << 63)))
    factor = pmi.select("token").distinct().select("token", start.alias("q"))
    pairs = _laid_out(pmi, k, params)
    last = np.zeros(dim)
    for _ in range(max(iterations, 1)):
        y = _multiply(pairs, factor, k)
        values, basis = np.linalg.eigh(_outer_sum(y, "y", "y", k))
        order = np.argsort(-values, kind="stable")
        values, basis = np.maximum(values[order], 0.0), basis[:, order]
        live = values > values[0] * 1e-13 if values[0] > 0 else values > 0
        # orthonormal columns; directions that are not there are 0
        scale = np.where(live, 1 / np.sqrt(np.where(live, values, 1.0)), 0.0)
        factor = y.select("token", _times(F.col("y"), basis * scale).alias("q"))
        now = np.sqrt(values[:dim])
        if np.all(np.abs(now - last) <= tolerance * np.maximum(now, 1e-300)):
            break
        last = now
    factor = materialize(factor, "factor")
    y = _multiply(pairs, factor, k)
    ritz = _outer_sum(factor.join(y, "token"), "q", "y", k)
    values, basis = np.linalg.eigh((ritz + ritz.T) / 2)
    order = np.argsort(-np.abs(values), kind="stable")[:dim]
    singular, basis = np.abs(values[order]), basis[:, order]
    vectors = materialize(factor.select("token", _times(F.col("q"), basis * np.sqrt(singular)).alias("vector")), "vectors")
    sums = vectors.agg(Summarizer.sum(array_to_vector("vector")).alias("s")).first()["s"]
    signs = np.where(np.asarray(sums.toArray()) < 0, -1.0, 1.0)
    flipped = F.zip_with("vector", double_array(signs.tolist()), lambda a, b: a * b)
    return vectors.select("token", flipped.alias("vector")), singular.tolist()
