"""Token vectors and attention pooling.

Attention over a sequence ``x_1..x_T`` (Raffel & Ellis, "Feed-forward networks with
attention can solve some long-term memory problems", 2015):
``e_t = tanh(x_t . W + b_t)``, ``a_t = exp(e_t) m_t / (sum_s exp(e_s) m_s + eps)``,
pooled ``= sum_t a_t x_t``. The bias is per step.

On Spark the per-step score is a row expression and both sums are group aggregates:
``sum(exp(e) m)`` and the vector sum ``sum(exp(e) m x)`` (``Summarizer.sum``, a
partial-aggregating vector sum). A sequence never has to sit in one task or one row,
so a group holding a third of all rows is combined map-side like any sum.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqtok.config import Params
from seqtok.operators.lookup import fits_broadcast, join_totals, lookup_mixed, lookup_positions

_DEFAULT = Params()


def double_array(values: Sequence[float]) -> Column:
    """A literal ``array<double>`` built from one SQL expression (not one call per item)."""
    if not values:
        return F.expr("cast(array() as array<double>)")
    return F.expr("array(" + ",".join(f"CAST('{float(v)!r}' AS DOUBLE)" for v in values) + ")")


def embed_tokens(records: DataFrame, vectors: DataFrame, n_tokens: int, dim: int,
                 ids_col: str = "token_ids", out: str = "embedded",
                 broadcast: bool | None = None, flatten: bool = True,
                 params: Params = _DEFAULT) -> DataFrame:
    """Replace each token id by its vector (``vectors``: ``token_id, vector``); ids
    without a vector get zeros. Vectors too large to broadcast (``broadcast=None`` measures them) are: those of the
    most frequent ids by broadcast, the others by a shuffle. ``flatten`` gives one ``n_tokens*dim`` array per row."""
    measured = broadcast is None
    if measured:
        broadcast = fits_broadcast(vectors.select("token_id", "vector"), params)
    vecs = vectors.select("token_id", F.col("vector").cast("array<float>").alias("vector"))
    zero = F.array_repeat(F.lit(0.0).cast("float"), dim)
    if measured and not broadcast and n_tokens <= params.wide_tokens:
        staged = lookup_mixed(records, ids_col, n_tokens, vecs, "token_id", "vector", zero, out, params)
    else:
        staged = lookup_positions(records, ids_col, n_tokens, vecs, "token_id", "vector", zero,
                                  out, broadcast, params)
    return staged.withColumn(out, F.flatten(out)) if flatten else staged


Bias = Sequence[float] | Callable[[Column], Column] | None


def attention_scores(vec: Column, step: Column, W: Sequence[float],
                     b: Bias, mask: Column | None = None) -> Column:
    """Unnormalised weight ``exp(tanh(x.W + b_step)) * mask`` of one step (double).

    ``b`` is a list indexed by step (a model's fixed number of steps) or a function of
    the step column (a rule; nothing sized by the data is built on the driver).
    """
    w_arr = double_array(W)
    x = vec.cast("array<double>")
    dot = F.aggregate(F.zip_with(x, w_arr, lambda u, v: u * v), F.lit(0.0), lambda acc, y: acc + y)
    if callable(b):
        dot = dot + b(step).cast("double")
    elif b is not None:
        dot = dot + F.element_at(double_array(b), (step + 1).cast("int"))
    a = F.exp(F.tanh(dot))
    if mask is not None:
        a = a * mask.cast("double")
    return a


def attention_pool(df: DataFrame, group_cols: Sequence[str], step_col: str, vec_col: str,
                   W: Sequence[float], b: Bias = None,
                   mask_col: str | None = None, epsilon: float = 1e-7,
                   return_attention: bool = False, out: str = "pooled",
                   keep: Sequence[str] = (), params: Params = _DEFAULT):
    """Attention-pooled vector per group: ``(group_cols..., pooled array<double>)``.

    ``step_col`` is the 0-based step of the row in its sequence (indexes ``b``).
    With ``return_attention`` also returns per-row weights
    ``(group_cols..., step, keep..., attention double)``; the normaliser is joined
    back on the group key (broadcast if small, else hot groups are salted).
    """
    group_cols = list(group_cols)
    mask = F.col(mask_col) if mask_col else None
    a = attention_scores(F.col(vec_col), F.col(step_col), W, b, mask)
    staged = df.select(*group_cols, step_col, *keep, vec_col, a.alias("__a"))
    weighted = F.transform(F.col(vec_col).cast("array<double>"), lambda x: x * F.col("__a"))
    sums = staged.groupBy(*group_cols).agg(
        F.sum("__a").alias("__z"), F.count(F.lit(1)).alias("__rows"),
        Summarizer.sum(array_to_vector(weighted)).alias("__s"),
    )
    pooled = sums.select(
        *group_cols,
        F.transform(vector_to_array("__s"), lambda v: v / (F.col("__z") + F.lit(epsilon))).alias(out),
    )
    if not return_attention:
        return pooled
    totals = sums.select(*group_cols, "__z", "__rows")
    weights = (join_totals(staged.drop(vec_col), totals, group_cols, "__rows", F.xxhash64(step_col, *keep), params)
                     .select(*group_cols, step_col, *keep,
                             (F.col("__a") / (F.col("__z") + F.lit(epsilon))).alias("attention")))
    return pooled, weights


def past_future_pool(df: DataFrame, group_cols: Sequence[str], step_col: str, vec_col: str,
                     center: int, W_past: Sequence[float], b_past: Bias,
                     W_future: Sequence[float], b_future: Bias,
                     epsilon: float = 1e-7, out: str = "pooled") -> DataFrame:
    """Pool steps ``0..center`` read backwards and steps ``center..`` forwards with two
    attention weight sets, then concatenate ``[past, future]``. Step ``center`` is in
    both halves; a side with no steps contributes zeros."""
    group_cols = list(group_cols)
    s, x = F.col(step_col), F.col(vec_col).cast("array<double>")
    back, ahead = F.lit(center) - s, s - F.lit(center)
    # one pass: a row off a side has weight 0 there (its bias is then read at step 0)
    wp = F.when(s <= center, attention_scores(x, F.greatest(back, F.lit(0)), W_past, b_past)).otherwise(0.0)
    wf = F.when(s >= center, attention_scores(x, F.greatest(ahead, F.lit(0)), W_future, b_future)).otherwise(0.0)
    staged = df.select(*group_cols, x.alias("__x"), wp.alias("__wp"), wf.alias("__wf"))
    side = lambda w: Summarizer.sum(array_to_vector(F.transform("__x", lambda v: v * F.col(w))))
    sums = staged.groupBy(*group_cols).agg(
        F.sum("__wp").alias("__zp"), side("__wp").alias("__sp"),
        F.sum("__wf").alias("__zf"), side("__wf").alias("__sf"))
    pooled = lambda v, z: F.transform(vector_to_array(v), lambda e: e / (F.col(z) + F.lit(epsilon)))
    return sums.select(*group_cols, concat_vectors(pooled("__sp", "__zp"), pooled("__sf", "__zf")).alias(out))


def concat_vectors(*vecs: Column) -> Column:
    return F.concat(*vecs)
