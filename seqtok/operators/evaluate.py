"""Evaluation: threshold sweep, F1, losses, model comparison, alignment.

The sweep is ONE aggregate pass: for every threshold t three conditional sums
(tp, fp, fn), all in the same hash aggregate, then ``inline`` turns the one row per
model into one row per threshold. No row x threshold cross join. ``score_curve`` takes every
distinct score as a threshold.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqtok.config import Params
from seqtok.operators.lookup import join_totals
from seqtok.operators.ranges import running_sums
from seqtok.session import materialize

_DEFAULT = Params()


def threshold_flags(score: Column, t: float) -> Column:
    """Prediction at threshold t: strict ``score > t``; 0 for a NaN or NULL score."""
    return predicted(score, t).cast("int")


def predicted(score: Column, t: float) -> Column:
    """``score > t`` as a boolean that is never NULL. Spark orders NaN above all numbers;
    a NaN score is no prediction here, as in NumPy."""
    s = score.cast("double")
    return F.coalesce((s > F.lit(t)) & ~F.isnan(s), F.lit(False))


def _safe_ratio(num: Column, den: Column) -> Column:
    return F.when(den == 0, F.lit(0.0)).otherwise(num.cast("double") / den.cast("double"))


def precision_recall_curve(scores: DataFrame, score_col: str = "score", label_col: str = "label",
                           group_cols: Sequence[str] = (), thresholds: Sequence[float] | None = None,
                           params: Params = _DEFAULT) -> DataFrame:
    """``(group..., threshold, tp, fp, fn, precision, recall, f1)``; ratios are 0 when
    their denominator is 0. A NaN or NULL score is not predicted positive, so
    ``tp + fn`` is the number of positives; rows with a NULL label count nowhere."""
    ths = list(thresholds) if thresholds is not None else params.thresholds()
    s, y = F.col(score_col), F.col(label_col)
    aggs = []
    for i, t in enumerate(ths):
        p = predicted(s, t)
        aggs += [
            F.sum(F.when(p & (y == 1), 1).otherwise(0)).cast("long").alias(f"tp{i}"),
            F.sum(F.when(p & (y != 1), 1).otherwise(0)).cast("long").alias(f"fp{i}"),
            F.sum(F.when(~p & (y == 1), 1).otherwise(0)).cast("long").alias(f"fn{i}"),
        ]
    group_cols = list(group_cols)
    wide = scores.groupBy(*group_cols).agg(*aggs) if group_cols else scores.agg(*aggs)
    rows = F.array(*[
        F.struct(F.lit(float(t)).alias("threshold"), F.col(f"tp{i}").alias("tp"),
                 F.col(f"fp{i}").alias("fp"), F.col(f"fn{i}").alias("fn"))
        for i, t in enumerate(ths)
    ])
    long = wide.select(*group_cols, F.inline(rows))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return long.select(
        *group_cols, "threshold", "tp", "fp", "fn",
        _safe_ratio(tp, tp + fp).alias("precision"),
        _safe_ratio(tp, tp + fn).alias("recall"),
        _safe_ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def compare_models(scores: DataFrame, score_col: str = "score", label_col: str = "label",
                   params: Params = _DEFAULT) -> DataFrame:
    """The sweep for every ``model_id`` of one score table."""
    return precision_recall_curve(scores, score_col, label_col, ["model_id"], params=params)


def model_losses(scores: DataFrame, prob_col: str = "score", label_col: str = "label",
                 group_cols: Sequence[str] = ("model_id",), params: Params = _DEFAULT) -> DataFrame:
    """Per group: binary cross-entropy (= 2-class categorical), class-weighted
    cross-entropy (``loss_weight[y] * -ln p_y``) and binary accuracy (``p > 0.5``).
    Probabilities are clipped to ``[eps, 1-eps]``.

    ``n`` rows have a label; rows with a NULL label count nowhere. ``n_undefined`` of them have a NULL or
    NaN score: such a score has no loss, and is no positive prediction, as in the curves.
    """
    eps = params.epsilon
    s, y = F.col(prob_col).cast("double"), F.col(label_col)
    defined = s.isNotNull() & ~F.isnan(s)
    p = F.when(defined, F.least(F.greatest(s, F.lit(eps)), F.lit(1 - eps)))
    p_true = F.when(y == 1, p).otherwise(1 - p)
    w = F.lit(None).cast("double")
    for cls, wt in enumerate(params.loss_weight):
        w = F.when(y == cls, F.lit(float(wt))).otherwise(w)
    return scores.where(y.isNotNull()).groupBy(*group_cols).agg(
        F.avg(-F.log(p_true)).alias("log_loss"),
        F.avg(-w * F.log(p_true)).alias("weighted_loss"),
        F.avg((predicted(s, 0.5).cast("int") == y).cast("int")).alias("binary_accuracy"),
        F.count(F.lit(1)).alias("n"),
        F.count_if(~defined).alias("n_undefined"),
    )


def best_model(losses: DataFrame, loss_col: str = "log_loss") -> DataFrame:
    """The model with the smallest loss (ties: smallest ``model_id``). A model with undefined scores comes
    after all with fewer of them, one without any loss last."""
    undefined = F.col("n_undefined") if "n_undefined" in losses.columns else F.lit(0)
    rank = F.struct(F.col(loss_col).isNull(), undefined, F.col(loss_col), F.col("model_id"))
    return losses.agg(F.min_by(F.col("model_id"), rank).alias("model_id"), F.min_by(F.col(loss_col), rank).alias(loss_col))


def score_curve(scores: DataFrame, score_col: str = "score", label_col: str = "label",
                group_cols: Sequence[str] = (), params: Params = _DEFAULT) -> DataFrame:
    """The exact curve: ``(group..., threshold, tp, fp, fn, precision, recall, f1)`` with one row per distinct
    score, predicting positive from that score on (``score >= threshold``; equal scores are one step).

    Scores are counted first (partial aggregate), then summed up from the highest by ``ranges.running_sums``,
    so neither a model nor a score is ever one task. NULL and NaN scores are never positive
    but count in ``fn``; rows with a NULL label count nowhere. -0.0 is 0.0.
    """
    groups = list(group_cols)
    s, y = F.col(score_col).cast("double"), F.col(label_col)
    counted = scores.where(y.isNotNull()).groupBy(*groups, F.when(~F.isnan(s), s + F.lit(0.0)).alias("threshold")).agg(
        F.count_if(y == 1).alias("pos"), F.count_if(y != 1).alias("neg"))
    counted = materialize(counted, "score-counts")
    all_pos = counted.groupBy(*groups).agg(F.sum("pos").alias("__all"), F.count(F.lit(1)).alias("__rows"))
    # without groups all_pos is one row
    steps = running_sums(counted.where(F.col("threshold").isNotNull()), [F.desc("threshold")], ["pos", "neg"], groups, params)
    if groups:
        steps = join_totals(steps, all_pos, groups, "__rows", F.xxhash64("threshold"), params)
    else:
        steps = steps.withColumn("__all", F.lit(all_pos.first()["__all"]).cast("long"))
    tp, fp, fn = F.col("cum_pos"), F.col("cum_neg"), F.col("__all") - F.col("cum_pos")
    return steps.select(
        *groups, "threshold", tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), _safe_ratio(tp, tp + fp).alias("precision"),
        _safe_ratio(tp, tp + fn).alias("recall"), _safe_ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), F.col("pos").alias("step_tp"))


def average_precision(curve: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """``(group..., average_precision, best_f1, best_threshold, n_steps)`` of exact curves: precision averaged
    over the positives in the order of their scores (0 without positives); the highest threshold with the best F1."""
    p = F.col("tp") + F.col("fn")
    gain = _safe_ratio(F.col("step_tp"), p) * F.col("precision")
    rank = F.struct("f1", "threshold")
    return curve.groupBy(*group_cols).agg(
        F.sum(gain).alias("average_precision"), F.max("f1").alias("best_f1"),
        F.max_by("threshold", rank).alias("best_threshold"), F.count(F.lit(1)).alias("n_steps"))


def align_scores(predictions: DataFrame, truth: DataFrame, keys: Sequence[str] = ("pos",)) -> DataFrame:
    """Pair predictions with truth by row key; rows present on one side only drop out
    (whichever side is shorter)."""
    return predictions.join(truth, list(keys), "inner")


def align_chunks(predictions: DataFrame, truth: DataFrame, keys: Sequence[str] = ("row_in_chunk",)) -> DataFrame:
    """``align_scores`` chunk by chunk, on ``chunk_id`` and ``keys``. Two chunk tables of one bucket count are
    merged in place: their buckets hold the same chunks, and each bucket is sorted."""
    return predictions.hint("merge").join(truth, ["chunk_id", *keys], "inner")
