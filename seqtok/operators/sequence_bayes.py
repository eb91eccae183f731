"""Naive Bayes over history windows, computed along the sequence instead of from windows.

The window at position p holds the tokens of the records at p, p-1, .., p-n+1. A term is (lag, token), so
both fitting and scoring come apart by lag and no window is ever built or exploded:

* Fitting counts a record's tokens once per lag, weighted by the label of the record ``lag`` places
  later: one row per token of a record, with n weights each, pre-aggregated by token.
* Scoring gives every record, from one lookup per token, its n partial log odds (one per lag). The log
  odds of p are the sum over the lags of the partial sum of the record at p-lag.

Both read neighbours inside the ranges of ``ranges.ranged_rows``. What crosses the border of a range comes from the
n-1 rows beside it, as a table with at most n-1 rows per range. Before the first record lie ``fields``
pad tokens per step. The result equals ``bayes.fit_bayes`` / ``score_bayes`` on the windows' terms.

Rows: NULL tokens count nowhere; tokens never seen in training count with zero occurrences; training rows
with a NULL label, weight or train flag teach nothing, but their tokens are in the windows of later records.
"""

from __future__ import annotations

import math
import os
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqtok.config import Params
from seqtok.operators.lookup import fits_broadcast, lookup_positions
from seqtok.operators.ranges import Ranged
from seqtok.session import materialize

_DEFAULT = Params()


@dataclass
class SequenceModel:
    """``tokens (token, w0, w1, seen)``: weighted class counts and training windows of a token, per lag; a
    NULL token is the pad. ``totals (p0, p1, w0, w1, n_terms, steps)``; the smoothing constants."""

    tokens: DataFrame
    totals: DataFrame
    alphas: Mapping[str, float]


def _array(cols: Sequence[Column]) -> Column:
    return F.array(*cols)


def _border_rows(ranged: Ranged, rows: DataFrame, steps: int, first: bool) -> DataFrame:
    """The first (or last) ``steps - 1`` rows of every range, with ``__n`` rows in it."""
    sized = rows.join(F.broadcast(ranged.table()), F.col("__range") == F.col("__r"))
    at = F.col("__at") if first else F.col("__n") - 1 - F.col("__at")
    return sized.where(at < steps - 1)


def _by_position(table: DataFrame, params: Params) -> DataFrame:
    table = materialize(table, "range-borders")
    return F.broadcast(table) if fits_broadcast(table, params) else table


def fit_sequence_bayes(ranged: Ranged, alphas: Mapping[str, float], steps: int, fields: int,
                       tokens_col: str = "tokens", label_col: str = "label", weight_col: str = "weight",
                       train_col: str = "train", pos_col: str = "pos", params: Params = _DEFAULT) -> SequenceModel:
    """Fit on ordered records ``(pos, tokens array, label 0/1, weight, train boolean)``."""
    y, w = F.col(label_col).cast("int"), F.col(weight_col).cast("double")
    live = F.coalesce(F.col(train_col).cast("boolean"), F.lit(False)) & y.isNotNull() & w.isNotNull()
    g = F.struct(*[F.when(live & (y == k), w).otherwise(0.0).alias(f"g{k}") for k in (0, 1)],
                 live.cast("double").alias("c"))
    rows = ranged.rows.select("__range", "__at", F.col(pos_col).alias("__pos"), F.col(tokens_col).alias("__t"), g.alias("__g"))
    names = ("g0", "g1", "c")
    # weights of the windows that begin behind the border and reach back over it
    heads = _border_rows(ranged, rows, steps, True).select(
        F.explode(F.sequence(F.col("__at") + 1, F.lit(steps - 1).cast("long"))).alias("__lag"), "__pos", "__g").where(
        F.col("__pos") >= F.col("__lag")) if steps > 1 else None
    ahead = Window.partitionBy("__range").orderBy("__at")
    lead = [F.col("__g") if k == 0 else F.lead("__g", k).over(ahead) for k in range(steps)]
    found = rows.select("*", *[x.alias(f"__l{k}") for k, x in enumerate(lead)])
    if heads is not None and len(ranged.sizes) > 1:
        cross = heads.groupBy((F.col("__pos") - F.col("__lag")).alias("__q")).agg(*[
            F.max(F.when(F.col("__lag") == k, F.col("__g"))).alias(f"__x{k}") for k in range(1, steps)])
        found = found.join(_by_position(cross, params), F.col("__pos") == F.col("__q"), "left").select(
            "__t", "__l0", *[F.coalesce(f"__l{k}", f"__x{k}").alias(f"__l{k}") for k in range(1, steps)])
    value = {(x, k): F.coalesce(F.col(f"__l{k}.{x}"), F.lit(0.0)).alias(f"{x}_{k}") for x in names for k in range(steps)}
    exploded = found.select(F.explode("__t").alias("token"), *value.values()).where(F.col("token").isNotNull())
    sums = exploded.groupBy("token").agg(*[F.sum(f"{x}_{k}").alias(f"{x}_{k}") for x, k in value])
    out = {"g0": "w0", "g1": "w1", "c": "seen"}
    table = sums.select("token", *[_array([F.col(f"{x}_{k}") for k in range(steps)]).alias(o) for x, o in out.items()])
    table = materialize(table.where(F.exists("seen", lambda c: c > 0)).unionByName(
        _pad_row(rows, steps, fields, sums.schema["token"].dataType.simpleString())), "sequence-bayes")
    prior = rows.agg(*[F.coalesce(F.sum(f"__g.g{k}"), F.lit(0.0)).alias(f"p{k}") for k in (0, 1)]).first()
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    mass = table.agg(*[F.coalesce(F.sum(total(f"w{k}")), F.lit(0.0)).alias(f"w{k}") for k in (0, 1)],
                     F.coalesce(F.sum(F.size(F.filter("seen", lambda c: c > 0))), F.lit(0)).alias("n_terms")).first()
    totals = ranged.rows.sparkSession.createDataFrame(
        [(prior["p0"], prior["p1"], mass["w0"], mass["w1"], mass["n_terms"], steps)],
        "p0 double, p1 double, w0 double, w1 double, n_terms long, steps int")
    return SequenceModel(table, totals, dict(alphas))


def _pad_row(rows: DataFrame, steps: int, fields: int, token_type: str) -> DataFrame:
    """Counts of the pad per lag: the first ``steps - 1`` records see it."""
    first = {r["__pos"]: r["__g"] for r in rows.where(F.col("__pos") < steps - 1).select("__pos", "__g").collect()}
    sums = [[float(fields) * sum(g[x] for p, g in first.items() if p < k) for k in range(steps)] for x in ("g0", "g1", "c")]
    return rows.sparkSession.createDataFrame(
        [(None, *sums)], f"token {token_type}, w0 array<double>, w1 array<double>, seen array<double>")


def _log_odds(t, alphas: Sequence[float]):
    """Elements ``alpha * steps + lag`` of a token from its count arrays (columns or lists)."""
    def of(a: float, w0: Column, w1: Column) -> Column:
        def side(w: Column, k: int) -> Column:
            return F.log((w + F.lit(a)) / F.lit(t[f"w{k}"] + a * (t["n_terms"] + 1)))

        return F.zip_with(w1, w0, lambda u, v: side(u, 1) - side(v, 0))

    def column(w0: Column, w1: Column) -> Column:
        return F.concat(*[of(a, w0, w1) for a in alphas])

    def plain(w0: Sequence[float], w1: Sequence[float]) -> list[float]:
        return [math.log((u + a) / (t["w1"] + a * (t["n_terms"] + 1))) - math.log((v + a) / (t["w0"] + a * (t["n_terms"] + 1)))
                for a in alphas for u, v in zip(w1, w0)]

    return column, plain


def score_sequence_bayes(model: SequenceModel, ranged: Ranged, keep: Sequence[str], fields: int,
                         tokens_col: str = "tokens", pos_col: str = "pos", params: Params = _DEFAULT) -> DataFrame:
    """``(model_id, keep..., score)``: probability of class 1 of every record's window under every
    candidate. ``fields`` tokens per record."""
    t = model.totals.first()     # one row
    steps, names = t["steps"], sorted(model.alphas)
    alphas = [model.alphas[m] for m in names]
    column, plain = _log_odds(t, alphas)
    width = steps * len(alphas)
    table = model.tokens.where(F.col("token").isNotNull()).select("token", column(F.col("w0"), F.col("w1")).alias("z"))
    pad = model.tokens.where(F.col("token").isNull()).first()                     # one row
    pad_odds = [fields * x for x in plain(pad["w0"], pad["w1"])]
    unseen = F.array(*[F.lit(x) for x in plain([0.0] * steps, [0.0] * steps)])
    rows = ranged.rows.select("__range", "__at", F.col(pos_col).alias("__pos"), *keep, F.col(tokens_col).alias("__t"))
    parts = _partial_odds(rows, table, fields, unseen, width, params)
    z = _along(ranged, parts, keep, steps, len(alphas), params)
    # windows that begin before the first record
    scored = []
    for i, (m, a) in enumerate(zip(names, alphas)):
        missing = [sum(pad_odds[i * steps + k] for k in range(p + 1, steps)) for p in range(steps - 1)]
        early = F.coalesce(F.get(F.array(*[F.lit(x) for x in missing]), F.col("__pos").cast("int")), F.lit(0.0)) \
            if missing else F.lit(0.0)
        odds = F.col(f"__z{i}") + F.when(F.col("__pos") < steps - 1, early).otherwise(0.0) + F.log(
            F.lit((t["p1"] + a) / (t["p0"] + a)))
        scored.append(F.struct(F.lit(m).alias("model_id"), (1 / (1 + F.exp(-odds))).alias("score")))
    return z.select(*keep, F.inline(F.array(*scored))).select("model_id", *keep, "score")


def _partial_odds(rows: DataFrame, table: DataFrame, fields: int, unseen: Column, width: int, params: Params) -> DataFrame:
    """``rows`` with ``__v``: the sum over the record's tokens of their log odds, per candidate and lag."""
    nothing = F.array_repeat(F.lit(0.0), width)
    if fits_broadcast(table, params):
        small = F.broadcast(table.select(F.col("token").alias("__key"), F.col("z").alias("__z")))
        staged = rows.withColumn("__v", nothing)
        for k in range(fields):              # the sums stay one array, whatever the number of fields
            staged = staged.withColumn("__key", F.get("__t", F.lit(k))).join(small, "__key", "left")
            odds = F.when(F.col("__key").isNull(), nothing).otherwise(F.coalesce("__z", unseen))
            staged = staged.withColumn("__v", F.zip_with("__v", odds, lambda a, b: a + b)).drop("__key", "__z")
        return staged
    found = lookup_positions(rows, "__t", fields, table, "token", "z", F.lit(None).cast("array<double>"), "__zs", False, params)
    odds = [F.when(F.get("__t", F.lit(k)).isNull(), nothing).otherwise(F.coalesce(F.get("__zs", F.lit(k)), unseen))
            for k in range(fields)]
    total = nothing
    for o in odds:
        total = F.zip_with(total, o, lambda a, b: a + b)
    return found.withColumn("__v", total).drop("__zs")


def _along(ranged: Ranged, parts: DataFrame, keep: Sequence[str], steps: int, models: int, params: Params) -> DataFrame:
    """``__pos, keep..., __z<i>``: sums over the lags of the partial odds ``lag`` records back."""
    behind = Window.partitionBy("__range").orderBy("__at")
    terms = {(i, k): F.col("__v")[i * steps + k] for i in range(models) for k in range(steps)}
    flat = parts.select("__range", "__at", "__pos", *keep, *[x.alias(f"__v{i}_{k}") for (i, k), x in terms.items()])

    def shifted(i: int, k: int) -> Column:
        return F.col(f"__v{i}_0") if k == 0 else F.lag(f"__v{i}_{k}", k, 0.0).over(behind)

    lagged = flat.select("__range", "__at", "__pos", *keep, *[shifted(i, k).alias(f"__s{i}_{k}") for i, k in terms])
    inside = lagged.select("__pos", *keep, *[
        sum((F.col(f"__s{i}_{k}") for k in range(1, steps)), F.col(f"__s{i}_0")).alias(f"__z{i}") for i in range(models)])
    if steps == 1 or len(ranged.sizes) < 2:
        return inside
    # partial odds that go to records behind the border of their range
    ends = _border_rows(ranged, parts.select("__range", "__at", "__pos", "__v"), steps, False)
    to_come = F.sequence((F.col("__n") - F.col("__at")).cast("int"), F.lit(steps - 1))
    cross = ends.select("__pos", "__v", F.explode(to_come).alias("__lag")).groupBy(
        (F.col("__pos") + F.col("__lag")).alias("__q")).agg(*[
            F.sum(F.get("__v", F.lit(i * steps) + F.col("__lag"))).alias(f"__x{i}") for i in range(models)])
    joined = inside.join(_by_position(cross, params), F.col("__pos") == F.col("__q"), "left")
    return joined.select("__pos", *keep, *[
        (F.col(f"__z{i}") + F.coalesce(F.col(f"__x{i}"), F.lit(0.0))).alias(f"__z{i}") for i in range(models)])


def save_sequence_bayes(model: SequenceModel, root: str, mode: str = "overwrite") -> None:
    """Write the tokens, the totals and the candidates below ``root``."""
    spark = model.tokens.sparkSession
    model.tokens.write.mode(mode).parquet(os.path.join(root, "tokens"))
    model.totals.write.mode(mode).parquet(os.path.join(root, "totals"))
    spark.createDataFrame(sorted(model.alphas.items()), "model_id string, alpha double").write.mode(
        mode).parquet(os.path.join(root, "candidates"))


def load_sequence_bayes(spark: SparkSession, root: str) -> SequenceModel:
    rows = spark.read.parquet(os.path.join(root, "candidates")).collect()   # one row per candidate
    return SequenceModel(spark.read.parquet(os.path.join(root, "tokens")),
                         spark.read.parquet(os.path.join(root, "totals")),
                         {r["model_id"]: r["alpha"] for r in rows})
