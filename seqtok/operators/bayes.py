"""Class-weighted, smoothed naive Bayes over window terms, by aggregates and joins only.

Fitting is one ``groupBy`` over (term, class) with weighted counts; a candidate model is a
smoothing constant ``alpha`` over the same counts. Scoring looks each term's counts up, sums the
log odds per window and turns them into a probability. The model is two tables: one row per
term, and one row of totals; saving and loading are Parquet writes and reads. Nothing
but the totals row reaches the driver.

Rows: a window without terms (empty or NULL array) scores the class prior; NULL terms
and terms never seen in training count with zero occurrences; training rows with a NULL
label or weight teach nothing; a class never seen keeps the mass of ``alpha``.
"""

from __future__ import annotations

import os
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqtok.config import Params
from seqtok.operators.lookup import fits_broadcast, lookup_column
from seqtok.session import materialize

_DEFAULT = Params()


@dataclass
class BayesModel:
    """``terms (term, w0, w1)``, ``totals (p0, p1, w0, w1, n_terms)``, and the
    smoothing constant of each candidate."""

    terms: DataFrame
    totals: DataFrame
    alphas: Mapping[str, float]


def step_terms(window: Column, fields_per_step: int) -> Column:
    """``step|value`` for every element of a flat window array."""
    return F.transform(window, lambda x, i: F.concat_ws(
        "|", F.floor(i / fields_per_step).cast("string"), x.cast("string")))


def fit_bayes(train: DataFrame, alphas: Mapping[str, float], terms_col: str = "terms",
              label_col: str = "label", weight_col: str = "weight") -> BayesModel:
    """Fit on ``(terms array, label 0/1, weight)``."""
    rows = train.select(F.col(terms_col).alias("terms"), F.col(label_col).cast("int").alias("y"),
                        F.col(weight_col).cast("double").alias("w")).where("y is not null and w is not null")

    def of_class(k: int) -> Column:
        return F.coalesce(F.sum(F.when(F.col("y") == k, F.col("w"))), F.lit(0.0))

    counted = rows.select("y", "w", F.explode("terms").alias("term")).where(F.col("term").isNotNull())
    terms = materialize(counted.groupBy("term").agg(of_class(0).alias("w0"), of_class(1).alias("w1")),
                        "bayes-terms")
    prior = rows.agg(of_class(0).alias("p0"), of_class(1).alias("p1")).first()
    mass = terms.agg(F.coalesce(F.sum("w0"), F.lit(0.0)).alias("w0"),
                     F.coalesce(F.sum("w1"), F.lit(0.0)).alias("w1"),
                     F.count(F.lit(1)).alias("n_terms")).first()
    totals = train.sparkSession.createDataFrame(
        [(prior["p0"], prior["p1"], mass["w0"], mass["w1"], mass["n_terms"])],
        "p0 double, p1 double, w0 double, w1 double, n_terms long")
    return BayesModel(terms, totals, dict(alphas))


def score_bayes(model: BayesModel, windows: DataFrame, keep: Sequence[str], terms_col: str = "terms",
                params: Params = _DEFAULT) -> DataFrame:
    """``(model_id, keep..., score)``: probability of class 1 under every candidate.
    ``keep`` identifies a window (its columns are grouped on)."""
    t = model.totals.first()     # one row
    table = model.terms.select("term", F.struct("w0", "w1").alias("w"))
    exploded = windows.select(*keep, F.explode_outer(terms_col).alias("term"))
    found = lookup_column(exploded, F.col("term"), table, "term", "w", "w",
                          fits_broadcast(table, params), [*keep, "term"], params)

    def log_odds(alpha: float) -> Column:
        part = lambda k: (F.coalesce(F.col(f"w.w{k}"), F.lit(0.0)) + F.lit(alpha)) / F.lit(
            t[f"w{k}"] + alpha * (t["n_terms"] + 1))
        return F.when(F.col("term").isNotNull(), F.log(part(1)) - F.log(part(0))).otherwise(F.lit(0.0))

    names = sorted(model.alphas)
    sums = found.groupBy(*keep).agg(*[F.sum(log_odds(model.alphas[m])).alias(f"z{i}")
                                      for i, m in enumerate(names)])
    scored = []
    for i, m in enumerate(names):
        a = model.alphas[m]
        z = F.col(f"z{i}") + F.log(F.lit((t["p1"] + a) / (t["p0"] + a)))
        scored.append(F.struct(F.lit(m).alias("model_id"), (1 / (1 + F.exp(-z))).alias("score")))
    return sums.select(*keep, F.inline(F.array(*scored))).select("model_id", *keep, "score")


def save_bayes(model: BayesModel, root: str, mode: str = "overwrite") -> None:
    """Write the terms, the totals and the candidates below ``root``."""
    spark = model.terms.sparkSession
    model.terms.write.mode(mode).parquet(os.path.join(root, "terms"))
    model.totals.write.mode(mode).parquet(os.path.join(root, "totals"))
    spark.createDataFrame(sorted(model.alphas.items()), "model_id string, alpha double").write.mode(
        mode).parquet(os.path.join(root, "candidates"))


def load_bayes(spark: SparkSession, root: str) -> BayesModel:
    rows = spark.read.parquet(os.path.join(root, "candidates")).collect()   # one row per candidate
    return BayesModel(spark.read.parquet(os.path.join(root, "terms")),
                      spark.read.parquet(os.path.join(root, "totals")),
                      {r["model_id"]: r["alpha"] for r in rows})
