"""Learning and scoring with Spark ML.

The classifier sees a history window as a bag of (step, token id) terms, each one
number ``token_id * n_steps + step``, hashed into a sparse vector (``HashingTF``), and a class-weighted ``LogisticRegression``
(``weightCol``) is fitted on it; both are distributed Spark ML stages. Candidate
models (the reference's per-epoch checkpoints) are a small parameter grid scored into
one table keyed by ``model_id``. Token vectors are sums of seeded sign vectors over contexts.
"""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqtok.config import Params

_DEFAULT = Params()


def class_weight(label: Column, params: Params = _DEFAULT) -> Column:
    """Per-row sample weight from ``params.class_weight`` (literal map lookup)."""
    pairs = []
    for k, v in params.class_weight:
        pairs += [F.lit(int(k)), F.lit(float(v))]
    return F.element_at(F.create_map(*pairs), label)


def window_terms(ids: Column, fields_per_step: int, n_steps: int) -> Column:
    """One numeric term per element of a flat window array: ``token_id * n_steps + step``
    (unique per (step, token) pair; no string is built per element)."""
    return F.transform(
        ids,
        lambda x, i: x.cast("long") * n_steps + F.floor(i / fields_per_step).cast("long"),
    )


def classifier_pipeline(num_features: int = 1 << 18, max_iter: int = 20,
                        reg_param: float = 0.0, terms_col: str = "terms",
                        label_col: str = "label", weight_col: str = "weight") -> Pipeline:
    tf = HashingTF(inputCol=terms_col, outputCol="features", numFeatures=num_features)
    lr = LogisticRegression(featuresCol="features", labelCol=label_col, weightCol=weight_col,
                            maxIter=max_iter, regParam=reg_param)
    return Pipeline(stages=[tf, lr])


def fit_window_classifier(train: DataFrame, num_features: int = 1 << 18, max_iter: int = 20,
                          reg_param: float = 0.0, terms_col: str = "terms",
                          label_col: str = "label", weight_col: str = "weight") -> PipelineModel:
    """Fit HashingTF + weighted LogisticRegression on ``(terms, label, weight)``."""
    data = train.select(terms_col, F.col(label_col).cast("double").alias(label_col), weight_col)
    return classifier_pipeline(num_features, max_iter, reg_param, terms_col, label_col,
                               weight_col).fit(data)


def score_windows(model: PipelineModel, df: DataFrame, model_id: str,
                  keep: Sequence[str] = ("pos", "label")) -> DataFrame:
    """``(model_id, keep..., score)``: score = probability of the last class."""
    scored = model.transform(df)
    return scored.select(
        F.lit(model_id).alias("model_id"), *keep,
        F.element_at(vector_to_array("probability"), -1).alias("score"),
    )


def fit_candidates(train: DataFrame, grid: Sequence[tuple[str, int, float]],
                   **kw) -> dict[str, PipelineModel]:
    """One model per ``(model_id, max_iter, reg_param)`` of a small fixed grid."""
    return {mid: fit_window_classifier(train, max_iter=it, reg_param=reg, **kw)
            for mid, it, reg in grid}


def save_models(spark: SparkSession, models: dict[str, PipelineModel], root: str) -> DataFrame:
    """Write every model under ``root/<model_id>`` and an index table ``root/_index``."""
    rows = []
    for mid, model in models.items():
        path = os.path.join(root, mid)
        model.write().overwrite().save(path)
        rows.append((mid, path))
    index = spark.createDataFrame(rows, "model_id string, path string")
    index.write.mode("overwrite").parquet(os.path.join(root, "_index"))
    return index


def load_models(spark: SparkSession, root: str) -> dict[str, PipelineModel]:
    index = spark.read.parquet(os.path.join(root, "_index")).collect()  # one row per model
    return {r["model_id"]: PipelineModel.load(r["path"]) for r in index}


def context_pairs(sentences: DataFrame, tokens_col: str = "tokens", window_size: int = 5) -> DataFrame:
    """``(token, __c, __n)``: how often two tokens of a sentence are at most ``window_size`` places apart."""
    arr = F.col(tokens_col)
    at = sentences.select(arr.alias("__t"), F.posexplode(arr).alias("__i", "token"))
    near = F.concat(
        F.slice("__t", F.greatest(F.col("__i") + 1 - window_size, F.lit(1)), F.least("__i", F.lit(window_size))),
        F.slice("__t", F.col("__i") + 2, F.lit(window_size)))
    return (at.where(F.col("token").isNotNull()).select("token", F.explode(near).alias("__c"))
              .where(F.col("__c").isNotNull()).groupBy("token", "__c").agg(F.count(F.lit(1)).alias("__n")))


def context_vectors(sentences: DataFrame, tokens_col: str = "tokens", dim: int = 40,
                    window_size: int = 5) -> DataFrame:
    """``(token, vector array<long>)``: per token the sum of the sign vectors of the tokens
    at most ``window_size`` places from it, over all sentences (random indexing).

    The sign vector of a token is fixed by md5: element d is +1 where hex digit ``d mod 32`` of
    ``md5('<d div 32>/<token>')`` is 8 or more, else -1. Pairs are counted first (a partial
    aggregate, so a hot pair costs one row per task), then weighted and summed per
    token; no vocabulary or weights are held anywhere. Tokens that share contexts get similar
    vectors. NULL tokens take no part; a token that never has a neighbour has no row.
    """
    pairs = context_pairs(sentences, tokens_col, window_size)
    digests = pairs.select("token", "__n", *[
        F.md5(F.concat(F.lit(f"{b}/"), F.col("__c"))).alias(f"__d{b}") for b in range((dim + 31) // 32)])

    def signed(d: int) -> Column:
        up = F.substring(F.col(f"__d{d // 32}"), d % 32 + 1, 1) >= "8"
        return F.sum(F.when(up, F.col("__n")).otherwise(-F.col("__n"))).alias(f"__v{d}")

    sums = digests.groupBy("token").agg(*[signed(d) for d in range(dim)])
    return sums.select("token", F.array(*[F.col(f"__v{d}") for d in range(dim)]).alias("vector"))


def vectors_by_id(word_vectors: DataFrame, vocab: DataFrame) -> DataFrame:
    """Attach vocabulary ids: ``(token_id, vector)`` for J3."""
    return word_vectors.join(vocab.select("token", "token_id"), "token", "inner").select(
        "token_id", "vector")
