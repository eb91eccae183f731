"""Corpus pipeline over ``documents``: filter, clean, deduplicate, pack.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; it works on all rows of
its predecessor. All but the last return the columns of ``documents``; the last returns the packing
of the documents that stayed. Models are learned from the stage's own input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqtok.llm import language, line_dedup, ngram_join, packing, quality
from seqtok.session import ensure_checkpoint_dir, materialize, ship_package

MAX_BITS_PER_SYMBOL = 8.0      # a text unlike every learned language needs more


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least the classifier's cut."""
    ship_package(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.learn_quality(docs, labels)
    scored = quality.with_quality(docs, model, out="__quality")
    return scored.where(F.col("__quality") >= quality.REJECT_BELOW).drop("__quality")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language: not those without letters, nor those whose best parse
    needs more than MAX_BITS_PER_SYMBOL bits per symbol."""
    ship_package(spark)
    parser = language.learn_languages(spark, docs)
    if not parser.value.names:      # nothing to tell apart
        return docs
    named = language.with_language(docs, parser, lang_out="__lang", score_out="__score", bits_out="__bits")
    return named.where((F.col("__lang") != language.UNDETERMINED)
                       & (F.col("__bits") <= MAX_BITS_PER_SYMBOL)).drop("__lang", "__score", "__bits")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the boilerplate lines of their source. Copies count as one text
    and no document is emptied, so that the next stage sees all copies with their text."""
    out = line_dedup.drop_boilerplate(docs, F.col("source"), by_text=True)
    if "n_chars" in out.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, told apart by row and not by id."""
    ship_package(spark)
    return ngram_join.keep_one_row_of_each(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Length bucket, batch and slot of every document that stayed."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_classifier", quality_stage),
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("ngram_jaccard_join", near_duplicate_stage),
    ("packing", packing_stage),
]

# learned models and near-duplicate components: not expressible in SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over ``documents``; each result is written and read again."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
