"""The operators applied to the given tables: one query each, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqtok.llm import (
    bpe, conversation_repair, decontaminate, fingerprints, html_extract, language, line_dedup, ngram_join, packing,
    quality, topk, url_filters, vector_codes,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that more than 2 % (5 at least) of the documents
    of its source contain; ``source`` is the host."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return line_dedup.drop_boilerplate(docs, F.col("source"), dropped_col="lines_dropped")


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of every document and of its edited text, with their likeness."""
    return fingerprints.edit_fingerprints(_table(spark, sf_dir, "documents"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class and number of links (Jaccard of word five-grams 0.8 or more)
    of every document."""
    return ngram_join.near_duplicates(_table(spark, sf_dir, "documents"))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page capture against the list entries active at its fetch time.

    Stand-in input: a page's fetch time is a point of January 2024 given by its number;
    every event is a changelog entry that adds (value above 50) or removes the host or the
    first path segment of the page numbered by its user.
    """
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    events = _table(spark, sf_dir, "events")
    captures = pages.withColumn("fetch_time", F.to_timestamp(F.lit("2024-01-01 00:00:00"))
                                + F.make_dt_interval(secs=F.col("page_id") * 104729 % 2592000))
    listed = pages.select(F.col("page_id").alias("user_id"), F.col("url").alias("listed_url"))
    place = F.regexp_extract("listed_url", r"^https?://([^/?#]+)", 1)
    deep = F.regexp_extract("listed_url", r"^https?://([^/?#]+/[^/?#]+)", 1)
    entries = events.join(listed, "user_id").select(
        F.concat(F.lit("list_"), "event_type").alias("list_name"),
        F.when((F.col("event_id") % 2 == 0) & (deep != ""), deep).otherwise(place).alias("pattern"),
        F.when(F.col("value") > F.lit(50.0), F.lit("add")).otherwise(F.lit("remove")).alias("action"),
        F.to_date("ts").alias("entry_date"))
    out = url_filters.filter_urls(captures, entries)
    return out.select("page_id", "url", F.to_date("fetch_time").alias("fetch_date"), "blocked",
                      F.concat_ws(",", "lists").alias("lists"),
                      F.concat_ws(",", "patterns").alias("patterns"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of every document and their decoding, as digests."""
    import public_tokenizers

    return bpe.token_digests(_table(spark, sf_dir, "documents"),
                             public_tokenizers.path("byte_bpe_50k.tiktoken"),
                             public_tokenizers.PATTERN)


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_extract.extract_pages(_table(spark, sf_dir, "pages"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned from the labels that are not held out."""
    return quality.score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the documents that are not held out."""
    return language.identify_documents(_table(spark, sf_dir, "documents"))


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best partners of every 50th embedding among all embeddings."""
    return topk.search_multiples(_table(spark, sf_dir, "embeddings"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length buckets of least padding over all documents and their batches."""
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, least repair cost, audit and digest of every conversation after damage by row number."""
    return conversation_repair.repair_damaged(_table(spark, sf_dir, "conversations"))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside of ten-word runs that a benchmark item has too."""
    return decontaminate.contamination_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code, error and error of its label of every embedding: 4 parts, 256 entries, 4 rounds."""
    return vector_codes.compress(_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_fingerprints": op2_fingerprints,
    "op3_ngram_jaccard": op3_ngram_jaccard,
    "op4_url_filters": op4_url_filters,
    "op5_bpe": op5_bpe,
    "op6_html": op6_html,
    "op7_quality": op7_quality,
    "op8_language": op8_language,
    "op9_topk": op9_topk,
    "op10_packing": op10_packing,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_decontamination": op12_decontamination,
    "op13_vector_codes": op13_vector_codes,
}
