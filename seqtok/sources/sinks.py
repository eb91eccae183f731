"""Sinks and their readers: sentences, vocabulary, frequencies, chunks, metrics.

Everything is Parquet unless the caller asks for CSV interchange; nothing passes
through the driver. Chunks are grouped by split and chunk range, so reading a range of
chunks prunes directories instead of scanning.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqtok.config import Bounds
from seqtok.operators.tokens import split_sentence, to_sentence


_CSV = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "escape": '"',
        "nullValue": "\x01null\x01", "emptyValue": ""}


def write_sentences(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists",
                    pos_col: str = "pos", tokens_col: str = "tokens") -> None:
    """Parquet keeps ``(pos, tokens)``; CSV writes ``(pos, line)`` with the comma-joined
    sentence, quoted. Blanks at the edges and empty sentences come back as they were; a
    token with a line break fails the job (CSV files stay splittable)."""
    if fmt == "parquet":
        df.select(pos_col, tokens_col).write.mode(mode).parquet(path)
    elif fmt == "csv":
        line = to_sentence(F.col(tokens_col))
        broken = F.raise_error(F.lit("a sentence with a line break needs fmt='parquet'")).cast("string")
        df.select(pos_col, F.when(line.rlike("[\\r\\n]"), broken).otherwise(line).alias("line")
                  ).write.mode(mode).options(**_CSV, quoteAll=True).csv(path)
    else:
        raise ValueError(fmt)


def read_sentences(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """``(pos, tokens)`` back from ``write_sentences``."""
    if fmt == "parquet":
        return spark.read.parquet(path)
    lines = spark.read.schema("pos long, line string").options(**_CSV).csv(path)
    return lines.select("pos", split_sentence(F.col("line")).alias("tokens"))


def save_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def save_vocabulary(vocab: DataFrame, path: str, mode: str = "overwrite") -> None:
    """``(token, token_id, freq)`` as Parquet (vocabulary and frequencies in one table)."""
    vocab.select("token", "token_id", "freq").write.mode(mode).parquet(path)


def load_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_vocabulary_version(vocab: DataFrame, root: str) -> int:
    """Write a grown vocabulary below ``root`` as its newest version, beside the older ones; returns the
    version. A version that is there already is never overwritten."""
    version = vocab.agg(F.max("version").alias("v")).first()["v"] or 0
    vocab.select("token", "token_id", "freq", "version").write.mode("errorifexists").parquet(f"{root}/version={version}")
    return version


def load_vocabulary_version(spark: SparkSession, root: str, version: int) -> DataFrame:
    """The vocabulary as of ``version``: tokens of later versions are unknown to it."""
    return spark.read.parquet(f"{root}/version={version}")


def save_bounds(spark: SparkSession, bounds: Mapping[str, Bounds], path: str, mode: str = "overwrite") -> None:
    """The bounds of the bucketized columns, one row each, for later files of the same kind."""
    rows = [(c, b.minimum, b.maximum, b.stddev, b.n_buckets, b.n_rows) for c, b in bounds.items()]
    spark.createDataFrame(rows, "column string, minimum double, maximum double, stddev double, n_buckets long, "
                                "n_rows long").write.mode(mode).parquet(path)


def load_bounds(spark: SparkSession, path: str) -> dict[str, Bounds]:
    """One row per bucketized column."""
    return {r["column"]: Bounds(r["minimum"], r["maximum"], r["stddev"], r["n_buckets"], r["n_rows"])
            for r in spark.read.parquet(path).collect()}


CHUNKS_PER_DIRECTORY = 1000


def write_chunks(df: DataFrame, path: str, mode: str = "overwrite",
                 chunks_per_directory: int = CHUNKS_PER_DIRECTORY) -> None:
    """Indexed windows as Parquet, one directory per split and range of
    ``chunks_per_directory`` chunks. A chunk is dealt to one task and sorted by id there,
    so a directory has at most one file per task that holds some of its chunks, and
    Parquet's row-group statistics find a chunk inside a file."""
    ranged = df.withColumn("chunk_range", F.floor(F.col("chunk_id") / chunks_per_directory).cast("long"))
    (ranged.repartition("split", "chunk_range", "chunk_id")
           .sortWithinPartitions("split", "chunk_range", "chunk_id")
           .write.mode(mode).partitionBy("split", "chunk_range").parquet(path))


def read_chunks(spark: SparkSession, path: str, first: int | None = None, last: int | None = None,
                split: str | None = None,
                chunks_per_directory: int = CHUNKS_PER_DIRECTORY) -> DataFrame:
    """Chunks ``first..last`` (both included; None: open) of a split (None: all). The range
    prunes directories and is pushed into the Parquet scan."""
    df = spark.read.parquet(path)
    if split is not None:
        df = df.where(F.col("split") == split)
    if first is not None:
        df = df.where((F.col("chunk_range") >= first // chunks_per_directory) & (F.col("chunk_id") >= first))
    if last is not None:
        df = df.where((F.col("chunk_range") <= last // chunks_per_directory) & (F.col("chunk_id") <= last))
    return df.drop("chunk_range")


def write_chunk_table(df: DataFrame, table: str, path: str, buckets: int, sort: Sequence[str] = ("row_in_chunk",)) -> None:
    """Chunks as a table bucketed by ``chunk_id`` and sorted in each bucket, the layout for repeated work per
    chunk: batching, windows and aggregates per chunk, and joins of tables of one bucket count on
    ``chunk_id`` (and more columns) read it without an exchange. ``table`` is its name in the
    session's catalogue, ``path`` where the files lie.

    The rows are dealt to the buckets by one exchange here, so a bucket is one file.
    """
    (df.repartition(buckets, "chunk_id").write.mode("overwrite").format("parquet")
       .bucketBy(buckets, "chunk_id").sortBy("chunk_id", *sort).option("path", path).saveAsTable(table))


def read_chunk_table(spark: SparkSession, table: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """Chunks ``first..last`` of a chunk table; the range is pushed into the Parquet scan."""
    df = spark.table(table)
    if first is not None:
        df = df.where(F.col("chunk_id") >= first)
    return df if last is None else df.where(F.col("chunk_id") <= last)


def write_metrics(metrics: DataFrame, path: str, mode: str = "overwrite") -> None:
    metrics.write.mode(mode).parquet(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
