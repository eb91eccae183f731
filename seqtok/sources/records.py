"""Record sources: comma-separated text with a fixed schema.

Lines are split on ``,`` with no quoting (quotes are literal characters) and empty
fields stay ``''``: this is not what ``spark.read.csv`` does (it honours quotes, turns
empty fields into NULL and null-fills short rows), so the text reader plus ``split``
is used. A line with the wrong number of fields fails the job (``on_bad='fail'``) or
is flagged in ``_corrupt`` (``'quarantine'``).

Record order is file, then line: ``(_file, _block, _row)`` where ``_block`` is the
split's start offset and ``_row`` increases with the line inside a split. Feed these
to ``global_position`` for a dense record sequence.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqtok.config import KDD_COLUMNS

ORDER_COLUMNS = ("_file", "_block", "_row")


def split_line(line: Column) -> Column:
    return F.split(line, ",", -1)


def parse_records(lines: DataFrame, columns: Sequence[str] = KDD_COLUMNS,
                  value_col: str = "value", on_bad: str = "fail",
                  keep: Sequence[str] = ()) -> DataFrame:
    """Apply a fixed all-string schema to comma-separated lines."""
    columns = list(columns)
    n = len(columns)
    parts = split_line(F.col(value_col))
    size = F.size("__parts")
    if on_bad == "fail":
        # made by a generator, so that the filter stays above it: moved below, it would make and split every line twice
        staged = lines.select(*keep, F.explode(F.array(parts)).alias("__parts"))
        # a filter: unlike a guard in the fields it is never pruned away (e.g. by count)
        wrong = F.raise_error(F.concat(
            F.lit(f"record has wrong number of fields (expected {n}): "), size.cast("string")))
        checked = staged.where(F.when(size == n, F.lit(True)).otherwise(wrong.cast("boolean")))
        return checked.select(*keep, *[F.col("__parts")[i].alias(c) for i, c in enumerate(columns)])
    if on_bad == "quarantine":
        staged = lines.select(*keep, parts.alias("__parts"))
        fields = [F.when(size == n, F.col("__parts")[i]).alias(c) for i, c in enumerate(columns)]
        return staged.select(*keep, *fields, (size != n).alias("_corrupt"))
    raise ValueError("on_bad must be 'fail' or 'quarantine'")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines with their order columns ``_file, _block, _row``."""
    raw = spark.read.text(path)
    return raw.select(
        "value",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_row"),
    )


def read_records(spark: SparkSession, path: str, columns: Sequence[str] = KDD_COLUMNS,
                 on_bad: str = "fail") -> DataFrame:
    """Records with the fixed schema plus the order columns."""
    return parse_records(read_lines(spark, path), columns, "value", on_bad, ORDER_COLUMNS)


def rows_per_file(df: DataFrame) -> DataFrame:
    """``(file_path, n_rows)`` for a file-based DataFrame (uses hidden ``_metadata``)."""
    return df.groupBy(F.col("_metadata.file_path").alias("file_path")).agg(
        F.count(F.lit(1)).alias("n_rows"))
