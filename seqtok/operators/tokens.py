"""Tokenize stage: bounds, buckets, tokens, sentences.

All continuous columns get their min/max/stddev in ONE aggregate pass (the reference
runs three collecting actions per column). The bounds are one small row; they are
collected once and enter later expressions as literals, so Catalyst can fold them and
every downstream stage stays a narrow projection.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqtok.config import Bounds, Params, RecordSpec
from seqtok.functions.buckets import bucket_count, bucket_stddev, bucket_unit
from seqtok.functions.text import encode_token, value_text


def as_double(df: DataFrame, column: str) -> Column:
    """The column as double; strings go through ``try_cast`` (bad text -> NULL)."""
    dtype = df.schema[column].dataType
    if isinstance(dtype, T.StringType):
        return F.col(column).try_cast("double")
    return F.col(column).cast("double")


def column_bounds(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """One-row DataFrame: ``<c>_min, <c>_max, <c>_stddev, <c>_n`` for every column, and
    the row count ``__rows`` (same pass). Only finite numbers take part: NaN, infinities and NULL do
    not (infinite values then fall into the end buckets)."""
    columns = list(columns)
    aggs = []
    for c in columns:
        x = as_double(df, c)
        x = F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)
        aggs += [F.min(x).alias(f"{c}_min"), F.max(x).alias(f"{c}_max"),
                 F.stddev_samp(x).alias(f"{c}_stddev")]
    aggs.append(F.count(F.lit(1)).alias("__rows"))
    row = df.agg(*aggs)
    return row.select(
        "*",
        *[bucket_count(f"{c}_max", f"{c}_min", f"{c}_stddev").alias(f"{c}_n") for c in columns],
    )


def bounds_table(df: DataFrame, columns: Iterable[str], table: str | None = None) -> DataFrame:
    """Bounds in long form: ``(column_name, min_value, max_value, stddev, n_buckets)``."""
    columns = list(columns)
    row = column_bounds(df, columns)
    name = (lambda c: f"{table}.{c}") if table else (lambda c: c)
    items = [
        F.struct(
            F.lit(name(c)).alias("column_name"),
            F.col(f"{c}_min").alias("min_value"),
            F.col(f"{c}_max").alias("max_value"),
            F.col(f"{c}_stddev").alias("stddev"),
            F.col(f"{c}_n").alias("n_buckets"),
        )
        for c in columns
    ]
    return row.select(F.inline(F.array(*items)))


def collect_bounds(df: DataFrame, columns: Iterable[str]) -> dict[str, Bounds]:
    """One action over ``df``; returns the bounds of every column."""
    columns = list(columns)
    if not columns:
        return {}
    row = column_bounds(df, columns).first()
    return {
        c: Bounds(row[f"{c}_min"], row[f"{c}_max"], row[f"{c}_stddev"], int(row[f"{c}_n"]),
                  int(row["__rows"]))
        for c in columns
    }


def bucket_expr(x: Column, bounds: Bounds, params: Params) -> Column:
    """Bucket index of ``x`` under ``params.bucket_width``."""
    if params.bucket_width == "unit":
        return bucket_unit(x, bounds.n_buckets, params.on_nan)
    if params.bucket_width == "stddev":
        return bucket_stddev(x, bounds.minimum, bounds.stddev, bounds.n_buckets, params.on_nan)
    raise ValueError(f"unknown bucket_width {params.bucket_width!r}")


def bucketize(df: DataFrame, column: str, bounds: Bounds, params: Params,
              out: str | None = None) -> DataFrame:
    """Add ``<column>_bucketized`` (int) to ``df``; ``on_nan='skip'`` drops the rows whose
    value is NaN or NULL."""
    out = out or f"{column}_bucketized"
    df = drop_invalid(df, [column]) if params.on_nan == "skip" else df
    return df.withColumn(out, bucket_expr(as_double(df, column), bounds, params))


def drop_invalid(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Rows whose ``columns`` are all numbers (no NULL, no NaN, no unreadable text)."""
    for c in columns:
        x = as_double(df, c)
        df = df.where(x.isNotNull() & ~F.isnan(x))
    return df


def bucket_token_text(b: Column, params: Params) -> Column:
    txt = b.cast("string")
    if params.bucket_text == "double":
        txt = F.concat(txt, F.lit(".0"))
    return F.coalesce(txt, F.lit("None"))


def token_columns(df: DataFrame, spec: RecordSpec, bounds: Mapping[str, Bounds],
                  params: Params) -> list[Column]:
    """One token expression per feature, then the answer token (if any).

    Bucketized columns are read as doubles (as the reference casts them in place), so
    a bucketized column used as a ``text`` token prints like ``5450.0``.
    """
    bucketed = set(spec.bucket_columns)
    cols: list[Column] = []
    for f in spec.features:
        if f.kind == "bucket":
            b = bucket_expr(as_double(df, f.column), bounds[f.column], params)
            cols.append(F.concat(bucket_token_text(b, params), F.lit(f.token_suffix)))
        elif f.column in bucketed:
            txt = value_text(as_double(df, f.column), T.DoubleType())
            cols.append(F.concat(txt, F.lit(f.token_suffix)))
        else:
            cols.append(encode_token(df, f.column, f.token_suffix))
    if spec.answer:
        cols.append(value_text(F.col(spec.answer), df.schema[spec.answer].dataType))
    return cols


def tokenize_records(df: DataFrame, spec: RecordSpec, bounds: Mapping[str, Bounds],
                     params: Params, keep: Iterable[str] = ()) -> DataFrame:
    """``keep`` columns + ``tokens array<string>`` (features then answer) + ``answer``.

    One projection; the answer string is kept as its own column for labelling.
    """
    keep = list(keep)
    if params.on_nan == "skip":
        df = drop_invalid(df, spec.bucket_columns)
    toks = token_columns(df, spec, bounds, params)
    extra = [F.col(spec.answer).cast("string").alias("answer")] if spec.answer else []
    return df.select(*keep, F.array(*toks).alias("tokens"), *extra)


def to_sentence(tokens: Column) -> Column:
    """Comma-joined sentence (the sink form)."""
    return F.concat_ws(",", tokens)


def split_sentence(line: Column) -> Column:
    """Sentence back to tokens; keeps empty tokens."""
    return F.split(line, ",", -1)


def explode_tokens(df: DataFrame, pos_col: str = "pos", tokens_col: str = "tokens",
                   include_answer: bool = True, n_tokens: int | None = None, counted: bool = False) -> DataFrame:
    """``(pos, token_pos, token)``; drops the answer token when asked. ``counted``: ``(token, n)`` instead, every
    token of a batch of records once with its number there, for ``token_frequencies`` of records with many tokens."""
    arr = F.col(tokens_col)
    if not include_answer:
        if n_tokens is None:
            arr = F.slice(arr, 1, F.size(arr) - 1)
        else:
            arr = F.slice(arr, 1, n_tokens - 1)
    if counted:
        return df.select(packed(arr)).mapInArrow(_count_tokens, "token string, n long")
    return df.select(F.col(pos_col), F.posexplode(arr).alias("token_pos", "token"))


# ---------------------------------------------------------------- tokens of a batch of records at once
# An array of texts costs much more on its way to Arrow than one text, so the tokens of a record go there joined.
# Neither byte is part of any UTF-8 text.
BETWEEN, NO_TOKEN = b"\xff", b"\xfe"


def packed(tokens: Column) -> Column:
    """All tokens of an array of texts in one binary, each with ``BETWEEN`` after it; see ``unpacked``. The array is
    named once, so Spark never lays it out."""
    between, none = (F.lit(bytearray(x)).cast("string") for x in (BETWEEN, NO_TOKEN))
    return F.call_function("array_join", F.concat(tokens, F.array(F.lit(""))), between, none).cast("binary").alias("__tokens")


def unpacked(batch: pa.RecordBatch) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray]:
    """The tokens of all records of a batch (binary; ``NO_TOKEN`` for NULL), where those of each record start, and
    their number: behind them is one more element, which is not a token."""
    parts = pc.split_pattern(batch.column("__tokens"), pattern=BETWEEN)
    ends = parts.offsets.to_numpy()
    return parts.values.dictionary_encode(), ends[:-1], np.maximum(np.diff(ends) - 1, 0)


def _count_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tokens, starts, sizes = unpacked(batch)
        codes = tokens.indices.to_numpy()
        behind = (starts + sizes)[batch.column("__tokens").is_valid().to_numpy(zero_copy_only=False)]
        n = np.bincount(codes, minlength=len(tokens.dictionary)) - np.bincount(codes[behind], minlength=len(tokens.dictionary))
        found, n = tokens.dictionary.filter(pa.array(n > 0)), n[n > 0]
        found = pc.if_else(pc.equal(found, pa.scalar(NO_TOKEN)), pa.scalar(None, pa.binary()), found)
        yield pa.RecordBatch.from_arrays([found.cast(pa.string()), pa.array(n, pa.int64())], names=["token", "n"])
