"""Record sequence: global position, history windows, labels, chunks, batches.

Global order without a single-partition window
----------------------------------------------
``global_position`` range-partitions the rows on the *whole* key tuple (so one hot
leading key is spread over many ranges), sorts inside each range and writes the
result once, with each row's range id and in-range index, as a Parquet table in the
shared checkpoint folder. A running sum over the range table (bounded by ``max_ranges``
rows) gives each range its offset. It is the only path, whatever the input size; no
window ever runs over data rows.

History windows with halo chunks
--------------------------------
``sequence_window`` cuts positions into chunks of C >= N-1 rows and copies the last N-1
rows of every chunk into the next one; a plain ``rows between N-1 preceding and
current row`` window per chunk then equals the global window. Overhead (N-1)/C.
Keyed windows take the position over ``(key, order)`` and partition by
``(chunk, key)``, so a key holding a third of all rows is still cut into chunks.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqtok.config import Params
from seqtok.functions.arrays import left_pad
from seqtok.operators.lookup import null_safe
from seqtok.session import materialize

_DEFAULT = Params()


def _sort_orders(order: Sequence) -> list[Column]:
    return [F.col(c).asc_nulls_first() if isinstance(c, str) else c for c in order]


def global_position(df: DataFrame, order: Sequence, out: str = "pos",
                    params: Params = _DEFAULT, n_rows: int | None = None,
                    range_col: str | None = None) -> DataFrame:
    """Add ``out``: the 0-based position of each row in ``order``.

    ``order`` items are column names (ascending) or Column sort expressions
    (``F.desc("freq")``). The order must be total (unique key tuple); ties are
    broken arbitrarily. The rows are range-partitioned into ranges of about
    ``rows_per_range`` rows, ``max_ranges`` at most (Spark samples the bounds; its driver
    sample is bounded), sorted inside each range, and written once to a Parquet table in
    the shared checkpoint folder with their range id and in-range row index. A second job
    reads only the range id: the rows of all earlier ranges are a running sum over that
    range table (at most ``max_ranges`` rows, whatever the input), broadcast back.
    Position = rows of earlier ranges + in-range index. Lineage is cut at the written table.

    ``df`` is evaluated for the range sample and again for the write: position before
    expensive work. ``n_rows``: the row count when the caller already has it (saves one
    job). ``range_col`` keeps the range id under that name.
    """
    keys = _sort_orders(order)
    spark = df.sparkSession
    n = df.count() if n_rows is None else n_rows
    parts = min(params.max_ranges, max(1, math.ceil(n / params.rows_per_range)))
    ranged = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    back = materialize(ranged.select("*", F.spark_partition_id().alias("__p"),
                                     F.monotonically_increasing_id().alias("__m")), "position")
    before = Window.orderBy("__prange").rowsBetween(Window.unboundedPreceding, -1)
    offsets = back.groupBy(F.col("__p").alias("__prange")).agg(F.count(F.lit(1)).alias("__c")).select(
        "__prange", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__poffset"))
    row_in_part = F.col("__m") - F.shiftleft(F.col("__p").cast("long"), 33)
    placed = back.join(F.broadcast(offsets), F.col("__p") == F.col("__prange"), "inner").withColumn(
        out, (F.col("__poffset") + row_in_part).cast("long"))
    if range_col:
        placed = placed.withColumn(range_col, F.col("__p"))
    return placed.drop("__p", "__m", "__prange", "__poffset")


def rank_within(df: DataFrame, keys: Sequence[str], order: Sequence, out: str = "rank",
                params: Params = _DEFAULT, n_rows: int | None = None) -> DataFrame:
    """0-based rank of each row inside its key group (NULL keys form a group), without a
    per-key window.

    Position over ``(keys, order)`` minus the first position of the key. The first
    positions are looked up by (range, key): a key that fills many ranges has a row in each,
    so a hot key is spread over its ranges in the join.
    """
    keys = list(keys)
    gp = global_position(df, [*keys, *order], "__gpos", params, n_rows, "__range")
    here = gp.groupBy("__range", *keys).agg(F.min("__gpos").alias("__here"))
    first = here.groupBy(*keys).agg(F.min("__here").alias("__first"))
    both = null_safe([(F.col(k), F.col(f"__k_{k}")) for k in keys])
    table = here.drop("__here").join(
        first.select(*[F.col(k).alias(f"__k_{k}") for k in keys], "__first"), both).select(
        F.col("__range").alias("__r"), *[F.col(k).alias(f"__j_{k}") for k in keys], "__first")
    same = null_safe([(F.col(k), F.col(f"__j_{k}")) for k in keys])
    return (gp.join(table, (F.col("__range") == F.col("__r")) & same)
              .withColumn(out, F.col("__gpos") - F.col("__first"))
              .drop("__gpos", "__first", "__range", "__r", *[f"__j_{k}" for k in keys]))


def sequence_windows(df: DataFrame, values: dict, n: int, pos_col: str = "pos",
                     keys: Sequence[str] = (), chunk_rows: int | None = None,
                     params: Params = _DEFAULT) -> DataFrame:
    """Several history windows over the same rows in ONE exchange and one Window.

    ``values`` maps output name -> ``(value column, pad, flatten)``. Each output is the
    last ``n`` values up to and including the row, left-padded with ``pad``.
    ``pos_col`` must be a dense 0-based position (consecutive across keys when ``keys``
    is given: use ``global_position`` over ``(keys, order)``).
    """
    if n < 1:
        raise ValueError("window length must be >= 1")
    halo = n - 1
    c = max(chunk_rows or params.halo_chunk_rows, halo, 1)
    pos = F.col(pos_col)
    chunk = F.floor(pos / c).cast("long")
    in_halo = (pos - chunk * c) >= (c - halo)
    targets = F.when(F.lit(halo > 0) & in_halo, F.array(chunk, chunk + 1)).otherwise(F.array(chunk))
    vals = {out: (F.col(v) if isinstance(v, str) else v) for out, (v, _, _) in values.items()}
    staged = df.select("*", *[v.alias(f"__v_{out}") for out, v in vals.items()],
                       chunk.alias("__c"), F.explode(targets).alias("__w"))
    w = (Window.partitionBy("__w", *keys).orderBy(pos_col)
         .rowsBetween(-halo, Window.currentRow))
    outs = []
    for out, (_, pad, flat) in values.items():
        pad_col = pad if isinstance(pad, Column) else F.lit(pad)
        # collected in a struct: collect_list leaves out NULLs, which are values here
        kept = F.transform(F.collect_list(F.struct(F.col(f"__v_{out}").alias("v"))).over(w), lambda x: x["v"])
        hist = left_pad(kept, n, pad_col)
        outs.append((F.flatten(hist) if flat else hist).alias(out))
    return (staged.select("*", *outs)
                  .where(F.col("__w") == F.col("__c"))
                  .drop("__c", "__w", *[f"__v_{out}" for out in values]))


def sequence_window(df: DataFrame, value: str | Column, n: int, pad, pos_col: str = "pos",
                    keys: Sequence[str] = (), out: str = "window", chunk_rows: int | None = None,
                    flatten: bool = False, params: Params = _DEFAULT) -> DataFrame:
    """History of the last ``n`` values up to and including each row, left-padded.

    ``pad`` is a Python value or a Column of the element type. See ``sequence_windows``.
    """
    return sequence_windows(df, {out: (value, pad, flatten)}, n, pos_col, keys, chunk_rows, params)


def binary_label(answer: Column, params: Params = _DEFAULT) -> Column:
    """0 for normal answers, 1 otherwise (or 1 for ``attack_values`` when given)."""
    if params.attack_values is not None:
        return F.when(answer.isin(*params.attack_values), 1).otherwise(0).cast("int")
    return F.when(answer.isin(*params.normal_values), 0).otherwise(1).cast("int")


def label_window(df: DataFrame, label: str, n: int, pos_col: str = "pos",
                 keys: Sequence[str] = (), out: str = "labels",
                 params: Params = _DEFAULT) -> DataFrame:
    """Window of the last ``n`` labels, left-padded with 0."""
    return sequence_window(df, label, n, 0, pos_col, keys, out, params=params)


def assign_chunk(df: DataFrame, rows_per_chunk: int, pos_col: str = "pos",
                 out: str = "chunk_id") -> DataFrame:
    """Chunk number ``pos div rows_per_chunk`` and ``row_in_chunk``."""
    pos = F.col(pos_col)
    chunk = F.floor(pos / rows_per_chunk).cast("long")
    return df.withColumn(out, chunk).withColumn("row_in_chunk", pos - chunk * rows_per_chunk)


def assign_chunk_by_key(df: DataFrame, rows_per_chunk: int, keys: Sequence[str],
                        order: Sequence, out: str = "chunk_id",
                        params: Params = _DEFAULT, n_rows: int | None = None) -> DataFrame:
    """Chunks that also end where the key ends (e.g. at every input file): rows are
    ranked inside their key, cut every ``rows_per_chunk`` rows, and the
    ``(key, chunk in key)`` pairs get dense ids in key order. Adds ``row_in_chunk``.

    The id table has one row per chunk; it is joined back on ``(key, chunk in key)``, so a
    hot key is spread over its chunks (AQE broadcasts the table when it is small).
    """
    keys = list(keys)
    ranked = rank_within(df, keys, order, "__rk", params, n_rows)
    staged = ranked.withColumn("__ck", F.floor(F.col("__rk") / rows_per_chunk).cast("long"))
    chunks = staged.select(*keys, "__ck").distinct()
    ids = global_position(chunks, [*keys, "__ck"], out, params)
    ids = ids.select(*[F.col(k).alias(f"__c_{k}") for k in keys], F.col("__ck").alias("__cc"), out)
    same = null_safe([(F.col(k), F.col(f"__c_{k}")) for k in keys])
    return (staged.join(ids, (F.col("__ck") == F.col("__cc")) & same, "inner")
                  .withColumn("row_in_chunk", F.col("__rk") - F.col("__ck") * rows_per_chunk)
                  .drop("__rk", "__ck", "__cc", *[f"__c_{k}" for k in keys]))


def assign_batch(df: DataFrame, batch_size: int, row_col: str = "row_in_chunk",
                 out: str = "batch_id") -> DataFrame:
    """Batch number inside a chunk; the last batch of a chunk may be short."""
    return df.withColumn(out, F.floor(F.col(row_col) / batch_size).cast("long"))


def split_name(chunk: Column, params: Params = _DEFAULT) -> Column:
    """'train' for the first ``train_chunks`` chunks, then 'validation', then 'test'."""
    t, v = params.train_chunks, params.validation_chunks
    return (F.when(chunk < t, F.lit("train"))
             .when(chunk < t + v, F.lit("validation"))
             .otherwise(F.lit("test")))


def train_validation_split(df: DataFrame, chunk_col: str = "chunk_id",
                           params: Params = _DEFAULT) -> tuple[DataFrame, DataFrame]:
    """Filter on chunk ranges (pushes into ``partitionBy('chunk_id')`` layouts)."""
    t, v = params.train_chunks, params.validation_chunks
    c = F.col(chunk_col)
    return df.where(c < t), df.where((c >= t) & (c < t + v))
