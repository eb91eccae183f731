"""Work on an ordered sequence that is stored range by range.

``ranged_rows`` orders a table once: range-partitioned on the whole order tuple, sorted inside each
range, and written as a table bucketed by the range id. What needs neighbouring rows afterwards runs
inside the ranges with no further exchange of records, because Spark knows the bucketing:

* ``range_windows``: history windows. Each range is read in order, a batch at a time, and the windows of a batch are
  cut from its values at once (Arrow). A window that reaches back over the start of its range takes the
  missing rows from the halo, a small table with the last N-1 values before every range.
* ``running_sums``: cumulative sums in order, per group. Each range sums up its own rows; the
  sums of all earlier ranges come from one row per (range, group).

``file_positions`` numbers the rows of text files, which are in order already: the rows before a file
split are a running sum over the splits, so the records are neither sampled nor sorted nor moved.

At most ``Params.max_ranges`` ranges exist, so per-range counts (a few numbers each) may go through
the driver; records never do.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqtok.config import Params
from seqtok.operators.lookup import fits_broadcast, null_safe
from seqtok.operators.sequence import _sort_orders, sequence_windows
from seqtok.session import materialize, materialize_bucketed
from seqtok.sources.records import ORDER_COLUMNS

_DEFAULT = Params()
MIN_RANGE_ROWS = 2_000         # smaller ranges only to reach ``rows_per_range``
RANGES_PER_BUCKET = 4          # a bucket is one task; ranges fall into buckets by hash, so several even it out
BUCKETS_PER_CORE = 4           # and so do several tasks per core
PIECE_ITEMS = 1 << 20          # window elements made at once
RANGE_COLUMNS = ("__range", "__at", "__left")     # of ``Ranged.rows`` with a position


@dataclass(frozen=True)
class Ranged:
    """``rows`` with ``__range`` and ``__at`` (0-based place in the range), bucketed by ``__range``, and, where
    they have a position, ``__left`` (rows from this one to the end of the range); ``sizes``: the rows of every
    non-empty range, in order."""

    rows: DataFrame
    sizes: dict[int, int]

    def over(self, rows: DataFrame) -> Ranged:
        """The same ranges after a projection or broadcast lookup of all rows."""
        return Ranged(rows, self.sizes)

    def table(self) -> DataFrame:
        """``(__r, __before, __n)``: rows of all earlier ranges and of this one."""
        before = accumulate(self.sizes.values(), initial=0)
        return self.rows.sparkSession.createDataFrame(
            [(r, b, n) for (r, n), b in zip(self.sizes.items(), before)], "__r int, __before long, __n long")


def ranged_rows(df: DataFrame, order: Sequence, out: str | None = "pos", params: Params = _DEFAULT,
                n_rows: int | None = None, then: Callable[[DataFrame], DataFrame] | None = None) -> Ranged:
    """Order ``df`` once (see the module). ``out``: also add the global 0-based position.

    ``df`` is evaluated for the range sample and again for the write. ``n_rows``: the row count when the
    caller has it. Ties of the order are broken arbitrarily. ``then``: a projection of the ordered
    rows, evaluated once, for the write.
    """
    keys = _sort_orders(order)
    n = df.count() if n_rows is None else n_rows
    cores = df.sparkSession.sparkContext.defaultParallelism
    parts = min(params.max_ranges, max(1, math.ceil(n / params.rows_per_range),
                                       min(cores * BUCKETS_PER_CORE * RANGES_PER_BUCKET, n // MIN_RANGE_ROWS)))
    ranged = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    ranged = then(ranged) if then else ranged
    place = F.monotonically_increasing_id()
    back = materialize_bucketed(
        ranged.select("*", F.spark_partition_id().alias("__range"), place.alias("__at")).withColumn(
            "__at", F.col("__at") - F.shiftleft(F.col("__range").cast("long"), 33)),
        "ranges", math.ceil(parts / RANGES_PER_BUCKET), "__range", "__at")
    counts = back.groupBy("__range").agg(F.count(F.lit(1)).alias("n")).collect()      # one row per range
    made = Ranged(back, {r["__range"]: r["n"] for r in sorted(counts, key=lambda r: r["__range"])})
    if out is None:
        return made
    placed = back.join(F.broadcast(made.table()), F.col("__range") == F.col("__r"))
    return made.over(placed.withColumn(out, F.col("__before") + F.col("__at")).withColumn(
        "__left", F.col("__n") - F.col("__at")).drop("__r", "__before", "__n"))


# ---------------------------------------------------------------- windows

def range_windows(ranged: Ranged, values: dict, n: int, pos_col: str = "pos", keys: Sequence[str] = (),
                  params: Params = _DEFAULT, keep: Sequence[str] | None = None) -> DataFrame:
    """``sequence_windows`` over ordered ranges: same values and results, but the records are not shuffled
    again. With ``keys`` the order must begin with them.

    The last ``n - 1`` values before every range are collected once and put beside the first row of the range.
    If they are too large to broadcast, the halo chunks of ``sequence_windows`` take over. The columns of
    ``ranged.rows`` come back with the windows (``keep``: only these): leave out before what is not needed after.
    """
    if n < 1:
        raise ValueError("window length must be >= 1")
    keys, halo = list(keys), n - 1
    vals = {o: (F.col(v) if isinstance(v, str) else v) for o, (v, _, _) in values.items()}
    rows = ranged.rows
    kept = [c for c in rows.columns if c not in RANGE_COLUMNS] if keep is None else list(keep)
    through = [c for c in rows.columns if keep is None or c in (*RANGE_COLUMNS, pos_col, *keys, *kept)]
    staged = rows.select(*through, *[v.alias(f"__v_{o}") for o, v in vals.items()])
    before = _halo_table(ranged, staged, keys, [f"__v_{o}" for o in vals], pos_col, halo)
    if before is not None:
        before = materialize(before, "halo")
        if not fits_broadcast(before, params):
            return sequence_windows(rows, values, n, pos_col, keys, params=params).select(*kept, *values)
        staged = staged.join(F.broadcast(before), (F.col("__range") == F.col("__hr")) & (F.col("__at") == 0), "left").drop("__hr")
        # empty, not NULL: for every row Spark measures the batch so far, and goes again through all its NULL arrays
        staged = staged.withColumn("__halo", F.coalesce("__halo", F.array().cast(before.schema["__halo"].dataType)))
    pads, fields = [], [rows.schema[c] for c in kept]
    for o, (_, pad, flat) in values.items():
        kind = staged.schema[f"__v_{o}"].dataType
        pad_col = (pad if isinstance(pad, Column) else F.lit(pad)).cast(kind)
        pads.append(F.when(F.col("__at") == 0, F.array(pad_col)).otherwise(F.array().cast(T.ArrayType(kind))).alias(f"__p_{o}"))
        fields.append(T.StructField(o, T.ArrayType(kind.elementType if flat else kind)))
    # the row numbers bring the rows of a range in order
    place = F.row_number().over(Window.partitionBy("__range").orderBy("__at")).alias("__i")
    flat_of = {o: flat for o, (_, _, flat) in values.items()}
    return staged.select("*", *pads, place).groupBy("__range").applyInArrow(
        _cut_windows(flat_of, n, keys, [f.name for f in fields]), T.StructType(fields))


def _cut_windows(flat_of: dict[str, bool], n: int, keys: list[str], names: list[str]) -> Callable:
    """The windows of one range, whose rows come in order, a batch at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pads: dict[str, pa.Array] = {}
        tail: dict[str, pa.Array] = {}             # values and keys of the last rows
        rows = max(1, PIECE_ITEMS // n)
        for whole in batches:
            for start in range(0, whole.num_rows, rows):
                batch = whole.slice(start, rows)
                if not pads:
                    pads = {o: batch.column(f"__p_{o}")[0].values for o in flat_of}
                    halo = batch.column("__halo")[0] if "__halo" in batch.schema.names else None
                    if halo is not None and len(halo.values):
                        items = halo.values
                        kept = {f.name: items.field(f.name) for f in items.type}
                        tail = {**{f"__v_{o}": kept[f"__v_{o}"] for o in flat_of}, **{k: kept[f"k_{k}"] for k in keys}}
                have = {c: _joined([tail[c]] if tail else [], batch.column(c)) for c in [*(f"__v_{o}" for o in flat_of), *keys]}
                behind = len(next(iter(have.values()))) - batch.num_rows
                # element 0 is the pad, so the rows begin at 1
                at = np.arange(behind + 1, behind + 1 + batch.num_rows)
                index = at[:, None] + np.arange(1 - n, 1)
                least = _run_starts([have[k] for k in keys], behind + batch.num_rows)[behind:] + 1
                index = pa.array(np.where(index >= least[:, None], index, 0).ravel())
                made = {o: _lists(_joined([pads[o]], have[f"__v_{o}"]).take(index), n, flat) for o, flat in flat_of.items()}
                tail = {c: v.slice(max(len(v) - n + 1, 0)) for c, v in have.items()}
                yield pa.RecordBatch.from_arrays([made[c] if c in made else batch.column(c) for c in names], names=names)

    return run


def _joined(first: list[pa.Array], last: pa.Array) -> pa.Array:
    return pa.concat_arrays([*(x.cast(last.type) for x in first), last])


def _run_starts(keys: list[pa.Array], n: int) -> np.ndarray:
    """For each of ``n`` ordered rows the first row of its run of equal keys (nulls are equal)."""
    new = np.zeros(n, dtype=bool)
    for k in keys:
        codes = k.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    return np.maximum.accumulate(np.where(new, np.arange(n), 0))


def _lists(values: pa.Array, n: int, flat: bool) -> pa.Array:
    """Lists of every ``n`` values; ``flat``: of their elements (null where one of the values is)."""
    rows = len(values) // n
    if not flat:
        return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * n, pa.int32()), values)
    sizes = pc.fill_null(pc.list_value_length(values), 0).to_numpy().astype(np.int64).reshape(rows, n).sum(axis=1)
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
    null = values.is_null().to_numpy(zero_copy_only=False).reshape(rows, n).any(axis=1)
    return pa.ListArray.from_arrays(offsets, values.flatten(), mask=pa.array(null) if null.any() else None)


def _halo_table(ranged: Ranged, staged: DataFrame, keys: list[str], vals: list[str], pos_col: str,
                halo: int) -> DataFrame | None:
    """``(__hr, __halo)``: the last ``halo`` rows (keys and values) before every range but the first."""
    sizes = list(ranged.sizes.values())
    if halo == 0 or len(sizes) < 2:
        return None
    item = F.struct(F.col(pos_col).alias("pos"), *[F.col(k).alias(f"k_{k}") for k in keys], *vals)
    # a filter that Spark moves below the lookups: only the last rows of the ranges are looked up
    ends = staged.where(F.col("__left") <= halo) if "__left" in staged.columns else staged.join(
        F.broadcast(ranged.table()), F.col("__range") == F.col("__r")).where(F.col("__at") >= F.col("__n") - halo)
    tails = ends.groupBy("__range").agg(F.array_sort(F.collect_list(item)).alias("t"))
    # ranges shorter than the halo pass on what lies before them
    reach = 1 if min(sizes[:-1]) >= halo else halo
    earlier = Window.orderBy("__range").rowsBetween(-reach, -1)                # one row per range
    got = tails.select(F.col("__range").alias("__hr"), F.flatten(F.collect_list("t").over(earlier)).alias("h"))
    return got.where(F.size("h") > 0).select(
        "__hr", F.slice("h", F.greatest(F.size("h") - halo + 1, F.lit(1)), F.lit(halo)).alias("__halo"))


# ---------------------------------------------------------------- running sums

def running_sums(df: DataFrame, order: Sequence, values: Sequence[str], keys: Sequence[str] = (),
                 params: Params = _DEFAULT) -> DataFrame:
    """``df`` with ``cum_<value>``: the sum of ``value`` over the rows of the same ``keys`` up to and
    including this one in ``order`` (NULL keys are a group). No window ever holds more than a range."""
    keys, values = list(keys), list(values)
    ranged = ranged_rows(df, [*keys, *order], None, params)
    rows = ranged.rows
    part = rows.groupBy("__range", *keys).agg(*[F.sum(v).alias(f"__p_{v}") for v in values])
    earlier = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    table = part.select(
        F.col("__range").alias("__r"), *[F.col(k).alias(f"__k_{k}") for k in keys],
        *[F.coalesce(F.sum(f"__p_{v}").over(earlier), F.lit(0)).alias(f"__b_{v}") for v in values])
    table = materialize(table, "range-sums")              # ranges + keys rows at most
    if fits_broadcast(table, params):
        table = F.broadcast(table)
    same = null_safe([(F.col(k), F.col(f"__k_{k}")) for k in keys])
    inside = Window.partitionBy("__range", *keys).orderBy("__at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = rows.select("*", *[F.sum(v).over(inside).alias(f"__s_{v}") for v in values])
    return (summed.join(table, (F.col("__range") == F.col("__r")) & same)
                  .select("*", *[(F.col(f"__s_{v}") + F.col(f"__b_{v}")).alias(f"cum_{v}") for v in values])
                  .drop("__range", "__at", "__r", *[f"__k_{k}" for k in keys],
                        *[f"__{x}_{v}" for v in values for x in "sb"]))


# ---------------------------------------------------------------- files

def file_positions(records: DataFrame, out: str = "pos", params: Params = _DEFAULT) -> DataFrame:
    """The 0-based position in (file, line) order of records with ``_file, _block, _row`` (see
    ``sources.records``), without a sort.

    A file split is read by one task from top to bottom, so a row's place in it is its ``_row`` less the
    split's first. The rows before a split are a running sum over the splits: blocks within
    each file, then files. The records are read once and written once; the table of
    splits (one row each) is broadcast if its measured size allows it, else joined by split.
    """
    back = materialize(records, "file-records")
    file, block, row = ORDER_COLUMNS
    splits = materialize(back.groupBy(file, block).agg(F.min(row).alias("__first"), F.count(F.lit(1)).alias("__n")), "splits")
    in_file = Window.partitionBy(file).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    files = splits.groupBy(file).agg(F.sum("__n").alias("__n"))
    before = Window.orderBy(file).rowsBetween(Window.unboundedPreceding, -1)           # one row per file
    files = files.select(F.col(file).alias("__f"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__bf"))
    table = splits.select("*", F.coalesce(F.sum("__n").over(in_file), F.lit(0)).alias("__bb")).join(
        files, F.col(file) == F.col("__f")).select(
        F.col("__f"), F.col(block).alias("__b"), (F.col("__bf") + F.col("__bb") - F.col("__first")).alias("__shift"))
    table = materialize(table, "split-offsets")
    if fits_broadcast(table, params):
        table = F.broadcast(table)
    return (back.join(table, (F.col(file) == F.col("__f")) & (F.col(block) == F.col("__b")))
                .withColumn(out, F.col("__shift") + F.col(row)).drop("__f", "__b", "__shift"))
