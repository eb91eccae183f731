"""Dictionary lookups as joins, with a checked broadcast and a shuffle join beyond it.

A lookup table (vocabulary, frequencies, token vectors) is broadcast only after one
aggregate over the table itself has bounded its size in bytes. Otherwise the lookup is
a shuffle join. There, a token occurring more than ``target`` times is spread over
``ceil(occurrences / target)`` salts, where ``target`` is the larger of
``Params.salt_rows`` and a ten-thousandth of all occurrences: at most 10,000 tokens are
hot, so their list is always small, and no other key of the table is copied.

One contract for all forms: every row comes back once, whatever its keys; the result
always has ``n`` elements; missing, NULL and unknown elements give the default.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqtok.config import Params
from seqtok.session import materialize

_DEFAULT = Params()
MAX_HOT_KEYS = 10_000
SKETCH_ITEMS = 100_000         # keys that the frequent-items sketch keeps
UNBOUNDED = 1 << 62
_FIXED = (T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
          T.DoubleType, T.DateType, T.TimestampType, T.TimestampNTZType, T.NullType,
          T.DayTimeIntervalType, T.YearMonthIntervalType)


def size_in_bytes(table: DataFrame) -> int:
    """Upper bound of the in-memory size of ``table``: one aggregate action.

    Strings and binaries count their bytes + 8, fixed-width values 8, decimals 16; arrays,
    maps and structs 16 plus the sizes of what they hold; each row adds 16. A table with a
    column of any other type counts as unbounded.
    """
    return table_stats(table)[1]


def _value_bytes(c: Column, dt: T.DataType) -> Column | None:
    """Size bound of one value; None for a type without a rule."""
    if isinstance(dt, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)).cast("long") + 8
    if isinstance(dt, T.DecimalType):
        return F.lit(16).cast("long")
    if isinstance(dt, _FIXED):
        return F.lit(8).cast("long")
    if isinstance(dt, T.ArrayType):
        return _elements_bytes(c, dt.elementType)
    if isinstance(dt, T.MapType):
        keys = _elements_bytes(F.map_keys(c), dt.keyType)
        values = _elements_bytes(F.map_values(c), dt.valueType)
        return None if keys is None or values is None else keys + values
    if isinstance(dt, T.StructType):
        total = F.lit(16).cast("long")
        for f in dt.fields:
            part = _value_bytes(c[f.name], f.dataType)
            if part is None:
                return None
            total = total + part
        return total
    return None


def _elements_bytes(c: Column, dt: T.DataType) -> Column | None:
    if isinstance(dt, (*_FIXED, T.DecimalType)):
        width = 16 if isinstance(dt, T.DecimalType) else 8
        return F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)).cast("long") * width + 16
    if _value_bytes(F.lit(None), dt) is None:
        return None
    total = F.aggregate(c, F.lit(16).cast("long"), lambda acc, x: acc + _value_bytes(x, dt))
    return F.coalesce(total, F.lit(16).cast("long"))


def table_stats(table: DataFrame) -> tuple[int, int]:
    """``(rows, size bound in bytes)`` of ``table`` in one aggregate action (see
    ``size_in_bytes`` for the size rule)."""
    row_bytes: Column | None = F.lit(16).cast("long")
    for f in table.schema.fields:
        part = _value_bytes(F.col(f"`{f.name}`"), f.dataType)
        row_bytes = None if part is None or row_bytes is None else row_bytes + part
    size = F.lit(UNBOUNDED) if row_bytes is None else F.sum(row_bytes)
    got = table.agg(F.count(F.lit(1)).alias("n"), size.alias("b")).first()
    return int(got["n"] or 0), int(got["b"] or 0)


def fits_broadcast(table: DataFrame, params: Params = _DEFAULT) -> bool:
    return size_in_bytes(table) <= params.broadcast_max_bytes


def hot_keys(rows: DataFrame, key: str, params: Params = _DEFAULT) -> DataFrame:
    """``(__hot, __salts)`` of the keys that need more than one salt; at most ``MAX_HOT_KEYS`` rows.

    One aggregate over the keys: a mergeable frequent-items sketch of bounded size, so neither the
    distinct keys nor their counts are shuffled or written. Its counts are exact up to ``SKETCH_ITEMS``
    distinct keys and estimates beyond: salts only spread work, they decide no result.
    """
    stats = rows.where(F.col(key).isNotNull()).agg(
        F.call_function("approx_top_k", F.col(key), F.lit(MAX_HOT_KEYS), F.lit(SKETCH_ITEMS)).alias("top"), F.count(F.lit(1)).alias("n"))
    target = F.greatest(F.lit(params.salt_rows), F.ceil(F.col("n") / MAX_HOT_KEYS)).cast("long")
    found = stats.select(target.alias("__t"), F.explode("top").alias("x")).where(F.col("x.count") > F.col("__t"))
    return materialize(found.select(F.col("x.item").alias("__hot"), F.ceil(F.col("x.count") / F.col("__t")).cast(
        "int").alias("__salts")), "hot-keys")


def salted_join(rows: DataFrame, spread: Column, table: DataFrame, key: str, value: str, out: str,
                params: Params = _DEFAULT) -> DataFrame:
    """Left shuffle join of ``rows.__key`` with ``table.key``, adding ``out``; rows of a hot
    key are dealt over its salts by ``spread`` (a hash), only hot table keys are copied."""
    hot = F.broadcast(hot_keys(rows, "__key", params))     # at most MAX_HOT_KEYS rows
    salts = F.coalesce(F.col("__salts"), F.lit(1))
    left = (rows.join(hot, F.col("__key") == F.col("__hot"), "left")
                .withColumn("__salt", F.pmod(spread, salts).cast("int")).drop("__hot", "__salts"))
    right = (table.select(F.col(key).alias("__tk"), F.col(value).alias(out))
                  .join(hot, F.col("__tk") == F.col("__hot"), "left")
                  .withColumn("__ts", F.explode(F.sequence(F.lit(0), salts - 1)))
                  .drop("__hot", "__salts"))
    return left.join(right, (F.col("__key") == F.col("__tk")) & (F.col("__salt") == F.col("__ts")),
                     "left").drop("__salt", "__tk", "__ts")


def join_each_position(df: DataFrame, array_col: str, n: int, small: DataFrame, default: Column,
                       out: str) -> DataFrame:
    """One left join with ``small (__key, __val)`` per position; the same right-hand plan in
    every join, so one (broadcast) exchange is reused. Works on streams too."""
    staged = df.select("*", *[F.get(F.col(array_col), F.lit(i)).alias(f"__e{i}") for i in range(n)])
    for i in range(n):
        staged = (staged.withColumnRenamed(f"__e{i}", "__key")
                        .join(small, "__key", "left")
                        .drop("__key")
                        .withColumnRenamed("__val", f"__v{i}"))
    result = F.array(*[F.coalesce(F.col(f"__v{i}"), default) for i in range(n)])
    return staged.withColumn(out, result).drop(*[f"__v{i}" for i in range(n)])


def lookup_positions(df: DataFrame, array_col: str, n: int, table: DataFrame, key: str,
                     value: str, default: Column, out: str, broadcast: bool,
                     params: Params = _DEFAULT) -> DataFrame:
    """Replace each of the first ``n`` elements of ``array_col`` by ``table[key] -> value``.

    ``table`` has unique keys. ``broadcast=True`` and at most ``params.wide_tokens``
    positions: one broadcast hash join per position, the row side is never shuffled.
    Else the rows are written once with a row number of their own, exploded, joined once
    (broadcast, or salted shuffle) and regrouped by that number.
    """
    small = table.select(F.col(key).alias("__key"), F.col(value).alias("__val"))
    if broadcast and n <= params.wide_tokens:
        return join_each_position(df, array_col, n, F.broadcast(small), default, out)
    # written first: the numbers stay the same if a task runs again
    base = materialize(df.withColumn("__rid", F.monotonically_increasing_id()), "lookup-rows")
    exploded = base.select("__rid", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("__i"),
                           array_col).select(
        "__rid", "__i", F.get(F.col(array_col), F.col("__i")).alias("__key"))
    if broadcast:
        joined = exploded.join(F.broadcast(small), "__key", "left")
    else:
        joined = salted_join(exploded, F.xxhash64("__rid", "__i"), small, "__key", "__val", "__val", params)
    regrouped = joined.groupBy(F.col("__rid").alias("__g")).agg(
        F.array_sort(F.collect_list(F.struct(
            F.col("__i").alias("i"), F.coalesce(F.col("__val"), default).alias("v")
        ))).alias("__pairs")
    ).select("__g", F.transform("__pairs", lambda p: p["v"]).alias(out))
    base = base.drop(out) if out in df.columns else base
    return base.join(regrouped, F.col("__rid") == F.col("__g"), "inner").drop("__rid", "__g")


def frequent_rows(keys: DataFrame, table: DataFrame, params: Params = _DEFAULT) -> DataFrame:
    """The rows of ``table (__key, __val)`` whose key is most frequent in ``keys (__key)``: as many as fit a
    broadcast by their mean size (of equally frequent ones all or none)."""
    n, size = table_stats(table)
    room = int(params.broadcast_max_bytes // max(size / max(n, 1), 1))
    counts = keys.where(F.col("__key").isNotNull()).groupBy("__key").agg(F.count(F.lit(1)).alias("__n"))
    counts = materialize(counts.join(table.select("__key"), "__key", "left_semi"), "key-counts")
    least = above = 0
    for row in counts.groupBy("__n").agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("__n")).toLocalIterator():
        above += row["c"]
        if above > room:
            least = row["__n"]
            break
    return materialize(table.join(counts.where(F.col("__n") > least), "__key", "left_semi"), "frequent-rows")


def lookup_mixed(df: DataFrame, array_col: str, n: int, table: DataFrame, key: str, value: str,
                 default: Column, out: str, params: Params = _DEFAULT) -> DataFrame:
    """``lookup_positions`` for a table of large values that does not fit a broadcast: its most frequent rows are
    broadcast, so only the other elements that have a value meet it in a shuffle."""
    small = table.select(F.col(key).alias("__key"), F.col(value).alias("__val"))
    # written first: the numbers stay the same if a task runs again
    base = materialize(df.withColumn("__rid", F.monotonically_increasing_id()), "lookup-rows")
    exploded = base.select("__rid", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("__i"), array_col).select(
        "__rid", "__i", F.get(F.col(array_col), F.col("__i")).alias("__key"))
    frequent = frequent_rows(exploded, small, params)
    rare = exploded.where(F.col("__key").isNotNull()).join(F.broadcast(frequent.select("__key")), "__key", "left_anti")
    others = small.join(F.broadcast(frequent.select("__key")), "__key", "left_anti")
    found = salted_join(rare, F.xxhash64("__rid", "__i"), others, "__key", "__val", "__val", params).where(
        F.col("__val").isNotNull())
    rows = found.groupBy(F.col("__rid").alias("__g")).agg(
        F.map_from_entries(F.collect_list(F.struct("__i", "__val"))).alias("__rare"))
    joined = base.join(rows, F.col("__rid") == F.col("__g"), "left").drop("__rid", "__g")
    nothing = F.lit(None).cast(small.schema["__val"].dataType)
    filled = join_each_position(joined, array_col, n, F.broadcast(frequent), nothing, "__often")
    values = [F.coalesce(F.get("__often", F.lit(i)), F.try_element_at("__rare", F.lit(i)), default) for i in range(n)]
    return filled.withColumn(out, F.array(*values)).drop("__often", "__rare")


def lookup_column(df: DataFrame, col: Column, table: DataFrame, key: str, value: str,
                  out: str, broadcast: bool, salt_key: Sequence[str] = ("pos",),
                  params: Params = _DEFAULT) -> DataFrame:
    """Left lookup of one scalar column in ``table`` (unique keys)."""
    staged = df.withColumn("__key", col)
    if broadcast:
        small = F.broadcast(table.select(F.col(key).alias("__key"), F.col(value).alias(out)))
        return staged.join(small, "__key", "left").drop("__key")
    return salted_join(staged, F.xxhash64(*salt_key), table, key, value, out, params).drop("__key")


def null_safe(pairs: Sequence[tuple[Column, Column]]) -> Column:
    """Join condition that treats NULL keys as equal."""
    cond = F.lit(True)
    for a, b in pairs:
        cond = cond & a.eqNullSafe(b)
    return cond


def join_totals(rows: DataFrame, totals: DataFrame, keys: Sequence[str], count_col: str,
                spread: Column, params: Params = _DEFAULT) -> DataFrame:
    """Join one-row-per-group ``totals`` back to the rows of the group (NULL keys included).

    Broadcast when the measured size allows it; else a group of more than
    ``params.salt_rows`` rows and a ten-thousandth of all (``count_col``) is dealt over salts by ``spread``.
    """
    keys = list(keys)
    renamed = totals.select(*[F.col(k).alias(f"__t_{k}") for k in keys],
                            *[c for c in totals.columns if c not in keys])
    pairs = [(F.col(k), F.col(f"__t_{k}")) for k in keys]
    drop = [f"__t_{k}" for k in keys]
    if fits_broadcast(totals, params):
        return rows.join(F.broadcast(renamed), null_safe(pairs), "inner").drop(*drop, count_col)
    rows_in_all = totals.agg(F.sum(count_col).alias("n")).first()["n"] or 0
    target = max(params.salt_rows, -(-rows_in_all // MAX_HOT_KEYS))
    salts = F.greatest(F.ceil(F.col(count_col) / F.lit(target)), F.lit(1)).cast("int")
    copies = renamed.withColumn("__ts", F.explode(F.sequence(F.lit(0), salts - 1)))
    # at most MAX_HOT_KEYS groups have more rows than the target
    hot = F.broadcast(hot_groups(renamed, [f"__t_{k}" for k in keys], count_col, target))
    sized = rows.join(hot, null_safe([(F.col(k), F.col(f"__h___t_{k}")) for k in keys]), "left").withColumn(
        "__salt", F.pmod(spread, F.coalesce(F.col("__salts"), F.lit(1))).cast("int")).drop(
        "__salts", *[f"__h___t_{k}" for k in keys])
    return sized.join(copies, null_safe(pairs) & (F.col("__salt") == F.col("__ts")), "inner").drop(
        *drop, "__ts", "__salt", count_col)


def hot_groups(totals: DataFrame, keys: Sequence[str], count_col: str, target: int) -> DataFrame:
    """Groups of more than ``target`` rows and their salts: rows / target groups at most."""
    return totals.where(F.col(count_col) > target).select(
        *[F.col(k).alias(f"__h_{k}") for k in keys],
        F.ceil(F.col(count_col) / F.lit(target)).cast("int").alias("__salts"))
