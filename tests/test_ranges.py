"""Ranges: windows beside their halo, running sums, positions of file records; no second exchange."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from seqtok.config import Params
from seqtok.operators.ranges import _halo_table, file_positions, range_windows, ranged_rows, running_sums
from seqtok.sources.records import ORDER_COLUMNS, read_records


def _exchanges(df) -> list[str]:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [x.strip() for x in plan.splitlines() if "Exchange" in x and "BroadcastExchange" not in x]


def _same(a, b):
    cols = sorted(a.columns)
    return a.select(cols).exceptAll(b.select(cols)).count() == 0 and b.select(cols).exceptAll(a.select(cols)).count() == 0


@pytest.mark.parametrize("n_rows,n,per_range", [(1, 4, 3), (97, 5, 10), (97, 12, 5), (300, 1, 50), (500, 40, 100), (60, 7, 1)])
def test_windows_equal_plain_windows(spark, n_rows, n, per_range):
    rnd = random.Random(n_rows + n)
    rows = [(i, rnd.choice([None, *range(100)]), [i, -i]) for i in range(n_rows)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "k long, v int, a array<long>").repartition(3)
    ranged = ranged_rows(df, ["k"], params=Params(rows_per_range=per_range))
    pad = F.array(F.lit(0).cast("long"), F.lit(7).cast("long"))
    got = range_windows(ranged, {"w": ("v", -1, False), "f": ("a", pad, True)}, n)
    over = Window.orderBy("k").rowsBetween(-(n - 1), 0)
    ref = df.select("*", F.collect_list(F.struct("v", "a")).over(over).alias("h")).select(
        "k", "v", "a", F.col("k").alias("pos"),
        F.concat(F.array_repeat(F.lit(-1), F.lit(n) - F.size("h")), F.transform("h", lambda x: x["v"])).alias("w"),
        F.flatten(F.concat(F.array_repeat(pad, F.lit(n) - F.size("h")), F.transform("h", lambda x: x["a"]))).alias("f"))
    assert _same(got, ref)


@pytest.mark.parametrize("per_range", [4, 50, 1000])
def test_keyed_windows_with_a_hot_and_a_null_key(spark, per_range):
    rnd = random.Random(5)
    rows = [(i, 0 if i % 3 == 0 else rnd.choice([None, *range(1, 20)]), rnd.randint(0, 9)) for i in range(600)]
    df = spark.createDataFrame(rows, "t long, key long, v int")
    ranged = ranged_rows(df, ["key", "t"], params=Params(rows_per_range=per_range))
    got = range_windows(ranged, {"w": ("v", -1, False)}, 6, keys=["key"]).select("t", "w")
    over = Window.partitionBy("key").orderBy("t").rowsBetween(-5, 0)
    ref = df.select("t", F.collect_list("v").over(over).alias("h")).select(
        "t", F.concat(F.array_repeat(F.lit(-1), F.lit(6) - F.size("h")), "h").alias("w"))
    assert _same(got, ref)


def test_halo_too_large_to_broadcast(spark):
    df = spark.range(300).select(F.col("id").alias("k"), (F.col("id") * 3).alias("v"))
    p = Params(rows_per_range=40, broadcast_max_bytes=10, halo_chunk_rows=30)
    small, plain = (range_windows(ranged_rows(df, ["k"], params=q), {"w": ("v", 0, False)}, 8, params=q)
                    for q in (p, p.with_(broadcast_max_bytes=1 << 20)))
    assert _same(small, plain)


def test_windows_of_ranges_move_no_records(spark):
    df = spark.range(4000).select((F.col("id") * 7 % 4001).alias("k"), F.col("id").alias("v"))
    ranged = ranged_rows(df, ["k"], params=Params(rows_per_range=500))
    small = spark.createDataFrame([(i, i * i) for i in range(9)], "m long, x long")
    looked = ranged.over(ranged.rows.withColumn("m", F.col("v") % 9).join(F.broadcast(small), "m"))
    got = range_windows(looked, {"w": ("x", 0, False)}, 40)
    assert _exchanges(got) == [] and got.count() == 4000


@pytest.mark.parametrize("per_range", [5, 60, 10_000])
def test_running_sums(spark, per_range):
    rnd = random.Random(per_range)
    rows = [(rnd.choice([None, "a", "a", "a", "b"]), i, rnd.randint(-5, 5), 1) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, t long, x long, y long").repartition(4)
    p = Params(rows_per_range=per_range)
    for keys in ([], ["g"]):
        over = Window.partitionBy(*keys).orderBy(F.desc("t")).rowsBetween(Window.unboundedPreceding, 0)
        ref = df.select("*", F.sum("x").over(over).alias("cum_x"), F.sum("y").over(over).alias("cum_y"))
        got = running_sums(df, [F.desc("t")], ["x", "y"], keys, p)
        assert _same(got, ref)
        assert _same(running_sums(df, [F.desc("t")], ["x", "y"], keys, p.with_(broadcast_max_bytes=1)), ref)
    assert running_sums(df.where("false"), ["t"], ["x"], ["g"], p).count() == 0


def test_file_positions_without_a_sort(spark, tmp_path):
    sizes = [0, 1, 700, 3, 250]
    want, at = [], 0
    for f, n in enumerate(sizes):
        lines = [f"{f}-{i},{'x' * (i % 50)}" for i in range(n)]
        (tmp_path / f"part-{f}.txt").write_text("".join(x + "\n" for x in lines))
        want += [(x.split(",")[0], at + i) for i, x in enumerate(lines)]
        at += n
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "900")       # many splits per file, many splits per task
    try:
        rec = read_records(spark, str(tmp_path), ["id", "pad"])
        assert rec.select("_block").distinct().count() > 10
        for p in (Params(), Params(broadcast_max_bytes=1)):
            got = file_positions(rec, params=p)
            assert sorted((r["id"], r["pos"]) for r in got.collect()) == sorted(want)
            if p.broadcast_max_bytes > 1:
                assert _exchanges(got) == []
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert set(ORDER_COLUMNS) <= set(got.columns)


def test_halo_reads_only_the_last_rows_of_the_ranges(spark):
    df = spark.range(400).select(F.col("id").alias("k"))
    ranged = ranged_rows(df, ["k"], params=Params(rows_per_range=100))
    only = F.when(F.col("__left") > 3, F.raise_error(F.lit("looked up")).cast("long")).otherwise(F.col("k"))
    looked = ranged.over(ranged.rows.withColumn("x", only))
    staged = looked.rows.withColumn("__v_w", F.col("x"))
    got = _halo_table(looked, staged, [], ["__v_w"], "pos", 3).collect()
    assert len(got) >= 2 and all(len(r["__halo"]) == 3 for r in got)


def test_projection_between_sort_and_write(spark):
    df = spark.range(50).select((49 - F.col("id")).alias("k"))
    ranged = ranged_rows(df, ["k"], params=Params(rows_per_range=20), then=lambda r: r.select("k", (F.col("k") * 2).alias("d")))
    assert all(r["pos"] == r["k"] and r["d"] == 2 * r["k"] for r in ranged.rows.collect())


def test_windows_of_arrays_of_any_length_with_nulls(spark):
    rows = [(0, ["a", None]), (1, []), (2, ["b"]), (3, None), (4, ["c"]), (5, ["d"])]
    df = spark.createDataFrame(rows, "k long, a array<string>")
    got = range_windows(ranged_rows(df, ["k"]), {"w": ("a", F.array(F.lit("-")), True)}, 2).orderBy("k").collect()
    assert [r["w"] for r in got] == [["-", "a", None], ["a", None], ["b"], None, None, ["c", "d"]]


def test_windows_beside_the_columns_to_keep(spark):
    df = spark.range(90).select(F.col("id").alias("k"), (F.col("id") % 7).alias("v"), F.lit("x").alias("left_out"))
    for p in (Params(rows_per_range=20), Params(rows_per_range=20, broadcast_max_bytes=10, halo_chunk_rows=30)):
        ranged = ranged_rows(df, ["k"], params=p)
        got = range_windows(ranged, {"w": ("v", -1, False)}, 4, params=p, keep=["k"])
        assert got.columns == ["k", "w"] and _same(got, range_windows(ranged, {"w": ("v", -1, False)}, 4, params=p).select("k", "w"))


def test_no_null_arrays_go_to_the_windows(spark):
    df = spark.range(90).select(F.col("id").alias("k"))
    got = range_windows(ranged_rows(df, ["k"], params=Params(rows_per_range=20)), {"w": ("k", -1, False)}, 4)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "ELSE [] END AS __p_w" in plan and "coalesce(__halo" in plan
