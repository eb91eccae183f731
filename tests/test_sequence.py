"""Global position, halo windows, labels, chunks and batches."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from seqtok.config import Params
from seqtok.operators.sequence import (
    assign_batch, assign_chunk, assign_chunk_by_key, global_position, label_window, rank_within, sequence_window,
)


def test_history_window_fixture(spark):
    rows = [(i, [i, i * 10]) for i in range(1, 6)]
    df = spark.createDataFrame(rows, "k long, v array<long>")
    pos = global_position(df, ["k"])
    pad = F.array(F.lit(0).cast("long"), F.lit(0).cast("long"))
    got = sequence_window(pos, "v", 3, pad, flatten=True, chunk_rows=2).orderBy("k")
    assert [r["window"] for r in got.collect()] == [
        [0, 0, 0, 0, 1, 10], [0, 0, 1, 10, 2, 20], [1, 10, 2, 20, 3, 30],
        [2, 20, 3, 30, 4, 40], [3, 30, 4, 40, 5, 50]]


def test_label_window_fixture(spark):
    df = spark.createDataFrame([(0, 0), (1, 1), (2, 0), (3, 1)], "pos long, label int")
    got = label_window(df, "label", 3).orderBy("pos").collect()
    assert [r["labels"] for r in got] == [[0, 0, 0], [0, 0, 1], [0, 1, 0], [1, 0, 1]]


@pytest.mark.parametrize("n_rows,n,chunk,parts", [
    (1, 4, 3, 1), (2, 4, 3, 2), (97, 5, 4, 3), (500, 10, 9, 7), (500, 10, 37, 4),
    (300, 1, 1, 5), (1000, 40, 39, 8),
])
def test_halo_window_equals_global_window(spark, n_rows, n, chunk, parts):
    rnd = random.Random(n_rows * 31 + n)
    rows = [(i, rnd.randint(0, 99)) for i in range(n_rows)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "pos long, v int").repartition(parts)
    halo = sequence_window(df, "v", n, -1, chunk_rows=chunk).select("pos", "window")
    w = Window.orderBy("pos").rowsBetween(-(n - 1), 0)
    ref = df.select("pos", F.collect_list("v").over(w).alias("h"))
    ref = ref.select("pos", F.concat(F.array_repeat(F.lit(-1), F.lit(n) - F.size("h")), "h").alias("window"))
    assert halo.count() == n_rows
    assert halo.exceptAll(ref).count() == 0 and ref.exceptAll(halo).count() == 0


def test_keyed_window_hot_key(spark):
    # one key holds a third of all rows; windows restart per key
    rnd = random.Random(5)
    rows = [(i, 0 if i % 3 == 0 else rnd.randint(1, 20), rnd.randint(0, 9)) for i in range(900)]
    df = spark.createDataFrame(rows, "t long, key long, v int")
    p = Params(rows_per_range=100)
    pos = global_position(df, ["key", "t"], "pos", p)
    got = sequence_window(pos, "v", 6, -1, keys=["key"], chunk_rows=50).select("t", "window")
    w = Window.partitionBy("key").orderBy("t").rowsBetween(-5, 0)
    ref = df.select("t", F.collect_list("v").over(w).alias("h")).select(
        "t", F.concat(F.array_repeat(F.lit(-1), F.lit(6) - F.size("h")), "h").alias("window"))
    assert got.exceptAll(ref).count() == 0 and ref.exceptAll(got).count() == 0


@pytest.mark.parametrize("rows_per_range", [3, 7, 100, 10_000])
def test_global_position_many_ranges(spark, rows_per_range):
    rnd = random.Random(rows_per_range)
    # composite key whose leading column is very skewed (a third of rows share it)
    rows = [((0 if rnd.random() < 0.34 else rnd.randint(1, 50)), rnd.random(), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "a long, b double, c long").repartition(5)
    p = Params(rows_per_range=rows_per_range, max_ranges=64)
    got = global_position(df, ["a", "b", "c"], "pos", p)
    ref = df.select("*", (F.row_number().over(Window.orderBy("a", "b", "c")) - 1).cast("long").alias("pos"))
    assert got.exceptAll(ref).count() == 0 and got.count() == 3000


def test_global_position_ranges_are_partitioned(spark):
    df = spark.range(0, 5000).withColumn("k", F.col("id") * 7 % 5003)
    got = global_position(df, ["k"], "pos", Params(rows_per_range=500))  # 10 ranges
    assert got.agg(F.countDistinct("pos"), F.max("pos")).first() == (5000, 4999)
    many = global_position(df, ["k"], "pos", Params(rows_per_range=50, max_ranges=10))
    ref = df.select("*", (F.row_number().over(Window.orderBy("k")) - 1).cast("long").alias("pos"))
    assert many.exceptAll(ref).count() == 0


def test_global_position_string_desc_keys(spark):
    rows = [("b", 2), ("a", 3), ("a", 3), ("c", 1)]
    df = spark.createDataFrame(rows, "token string, freq long").groupBy("token").agg(F.sum("freq").alias("freq"))
    got = global_position(df, [-F.col("freq"), F.col("token")], "r", Params(rows_per_range=1))
    assert [(r.token, r.r) for r in got.orderBy("r").collect()] == [("a", 0), ("b", 1), ("c", 2)]


def test_global_position_empty_and_single(spark):
    empty = spark.createDataFrame([], "k long")
    assert global_position(empty, ["k"]).count() == 0
    one = spark.createDataFrame([(9,)], "k long")
    assert global_position(one, ["k"]).first()["pos"] == 0


def test_rank_within(spark):
    rows = [(k, t) for k in range(3) for t in range(k * 10, k * 10 + 5 + k)]
    df = spark.createDataFrame(rows, "k long, t long")
    got = rank_within(df, ["k"], ["t"], "r", Params(rows_per_range=3))
    w = Window.partitionBy("k").orderBy("t")
    ref = df.select("k", "t", (F.row_number().over(w) - 1).cast("long").alias("r"))
    assert got.select("k", "t", "r").exceptAll(ref).count() == 0


def test_chunks_and_batches(spark):
    df = spark.createDataFrame([(50000,), (50001,)], "pos long")
    got = assign_chunk(df, 50001).orderBy("pos").collect()
    assert [r.chunk_id for r in got] == [0, 1]
    chunk = spark.range(0, 300).withColumnRenamed("id", "pos")
    b = assign_batch(assign_chunk(chunk, 300), 128)
    sizes = [r["count"] for r in b.groupBy("batch_id").count().orderBy("batch_id").collect()]
    assert sizes == [128, 128, 44]


def test_no_row_lost_or_doubled_across_chunks(spark):
    for n_rows in (1, 2, 1001):
        df = spark.range(0, n_rows).withColumnRenamed("id", "pos")
        out = sequence_window(df, "pos", 40, -1, chunk_rows=39)
        assert out.count() == n_rows
        assert out.select("pos").distinct().count() == n_rows


def test_chunks_end_at_file_ends(spark):
    rows = [("f1", i) for i in range(5)] + [("f2", i) for i in range(3)] + [("f3", i) for i in range(4)]
    df = spark.createDataFrame(rows, "file string, line long")
    got = assign_chunk_by_key(df, 2, ["file"], ["line"]).orderBy("file", "line").collect()
    assert [(r.file, r.line, r.chunk_id, r.row_in_chunk) for r in got] == [
        ("f1", 0, 0, 0), ("f1", 1, 0, 1), ("f1", 2, 1, 0), ("f1", 3, 1, 1), ("f1", 4, 2, 0),
        ("f2", 0, 3, 0), ("f2", 1, 3, 1), ("f2", 2, 4, 0),
        ("f3", 0, 5, 0), ("f3", 1, 5, 1), ("f3", 2, 6, 0), ("f3", 3, 6, 1)]


def _final_plan(df):
    df._jdf.queryExecution().toRdd().count()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


@pytest.mark.parametrize("n_rows", [5, 3000])
def test_position_runs_no_window_over_rows(spark, n_rows):
    # the only window and single partition are over the range table, below the broadcast
    df = spark.range(0, n_rows).withColumn("k", (F.col("id") * 37) % 3001)
    got = global_position(df, ["k"], "pos", Params(rows_per_range=400))
    plan = _final_plan(got)
    data_side, range_side = plan.split("BroadcastQueryStage", 1)
    assert "Window" not in data_side and "SinglePartition" not in data_side
    assert range_side.count("SinglePartition") == 1
    assert got.agg(F.countDistinct("pos"), F.max("pos")).first() == (n_rows, n_rows - 1)


def test_ranges_have_a_ceiling(spark):
    df = spark.range(0, 1000)
    got = global_position(df, ["id"], "pos", Params(rows_per_range=1, max_ranges=7), range_col="r")
    assert got.select("r").distinct().count() <= 7
    assert got.where("pos <> id").count() == 0


def test_null_elements_stay_in_windows(spark):
    df = spark.createDataFrame([(0, 1), (1, None), (2, 3)], "pos long, v int")
    got = sequence_window(df, "v", 2, 0).orderBy("pos").collect()
    assert [r["window"] for r in got] == [[0, 1], [1, None], [None, 3]]


def test_rank_and_chunks_with_null_and_hot_keys(spark):
    rows = [(None if i % 5 == 0 else ("hot" if i % 2 else f"k{i % 7}"), i) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, t long").repartition(4)
    p = Params(rows_per_range=30)
    got = {(r.k, r.t): r.r for r in rank_within(df, ["k"], ["t"], "r", p).collect()}
    want = {}
    for k in {k for k, _ in rows}:
        for r, t in enumerate(sorted(t for x, t in rows if x == k)):
            want[k, t] = r
    assert got == want
    chunks = assign_chunk_by_key(df, 9, ["k"], ["t"], params=p)
    assert chunks.count() == 400
    assert chunks.groupBy("chunk_id").count().where("count > 9").count() == 0


def test_order_free_queries_write_no_position_table(spark, monkeypatch):
    from conftest import SF001

    from seqtok.operators import sequence
    from seqtok.plans import catalogue

    def fail(*a, **k):
        raise AssertionError("position table written")

    monkeypatch.setattr(sequence, "materialize", fail)
    for name in ("token_frequencies", "encode_tokens", "record_sentence", "distinct_tokens"):
        assert catalogue.QUERIES[name](spark, SF001).count() > 0
