"""Windows of a stream equal windows of a batch over the same files, over restarts."""

import random

import pytest
from pyspark.sql import functions as F

from seqtok.config import Params
from seqtok.operators.ranges import range_windows, ranged_rows
from seqtok.streaming.windows import keyed_window_stream

SCHEMA = "user string, t long, v long"


def _run(spark, src, sink, ckpt, n=4):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", "1").parquet(src)
    out = keyed_window_stream(stream, "user", "t", "v", n, -1)
    q = out.writeStream.format("parquet").option("checkpointLocation", ckpt).outputMode("append").trigger(availableNow=True).start(sink)
    q.awaitTermination()
    assert q.exception() is None


def test_stream_equals_batch_over_a_restart(spark, tmp_path):
    rng = random.Random(3)
    src, sink, ckpt = (str(tmp_path / x) for x in ("src", "sink", "ckpt"))
    rows = [(rng.choice(["hot", "hot", "a", "b", None]), t, rng.choice([None, *range(50)])) for t in range(160)]
    spark.createDataFrame([], SCHEMA).write.parquet(src)
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        for part in range(4):                          # two runs of two files each; a file is not sorted
            own = rows[part * 40:part * 40 + 40]
            rng.shuffle(own)
            spark.createDataFrame(own, SCHEMA).coalesce(1).write.mode("append").parquet(src)
            if part % 2:
                _run(spark, src, sink, ckpt)
        got = spark.read.parquet(sink)
        assert got.where("late").count() == 0
        batch = range_windows(ranged_rows(spark.createDataFrame(rows, SCHEMA), ["user", "t"], params=Params(rows_per_range=30)),
                              {"window": ("v", -1, False)}, 4, keys=["user"]).select("user", "t", "window")
        mine = got.select("user", "t", "window")
        assert mine.count() == 160 and mine.exceptAll(batch).count() == 0
        # late and unordered records are marked and change nothing
        spark.createDataFrame([("a", 5, 1), ("a", None, 2), ("a", 500, 3), ("new", 1, 9)], SCHEMA).coalesce(1).write.mode("append").parquet(src)
        _run(spark, src, sink, ckpt)
        more = {(r["user"], r["t"]): r for r in spark.read.parquet(sink).where("late or t = 500 or user = 'new'").collect()}
        last = [v for u, _, v in rows if u == "a"][-3:]
        assert more["a", 500]["window"] == [*last, 3] and more["new", 1]["window"] == [-1, -1, -1, 9]
        assert {k for k, r in more.items() if r["late"]} == {("a", 5), ("a", None)}
        assert more["a", 5]["window"] is None
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)


@pytest.mark.parametrize("value,pad,want", [("cast(v as double) / 2", 0.0, [[0.0, 0.5], [0.5, 1.0]]), ("concat('x', v)", "", [["", "x1"], ["x1", "x2"]]),
                                            ("v = 1", False, [[False, True], [True, False]])])
def test_value_types_and_time_order(spark, tmp_path, value, pad, want):
    df = spark.createDataFrame([("a", 1, 1), ("a", 2, 2)], SCHEMA).select(
        "user", F.timestamp_seconds("t").alias("t"), F.expr(value).alias("x"))
    df.write.parquet(str(tmp_path / "src"))
    stream = keyed_window_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "src")), "user", "t", "x", 2, pad)
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        q = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(
            availableNow=True).start(str(tmp_path / "sink"))
        q.awaitTermination()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    got = spark.read.parquet(str(tmp_path / "sink")).orderBy("t").collect()
    assert [r["window"] for r in got] == want and [r["t"].second for r in got] == [1, 2]
