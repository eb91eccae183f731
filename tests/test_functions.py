"""Column-expression helpers against hand-computed answers (FIXTURES.md section 4)."""

import math
import random

import pytest
from pyspark.ml.feature import Bucketizer
from pyspark.sql import functions as F

from seqtok.functions import (
    bucket_count, bucket_stddev, bucket_unit, hash_index, one_hot, past_future_split,
    py_float_text, reshape_steps, uniform01,
)


def test_unit_buckets_fixture(spark):
    df = spark.createDataFrame([(-1.0,), (0.0,), (0.5,), (1.0,), (7.0,), (None,)], "x double")
    got = [r[0] for r in df.select(bucket_unit(F.col("x"), 3).alias("b")).collect()]
    assert got == [0, 1, 1, 2, 3, None]


def test_unit_bucket_nan_error_and_keep(spark):
    df = spark.createDataFrame([(float("nan"),)], "x double")
    with pytest.raises(Exception):
        df.select(bucket_unit(F.col("x"), 3)).collect()
    assert df.select(bucket_unit(F.col("x"), 3, on_nan="keep")).first()[0] == 4


def test_unit_bucket_equals_bucketizer(spark):
    rnd = random.Random(3)
    vals = [rnd.uniform(-5, 15) for _ in range(2000)] + [-1e300, 1e300, float("inf"),
                                                          float("-inf"), 0.0, 8.0, 9.0]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    n = 9
    splits = [-float("inf")] + [float(i) for i in range(n)] + [float("inf")]
    ref = Bucketizer(splits=splits, inputCol="x", outputCol="ref").transform(df)
    bad = ref.where(F.col("ref").cast("int") != bucket_unit(F.col("x"), n)).count()
    assert bad == 0


def test_stddev_bucket_values(spark):
    df = spark.createDataFrame([(1.0,), (2.9,), (3.1,), (50.0,), (None,)], "x double")
    b = bucket_stddev(F.col("x"), 1.0, 1.0, 3)
    assert [r[0] for r in df.select(b).collect()] == [0, 1, 2, 2, None]
    zero = bucket_stddev(F.col("x"), 1.0, 0.0, 1)
    assert [r[0] for r in df.select(zero).collect()] == [0, 0, 0, 0, None]


def test_bucket_count_constant_and_single_row(spark):
    const = spark.createDataFrame([(5.0,), (5.0,), (5.0,)], "x double")
    one = spark.createDataFrame([(5.0,)], "x double")
    for df in (const, one):
        row = df.agg(F.max("x").alias("mx"), F.min("x").alias("mn"),
                     F.stddev_samp("x").alias("sd")).select(bucket_count("mx", "mn", "sd")).first()
        assert row[0] == 1


@pytest.mark.parametrize("value,text", [
    (0.0, "0.0"), (5450.0, "5450.0"), (1e7, "10000000.0"), (1379963888.0, "1379963888.0"),
    (0.001, "0.001"), (0.0001, "0.0001"), (1e-5, "1e-05"), (1.5e-7, "1.5e-07"), (1e16, "1e+16"),
    (-2.5, "-2.5"), (12345678.5, "12345678.5"), (123456789012345678.0, "1.2345678901234568e+17"),
])
def test_python_float_text(spark, value, text):
    df = spark.createDataFrame([(value,)], "x double")
    assert df.select(py_float_text(F.col("x"))).first()[0] == text == repr(value)


def test_python_float_text_random(spark):
    rnd = random.Random(11)
    vals = [round(rnd.uniform(0, 1e6), rnd.randint(0, 6)) for _ in range(500)]
    vals += [rnd.uniform(-1e-3, 1e-3) for _ in range(100)]
    vals += [10 ** rnd.uniform(-8, 20) for _ in range(200)]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = [r[0] for r in df.select(py_float_text(F.col("x"))).collect()]
    mism = [(v, g) for v, g in zip(vals, got) if g != repr(v)]
    assert not mism, mism[:5]


def test_python_float_text_null(spark):
    df = spark.createDataFrame([(None,)], "x double")
    assert df.select(py_float_text(F.col("x"))).first()[0] is None


def test_hash_draws_match_sql(spark):
    df = spark.range(0, 2000).select(uniform01(42, F.col("id")).alias("u"),
                                     hash_index(42, F.col("id"), 39).alias("r"))
    stats = df.agg(F.min("u"), F.max("u"), F.avg("u"), F.min("r"), F.max("r")).first()
    assert 0 <= stats[0] and stats[1] < 1 and abs(stats[2] - 0.5) < 0.05
    assert stats[3] == 0 and stats[4] == 38
    # '42/0' -> md5 370f5232... -> first 8 hex digits
    assert spark.range(1).select(uniform01(42, F.lit(0))).first()[0] == int("370f5232", 16) / 2 ** 32


def test_one_hot(spark):
    df = spark.createDataFrame([(0,), (2,)], "y int")
    assert [r[0] for r in df.select(one_hot(F.col("y"), 3)).collect()] == [[1, 0, 0], [0, 0, 1]]


def test_reshape_and_past_future(spark):
    df = spark.range(1).select(F.sequence(F.lit(0), F.lit(50)).alias("a"))
    steps = reshape_steps(F.col("a"), 51, 1)
    past, fut = past_future_split(steps, 25, 51)
    r = df.select(F.flatten(past).alias("p"), F.flatten(fut).alias("f")).first()
    assert r["p"] == list(range(25, -1, -1))
    assert r["f"] == list(range(25, 51))
    r2 = spark.range(1).select(reshape_steps(F.sequence(F.lit(1), F.lit(6)), 3, 2)).first()[0]
    assert r2 == [[1, 2], [3, 4], [5, 6]]


def test_float_text_matches_math_rules():
    # the branch limits of py_float_text are Python's repr limits
    assert repr(1e-4) == "0.0001" and repr(9.9e-5) == "9.9e-05"
    assert repr(9999999999999998.0) == "9999999999999998.0" and repr(1e16) == "1e+16"
    assert not math.isnan(0.0)


from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402


@settings(max_examples=4, deadline=None)
@given(st.lists(st.floats(allow_nan=False, allow_infinity=False), min_size=50, max_size=300))
def test_python_float_text_property(spark, vals):
    # any finite double prints exactly like Python's str()
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = [r[0] for r in df.select(py_float_text(F.col("x"))).collect()]
    assert got == [str(v) for v in vals]
