"""Results on rows that the test tables do not hold: NaN, NULL and out-of-range values."""

import math
import random

import pytest
from pyspark.sql import functions as F

from seqtok.config import Params
from seqtok.functions.arrays import one_hot
from seqtok.operators import bayes, evaluate, learn
from seqtok.operators.tokens import bucketize, collect_bounds


def test_bounds_leave_nan_out(spark):
    rows = [(float(i),) for i in range(101)] + [(float("nan"),), (None,)]
    df = spark.createDataFrame(rows, "v double")
    b = collect_bounds(df, ["v"])["v"]
    assert (b.minimum, b.maximum, b.n_buckets) == (0.0, 100.0, int(100 // b.stddev))
    kept = bucketize(df, "v", b, Params(on_nan="keep"))
    assert kept.select("v_bucketized").distinct().count() == b.n_buckets + 2     # NaN bucket, NULL
    assert bucketize(df, "v", b, Params(on_nan="skip")).count() == 101
    with pytest.raises(Exception, match="NaN"):
        bucketize(df, "v", b, Params()).collect()


def test_null_boolean_token(spark):
    from seqtok.functions.text import encode_token

    df = spark.createDataFrame([(True,), (False,), (None,)], "b boolean")
    assert [r[0] for r in df.select(encode_token(df, "b", "x")).collect()] == ["Truex", "Falsex", "Nonex"]


def test_nan_and_null_scores_are_no_predictions(spark):
    df = spark.createDataFrame([(float("nan"), 1), (None, 1), (0.9, 1), (0.9, 0), (float("nan"), 0)],
                               "score double, label int")
    curve = evaluate.precision_recall_curve(df, thresholds=[0.5]).first()
    assert (curve.tp, curve.fp, curve.fn) == (1, 1, 2)
    assert [r[0] for r in df.select(evaluate.threshold_flags(F.col("score"), 0.5)).collect()] == [0, 0, 1, 1, 0]


def test_one_hot_out_of_range_fails(spark):
    df = spark.createDataFrame([(2,), (None,)], "y int")
    assert [r[0] for r in df.select(one_hot(F.col("y"), 3)).collect()] == [[0, 0, 1], None]
    for y in (3, -1):
        with pytest.raises(Exception, match="outside"):
            spark.createDataFrame([(y,)], "y int").select(one_hot(F.col("y"), 3)).collect()


def test_bayes_by_hand_and_odd_windows(spark, tmp_path):
    train = spark.createDataFrame([(["a", "b"], 1, 2.0), (["a"], 0, 1.0), (["c", None], 0, 1.0), (["a"], None, 1.0)],
                                  "terms array<string>, label int, weight double")
    model = bayes.fit_bayes(train, {"m": 1.0})
    bayes.save_bayes(model, str(tmp_path))
    model = bayes.load_bayes(spark, str(tmp_path))
    win = spark.createDataFrame([(1, ["a", "zz"]), (2, []), (3, None), (4, [None]), (5, ["c"]), (5, ["c"])],
                                "id long, terms array<string>")
    got = {r.id: r.score for r in bayes.score_bayes(model, win, ["id"]).collect()}
    # weighted counts: a 2/1, b 2/0, c 0/1; sums 4 and 2; 3 terms; prior 2 against 2
    lo = lambda w1, w0: math.log((w1 + 1) / (4 + 4)) - math.log((w0 + 1) / (2 + 4))
    p = lambda z: 1 / (1 + math.exp(-z))
    assert got[1] == pytest.approx(p(lo(2, 1) + lo(0, 0)))
    assert got[2] == got[3] == got[4] == pytest.approx(0.5)
    assert got[5] == pytest.approx(p(2 * lo(0, 1)))      # rows of one key are one window
    empty = bayes.fit_bayes(train.limit(0), {"m": 1.0})
    assert {r.score for r in bayes.score_bayes(empty, win, ["id"]).collect()} == {0.5}


def test_context_vectors(spark):
    import hashlib

    rows = [(["x", "a", "y"],), (["x", "b", "y"],), (["p", "c", "q"],), ([None, "solo"],), ([],), (None,)]
    df = spark.createDataFrame(rows, "tokens array<string>")
    got = {r.token: r.vector for r in learn.context_vectors(df, dim=40, window_size=1).collect()}

    def sign(token):
        return [1 if hashlib.md5(f"{d // 32}/{token}".encode()).hexdigest()[d % 32] >= "8" else -1
                for d in range(40)]

    assert got["a"] == got["b"] == [x + y for x, y in zip(sign("x"), sign("y"))]
    assert got["c"] != got["a"] and "solo" not in got


def test_infinite_values_stay_out_of_bounds_and_go_to_the_end_buckets(spark):
    inf = float("inf")
    rows = [(float(i),) for i in range(101)] + [(inf,), (-inf,), (None,)]
    df = spark.createDataFrame(rows, "v double")
    b = collect_bounds(df, ["v"])["v"]
    assert (b.minimum, b.maximum, b.n_buckets) == (0.0, 100.0, 3)
    for p in (Params(), Params(bucket_width="unit")):
        top = b.n_buckets - (p.bucket_width == "stddev")
        got = {r["v"]: r["v_bucketized"] for r in bucketize(df, "v", b, p).where("v is null or abs(v) > 100").collect()}
        assert got == {inf: top, -inf: 0, None: None}
        assert bucketize(df, "v", b, p).select("v_bucketized").distinct().count() > 3
    only = spark.createDataFrame([(inf,), (-inf,)], "v double")
    assert collect_bounds(only, ["v"])["v"].n_buckets == 1
    huge = spark.createDataFrame([(1.7e308,), (-1.7e308,), (0.0,)], "v double")
    b = collect_bounds(huge, ["v"])["v"]
    assert b.n_buckets == 1 and bucketize(huge, "v", b, Params()).select("v_bucketized").distinct().count() == 1


def test_losses_of_undefined_scores(spark):
    nan = float("nan")
    rows = [("a", 0.9, 1), ("a", 0.2, 0), ("a", nan, 1), ("a", None, 0), ("a", 0.5, None), ("b", 0.6, 1), ("b", 0.6, 0), ("c", None, 1)]
    df = spark.createDataFrame(rows, "model_id string, score double, label int")
    got = {r["model_id"]: r for r in evaluate.model_losses(df).collect()}
    assert (got["a"]["n"], got["a"]["n_undefined"]) == (4, 2) and got["a"]["binary_accuracy"] == 0.75
    assert got["a"]["log_loss"] == pytest.approx(-(math.log(0.9) + math.log(0.8)) / 2)
    assert got["c"]["log_loss"] is None and got["c"]["binary_accuracy"] == 0.0
    # a has the smaller loss over its defined scores, but not over all rows
    best = evaluate.best_model(evaluate.model_losses(df)).first()
    assert best["model_id"] == "b" and best["log_loss"] == pytest.approx(got["b"]["log_loss"])


@pytest.mark.parametrize("limit", [64 << 20, 1])
def test_exact_curve(spark, limit):
    rnd = random.Random(limit)
    rows = [(rnd.choice("ab"), rnd.choice([None, float("nan"), 0.0, -0.0, 0.25, 0.5, 0.75, rnd.random()]), rnd.choice([0, 1, 1, None]))
            for _ in range(400)] + [("c", 0.5, 0), ("d", None, 1)]
    df = spark.createDataFrame(rows, "m string, score double, label int")
    p = Params(rows_per_range=20, broadcast_max_bytes=limit, salt_rows=10)
    curve = evaluate.score_curve(df, group_cols=["m"], params=p)
    want, area = {}, {}
    for m in "abcd":
        own = [(None if s is None or s != s else s + 0.0, y) for g, s, y in rows if g == m and y is not None]
        pos = sum(y for _, y in own)
        for t in sorted({s for s, _ in own if s is not None}, reverse=True):
            hit = [y for s, y in own if s is not None and s >= t]
            want[m, t] = (sum(hit), len(hit) - sum(hit), pos - sum(hit))
            step = sum(y for s, y in own if s == t)
            area[m] = area.get(m, 0) + (step / pos * sum(hit) / len(hit) if pos else 0)
    assert {(r["m"], r["threshold"]): (r["tp"], r["fp"], r["fn"]) for r in curve.collect()} == want
    got = {r["m"]: r for r in evaluate.average_precision(curve, ["m"]).collect()}
    assert got.keys() == area.keys() and all(got[m]["average_precision"] == pytest.approx(area[m]) for m in area)
    whole = evaluate.score_curve(df, params=p)
    assert whole.count() == len({t for _, t in want}) and whole.agg(F.max("tp")).first()[0] == sum(
        y for _, s, y in rows if y and s is not None and s == s)
