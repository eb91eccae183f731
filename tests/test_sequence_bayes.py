"""Naive Bayes along the sequence equals naive Bayes over exploded windows."""

import random

import pytest
from pyspark.sql import functions as F

from seqtok.config import Params
from seqtok.operators import bayes
from seqtok.operators import sequence_bayes as sb
from seqtok.operators.ranges import range_windows, ranged_rows

ALPHAS = {"a": 0.1, "b": 2.0}


def _records(spark, n, seed):
    rng = random.Random(seed)
    toks = ["x", "y", "z", "hot", "hot", "hot", None]
    rows = [(i, [rng.choice(toks) for _ in range(3)], rng.choice([0, 1, 1, None]), rng.choice([1.0, 0.5, None]) if i % 5 else 2.0,
             rng.random() < 0.7) for i in range(n)]
    rows[-1] = (n - 1, ["only here", "x", "y"], 1, 1.0, False)
    return spark.createDataFrame(rows, "k long, tokens array<string>, label int, weight double, train boolean")


@pytest.mark.parametrize("n,steps,per_range,limit", [
    (90, 4, 25, 64 << 20), (90, 4, 25, 1), (40, 6, 3, 64 << 20), (3, 5, 2, 64 << 20), (60, 1, 10, 64 << 20), (50, 3, 100, 64 << 20)])
def test_equals_windows(spark, tmp_path, n, steps, per_range, limit):
    df = _records(spark, n, n + steps)
    p = Params(rows_per_range=per_range, broadcast_max_bytes=limit)
    ranged = ranged_rows(df, ["k"], params=p)
    model = sb.fit_sequence_bayes(ranged, ALPHAS, steps, 3, params=p)
    sb.save_sequence_bayes(model, str(tmp_path / "m"))
    got = sb.score_sequence_bayes(sb.load_sequence_bayes(spark, str(tmp_path / "m")), ranged, ["k", "label"], 3, params=p)

    plain = ranged_rows(df, ["k"], params=Params())
    pad = F.array_repeat(F.lit("<pad>"), 3)
    # a NULL token is no term; in windows it is marked so that the step text does not turn it into one
    win = range_windows(plain, {"w": ("tokens", pad, True)}, steps).select(
        "k", "label", "weight", "train", F.transform("w", lambda x, i: F.when(x.isNotNull(), F.concat_ws(
            "|", F.floor(i / 3).cast("string"), x))).alias("terms"))
    old = bayes.fit_bayes(win.where("train"), ALPHAS)
    a, b = model.totals.first(), old.totals.first()
    assert all(a[c] == pytest.approx(b[c]) for c in ("p0", "p1", "w0", "w1", "n_terms"))
    want = {(r["model_id"], r["k"]): r["score"] for r in bayes.score_bayes(old, win, ["k", "label"]).collect()}
    have = {(r["model_id"], r["k"]): r["score"] for r in got.collect()}
    assert have.keys() == want.keys() and len(have) == 2 * n
    assert all(have[x] == pytest.approx(want[x], abs=1e-12) for x in want)


def test_nothing_to_learn(spark):
    ranged = ranged_rows(_records(spark, 10, 1).withColumn("train", F.lit(False)), ["k"])
    model = sb.fit_sequence_bayes(ranged, {"a": 1.0}, 3, 3)
    assert {round(r["score"], 9) for r in sb.score_sequence_bayes(model, ranged, ["k"], 3).collect()} == {0.5}


def test_no_window_is_exploded(spark):
    p = Params(rows_per_range=100)
    ranged = ranged_rows(_records(spark, 400, 2), ["k"], params=p)
    model = sb.fit_sequence_bayes(ranged, ALPHAS, 10, 3, params=p)
    plan = sb.score_sequence_bayes(model, ranged, ["k"], 3, params=p)._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.splitlines() if "Exchange" in x and "BroadcastExchange" not in x]
    assert "Generate explode" not in plan
