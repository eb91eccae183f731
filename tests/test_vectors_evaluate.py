"""Attention pooling, embedding joins, threshold sweep, losses, model choice."""

import math

from pyspark.sql import functions as F

from seqtok.config import Params
from seqtok.operators.evaluate import (
    align_scores, best_model, compare_models, model_losses, precision_recall_curve,
)
from seqtok.operators.learn import class_weight, window_terms
from seqtok.operators.vectors import attention_pool, embed_tokens, past_future_pool


def _seq(spark):
    rows = [("g1", 0, [1.0, 2.0]), ("g1", 1, [3.0, 4.0]), ("g1", 2, [5.0, 0.0]),
            ("g2", 0, [1.0, 1.0])]
    return spark.createDataFrame(rows, "g string, step int, x array<double>")


def test_attention_zero_weights_is_mean(spark):
    pooled = attention_pool(_seq(spark), ["g"], "step", "x", [0.0, 0.0], [0.0, 0.0, 0.0])
    got = {r.g: r.pooled for r in pooled.collect()}
    assert all(abs(a - b) < 1e-6 for a, b in zip(got["g1"], [3.0, 2.0]))
    assert all(abs(a - b) < 1e-6 for a, b in zip(got["g2"], [1.0, 1.0]))


def test_attention_against_numpy_formula(spark):
    W, b = [0.3, -0.2], [0.1, -0.1, 0.05]
    pooled, weights = attention_pool(_seq(spark), ["g"], "step", "x", W, b, return_attention=True)
    xs = [[1.0, 2.0], [3.0, 4.0], [5.0, 0.0]]
    e = [math.tanh(x[0] * W[0] + x[1] * W[1] + b[t]) for t, x in enumerate(xs)]
    a = [math.exp(v) for v in e]
    z = sum(a) + 1e-7
    want = [sum(a[t] * xs[t][d] for t in range(3)) / z for d in range(2)]
    got = {r.g: r.pooled for r in pooled.collect()}["g1"]
    assert all(abs(p - q) < 1e-9 for p, q in zip(got, want))
    wts = {r.step: r.attention for r in weights.where("g = 'g1'").collect()}
    assert all(abs(wts[t] - a[t] / z) < 1e-9 for t in range(3))


def test_attention_masked_steps(spark):
    df = _seq(spark).withColumn("m", (F.col("step") != 2).cast("int"))
    pooled = attention_pool(df, ["g"], "step", "x", [0.0, 0.0], None, mask_col="m")
    got = {r.g: r.pooled for r in pooled.collect()}["g1"]
    assert abs(got[0] - 2.0) < 1e-6 and abs(got[1] - 3.0) < 1e-6


def test_past_future_pool_center_in_both(spark):
    rows = [("g", t, [float(t)]) for t in range(5)]
    df = spark.createDataFrame(rows, "g string, step int, x array<double>")
    out = past_future_pool(df, ["g"], "step", "x", 2, [0.0], None, [0.0], None).first()["pooled"]
    assert abs(out[0] - 1.0) < 1e-6 and abs(out[1] - 3.0) < 1e-6  # means of 0..2 and 2..4


def test_embed_tokens_zero_for_missing(spark):
    rec = spark.createDataFrame([(0, [5, 7])], "pos long, token_ids array<long>")
    vec = spark.createDataFrame([(5, [1.0, 2.0])], "token_id long, vector array<float>")
    for bc in (True, False):
        got = embed_tokens(rec, vec, 2, 2, broadcast=bc).first()["embedded"]
        assert got == [1.0, 2.0, 0.0, 0.0]


def test_precision_recall_fixture(spark):
    df = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.4, 1), (0.2, 0)], "score double, label int")
    rows = precision_recall_curve(df, thresholds=[0.0, 0.5, 0.85, 1.0]).orderBy("threshold").collect()
    got = [(r.tp, r.fp, r.fn, r.precision, r.recall, round(r.f1, 6)) for r in rows]
    assert got == [(2, 2, 0, 0.5, 1.0, 0.666667), (1, 1, 1, 0.5, 0.5, 0.5),
                   (1, 0, 1, 1.0, 0.5, 0.666667), (0, 0, 2, 0.0, 0.0, 0.0)]


def test_thresholds_like_linspace():
    th = Params().thresholds()
    assert len(th) == 11 and th[3] == 0.30000000000000004 and th[-1] == 1.0 and th[0] == 0.0


def test_tp_plus_fn_constant(spark):
    df = spark.range(500).select((F.rand(3)).alias("score"), (F.rand(4) > 0.7).cast("int").alias("label"))
    m = precision_recall_curve(df)
    assert m.select((F.col("tp") + F.col("fn")).alias("s")).distinct().count() == 1
    assert m.count() == 11


def test_compare_models_losses_best(spark):
    rows = [("m1", 0, 0.9, 1), ("m1", 1, 0.2, 0), ("m2", 0, 0.6, 1), ("m2", 1, 0.4, 0)]
    df = spark.createDataFrame(rows, "model_id string, pos long, score double, label int")
    assert compare_models(df).count() == 22
    ls = {r.model_id: r for r in model_losses(df).collect()}
    want = -(math.log(0.9) + math.log(0.8)) / 2
    assert abs(ls["m1"].log_loss - want) < 1e-12 and ls["m1"].binary_accuracy == 1.0
    assert best_model(model_losses(df)).first()["model_id"] == "m1"


def test_align_scores_cuts_longer_side(spark):
    pred = spark.createDataFrame([(0, 0.1), (1, 0.2)], "pos long, score double")
    truth = spark.createDataFrame([(0, 1), (1, 0), (2, 1)], "pos long, label int")
    assert align_scores(pred, truth).count() == 2


def test_class_weight_and_terms(spark):
    df = spark.createDataFrame([(0, [3, 4, 5, 6])], "label int, w array<long>")
    r = df.select(class_weight(F.col("label")).alias("cw"), window_terms(F.col("w"), 2, 2).alias("t")).first()
    assert r.cw == 10.0 and r.t == [6, 8, 11, 13]  # id * 2 + step


def test_embed_tokens_with_more_vectors_than_a_broadcast(spark):
    rows = [(i, [1, 2, i, None if i % 3 else 9000 + i, i]) for i in range(60)] + [(60, None), (61, []), (61, [5])]
    df = spark.createDataFrame(rows, "k long, ids array<long>").repartition(3)
    vecs = spark.createDataFrame([(i, [float(i), -1.0]) for i in range(40)] + [(50, None)], "token_id long, vector array<float>")
    want = [(k, [x for i in range(5) for x in ([float((ids or [])[i]), -1.0] if ids and i < len(ids) and ids[i] is not None
                                               and ids[i] < 40 else [0.0, 0.0])]) for k, ids in rows]
    for size in (1, 400, 1 << 20):         # no vector, some or all are broadcast
        got = embed_tokens(df, vecs, 5, 2, ids_col="ids", params=Params(broadcast_max_bytes=size, salt_rows=20))
        assert sorted((r["k"], list(r["embedded"])) for r in got.collect()) == sorted(want)


def test_only_rare_vectors_meet_a_shuffle(spark):
    from seqtok.operators.lookup import frequent_rows

    keys = spark.createDataFrame([(1,)] * 30 + [(2,)] * 20 + [(i,) for i in range(3, 40)] + [(None,)], "__key long")
    table = spark.createDataFrame([(i, [0.5] * 8) for i in range(1, 60)], "__key long, __val array<double>")
    got = frequent_rows(keys, table, Params(broadcast_max_bytes=600))
    assert sorted(r["__key"] for r in got.collect()) == [1, 2]
