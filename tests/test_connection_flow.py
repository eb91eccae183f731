"""The reference's whole flow on its own record format through ``seqtok.job``: text records
-> sentences, vocabulary -> indexing (both branches) -> windows, labels, chunks ->
class-weighted classifiers -> scores -> sweep -> best model."""

import pytest
from pyspark.sql import functions as F

from seqtok import job
from seqtok.config import KDD_COLUMNS, Params, kdd_spec
from seqtok.operators import evaluate, learn
from seqtok.sources import sinks
from seqtok.sources.records import read_records
from test_sources_plans import _kdd_line

P = Params.parity(rows_per_chunk=100, train_chunks=4, validation_chunks=1, window=5)


@pytest.fixture(scope="module")
def out(spark, tmp_path_factory):
    src = tmp_path_factory.mktemp("records")
    for f in range(3):
        lines = [_kdd_line(i * 7 + f) for i in range(f * 200, f * 200 + 200)]
        (src / f"part{f}.txt").write_text("\n".join(lines) + "\n")
    folder = str(tmp_path_factory.mktemp("job"))
    job.preprocess(spark, str(src), folder, P)
    return folder


def test_preprocess(spark, out):
    sent = spark.read.parquet(f"{out}/sentences")
    assert sent.count() == 600 and sent.where(F.size("tokens") != 42).count() == 0
    vocab = sinks.load_vocabulary(spark, f"{out}/vocabulary")
    assert vocab.agg(F.min("token_id"), F.max("token_id")).first() == (0, vocab.count() - 1)


def test_training_branch_masks_and_windows(spark, out):
    win = job.index_windows(spark, out, training=True, time_data=True, params=P)
    assert win.count() == 600
    first = win.where("pos = 0").first()
    assert len(first.features) == 205 and first.features[:164] == [P.pad_id] * 164
    assert first.labels[:4] == [0, 0, 0, 0]
    # at most one masked id per record: the last step of each window
    last = win.select(F.size(F.filter(F.slice("features", 165, 41), lambda x: x == P.unk_id)).alias("n"))
    assert last.agg(F.max("n")).first()[0] == 1
    by_file = job.index_windows(spark, out, training=True, params=P.with_(rows_per_chunk=150), by_file=True)
    assert sorted(r["count"] for r in by_file.groupBy("chunk_id").count().collect()) == [50, 50, 50, 150, 150, 150]
    assert "labels" not in by_file.columns


def test_train_and_evaluate_by_command_line(spark, out):
    cut = ["--parity", "--rows-per-chunk", "100", "--train-chunks", "4", "--validation-chunks", "1"]
    job.main(["index", out, "--inference", "--window", "5", *cut], spark)
    win = sinks.read_chunks(spark, f"{out}/chunks")
    assert win.where(F.exists("features", lambda x: x == P.unk_id)).count() == 0
    job.main(["train", out, *cut], spark)
    job.main(["evaluate", out, *cut], spark)
    curve = sinks.read_metrics(spark, f"{out}/metrics")
    assert curve.count() == 33
    assert curve.select((F.col("tp") + F.col("fn")).alias("n")).distinct().count() == 1
    best = spark.read.parquet(f"{out}/best").first()
    assert best.model_id in job.ALPHAS and best.log_loss >= 0


def test_new_files_are_judged_by_what_was_learned(spark, out, tmp_path):
    """Another input with tokens and values that the vocabulary and the bounds do not know."""
    cut = ["--parity", "--rows-per-chunk", "100", "--train-chunks", "4", "--validation-chunks", "1"]
    job.main(["index", out, "--window", "5", *cut], spark)
    job.main(["train", out, *cut], spark)
    at = KDD_COLUMNS.index
    lines = []
    for i in range(120):
        fields = _kdd_line(i).split(",")
        if i % 10 == 0:
            fields[at("service")], fields[at("duration")] = "never_seen", "987654"
        lines.append(",".join(fields))
    (tmp_path / "new").mkdir()
    (tmp_path / "new" / "a.txt").write_text("\n".join(lines) + "\n")
    test = str(tmp_path / "test")
    job.main(["preprocess", str(tmp_path / "new"), test, "--learned-from", out, *cut], spark)
    job.main(["index", test, "--inference", "--window", "5", "--learned-from", out, *cut], spark)
    job.main(["evaluate", test, "--learned-from", out, "--split", "all", *cut], spark)
    # known tokens have the ids of the first output, new ones the unknown id
    ids = {r["token"]: r["token_id"] for r in sinks.load_vocabulary(spark, f"{out}/vocabulary").collect()}
    tokens = {r["pos"]: r["tokens"][:41] for r in spark.read.parquet(f"{test}/sentences").collect()}
    chunks = sinks.read_chunks(spark, f"{test}/chunks").collect()
    assert len(chunks) == 120
    for r in chunks:
        assert r["record"] == [ids.get(t, P.unk_id) for t in tokens[r["pos"]]]
        assert (P.unk_id in r["record"]) >= (r["pos"] % 10 == 0)
    # values beyond the learned bounds go to the end bucket that the learned bounds define
    bounds = sinks.load_bounds(spark, f"{out}/bounds")["duration"]
    assert f"{bounds.n_buckets}.0duration_bucketized" in {t for row in tokens.values() for t in row}
    assert not (tmp_path / "test" / "vocabulary").exists() and not (tmp_path / "test" / "bounds").exists()
    assert spark.read.parquet(f"{test}/scores").count() == 3 * 120
    with pytest.raises(ValueError, match="windows of 5 records"):
        job.main(["index", test, "--inference", "--window", "4", "--learned-from", out, *cut], spark)
        job.main(["evaluate", test, "--learned-from", out, "--split", "all", *cut], spark)


def test_scores_of_a_split_equal_scores_of_all(spark, out):
    job.index_windows(spark, out, training=False, params=P)
    job.train(spark, out, P)
    job.evaluate_models(spark, out, P, "all")
    everything = {(r["model_id"], r["pos"]): r["score"] for r in spark.read.parquet(f"{out}/scores").collect()}
    job.evaluate_models(spark, out, P, "test")
    test = {(r["model_id"], r["pos"]): r["score"] for r in spark.read.parquet(f"{out}/scores").collect()}
    assert len(test) == 300 and all(everything[k] == pytest.approx(v, abs=1e-12) for k, v in test.items())


def test_past_and_future_halves(spark, out):
    win = job.index_windows(spark, out, training=False, params=P, past_future=True)
    r = win.where("pos = 300").first()
    own = {x["pos"]: x["record"] for x in win.where("pos between 250 and 300").collect()}
    assert "features" not in win.columns and len(r["past"]) == len(r["future"]) == 26 * 41
    assert r["past"] == [i for p in range(275, 249, -1) for i in own[p]]
    assert r["future"] == [i for p in range(275, 301) for i in own[p]]
    first = win.where("pos = 0").first()
    assert first["past"] == [P.pad_id] * 26 * 41 and first["future"][-41:] == first["record"]
    assert spark.read.parquet(f"{out}/layout").first()["steps"] == 51


def test_logistic_regression_beside_it(spark, out):
    win = job.index_windows(spark, out, training=False, params=P)

    def terms(df):
        return df.select("pos", "label", learn.window_terms(F.col("features"), 41, P.window).alias("terms"),
                         learn.class_weight(F.col("label"), P).alias("weight"))

    models = learn.fit_candidates(terms(win.where("split = 'train'")), [("it3", 3, 0.0), ("it10", 10, 0.01)],
                                  num_features=1 << 12)
    scores = None
    for mid, m in models.items():
        s = learn.score_windows(m, terms(win.where("split = 'test'")), mid)
        scores = s if scores is None else scores.unionByName(s)
    best = evaluate.best_model(evaluate.model_losses(scores, params=P)).first()
    assert best.model_id in {"it3", "it10"} and best.log_loss >= 0


def test_unreadable_numbers_become_null_buckets(spark, tmp_path):
    fields = _kdd_line(3).split(",")
    fields[KDD_COLUMNS.index("count")] = "many"
    (tmp_path / "r.txt").write_text(_kdd_line(1) + "\n" + ",".join(fields) + "\n")
    from seqtok.operators.tokens import collect_bounds, tokenize_records
    rec = read_records(spark, str(tmp_path), KDD_COLUMNS)
    spec = kdd_spec()
    bounds = collect_bounds(rec, spec.bucket_columns)
    got = [r.tokens for r in tokenize_records(rec, spec, bounds, Params()).collect()]
    assert sorted(t for r in got for t in r if t.endswith("count_bucketized") and "srv" not in t) == [
        "0count_bucketized", "Nonecount_bucketized"]
    skipped = tokenize_records(rec, spec, bounds, Params(on_nan="skip"))
    assert skipped.count() == 1
