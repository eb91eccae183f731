"""Vocabulary, indexing, unknown tokens, masking, lookups (broadcast and salted)."""

from pyspark.sql import functions as F

from seqtok.config import Params
from seqtok.operators.lookup import hot_keys, join_totals, lookup_positions, size_in_bytes
from seqtok.operators.tokens import explode_tokens
from seqtok.operators.vocab import (
    build_vocabulary, index_tokens, mask_tokens, replace_oov, token_frequencies, top_tokens,
)


def _tokens(spark, toks):
    return spark.createDataFrame([(t,) for t in toks], "token string")


def test_vocabulary_fixture(spark):
    freq = token_frequencies(_tokens(spark, ["b", "a", "a", "c", "b", "a"]))
    vocab = build_vocabulary(freq, Params())
    got = {r.token: (r.token_id, r.freq) for r in vocab.collect()}
    assert got == {"a": (2, 3), "b": (3, 2), "c": (4, 1)}
    rec = spark.createDataFrame([(0, ["a", "z", "c"])], "pos long, tokens array<string>")
    for bc in (True, False):
        ids = index_tokens(rec, vocab, 3, Params(), broadcast=bc).first()["token_ids"]
        assert ids == [2, 1, 4]


def test_vocabulary_same_under_repartitioning(spark):
    toks = [f"t{i % 97}" for i in range(5000)] + [f"u{i}" for i in range(300)]
    a = build_vocabulary(token_frequencies(_tokens(spark, toks).repartition(1)), Params(rows_per_range=10))
    b = build_vocabulary(token_frequencies(_tokens(spark, toks).repartition(13)), Params(rows_per_range=50))
    assert a.exceptAll(b).count() == 0 and a.count() == 397
    ids = [r.token_id for r in a.collect()]
    assert sorted(ids) == list(range(2, 2 + 397))  # dense bijection


def test_index_then_reverse_lookup_is_identity(spark):
    toks = [f"w{i % 50}" for i in range(1000)]
    vocab = build_vocabulary(token_frequencies(_tokens(spark, toks)), Params()).cache()
    rec = spark.createDataFrame([(i, [f"w{i % 50}", f"w{(i * 7) % 50}", f"w{(i * 3) % 50}"])
                                 for i in range(200)], "pos long, tokens array<string>")
    for bc in (True, False):
        idx = index_tokens(rec, vocab, 3, Params(), broadcast=bc)
        back = lookup_positions(idx, "token_ids", 3, vocab, "token_id", "token", F.lit("?"),
                                "back", bc, Params(salt_rows=7))
        assert back.where(F.col("back") != F.col("tokens")).count() == 0
        assert back.count() == 200


def test_replace_oov(spark):
    vocab = build_vocabulary(token_frequencies(_tokens(spark, ["a", "b"])), Params())
    rec = spark.createDataFrame([(0, ["a", "x", "b"])], "pos long, tokens array<string>")
    for bc in (True, False):
        got = replace_oov(rec, vocab, 3, Params(), broadcast=bc).first()["tokens_seen"]
        assert got == ["a", "unknown", "b"]


def test_masking_probability(spark):
    # token 'one' occurs once (never masked), 'two' twice (about half), 'many' 1000 times
    toks = ["one"] + ["two"] * 2 + ["many"] * 1000
    freq = token_frequencies(_tokens(spark, toks))
    vocab = build_vocabulary(freq, Params())
    n = 4000
    for tok, expect in (("one", 0.0), ("two", 0.5), ("many", 0.999)):
        rec = spark.range(n).select(F.col("id").alias("pos"), F.array(F.lit(tok)).alias("tokens"))
        idx = index_tokens(rec, vocab, 1, Params())
        out = mask_tokens(idx, freq, 1, Params(mask_seed=7))
        rate = out.agg(F.avg(F.col("masked").cast("double"))).first()[0]
        assert abs(rate - expect) < 0.03, (tok, rate)
        masked_ids = out.where("masked").select(F.col("token_ids")[0]).distinct().collect()
        assert all(r[0] == 1 for r in masked_ids)


def test_top_tokens_ties(spark):
    freq = token_frequencies(_tokens(spark, ["b", "a", "c", "c"]))
    assert [r.token for r in top_tokens(freq, 2).collect()] == ["c", "a"]


def test_size_in_bytes_bounds(spark):
    df = spark.createDataFrame([("abc", 1), ("de", 2)], "token string, token_id long")
    # 2 rows x (16 overhead + 8 long) + (3+8) + (2+8)
    assert size_in_bytes(df) == 2 * 24 + 11 + 10


def test_vocabulary_without_label_tokens(spark):
    from seqtok.operators.tokens import explode_tokens

    rec = spark.createDataFrame([(0, ["a", "b", "normal."]), (1, ["a", "c", "smurf."])],
                                "pos long, tokens array<string>")
    with_labels = token_frequencies(explode_tokens(rec, include_answer=True))
    without = token_frequencies(explode_tokens(rec, include_answer=False))
    assert {r.token for r in with_labels.collect()} == {"a", "b", "c", "normal.", "smurf."}
    assert {r.token for r in without.collect()} == {"a", "b", "c"}


def test_tokens_with_nulls_and_nan(spark):
    from seqtok.config import FieldToken, RecordSpec
    from seqtok.operators.tokens import collect_bounds, tokenize_records

    df = spark.createDataFrame(
        [(1.0, "a", 5.5, "x"), (None, None, None, None), (float("nan"), "b", 2.0, "y")],
        "v double, s string, d double, ans string")
    spec = RecordSpec((FieldToken("v", "bucket"), FieldToken("s", "text"), FieldToken("d", "text")),
                      answer="ans")
    p = Params(on_nan="keep")
    b = collect_bounds(df.where(~F.isnan("v")), spec.bucket_columns)
    got = [r.tokens for r in tokenize_records(df, spec, b, p).collect()]
    assert got[1] == ["Nonev_bucketized", "Nones", "Noned", "None"]
    assert got[0][1:] == ["as", "5.5d", "x"]
    assert got[2][0] == f"{b['v'].n_buckets}v_bucketized"  # NaN kept in its own bucket


def test_empty_input_pipeline(spark):
    from seqtok.operators.sequence import global_position, sequence_window
    from seqtok.operators.tokens import explode_tokens

    rec = spark.createDataFrame([], "k long, tokens array<string>")
    pos = global_position(rec, ["k"])
    vocab = build_vocabulary(token_frequencies(explode_tokens(pos)), Params())
    idx = index_tokens(pos, vocab, 2, Params())
    win = sequence_window(idx, "token_ids", 3, F.array(F.lit(0).cast("long"), F.lit(0).cast("long")))
    assert vocab.count() == 0 and win.count() == 0


ODD = [(0, ["a", "b"]), (1, ["a"]), (2, []), (3, None), (None, ["b", "a"]), (4, ["a", None]), (4, ["b", "zz", "x"])]


def test_all_lookup_forms_agree_on_odd_rows(spark):
    """Short, empty, NULL and repeated rows: no row is lost or spoiled in any form."""
    rec = spark.createDataFrame(ODD, "pos long, tokens array<string>")
    table = spark.createDataFrame([("a", 2), ("b", 3)], "token string, token_id long")
    want = sorted(str((p, t, [{"a": 2, "b": 3}.get(((t or []) + [None] * 2)[i], 1) for i in range(2)]))
                  for p, t in ODD)
    for broadcast, wide in ((True, 16), (True, 1), (False, 16)):
        p = Params(wide_tokens=wide, salt_rows=1)
        out = lookup_positions(rec, "tokens", 2, table, "token", "token_id", F.lit(1).cast("long"), "ids",
                               broadcast, p)
        assert out.columns == ["pos", "tokens", "ids"]
        assert sorted(str((r.pos, r.tokens, r.ids)) for r in out.collect()) == want


def test_shuffle_lookup_with_a_hot_token_and_no_broadcasts(spark):
    old = spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold", None)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        rec = spark.range(3000).select(F.col("id").alias("pos"), F.array(
            F.lit("hot"), F.concat(F.lit("w"), F.col("id") % 50)).alias("tokens"))
        vocab = spark.createDataFrame([("hot", 5)] + [(f"w{i}", 100 + i) for i in range(50)],
                                      "token string, token_id long")
        got = index_tokens(rec, vocab, 2, Params(salt_rows=100), broadcast=False)
        bad = got.where((F.col("token_ids")[0] != 5) | (F.col("token_ids")[1] != 100 + F.col("pos") % 50))
        assert got.count() == 3000 and bad.count() == 0
        hot = {r["__hot"]: r["__salts"] for r in hot_keys(
            rec.select(F.explode("tokens").alias("t")), "t", Params(salt_rows=100)).collect()}
        assert hot == {"hot": 30}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10485760")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold") if old is None else spark.conf.set(
            "spark.sql.adaptive.autoBroadcastJoinThreshold", old)


def test_size_bound_of_nested_types(spark):
    df = spark.sql("select map('k', repeat('x', 2048)) m, named_struct('a', repeat('y', 1000)) s, "
                   "array(array(repeat('z', 500))) a")
    assert size_in_bytes(df) >= 2048 + 1000 + 500
    assert size_in_bytes(spark.sql("select array(1.0D, 2.0D) v")) == 16 + 2 * 8 + 16
    from pyspark.ml.linalg import Vectors
    vec = spark.createDataFrame([(Vectors.dense([1.0]),)], ["v"])
    assert size_in_bytes(vec) >= 1 << 60        # no rule for the type: never broadcast


def test_totals_join_back_salted_and_with_null_groups(spark):
    rows = spark.createDataFrame([("a" if i % 3 else None, i) for i in range(100)], "g string, i long")
    totals = rows.groupBy("g").agg(F.sum("i").alias("s"), F.count(F.lit(1)).alias("n"))
    for p in (Params(), Params(broadcast_max_bytes=-1, salt_rows=10)):
        got = join_totals(rows, totals, ["g"], "n", F.xxhash64("i"), p)
        assert got.columns == ["g", "i", "s"] and got.count() == 100
        assert got.where("g is null").agg(F.min("s"), F.max("s")).first() == (1683, 1683)


def _many_tokens(spark):
    n = 20
    odd = [[""] * n, [None] * n, [], None, ["a,b", "é\n", "", None, "t1"], [f"t{i}" for i in range(n + 5)]]
    rows = [[f"t{(i * j) % 37}" for j in range(n)] for i in range(300)] + odd
    return spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "pos long, tokens array<string>").repartition(3), n


def test_counted_tokens_equal_exploded_tokens(spark):
    rec, _ = _many_tokens(spark)
    plain = token_frequencies(explode_tokens(rec))
    counted = token_frequencies(explode_tokens(rec, counted=True), count_col="n")
    assert counted.schema["freq"].dataType == plain.schema["freq"].dataType
    assert sorted(map(tuple, counted.collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)


def test_many_tokens_are_looked_up_without_a_join_per_token(spark):
    rec, n = _many_tokens(spark)
    vocab = build_vocabulary(token_frequencies(explode_tokens(rec).where(F.col("token") != "t7")), Params())
    idx = index_tokens(rec, vocab, n, Params(), keep=["pos"])
    assert idx.columns == ["pos", "token_ids"] and "Join" not in idx._jdf.queryExecution().executedPlan().toString()
    want = index_tokens(rec, vocab, n, Params(), broadcast=False, keep=["pos"])
    assert sorted(map(tuple, idx.collect())) == sorted(map(tuple, want.collect()))
    assert index_tokens(rec, vocab, n, Params()).columns == ["pos", "tokens", "token_ids"]
