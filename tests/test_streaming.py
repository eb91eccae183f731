"""The streaming tokenizer/indexer equals the batch one on the same files."""

from pyspark.sql import functions as F

from seqtok.config import KDD_COLUMNS, Params, kdd_spec
from seqtok.operators.tokens import collect_bounds, explode_tokens, tokenize_records
from seqtok.operators.vocab import build_vocabulary, index_tokens, token_frequencies
from seqtok.session import materialize, scratch_path
from seqtok.sources.records import ORDER_COLUMNS, read_records
from seqtok.streaming import index_stream, read_record_stream, start_parquet_sink
from test_sources_plans import _kdd_line


def test_stream_matches_batch(spark, tmp_path):
    src = tmp_path / "incoming"
    src.mkdir()
    (src / "a.txt").write_text("\n".join(_kdd_line(i) for i in range(20)) + "\n")
    (src / "b.txt").write_text("\n".join(_kdd_line(i) for i in range(20, 33)) + "\nbroken,line\n")
    spec, p = kdd_spec(), Params.parity()

    batch = read_records(spark, str(src), KDD_COLUMNS, on_bad="quarantine").where(~F.col("_corrupt"))
    bounds = collect_bounds(batch, spec.bucket_columns)
    tok = tokenize_records(batch, spec, bounds, p, keep=list(ORDER_COLUMNS))
    tok = tok.withColumn("pos", F.monotonically_increasing_id())
    vocab = materialize(build_vocabulary(token_frequencies(explode_tokens(tok)), p), "t-vocab")
    want = index_tokens(tok, vocab, spec.n_tokens, p).select("_file", "tokens", "token_ids")

    stream = read_record_stream(spark, str(src), KDD_COLUMNS)
    out = scratch_path(spark, "t-stream-out")
    q = start_parquet_sink(index_stream(stream, spec, bounds, vocab, p), out)
    q.awaitTermination(120)
    got = spark.read.parquet(out)
    assert got.where("_corrupt").count() == 1
    got = got.where(~F.col("_corrupt")).select("_file", "tokens", "token_ids")
    assert got.count() == 33
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_stream_token_frequencies_match_batch(spark, tmp_path):
    from seqtok.streaming import token_frequency_stream

    src = tmp_path / "freq-in"
    src.mkdir()
    (src / "a.txt").write_text("\n".join(_kdd_line(i) for i in range(15)) + "\n")
    (src / "b.txt").write_text("\n".join(_kdd_line(i) for i in range(15, 40)) + "\n")
    spec, p = kdd_spec(), Params.parity()
    batch = read_records(spark, str(src), KDD_COLUMNS)
    bounds = collect_bounds(batch, spec.bucket_columns)
    want = token_frequencies(explode_tokens(tokenize_records(batch, spec, bounds, p)
                                            .withColumn("pos", F.lit(0))))

    stream = token_frequency_stream(read_record_stream(spark, str(src), KDD_COLUMNS,
                                                       max_files_per_trigger=1), spec, bounds, p)
    q = (stream.writeStream.format("memory").queryName("t_stream_freq").outputMode("complete")
               .option("checkpointLocation", scratch_path(spark, "t-freq-ckpt"))
               .trigger(availableNow=True).start())
    q.awaitTermination(120)
    got = {r.token: r.freq for r in spark.sql("SELECT token, freq FROM t_stream_freq").collect()}
    # compared on the driver: both sides are one row per distinct token
    assert got == {r.token: r.freq for r in want.collect()}
