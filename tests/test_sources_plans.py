"""Record text source, sinks, the query catalogue and plan properties."""

import os

import pytest
from pyspark.sql import functions as F

from conftest import SF001
from seqtok.config import KDD_COLUMNS, Params, kdd_spec
from seqtok.operators.sequence import global_position
from seqtok.operators.tokens import collect_bounds, tokenize_records, to_sentence
from seqtok.session import scratch_path
from seqtok.sources import sinks
from seqtok.sources.records import ORDER_COLUMNS, parse_records, read_records


def test_line_split_no_quoting(spark):
    lines = spark.createDataFrame([('0,,"x, y",normal.',)], "value string")
    got = parse_records(lines, ["a", "b", "c", "d", "e"]).first()
    assert list(got) == ["0", "", '"x', ' y"', "normal."]


def test_line_arity_fail_and_quarantine(spark):
    lines = spark.createDataFrame([("1,tcp",), ("1,tcp,http,SF",)], "value string")
    with pytest.raises(Exception):
        parse_records(lines, ["a", "b", "c", "d"], on_bad="fail").collect()
    with pytest.raises(Exception):
        parse_records(lines, ["a", "b", "c", "d"], on_bad="fail").count()
    q = parse_records(lines, ["a", "b", "c", "d"], on_bad="quarantine").orderBy("_corrupt").collect()
    assert [r._corrupt for r in q] == [False, True] and q[0].d == "SF" and q[1].a is None


def test_a_line_is_made_and_split_once(spark):
    lines = spark.range(4).select(F.concat_ws(",", *[F.col("id").cast("string")] * 3).alias("value"))
    plan = parse_records(lines, ["a", "b", "c"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1 and plan.count("concat_ws(") == 1


def test_concat_ws_canonical_none(spark):
    df = spark.createDataFrame([("a", None, "c")], "x string, y string, z string")
    arr = F.array(*[F.coalesce(F.col(c), F.lit("None")) for c in "xyz"])
    assert df.select(to_sentence(arr)).first()[0] == "a,None,c"


def _kdd_line(i):
    vals = [str(i % 5), "tcp" if i % 2 else "udp", "http", "SF", str(100 + i), str(5450 * (i % 3)),
            "0", "0", "0", "0", "0", "1", "0", "0", "0", "0", "0", "0", "0", "0", "0", "0",
            str(i % 9), str(i % 4), "0.00", "0.5", "0.00", "0.00", "1.00", "0.00", "0.00",
            "9", "9", "1.00", "0.00", "0.11", "0.00", "0.00", "0.00", "0.00", "0.00",
            "normal." if i % 4 else "smurf."]
    assert len(vals) == 42
    return ",".join(vals)


def test_connection_records_parity_tokens(spark, tmp_path):
    d = tmp_path / "kdd"
    d.mkdir()
    (d / "part1.txt").write_text("\n".join(_kdd_line(i) for i in range(30)) + "\n")
    (d / "part2.txt").write_text("\n".join(_kdd_line(i) for i in range(30, 45)) + "\n")
    rec = read_records(spark, str(d), KDD_COLUMNS)
    spec = kdd_spec()
    assert spec.n_tokens == 42
    p = Params.parity()
    bounds = collect_bounds(rec, spec.bucket_columns)
    pos = global_position(rec, list(ORDER_COLUMNS), "pos", p)
    toks = tokenize_records(pos, spec, bounds, p, keep=["pos"]).orderBy("pos").collect()
    assert len(toks) == 45
    first = toks[0].tokens
    assert first[:3] == ["udp", "SF", "http"]          # protocol_type, flag, service
    assert first[3].endswith("duration_bucketized") and first[3][:-len("duration_bucketized")].endswith(".0")
    assert first[4] == "100src_bytes" and first[5] == "0.0dst_bytes"
    assert first[-1] == "smurf."
    assert toks[1].tokens[5] == "5450.0dst_bytes"
    # file order then line order: the second file's first line comes right after the first's last
    assert toks[30].tokens[4] == "130src_bytes"


def test_sentence_and_chunk_sinks(spark):
    rec = spark.createDataFrame([(0, ["a", "b,c"]), (1, ["d", "e"])], "pos long, tokens array<string>")
    path = scratch_path(spark, "t-sent")
    sinks.write_sentences(rec, path, fmt="parquet")
    assert sinks.read_sentences(spark, path).count() == 2
    chunks = spark.range(0, 30).select(F.col("id").alias("pos"), (F.col("id") % 3).alias("chunk_id"),
                                       F.lit("train").alias("split"))
    cpath = scratch_path(spark, "t-chunks")
    sinks.write_chunks(chunks, cpath)
    got = sinks.read_chunks(spark, cpath, 1, 2, "train")
    assert got.count() == 20 and sorted(got.columns) == ["chunk_id", "pos", "split"]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "chunk_range" in plan and "PushedFilters" in plan


def test_chunk_files_do_not_grow_with_chunks(spark):
    chunks = spark.range(0, 6000, numPartitions=8).select(
        F.col("id").alias("pos"), (F.col("id") % 300).alias("chunk_id"), F.lit("train").alias("split"))
    path = scratch_path(spark, "t-many-chunks")
    sinks.write_chunks(chunks, path, chunks_per_directory=100)
    files = [f for _, _, names in os.walk(path.replace("file:", "")) for f in names if f.endswith(".parquet")]
    assert len(files) <= 3 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    one = sinks.read_chunks(spark, path, 150, 150, "train", chunks_per_directory=100)
    assert one.count() == 20
    # a chunk is in one file
    assert spark.read.parquet(path).groupBy("chunk_id").agg(
        F.countDistinct(F.col("_metadata.file_path")).alias("n")).where("n > 1").count() == 0
    assert sinks.read_chunks(spark, path).count() == 6000


def test_csv_sentences_come_back_exactly(spark):
    rows = [(0, [" lead", "trail "]), (1, [""]), (2, ["", ""]), (3, ['say "x"', "\\", "'"]), (4, ["null", "NULL"])]
    df = spark.createDataFrame(rows, "pos long, tokens array<string>")
    path = scratch_path(spark, "t-csv")
    sinks.write_sentences(df, path, fmt="csv")
    assert sorted((r.pos, r.tokens) for r in sinks.read_sentences(spark, path, fmt="csv").collect()) == rows
    broken = spark.createDataFrame([(0, ["a\nb"])], "pos long, tokens array<string>")
    with pytest.raises(Exception, match="line break"):
        sinks.write_sentences(broken, scratch_path(spark, "t-csv-bad"), fmt="csv")


def test_scratch_tables_go_and_clusters_need_a_shared_folder(spark, monkeypatch):
    from seqtok import session

    kept = session.materialize(spark.range(3), "t-drop")
    path = kept.inputFiles()[0].rsplit("/", 1)[0].replace("file://", "")
    assert os.path.isdir(path) and spark.sparkContext.applicationId in path
    session.drop_scratch(spark, path)
    assert not os.path.exists(path)

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, key):
            raise KeyError(key)

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())


def test_scratch_path_under_checkpoint_dir(spark):
    root = spark.sparkContext.getCheckpointDir()
    parent = root.rsplit("/", 1)[0].replace("file:", "")
    assert root and scratch_path(spark, "x").replace("file:", "").startswith(parent)


def test_entry_smoke(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert set(df.columns) == {"pos", "event_id", "chunk_id", "batch_id", "split", "label",
                               "features", "labels"}
    assert all(len(r.features) == 40 * 4 and len(r.labels) == 40 for r in rows[:20])


@pytest.mark.parametrize("name", ["index_tokens", "sequence_window_global", "mask_tokens",
                                  "attention_pool", "precision_recall_curve", "embed_tokens"])
def test_no_python_udf_in_plans(spark, name):
    import __spark_entry__ as entry

    df = entry.queries()[name](spark, SF001)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_every_query_has_oracle_or_is_training():
    from seqtok.plans.catalogue import QUERIES
    from seqtok.plans.oracle import oracle_queries

    # logistic regression; factors (test_factors.py checks them with NumPy)
    assert set(QUERIES) - set(oracle_queries()) == {"fit_and_score", "token_embeddings"}


def test_entry_without_the_training_data_package(monkeypatch):
    import importlib.util

    import __spark_entry__ as entry
    from seqtok.plans.catalogue import QUERIES

    real = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec",
                        lambda m, *a: None if m in ("seqtok.llm", "corpus_pipeline") else real(m, *a))
    assert set(entry.queries()) == set(QUERIES)
    assert set(entry.oracle_sql()) <= set(QUERIES)


def test_testdata_present():
    assert os.path.exists(os.path.join(SF001, "events.parquet"))
