"""Chunk tables and growing vocabularies."""

import pytest
from pyspark.sql import functions as F

from seqtok.config import Params
from seqtok.operators.evaluate import align_chunks, align_scores
from seqtok.operators.lookup import hot_keys
from seqtok.operators.sequence import assign_batch, assign_chunk
from seqtok.operators.vocab import build_vocabulary, extend_vocabulary, index_tokens
from seqtok.session import scratch_table
from seqtok.sources import sinks


def _exchanges(df) -> list[str]:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [x for x in plan.splitlines() if "Exchange" in x]


@pytest.fixture(scope="module")
def tables(spark):
    rows = assign_chunk(spark.range(3000).select(F.col("id").alias("pos"), (F.col("id") * 7 % 13).alias("x")), 100)
    out = []
    for part in (rows.where("pos % 3 <> 0"), rows.where("pos > 500").withColumnRenamed("x", "y").drop("pos")):
        name, path = scratch_table(spark, "chunk-test")
        sinks.write_chunk_table(part, name, path, 6)
        out.append(name)
    return out


def test_stored_chunks_are_paired_and_batched_without_an_exchange(spark, tables):
    left, right = (sinks.read_chunk_table(spark, t) for t in tables)
    paired = align_chunks(left, right)
    assert _exchanges(paired) == []
    plain = align_scores(left, right, ["chunk_id", "row_in_chunk"])
    cols = sorted(paired.columns)
    assert paired.select(cols).exceptAll(plain.select(cols)).count() == 0 and paired.count() == plain.count() > 1000
    batches = assign_batch(left, 16).groupBy("chunk_id", "batch_id").agg(F.count(F.lit(1)).alias("n"))
    assert _exchanges(batches) == [] and batches.agg(F.sum("n")).first()[0] == 2000


def test_a_range_of_stored_chunks(spark, tables):
    some = sinks.read_chunk_table(spark, tables[0], 3, 5)
    assert sorted(r[0] for r in some.select("chunk_id").distinct().collect()) == [3, 4, 5]
    assert "PushedFilters: [IsNotNull(chunk_id), GreaterThanOrEqual(chunk_id,3)" in some._jdf.queryExecution().executedPlan().toString()


def test_a_vocabulary_grows_without_changing_ids(spark, tmp_path):
    def freq(*pairs):
        return spark.createDataFrame(list(pairs), "token string, freq long")

    v1 = build_vocabulary(freq(("a", 5), ("b", 5), ("c", 1)))
    v2 = extend_vocabulary(v1, freq(("c", 10), ("z", 2), ("y", 2), ("x", 9), (None, 4)))
    v3 = extend_vocabulary(v2, freq(("z", 1), ("w", 1)))
    root = str(tmp_path / "vocabularies")
    for v in (v1.withColumn("version", F.lit(1)), v2, v3):
        sinks.save_vocabulary_version(v, root)
    got = {r["token"]: tuple(r)[1:] for r in sinks.load_vocabulary_version(spark, root, 3).collect()}
    assert got == {"a": (2, 5, 1), "b": (3, 5, 1), "c": (4, 11, 1), "x": (5, 9, 2), "y": (6, 2, 2), "z": (7, 3, 2), "w": (8, 1, 3)}
    rec = spark.createDataFrame([(["a", "x", "w", "q"],)], "tokens array<string>")
    ids = [index_tokens(rec, sinks.load_vocabulary_version(spark, root, n), 4).first()["token_ids"] for n in (1, 2, 3)]
    assert ids == [[2, 1, 1, 1], [2, 5, 1, 1], [2, 5, 8, 1]]
    with pytest.raises(Exception, match="(?i)already exists"):
        sinks.save_vocabulary_version(v3, root)
    empty = extend_vocabulary(v1.where("false"), freq(("k", 1)), Params(first_id=7))
    assert [tuple(r) for r in empty.collect()] == [("k", 7, 1, 1)]
    assert extend_vocabulary(v1, freq()).count() == 3


def test_hot_keys_come_from_a_sketch(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, None).otherwise(
        F.concat(F.lit("k"), F.col("id"))).alias("key"))
    got = [tuple(r) for r in hot_keys(rows, "key", Params(salt_rows=400)).collect()]
    assert got == [("hot", 5)]
    assert hot_keys(rows.where("false"), "key").count() == 0
