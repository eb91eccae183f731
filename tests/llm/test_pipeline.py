"""The pipeline stage by stage, and the registered queries."""
import os

import duckdb
import pytest
from llm_fixtures import SMALL
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline as cp
from seqtok.llm import language, line_dedup, ngram_join, packing, quality

pytest_plugins = ["llm_fixtures"]


def test_stages_keep_the_columns_and_take_effect(shipped, small_docs):
    docs, sizes = small_docs, [small_docs.count()]
    for name, stage in cp.STAGES[:-1]:
        out = stage(shipped, docs, SMALL)
        assert out.dtypes == small_docs.dtypes, name
        out = out.cache()
        sizes.append(out.count())
        docs = out
    assert sizes[0] > sizes[1] >= sizes[2] == sizes[3] > sizes[4] > 0
    assert docs.where(F.length("text") != F.col("n_chars")).count() == 0
    packed = cp.STAGES[-1][1](shipped, docs, SMALL)
    assert sorted(r.doc_id for r in packed.collect()) == sorted(r.doc_id for r in docs.collect())


def test_run_equals_the_stages_by_hand(shipped, small_docs):
    labels = shipped.read.parquet(f"{SMALL}/labels.parquet")
    rows = small_docs.collect()
    model = quality.learn_quality(small_docs, labels).value
    rows = [r for r in rows if model.score([r.text])[0] >= quality.REJECT_BELOW]
    kept = shipped.createDataFrame(rows, small_docs.schema)
    parser = language.learn_languages(shipped, kept).value
    rows = [r for r in rows if (p := parser.predict([r.text]))[0][0] != "und" and p[2][0] <= cp.MAX_BITS_PER_SYMBOL]
    clean = line_dedup.drop_boilerplate(shipped.createDataFrame(rows, small_docs.schema), F.col("source"))
    classes = ngram_join.near_duplicates(clean).collect()
    stay = {r.doc_id for r in classes if r.doc_id == r.class_id}
    got = cp.run(shipped, SMALL).collect()
    assert {r.doc_id for r in got} == stay
    words = {r.doc_id: len(r.text.split()) for r in clean.collect()}
    assert {r.doc_id: r.n_tokens for r in got} == {d: words[d] for d in stay}
    assert sum(r.padding for r in got) == sum(r.bucket_len - r.n_tokens for r in got)


def test_stages_stand_odd_rows(shipped, tmp_path):
    rows = [(1, None, "en", "s", 0, "x"), (2, "", None, None, 0, "x"), (None, "Only words here.", "en", "s", 1, None),
            (3, "Same text again and again now.", "en", "s", 5, "y"), (3, "Same text again and again now.", "en", "s", 5, "y"),
            (4, "12 34 !!", "de", "t", None, "z")]
    docs = shipped.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string")
    for labels in ([(3, 1, 0), (4, None, None)], []):
        shipped.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.mode(
            "overwrite").parquet(f"{tmp_path}/labels.parquet")
        for some in (docs, docs.limit(0)):
            now = some
            for _, stage in cp.STAGES[:-1]:
                now = stage(shipped, now, str(tmp_path))
                assert now.columns == docs.columns
            cp.STAGES[-1][1](shipped, now, str(tmp_path)).collect()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("events", "documents", "embeddings", "pages", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(SMALL, t)}.parquet')")
    return con


def test_every_operator_has_a_query():
    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))


@pytest.mark.parametrize("name", ["op1_line_dedup", "op4_url_filters", "op9_topk"])
def test_sql_twins(shipped, duck, name):
    df = entry.queries()[name](shipped, SMALL)
    rel = duck.sql(entry.oracle_sql()[name])
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    got = sorted(str(tuple(r[c] for c in cols)) for r in df.collect())
    names = rel.columns
    assert got == sorted(str(tuple(r[names.index(c)] for c in cols)) for r in rel.fetchall())


def test_packing_of_whole_table_is_optimal_on_its_histogram(shipped, small_docs):
    got = packing.pack_documents(small_docs, n_buckets=3).collect()
    lengths = sorted(r.n_tokens for r in got)
    edges = sorted({r.bucket_len for r in got})
    cells = sorted(set(lengths))
    best = min(sum(min(b for b in (*c, lengths[-1]) if b >= n) - n for n in lengths)
               for c in ((a, b) for i, a in enumerate(cells[::4]) for b in cells[::4][i:]))
    assert sum(min(b for b in edges if b >= n) - n for n in lengths) <= best
