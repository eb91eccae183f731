from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from seqtok.llm import line_dedup as ld

pytest_plugins = ["llm_fixtures"]


def _brute(rows, ratio, least):
    total, pages = Counter(), defaultdict(set)
    for i, (_, host, text) in enumerate(rows):
        total[host] += 1
        for line in (text or "").split("\n"):
            if line.strip(" "):
                pages[host, line.strip(" ")].add(i)
    bad = {k for k, v in pages.items() if len(v) >= least and len(v) > ratio * total[k[0]]}
    out = []
    for i, host, text in rows:
        if text is not None:
            text = "\n".join(x for x in text.split("\n") if (host, x.strip(" ")) not in bad)
        out.append((i, host, text))
    return Counter(out)


def _rows():
    rows = []
    for i in range(60):
        host = None if i % 7 == 0 else f"h{i % 3}"
        lines = [f"own line {i}", "shared by all ", f"pair {i // 2}", "", "  shared by all"]
        rows.append((i, host, "\n".join(lines[i % 2:])))
    rows += [(100, "h0", None), (101, "h1", ""), (102, "h1", "shared by all"), (102, "h1", "shared by all"),
             (None, "solo", "one page only"), (103, "h2", "x\n" * 5000 + "shared by all")]
    return rows


@pytest.mark.parametrize("limit", [32 << 20, -1])
def test_equals_brute_force(shipped, monkeypatch, limit):
    monkeypatch.setattr(ld, "BROADCAST_BYTES", limit)
    monkeypatch.setattr(ld, "ROWS_PER_SALT", 5)
    rows = _rows()
    df = shipped.createDataFrame(rows, "doc_id long, source string, text string").withColumn(
        "line", F.lit("extra")).withColumn("host", F.lit(1))
    out = ld.drop_boilerplate(df, F.col("source"), max_ratio=0.1, min_pages=3, dropped_col="dropped")
    assert out.columns == [*df.columns, "dropped"]
    got = out.collect()
    assert Counter((r.doc_id, r.source, r.text) for r in got) == _brute(rows, 0.1, 3)
    assert all(r.dropped >= 0 and r.line == "extra" for r in got)


def test_empty_table_and_no_boilerplate(shipped):
    df = shipped.createDataFrame(_rows(), "doc_id long, source string, text string")
    assert ld.drop_boilerplate(df.limit(0), F.col("source")).collect() == []
    same = ld.drop_boilerplate(df, F.col("source"), max_ratio=1.0)
    assert Counter(map(tuple, same.collect())) == Counter(_rows())


def test_no_python_in_the_plan(shipped):
    df = shipped.createDataFrame(_rows(), "doc_id long, source string, text string")
    plan = ld.drop_boilerplate(df, F.col("source"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("limit", [32 << 20, -1])
def test_copies_count_as_one_text_and_no_page_is_emptied(shipped, monkeypatch, limit):
    monkeypatch.setattr(ld, "BROADCAST_BYTES", limit)
    copy, notice = "first line of the copy\nsecond line", "all rights reserved"
    rows = [(i, h, copy) for i in range(9) for h in ("a", None)]
    rows += [(100 + i, "a", f"own text {i}\n{notice}") for i in range(40)]
    rows += [(200 + i, "a", f"{notice}\n" + "\n" * i) for i in range(2)] + [(300, "a", None), (301, "a", "")]
    df = shipped.createDataFrame(rows, "doc_id long, source string, text string")
    got = ld.drop_boilerplate(df, F.col("source"), dropped_col="dropped", by_text=True).collect()
    want = [(i, h, t if (t or notice).startswith((notice, copy)) else t.split("\n")[0]) for i, h, t in rows]
    assert Counter((r.doc_id, r.source, r.text) for r in got) == Counter(want)
    assert sum(r.dropped for r in got) == 40


def test_the_pipeline_stage_leaves_copies_to_the_next_stage(shipped):
    import corpus_pipeline as cp

    rows = [(i, "a copied line of words\nand one more line", "s", 43) for i in range(11)]
    rows += [(50 + i, f"text number {i} of this source", "s", 30) for i in range(60)]
    docs = shipped.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    out = cp.line_stage(shipped, docs, "")
    assert sorted(out.select("doc_id", "text").collect()) == sorted((i, t) for i, t, _, _ in rows)
    stay = cp.near_duplicate_stage(shipped, out, "").collect()
    assert [r.text for r in stay if r.doc_id < 50] == [rows[0][1]]


def test_a_column_named_like_the_count_is_replaced(shipped):
    df = shipped.createDataFrame([(i, "h", f"same\nown {i}", "x") for i in range(8)], "doc_id long, host string, text string, Dropped string")
    out = ld.drop_boilerplate(df, F.col("host"), dropped_col="dropped")
    assert out.columns == ["doc_id", "host", "text", "dropped"]
    assert {(r.text, r.dropped) for r in out.collect()} == {(f"own {i}", 1) for i in range(8)}
