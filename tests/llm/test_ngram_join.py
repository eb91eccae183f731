import itertools

import pytest
from llm_fixtures import prose

from seqtok.llm import ngram_join as nj
from seqtok.llm.common import shingle_hashes

pytest_plugins = ["llm_fixtures"]


def _brute(rows, threshold=0.8):
    """(class id, links) by comparing all pairs."""
    sets = [set(shingle_hashes([t])[0].tolist()) for _, t in rows]
    links = [0] * len(rows)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9:
            links[a] += 1
            links[b] += 1
            root[find(a)] = find(b)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(d)
    return {(d, min(groups[find(i)]), links[i]) for i, (d, _) in enumerate(rows)}


def _near_copies(seed, n, words=120):
    base = prose(seed, words).split()
    out = []
    for i in range(n):
        w = list(base)
        for k in range(i % 4):
            w[(7 * i + 31 * k) % len(w)] = f"edit{i}x{k}"
        out.append(" ".join(w))
    return out


@pytest.fixture(scope="module")
def rows():
    texts = [prose(i, 60) for i in range(40)]
    texts += _near_copies(1, 30) + _near_copies(2, 12, 300) + ["same words here now please ok"] * 9
    texts += ["", None, "...", "one two", "one two", "ONE, two!"]
    return [(i, t) for i, t in enumerate(texts)]


def _run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return {(r.doc_id, r.class_id, r.n_links) for r in nj.near_duplicates(df, **kw).collect()}


def test_equals_all_pairs(shipped, rows):
    assert _run(shipped, rows) == _brute(rows)


def test_split_nodes_and_shuffled_texts_give_the_same(shipped, rows, monkeypatch):
    monkeypatch.setattr(nj, "NODE_MEMBERS", 4)
    monkeypatch.setattr(nj, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(nj, "ROWS_PER_SALT", 3)          # hubs and classes with copies are salted
    assert _run(shipped, rows) == _brute(rows)


def test_whole_small_table(shipped, small_docs):
    rows = [(r.doc_id, r.text) for r in small_docs.select("doc_id", "text").collect()]
    got = {(r.doc_id, r.class_id, r.n_links) for r in nj.near_duplicates(small_docs).collect()}
    assert got == _brute(rows)


def test_depth_shortens_to_the_target_recall():
    assert nj.forest_depth(0.8, 16, 5, 0.5) == 5
    assert nj.forest_depth(0.8, 16, 5, 0.999) == 4
    assert nj.forest_depth(0.5, 16, 5, 0.999) < nj.forest_depth(0.9, 16, 5, 0.999)
    assert nj.forest_depth(0.01, 2, 5, 0.999) == 1


def test_null_ids_repeated_ids_and_empty_table(shipped):
    t = prose(9, 50)
    df = shipped.createDataFrame([(None, t, 1), (3, t, 2), (3, t, 3), (3, prose(10, 50), 4), (8, None, 5)],
                                 "doc_id long, text string, bucket int")
    got = sorted((r.doc_id or 0, r.class_id or 0, r.n_links, r.n_copies) for r in nj.near_duplicates(df).collect())
    assert got == [(0, 3, 2, 3), (3, 3, 0, 1), (3, 3, 2, 3), (3, 3, 2, 3), (8, 8, 0, 1)]
    assert nj.near_duplicates(df.limit(0)).collect() == []
    kept = nj.keep_one_row_of_each(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [3, 3, 8]
    assert nj.keep_one_row_of_each(df.limit(0)).count() == 0


def test_keeps_one_of_each_class(shipped, rows):
    df = shipped.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in nj.keep_one_row_of_each(df).collect()}
    assert kept == {c for _, c, _ in _brute(rows)}


@pytest.mark.parametrize("limit", [64 << 20, -1])
def test_components_of_a_long_chain(shipped, monkeypatch, limit):
    monkeypatch.setattr(nj, "BROADCAST_BYTES", limit)
    monkeypatch.setattr(nj, "ROWS_PER_SALT", 2)
    n = 60 if limit > 0 else 12
    edges = shipped.createDataFrame([(i, i + 1) for i in range(n)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in nj.connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, 100: 100, 101: 100}


@pytest.mark.parametrize("limit", [64 << 20, -1])
def test_rows_under_one_id_are_told_apart_by_text(shipped, monkeypatch, limit):
    monkeypatch.setattr(nj, "BROADCAST_BYTES", limit)
    monkeypatch.setattr(nj, "ROWS_PER_SALT", 1)
    import corpus_pipeline as cp

    t, u, v = prose(9, 50), prose(10, 50), prose(11, 50)
    rows = [(None, t), (3, t), (3, t), (3, u), (2, t), (8, None), (8, ""), (None, v), (None, v), (9, v.upper()[:0]),
            (None, None), (5, prose(12, 40)), (5, prose(13, 40))]
    df = shipped.createDataFrame([(i, x, k) for k, (i, x) in enumerate(rows)], "doc_id long, text string, at int")
    out = cp.near_duplicate_stage(shipped, df, "")
    assert out.columns == df.columns
    got = sorted(str((r.doc_id, r.text)) for r in out.collect())
    assert got == sorted(str(r) for r in [(2, t), (3, u), (8, None), (8, ""), (None, v), (9, ""), (None, None), *rows[-2:]])
    assert cp.near_duplicate_stage(shipped, df.limit(0), "").count() == 0
