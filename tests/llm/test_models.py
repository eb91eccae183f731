"""Quality classifier and language identification."""
import zlib

import numpy as np
import pytest
from llm_fixtures import SMALL, prose

from seqtok.llm import language as lg
from seqtok.llm import quality as ql

pytest_plugins = ["llm_fixtures"]

TRAIN = {"aa": ["the cat sat on the mat and the dog ran", "a dog and a cat"],
         "bb": ["der hund und die katze sind im haus", "ein haus und ein hund"]}


def _phrases(symbols, sample):
    """Greedy longest phrases by plain substring search, block by block."""
    n = 0
    for at in range(0, len(symbols), lg.BLOCK):
        block, i = symbols[at:at + lg.BLOCK], 0
        while i < len(block):
            j = i + 1
            while j < len(block) and block[i:j + 1] in sample:
                j += 1
            n, i = n + 1, j
    return n


def test_walk_equals_greedy_substring_parse():
    m = lg.CrossParser(TRAIN)
    sample = [bytes(sum(([*m.symbols([t])[0].tolist(), m.pad] for t in TRAIN[k]), [])) for k in m.names]
    texts = ["The dog, the HAUS!! 12 und katze", "", None, "zzz qqq", "...", "ein dog " * 200, "ж и т"]
    counts, size = m.phrases(texts)
    sym, bounds = m.symbols(texts)
    for i in range(len(texts)):
        s = bytes(sym[bounds[i]:bounds[i + 1]].tolist())
        assert counts[i].tolist() == [_phrases(s, x) for x in sample]
    names, score, _ = m.predict(texts)
    assert [names[i] for i in (1, 2, 4)] == ["und"] * 3 and score[[1, 2, 4]].tolist() == [0, 0, 0]
    assert names[6] != "und" and ((0 <= score) & (score <= 1)).all()
    assert m.predict(["the cat and the dog"])[0] == ["aa"] and m.predict(["die katze und der hund"])[0] == ["bb"]


def test_automaton_knows_every_substring():
    s = [2, 3, 2, 2, 3, 4, 2, 3, 2]
    a = lg.SuffixAutomaton(s)
    for i in range(len(s)):
        for j in range(i + 1, len(s) + 1):
            state = 0
            for c in s[i:j]:
                state = a.next[state][c]


def test_language_of_held_out_documents(small_docs):
    got = {r.doc_id: r for r in lg.identify_documents(small_docs).collect()}
    truth = {r.doc_id: r.lang for r in small_docs.collect()}
    held = [d for d in truth if zlib.crc32(str(d).encode()) % 4 == 2]
    assert {d for d, r in got.items() if r.held_out} == set(held)
    assert np.mean([got[d].lang_pred == truth[d] for d in held]) > 0.9


def test_language_edge_rows(shipped):
    rows = [(i, t, k, 1.0) for k, v in TRAIN.items() for i, t in enumerate(v * 4)]
    rows += [(50, None, "aa", 1.0), (51, "", None, 1.0), (None, "123 !!", "aa", None), (7, "the cat", None, 0.0),
             (7, "the cat", None, 0.0)]
    df = shipped.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    out = lg.identify_documents(df).collect()
    assert len(out) == len(rows)
    assert all(r.lang_pred in ("aa", "bb", "und") and 0 <= r.score <= 1 for r in out)
    assert lg.identify_documents(df.limit(0)).collect() == []
    nothing = lg.identify_documents(df.selectExpr("doc_id", "text", "cast(null as string) lang")).collect()
    assert {r.lang_pred for r in nothing} == {"und"}


def test_quality_of_held_out_documents(shipped):
    docs = shipped.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = shipped.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = {r.doc_id: r for r in ql.score_documents(docs, labels).collect()}
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = [d for d in truth if zlib.crc32(str(d).encode()) % 5 == 0]
    assert all(got[d].held_out for d in held) and len(got) == docs.count()
    assert np.mean([got[d].predicted == truth[d] for d in held]) > 0.95


def test_quality_edge_rows(shipped):
    docs = shipped.createDataFrame(
        [(i, prose(i, 30) if i % 2 else prose(i, 30).upper().replace(" ", "!! "), "q") for i in range(20)]
        + [(20, None, "q"), (21, "", "q"), (None, "some words", "q"), (3, prose(3, 30), "q"), (22, "x" * 300_000, "q")],
        "doc_id long, text string, score string")
    labels = shipped.createDataFrame([(i, i % 2) for i in range(20)] + [(3, 1), (20, 0), (None, 1), (4, None), (5, 7)],
                                     "doc_id long, quality int")
    out = ql.score_documents(docs, labels).collect()
    assert len(out) == 25 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    by = {r.doc_id: r.score for r in out}
    assert by[20] == by[21] == 0.0 and by[1] > 0.9 and by[2] < 0.1
    assert ql.score_documents(docs.limit(0), labels).collect() == []
    assert {r.score for r in ql.score_documents(docs, labels.limit(0)).collect()} == {0.5}


def test_cosines_are_exact_and_votes_weighted():
    texts = [prose(i, 40) for i in range(30)] + [prose(i, 40).upper() for i in range(30)]
    y = np.array([1] * 30 + [0] * 30)
    m = ql.NeighbourModel(ql.term_shares(ql.term_counts(texts)), y)
    probe = prose(99, 60)
    z = (ql.term_shares(ql.term_counts([probe])) * m.idf) @ m.basis
    z /= np.linalg.norm(z)
    cos = (m.vectors @ z[0]).clip(0)
    near = np.argsort(-cos, kind="stable")[:ql.NEIGHBOURS]
    w = cos[near] ** ql.SHARPNESS
    assert abs(m.score([probe])[0] - (w * y[near]).sum() / w.sum()) < 1e-5


def test_equal_cosines_go_to_the_first():
    rng = np.random.default_rng(1)
    for _ in range(200):
        cosine = rng.choice([0.1, 0.5, 0.9, 1.0], size=(7, rng.integers(3, 40))).astype(np.float32)
        k = int(rng.integers(1, cosine.shape[1] + 1))
        want = np.sort(np.argsort(-cosine, axis=1, kind="stable")[:, :k], axis=1)
        assert (ql._nearest(cosine, k) == want).all()


def test_votes_of_tied_neighbours(monkeypatch):
    monkeypatch.setattr(ql, "NEIGHBOURS", 3)
    monkeypatch.setattr(ql, "term_counts", lambda texts: np.ones((len(texts), ql.TERMS), dtype=np.float32))
    shares = np.ones((6, ql.TERMS), dtype=np.float32)
    model = ql.NeighbourModel(shares, np.array([1, 0, 0, 1, 1, 1]))
    assert model.score(["x"])[0] == pytest.approx(1 / 3)          # the three smallest ids of six equal ones


def test_language_learns_from_anywhere_in_a_text_and_drops_no_language(shipped):
    long = "zz " * 2000 + "qwertz uiop asdf " * 2000
    rows = [(i, long, "a") for i in range(3)] + [(10 + i, "plain words here", f"l{i:03}") for i in range(260)]
    df = shipped.createDataFrame(rows, "doc_id long, text string, lang string")
    got = lg.language_samples(df, "doc_id", "text", "lang")
    assert len(got) == 261 and all(got.values())
    assert any("qwertz" in t for t in got["a"]) and all(len(t) <= lg.SAMPLE_CHARS for t in got["a"])
    assert 0 < len(got["a"]) <= lg.SAMPLE_DOCS * lg.MAX_LANGUAGES // 261
