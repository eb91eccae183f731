"""Shingle hashes and bounded samples."""
import re

from pyspark.sql import functions as F

from seqtok.llm import common

pytest_plugins = ["llm_fixtures"]


def _words(text):
    return re.findall(r"[0-9a-z_\x80-\U0010ffff]+", (text or "").lower())


def test_equal_words_have_equal_hashes_and_others_differ():
    texts = ["One two, THREE!", None, "", "...", "two one three", "x" * 5000, "déjà vu ー", "a_b a b"]
    h, bounds = common.word_hashes(texts)
    seen = {}
    for i, t in enumerate(texts):
        got = h[bounds[i]:bounds[i + 1]].tolist()
        assert len(got) == len(_words(t))
        for w, x in zip(_words(t), got):
            assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)


def test_blocks_do_not_change_hashes(monkeypatch):
    texts = ["alpha beta gamma " * 40, "z" * 300 + " end", "delta"]
    whole = common.word_hashes(texts)
    monkeypatch.setattr(common, "BLOCK_BYTES", 16)
    common._POWERS.clear()
    parts = common.word_hashes(texts)
    common._POWERS.clear()
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()


def test_shingles_are_runs_of_five_words():
    texts = ["a b c d e f", "b c d e f", "a b c", "a b c", "", "a b c d e"]
    h, b = common.shingle_hashes(texts)
    of = [h[b[i]:b[i + 1]].tolist() for i in range(len(texts))]
    assert [len(x) for x in of] == [2, 1, 1, 1, 0, 1]
    assert of[0] == [of[5][0], of[1][0]] and of[2] == of[3]


def test_pieces_cover_all_rows_in_order():
    texts = ["x" * n for n in (5, 100, 1, 1, 1, 0, 50)] + [None]
    got = list(common.pieces(texts, limit=60, rows=3))
    assert [a for a, _ in got] == [0, *[b for _, b in got[:-1]]] and got[-1][1] == len(texts)
    assert list(common.pieces([])) == []


def test_sample_by_hash_takes_the_least_hashes(shipped):
    df = shipped.range(5000).select(
        F.col("id"), F.when(F.col("id") % 10 < 8, "hot").when(F.col("id") % 10 == 8, "cold").alias("g"),
        F.xxhash64("id").alias("h"))
    got = common.sample_by_hash(df, "g", "h", 20)
    assert got.columns == df.columns
    rows = {g: sorted(r.h for r in df.collect() if r.g == g) for g in ("hot", "cold", None)}
    for g, want in rows.items():
        assert sorted(r.h for r in got.collect() if r.g == g) == want[:20]
    assert common.sample_by_hash(df.limit(0), "g", "h", 20).count() == 0
