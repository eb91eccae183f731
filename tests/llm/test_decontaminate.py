import hashlib
import random
import re

import numpy as np
import pytest

from seqtok.llm import decontaminate as dc
from seqtok.llm.queries import op12_decontamination

from llm_fixtures import SMALL

pytest_plugins = ["llm_fixtures"]

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _words(text):
    return WORD.findall((text or "").translate(LOWER))


def _brute(docs, items, size=10, within=0):
    windows = {}
    for item, text in items:
        w = _words(text)
        for i in range(max(len(w) - size + 1, 1) if w else 0):
            windows.setdefault(tuple(w[i:i + size]), set()).add("" if item is None else str(item))
    out = []
    for doc, text in docs:
        w, hit, found, near = _words(text), set(), set(), set()
        for i in range(len(w)):
            for n in {len(x) for x in windows}:
                own = windows.get(tuple(w[i:i + n]))
                if own and i + n <= len(w):
                    hit |= set(range(i, i + n))
                    found |= own
        for window, own in windows.items() if within else ():
            need = {t: window.count(t) for t in window}
            if any(all(w[i:i + within].count(t) >= n for t, n in need.items()) for i in range(max(len(w) - within, 0) + 1)):
                near |= own
        out.append((doc, len(w), len(hit), tuple(sorted(found)), tuple(sorted(near))))
    return sorted(out, key=repr)


def _tables(spark, docs, items):
    return (spark.createDataFrame([(d, t, "s", 1) for d, t in docs], "doc_id long, text string, segment string, TERM int"),
            spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int"))


def _fixture():
    rng = random.Random(8)
    pool = [f"w{i}" for i in range(30)] + ["été", "東京都", "Das", "a" * 70, "a" * 69 + "b", "b" * 20, "b" * 19 + "c"]
    text = lambda n: "".join(rng.choice(pool) + rng.choice([" ", ", ", "_", "\n", ".  "]) for _ in range(n))
    items = [(k, text(rng.choice([3, 9, 10, 11, 25]))) for k in range(20)]
    items += [(3, items[4][1]), (50, items[5][1]), (None, "only two"), (60, ""), (61, None), (62, " . _"), (63, "w1 " * 12)]
    docs = []
    for k in range(70):
        parts = [text(rng.choice([0, 1, 30, 200]))]
        for _ in range(rng.randrange(3)):
            own = _words(rng.choice(items)[1])
            a = rng.randrange(len(own) + 1)
            parts += [" ".join(own[a:] if rng.random() < 0.5 else own), text(rng.randrange(8))]
        docs.append((k, " ".join(parts).upper() if k % 7 == 0 else "-".join(parts)))
    docs += [(5, docs[5][1])] * 2 + [(None, items[0][1]), (80, None), (81, ""), (82, "only"), (83, "two"), (84, "only two"), (85, "w1 " * 40)]
    return docs, items


@pytest.mark.parametrize("segment_bytes", [1, 3000, 1 << 22])
@pytest.mark.parametrize("broadcast_bytes", [0, 1 << 25])
def test_search_equals_brute_force(shipped, segment_bytes, broadcast_bytes):
    docs, items = _fixture()
    d, i = _tables(shipped, docs, items)
    got = dc.find_contamination(d, i, within=16, segment_bytes=segment_bytes, broadcast_bytes=broadcast_bytes).collect()
    rows = sorted(((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"]), tuple(r["near_items"])) for r in got), key=repr)
    assert rows == _brute(docs, items, within=16)
    for r in got:
        assert sum(s["n_words"] for s in r["spans"]) == r["n_hit"]
        assert all(a["first_word"] + a["n_words"] < b["first_word"] for a, b in zip(r["spans"], r["spans"][1:]))


def test_small_blocks_of_candidates(monkeypatch):
    monkeypatch.setattr(dc, "MAX_CANDIDATES", 5)
    docs, items = _fixture()
    windows = dc.Windows.of_items([(str(i), dc.words_of(t)) for i, t in items if t], 10)
    words = dc.Words([(t or "").encode() for _, t in docs])
    base = np.concatenate([[0], np.cumsum(np.diff(words.bounds) + 1)])
    seg = dc.Segment(windows, *dc._postings(words, windows.vocabulary, base), base[:-1], np.diff(words.bounds))
    small = {*zip(*(x.tolist() for x in seg.phrases()))}
    monkeypatch.setattr(dc, "MAX_CANDIDATES", 1 << 20)
    assert small and small == {*zip(*(x.tolist() for x in seg.phrases()))}


def test_report_and_query(shipped):
    got = sorted(map(tuple, op12_decontamination(shipped, SMALL).collect()))
    docs, items = (shipped.read.parquet(f"{SMALL}/{t}.parquet").select(i, "text").collect()
                   for t, i in (("documents", "doc_id"), ("benchmark", "item_id")))
    want = _brute([tuple(r) for r in docs], [tuple(r) for r in items])
    assert got == sorted((d, n, h, len(f), hashlib.sha256(",".join(f).encode()).hexdigest(), h > 0) for d, n, h, f, _ in want)
    assert any(r[5] for r in got)


def test_empty_tables(shipped):
    docs, items = _fixture()
    none_d, none_i = _tables(shipped, [], [])
    d, i = _tables(shipped, docs, items)
    for limit in (0, 1 << 25):
        assert dc.find_contamination(none_d, i, broadcast_bytes=limit).collect() == []
        assert {r["n_hit"] for r in dc.find_contamination(d, none_i, broadcast_bytes=limit, within=12).collect()} == {0}


def test_words_are_exact_even_if_hashes_collide(monkeypatch):
    texts = ["Alpha beta_GAMMA 12 " + "x" * 100 + " " + "x" * 99 + "y", "", "été ÉTÉ beta"]
    plain = [w for t in texts for w in dc.words_of(t)]
    assert [w.decode() for w in plain] == [w for t in texts for w in _words(t)]
    words = dc.Words([t.encode() for t in texts])
    assert [words.word(i) for i in range(len(plain))] == plain
    monkeypatch.setattr(dc, "mix64", lambda x: x * 0)
    monkeypatch.setattr(dc.xxhash, "xxh3_64_intdigest", lambda b: 0)
    words = dc.Words([t.encode() for t in texts])
    base = np.concatenate([[0], np.cumsum(np.diff(words.bounds) + 1)])
    terms, offsets, places = dc._postings(words, None, base)
    assert sorted(terms) == sorted(set(plain)) and offsets[-1] == len(plain)
    assert places[offsets[terms.index(b"beta")]:offsets[terms.index(b"beta") + 1]].tolist() == [1, base[2] + 2]
    vocabulary = dc.Vocabulary([b"beta"])
    assert (vocabulary.find(words) == 0).sum() == 2
