import hashlib

import numpy as np
from llm_fixtures import prose

from seqtok.llm import fingerprints as fp
from seqtok.llm.common import shingle_hashes

pytest_plugins = ["llm_fixtures"]


def _jaccard(a, b):
    x, y = (set(shingle_hashes([t])[0].tolist()) for t in (a, b))
    return len(x & y) / len(x | y) if x | y else 1.0


def test_estimate_follows_the_true_likeness():
    sk, errors = fp.Sketcher(), []
    for i in range(60):
        a = prose(i, 300)
        b = a[:int(len(a) * (0.3 + 0.7 * i / 60))] + " " + prose(1000 + i, 40)
        c, e = sk.codes([a, b])
        errors.append(sk.likeness(c[:1], c[1:], e[:1], e[1:])[0] - _jaccard(a, b))
    assert abs(np.mean(errors)) < 0.02 and np.max(np.abs(errors)) < 0.12


def test_sparse_and_dense_densification_agree(monkeypatch):
    texts = [prose(5, n) for n in (1, 3, 5, 6, 20, 45)]
    a = fp.Sketcher().codes(texts)[0]
    monkeypatch.setattr(fp, "SPARSE_BINS", 0)
    assert (a == fp.Sketcher().codes(texts)[0]).all()


def test_packed_form_and_empty_texts():
    sk = fp.Sketcher()
    packed = sk.pack(*sk.codes(["", None, "!!! ...", "one two", "one two", prose(1, 80)]))
    assert packed[:3] == ["", "", ""] and packed[3] == packed[4] and len(packed[5]) == 2 * fp.BINS * fp.BITS // 8
    assert fp.fingerprint_likeness("", "") == 1.0 and fp.fingerprint_likeness("", packed[3]) == 0.0
    assert fp.fingerprint_likeness(packed[3], packed[4]) == 1.0


def test_next_document_across_ranges(shipped, monkeypatch):
    monkeypatch.setattr(fp, "RANGE_BYTES", 300)
    rows = [(i * 37 % 101 - 20, prose(i, 1 + i % 30), "extra") for i in range(101)]
    rows += [(500, None, None), (501, "", "x"), (None, "null id first", "y")]
    df = shipped.createDataFrame(rows, "doc_id long, text string, __key string")
    assert len(fp._id_ranges(df.selectExpr("coalesce(doc_id, -9223372036854775808) as __key",
                                           "text as __text"))[1]) > 5
    got = {r.doc_id: r for r in fp.edit_fingerprints(df).collect()}
    order = sorted(rows, key=lambda r: -10**9 if r[0] is None else r[0])
    assert len(got) == len(rows)
    sk = fp.Sketcher()
    for (i, t, _), (_, nxt, _) in zip(order, [*order[1:], order[0]]):
        t, nxt = t or "", nxt or ""
        k = len(t) // 4
        edited = t[:len(t) - k] + nxt[:k]
        r = got[i]
        assert r.n_chars == len(t)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert [r.fingerprint, r.edited_fingerprint] == sk.pack(*sk.codes([t, edited]))
        assert abs(r.near_edited - fp.fingerprint_likeness(r.fingerprint, r.edited_fingerprint)) < 1e-9
        c, e = sk.codes([t, nxt])
        assert abs(r.near_next - sk.likeness(c[:1], c[1:], e[:1], e[1:])[0]) < 1e-9


def test_single_repeated_and_no_rows(shipped):
    one = shipped.createDataFrame([(7, "a b c d e f g h")], "doc_id long, text string")
    r = fp.edit_fingerprints(one).collect()
    assert len(r) == 1 and r[0].near_next == 1.0
    twice = fp.edit_fingerprints(one.union(one)).collect()
    assert len(twice) == 2 and twice[0] == twice[1]
    assert fp.edit_fingerprints(one.limit(0)).collect() == []
    kept = fp.with_fingerprints(one.selectExpr("doc_id", "text", "1 as score")).collect()[0]
    assert kept.score == 1 and kept.fingerprint == r[0].fingerprint
