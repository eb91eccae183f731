"""Positive PMI and its factors against dense NumPy."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from seqtok.config import Params
from seqtok.operators.factors import learn_vectors, positive_pmi


def _sentences(seed):
    rng = random.Random(seed)
    groups = [[f"{g}{i}" for i in range(6)] for g in "abc"]
    return [[rng.choice(groups[s % 3]) if rng.random() < 0.9 else "hot" for _ in range(rng.choice([1, 4, 9]))] for s in range(200)]


def _brute(sentences, window):
    n = Counter()
    for s in sentences:
        for i, a in enumerate(s):
            for j in range(max(0, i - window), min(len(s), i + window + 1)):
                if i != j and a is not None and s[j] is not None:
                    n[a, s[j]] += 1
    alone, total = Counter(), sum(n.values())
    for (a, _), c in n.items():
        alone[a] += c
    pmi = {(a, b): math.log(c * total / (alone[a] * alone[b])) for (a, b), c in n.items()}
    return {p: (n[p], v) for p, v in pmi.items() if v > 0}


@pytest.mark.parametrize("limit", [64 << 20, 1])
def test_pmi_and_factors(spark, limit):
    sentences = [*_sentences(3), [None, "a1", None], ["lonely"], []]
    df = spark.createDataFrame([(s,) for s in sentences], "tokens array<string>")
    p = Params(broadcast_max_bytes=limit, salt_rows=40)
    pmi = positive_pmi(df, window_size=2, params=p)
    want = _brute(sentences, 2)
    got = {(r["token"], r["context"]): (r["n"], r["ppmi"]) for r in pmi.collect()}
    assert got.keys() == want.keys() and "lonely" not in {t for t, _ in got}
    assert all(got[k] == (want[k][0], pytest.approx(want[k][1])) for k in want)
    names = sorted({t for t, _ in want})
    dense = np.zeros((len(names), len(names)))
    for (a, b), (_, v) in want.items():
        dense[names.index(a), names.index(b)] = v
    values, basis = np.linalg.eigh(dense)
    top = np.argsort(-np.abs(values))[:4]
    vectors, singular = learn_vectors(pmi, dim=4, iterations=60, tolerance=1e-10, params=p)
    assert np.allclose(singular, np.abs(values[top]), rtol=1e-6)
    rows = {r["token"]: np.array(r["vector"]) for r in vectors.collect()}
    assert sorted(rows) == names
    mine = np.stack([rows[t] for t in names])
    ours = basis[:, top] * np.sqrt(np.abs(values[top]))
    assert np.allclose(np.abs(mine.T @ ours), np.diag(np.abs(values[top])), atol=1e-4)
    if limit > 1:
        again, _ = learn_vectors(pmi, dim=4, iterations=60, tolerance=1e-10, params=p)
        assert all(np.allclose(rows[r["token"]], r["vector"], atol=1e-6) for r in again.collect())


def test_vectors_of_one_group_are_alike_and_missing_directions_are_zero(spark):
    df = spark.createDataFrame([(["x", "y"],), (["x", "y"],), (["u", "v"],)], "tokens array<string>")
    vectors, singular = learn_vectors(positive_pmi(df, window_size=1), dim=6, iterations=30)
    rows = {r["token"]: np.array(r["vector"]) for r in vectors.collect()}
    assert len(rows) == 4 and abs(rows["x"] @ rows["u"]) < 1e-6 and all(len(v) == 6 for v in rows.values())
    assert np.allclose(singular[4:], 0, atol=1e-9)
    empty, none = learn_vectors(positive_pmi(spark.createDataFrame([], "tokens array<string>")), dim=3)
    assert empty.count() == 0 and none == [0.0, 0.0, 0.0]


def test_pairs_of_frequent_and_other_contexts(spark):
    from seqtok.operators.factors import _laid_out

    rnd = random.Random(8)
    cells = {(a, b): rnd.random() for a in range(12) for b in range(a, 12) if a < 3 or rnd.random() < 0.3}
    rows = [(f"t{a}", f"t{b}", x) for (a, b), x in cells.items()] + [(f"t{b}", f"t{a}", x) for (a, b), x in cells.items() if a != b]
    pmi = spark.createDataFrame(rows, "token string, context string, ppmi double")
    small = Params(broadcast_max_bytes=700)
    pairs = _laid_out(pmi, 10, small)
    assert pairs.near.count() > 0 and pairs.far.count() > 0 and pairs.near.count() + pairs.far.count() == len(rows)
    (a, s), (b, t) = (learn_vectors(pmi, dim=2, iterations=30, params=p) for p in (small, Params()))
    assert s == pytest.approx(t, rel=1e-6)
    got, want = ({r["token"]: r["vector"] for r in x.collect()} for x in (a, b))
    assert set(got) == set(want) == {f"t{i}" for i in range(12)}
    assert all(got[k] == pytest.approx(want[k], abs=1e-6) for k in got)
