import hashlib
import math
import random

import numpy as np
import pytest

from seqtok.llm import vector_codes as vc
from seqtok.llm.queries import op13_vector_codes

from llm_fixtures import SMALL

pytest_plugins = ["llm_fixtures"]


def _brute(rows, parts=4, entries=256, rounds=4, scale=1024):
    """(vec_id, code, error, label_error, digest) of every kept row, by plain loops over Python integers."""
    kept = [(i, [math.floor(x * scale) if abs(x) < 1e300 else int(x) * scale for x in v], y) for i, v, y in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    by_id = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    size = len(by_id[0][1])
    good = [r for r in by_id if len(r[1]) == size]
    cuts = [size * p // parts for p in range(parts + 1)]
    books = [[r[1][a:b] for r in good[:entries]] for a, b in zip(cuts, cuts[1:])]

    def near(book, part):
        return min((sum((x - y) ** 2 for x, y in zip(part, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p, (a, b) in enumerate(zip(cuts, cuts[1:])):
            own = {}
            for _, v, _ in good:
                own.setdefault(near(books[p], v[a:b])[1], []).append(v[a:b])
            books[p] = [[sum(c) // len(own[k]) for c in zip(*own[k])] if k in own else e for k, e in enumerate(books[p])]
    digest = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    out, label = [], {}
    for i, v, y in kept:
        if len(v) != size:
            out.append([i, None, None, y])
            continue
        hits = [near(books[p], v[a:b]) for p, (a, b) in enumerate(zip(cuts, cuts[1:]))]
        error = sum(d for d, _ in hits)
        error = error if error < 1 << 63 else None
        out.append([i, "".join(f"{k:02x}" for _, k in hits), error, y])
    for _, _, e, y in out:
        if e is not None:
            label[y] = label.get(y, 0) + e
    return sorted(((i, c, e, label.get(y), digest) for i, c, e, y in out), key=repr)


def _got(df):
    return sorted(map(tuple, df.collect()), key=repr)


def _frame(spark, rows):
    return spark.createDataFrame([(i, v, y, "x", "y") for i, v, y in rows],
                                 "vec_id long, embedding array<double>, label int, code string, Error string")


def test_query_equals_brute_force_on_a_table(shipped):
    rows = shipped.read.parquet(f"{SMALL}/embeddings.parquet").select("vec_id", "embedding", "label").collect()
    assert _got(op13_vector_codes(shipped, SMALL)) == _brute([tuple(r) for r in rows])


@pytest.mark.parametrize("levels", [3, 1000])
def test_ties_copies_and_bad_rows(shipped, levels, monkeypatch):
    monkeypatch.setattr(vc, "BLOCK_ROWS", 50)
    rng = random.Random(levels)
    rows = [(rng.randrange(500), [rng.randrange(-levels, levels) / levels for _ in range(10)], rng.choice([1, 2, None]))
            for _ in range(600)]
    rows += [(7, rows[0][1], 1)] * 40 + [(None, rows[1][1], 3), (1000, None, 1), (1001, [None] * 10, 1), (1002, [float("nan")] * 10, 1),
             (1003, [float("inf")] + [0.0] * 9, 1), (1004, [0.5], 1), (1005, [], 2)]
    assert _got(vc.compress(_frame(shipped, rows))) == _brute(rows)


def test_large_components_are_exact(shipped):
    rng = random.Random(5)
    rows = [(i, [rng.choice([-1, 1]) * rng.random() * 10 ** rng.choice([0, 6, 9, 12, 200]) for _ in range(4)], i % 3) for i in range(300)]
    assert _got(vc.compress(_frame(shipped, rows))) == _brute(rows)


def test_empty_table_and_empty_vectors(shipped):
    assert vc.compress(_frame(shipped, [])).collect() == []
    assert vc.compress(_frame(shipped, [(1, None, 1)])).collect() == []
    rows = [(1, [], 1), (2, [], None), (3, [0.5], None)]
    assert _got(vc.compress(_frame(shipped, rows))) == _brute(rows)


@pytest.mark.parametrize("kind", ["grid", "equal", "line", "spread"])
def test_tree_equals_scan_and_saves_distances(kind, monkeypatch):
    rng = np.random.default_rng(3)
    make = {"grid": lambda n: rng.integers(-2, 3, (n, 3)), "equal": lambda n: np.ones((n, 3), dtype=np.int64),
            "line": lambda n: np.stack([rng.integers(0, 900, n)] * 3, 1), "spread": lambda n: rng.integers(-10**8, 10**8, (n, 3))}[kind]
    entries, points = make(256).astype(np.int64), make(700).astype(np.int64)
    measured = []
    plain = vc._squares
    monkeypatch.setattr(vc, "_squares", lambda p, e: measured.append(len(p) * len(e)) or plain(p, e))
    tree = vc.Gnat(entries)
    measured.clear()
    who, best = tree.nearest(points)
    squares = plain(points, entries)
    assert (who == squares.argmin(axis=1)).all() and (best == squares.min(axis=1)).all()
    if kind != "equal":
        assert sum(measured) < squares.size * 0.75
    slow, exact = vc.Gnat(entries.astype(object)).nearest(points.astype(object))
    assert (slow == who).all() and (exact == best).all()


def test_codes_decode_to_entries(shipped):
    rows = [(i, [i / 8, -i / 4, 1.0, 0.25], 0) for i in range(20)]
    vectors = vc.finite_vectors(_frame(shipped, rows).drop("code", "Error"), "embedding")
    model = vc.learn_codebooks(vectors, "vec_id", parts=2, entries=20, rounds=0)
    back = vc.decode(vc.encode(vectors, model), model).orderBy("vec_id").collect()
    assert [r["vector"] for r in back] == [r["embedding"] for r in back] and {r["error"] for r in back} == {0}
