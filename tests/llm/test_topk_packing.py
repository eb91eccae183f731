import itertools
import math
import random

import pytest

from seqtok.llm import packing as pk
from seqtok.llm import topk

pytest_plugins = ["llm_fixtures"]


def _brute(rows, every, k):
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows
          if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for qi in sorted({i for i, _ in ok if i % every == 0}):
        q = min(v for i, v in ok if i == qi)
        best = sorted((-sum(a * b for a, b in zip(q, v)), i) for i, v in ok if i != qi)[:k]
        out += [(qi, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return out


@pytest.mark.parametrize("block", [3, 20_000])
def test_topk_equals_brute_force(shipped, block, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 7)
    rng = random.Random(4)
    rows = [(i, [rng.choice([0.0, 0.5, -0.25, rng.uniform(-1, 1)]) for _ in range(6)]) for i in range(90)]
    rows += [(200, [0.1, None]), (210, None), (220, [float("nan")]), (230, [float("inf"), 1.0]), (None, [1.0]),
             (240, []), (241, [0.5]), (250, rows[0][1]), (251, rows[0][1]), (10, rows[10][1])]
    df = shipped.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, rank string")
    v = topk.integer_vectors(df, "vec_id", "embedding")
    got = topk.top_k(v.where("id % 10 = 0"), v, 5, block).collect()
    assert sorted(map(tuple, got)) == _brute(rows, 10, 5)


def test_scores_beyond_64_bits_rank_exactly(shipped):
    rng = random.Random(9)
    rows = [(i, [rng.choice([-1, 1]) * rng.random() * 10 ** rng.choice([0, 3, 12, 30]) for _ in range(3)]) for i in range(40)]
    rows += [(100, [1e12, 0.0, 0.0]), (110, [1e12, 0.0, 0.0]), (120, [0.5, 0.5]), (130, [0.25, 0.0, 0.0])]
    df = shipped.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, topk.search_multiples(df, every=10).collect()))
    want = [(q, r, i, s if -(1 << 63) <= s < 1 << 63 else None) for q, r, i, s in _brute(rows, 10, 5)]
    assert got == sorted(want) and any(r[3] is None for r in got) and any(r[3] is not None for r in got)


def test_topk_without_rows(shipped):
    df = shipped.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.search_multiples(df).collect() == []
    one = shipped.createDataFrame([(50, [1.0])], "vec_id long, embedding array<float>")
    assert topk.search_multiples(one).collect() == []


def _padding(lengths, bounds):
    return sum(min(b for b in bounds if b >= n) - n for n in lengths)


def test_boundaries_are_optimal():
    rng = random.Random(1)
    for trial in range(20):
        lengths = [rng.randint(0, 12) for _ in range(30)]
        hist = [(n, lengths.count(n), n * lengths.count(n)) for n in sorted(set(lengths))]
        for k in (1, 2, 3, 4):
            best = min(_padding(lengths, [*c, max(lengths)])
                       for r in range(k) for c in itertools.combinations(sorted(set(lengths))[:-1], r))
            bounds = pk.optimal_boundaries(hist, k)
            assert len(bounds) <= k and _padding(lengths, bounds) == best
    assert pk.optimal_boundaries([], 4) == []


def test_batches_hold_every_row_within_budget(shipped):
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.choice([1, 5, 40, 41, 300, 2000])), "k") for i in range(400)]
    rows += [(500, None, "k"), (501, "", "k"), (None, "a b", "k"), (3, rows[3][1], "k"), (502, "w " * 5000, "k")]
    df = shipped.createDataFrame(rows, "doc_id long, text string, bucket string")
    got = pk.pack_documents(df, n_buckets=4, token_budget=1000, shard_rows=50).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in got) == sorted((str(i), len((t or "").split())) for i, t, _ in rows)
    batches = {}
    for r in got:
        assert r.padding == r.bucket_len - r.n_tokens >= 0
        batches.setdefault((r.bucket, r.shard, r.batch), []).append(r)
    for b in batches.values():
        assert len(b) == 1 or len(b) * b[0].bucket_len <= 1000
        assert sorted(r.slot for r in b) == list(range(len(b)))
    last = {}
    for (bucket, shard, n), b in batches.items():
        last[bucket, shard] = max(n, last.get((bucket, shard), 0))
    for (bucket, shard, n), b in batches.items():
        if n < last[bucket, shard]:
            assert len(b) == max(1, 1000 // max(1, b[0].bucket_len))
    assert len({r.shard for r in got}) > 1
    assert pk.pack_documents(df.limit(0)).collect() == []


def test_carried_columns_and_histogram(shipped):
    df = shipped.createDataFrame([(1, "a b c", "x")], "doc_id long, text string, lang string")
    assert pk.pack_documents(df, carry=("text", "lang")).collect()[0].lang == "x"
    sizes = shipped.range(0, 100_000).selectExpr("id as __len")
    hist = pk.length_histogram(sizes)
    assert [tuple(h) for h in hist] == [(n, 1, n) for n in range(100_000)]       # exact at any number of lengths


def test_null_lengths_and_clashing_names(shipped):
    df = shipped.createDataFrame([(1, 5, "x", "k"), (2, None, "y", "k")], "doc_id long, size int, Bucket string, kept string")
    got = pk.pack_documents(df, length=df["size"], carry=("Bucket", "kept", "DOC_ID"))
    assert got.columns == ["doc_id", *pk.RESULT, "kept"]
    assert {r.doc_id: (r.n_tokens, r.bucket_len - r.padding) for r in got.collect()} == {1: (5, 5), 2: (0, 0)}
    with pytest.raises(ValueError, match="id column"):
        pk.pack_documents(df, id_col="Bucket", length=df["size"])


def test_long_lengths_are_cut_exactly(shipped):
    # 4,100 and 4,126 lie in one cell of 1/128 relative width: a cut between them has to be found
    sizes = shipped.createDataFrame([(n,) for n in [4100] * 500 + [4126] + [300, 1000, 9000]], "__len long")
    hist = pk.length_histogram(sizes)
    assert [h[0] for h in hist] == [300, 1000, 4100, 4126, 9000]
    assert 4100 in pk.optimal_boundaries(hist, 3)


@pytest.mark.parametrize("k", [2, 7, 16])
def test_divide_and_conquer_equals_all_cuts(k):
    rng = random.Random(k)
    for n in (1, 2, 60, 257):
        tops = sorted(rng.sample(range(9000), n))
        hist = [(t, c, t * c) for t, c in ((t, rng.choice([1, 3, 900])) for t in tops)]
        lengths = [t for t, c, _ in hist for _ in range(c)]
        cost = lambda i, j: sum(c * (tops[j] - t) for t, c, _ in hist[i:j + 1])
        best = [cost(0, j) for j in range(n)]
        table = [[cost(i, j) for j in range(n)] for i in range(n)]
        for _ in range(k - 1):
            best = [min([table[0][j], *(best[i - 1] + table[i][j] for i in range(1, j + 1))]) for j in range(n)]
        bounds = pk.optimal_boundaries(hist, k)
        assert len(bounds) <= k and _padding(lengths, bounds) == best[-1]
