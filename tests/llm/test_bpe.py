import base64
import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from seqtok.llm import bpe

pytest_plugins = ["llm_fixtures"]

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def both():
    with open(PATH, "rb") as f:
        data = f.read()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
    return bpe.ByteBpe(data, P.PATTERN), tiktoken.Encoding(
        "own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _check(own, lib, texts):
    ids, bounds, decimal = own.encode(texts)
    data, ends = own.decode(ids, bounds)
    for i, t in enumerate(texts):
        want = lib.encode_ordinary(t or "")
        assert ids[bounds[i]:bounds[i + 1]].tolist() == want
        assert decimal[i] == " ".join(map(str, want))
        assert data[ends[i]:ends[i + 1]].tobytes() == (t or "").encode()


def test_odd_texts_equal_the_library(both):
    _check(*both, ["", None, "don't I'LL we've", "a" * 5000, "ab" * 3000 + "é" * 900, "\n\n  \t x ",
                   "😀👍🏽 zwj‍x", "=-" * 2000, "\x1c\x1d   x　y\u0085z", "١٢٣ ⅷ ½", "<|endoftext|>"])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=80), max_size=5))
def test_any_text_equals_the_library(both, texts):
    _check(*both, texts)


def test_matrix_and_heap_merge_alike(both):
    own, _ = both
    rng = np.random.default_rng(3)
    for n in (2, 7, 100, 900):
        ids = own.byte_id[rng.choice(np.frombuffer(b"aeinorst th", np.uint8), n)]
        assert own._merge_long(ids).tolist() == own._merge_matrix(ids[None, :])[0].tolist()


def test_cache_is_bounded_and_harmless(both, monkeypatch):
    own, lib = both
    monkeypatch.setattr(bpe, "CACHE_PIECES", 3)
    _check(own, lib, ["one two three four five"])
    _check(own, lib, ["six two seven"])


def test_query_and_round_trip_over_a_table(shipped, both):
    rows = [(1, "Hello world", "x"), (2, None, "y"), (2, "", "z"), (None, "é😀 é😀", None)]
    df = shipped.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted(((r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256)
                  for r in bpe.token_digests(df, PATH, P.PATTERN).collect()))
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for i, t, _ in rows:
        ids = both[1].encode_ordinary(t or "")
        want.append((i or 0, len(ids), sha(" ".join(map(str, ids)).encode()), sha((t or "").encode())))
    assert got == sorted(want)
    back = bpe.decode_ids(bpe.encode_texts(df, PATH, P.PATTERN), PATH)
    assert sorted((r.n_tokens or "", bytes(r.decoded)) for r in back.collect()) == sorted(
        (n or "", (t or "").encode()) for _, t, n in rows)
    assert bpe.token_digests(df.limit(0), PATH, P.PATTERN).count() == 0
