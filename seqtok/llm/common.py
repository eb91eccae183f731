"""Helpers shared by the operators of this package.

Words: a text is lower-cased; its words are the maximal runs of ASCII letters, digits,
underscores and non-ASCII code points. Hashes of words and shingles are 64 bits and are
computed for a whole piece of a batch at once (numpy, no Python loop over words).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqtok.operators.lookup import size_in_bytes

PIECE_BYTES = 1 << 20      # text of one call of an operator's work on a batch
BLOCK_BYTES = 1 << 18      # text bytes hashed by one numpy pass
SHINGLE_WORDS = 5
BROADCAST_BYTES = 32 << 20

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_PAD_WORD = _U(0x5851F42D4C957F2D)
_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[128:] = True
for _c in b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_":
    _IS_WORD[_c] = True

_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift-multiply rounds) on uint64 arrays."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, int(n - 1).bit_length())
    if size not in _POWERS:
        if size > BLOCK_BYTES * 2:            # rare large block: not kept
            return _power_tables(n)
        _POWERS.clear()
        _POWERS[size] = _power_tables(size)
    return _POWERS[size]


def _power_tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, _BASE_INV):
        t = np.full(size, base, dtype=_U)
        t[0] = 1
        out.append(np.multiply.accumulate(t))
    return out[0], out[1]


def _block_words(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start offsets and hashes of the words of one byte block (ends in a non-word)."""
    is_word = _IS_WORD[buf]
    edges = np.flatnonzero(np.diff(is_word, prepend=False, append=False))
    starts, stops = edges[0::2], edges[1::2]
    if not len(starts):
        return starts.astype(np.int64), np.zeros(0, dtype=_U)
    power, inverse = _powers(len(buf))
    prefix = np.zeros(len(buf) + 1, dtype=_U)
    np.cumsum((buf.astype(_U) + _U(1)) * power[:len(buf)], out=prefix[1:])
    h = (prefix[stops] - prefix[starts]) * inverse[starts]
    return starts, mix64(h + (stops - starts).astype(_U) * _U(0xD6E8FEB86659FD93))


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """``(hashes, bounds)``: the words of text i are ``hashes[bounds[i]:bounds[i+1]]``."""
    raw = [b"" if t is None else t.lower().encode("utf-8", "replace") for t in texts]
    sizes = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
    doc_start = np.concatenate([[0], np.cumsum(sizes + 1)])
    buf = np.frombuffer(b"\n".join([*raw, b""]), dtype=np.uint8)
    starts, hashes, at = [], [], 0
    while at < len(buf):
        stop = min(len(buf), at + BLOCK_BYTES)
        while stop < len(buf):                # a block never ends inside a word
            gap = np.flatnonzero(~_IS_WORD[buf[stop:stop + BLOCK_BYTES]])
            if len(gap):
                stop += int(gap[0])
                break
            stop = min(len(buf), stop + BLOCK_BYTES)
        s, h = _block_words(buf[at:stop])
        starts.append(s + at)
        hashes.append(h)
        at = stop
    if not starts:
        return np.zeros(0, dtype=_U), np.zeros(len(texts) + 1, dtype=np.int64)
    start = np.concatenate(starts)
    return np.concatenate(hashes), np.searchsorted(start, doc_start).astype(np.int64)


def shingle_hashes(texts: list[str | None],
                   n: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """``(hashes, bounds)`` of all word n-grams in text order, repeats included. A text
    of 1..n-1 words has one shingle of all its words; a text without words has none."""
    words, bounds = word_hashes(texts)
    counts = np.diff(bounds)
    per_doc = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    out_bounds = np.concatenate([[0], np.cumsum(per_doc)]).astype(np.int64)
    total = int(out_bounds[-1])
    if not total:
        return np.zeros(0, dtype=_U), out_bounds
    first = np.repeat(bounds[:-1] - out_bounds[:-1], per_doc) + np.arange(total)
    end = np.repeat(bounds[1:], per_doc)
    padded = np.concatenate([words, np.full(n, _PAD_WORD, dtype=_U)])
    acc = np.zeros(total, dtype=_U)
    for k in range(n):
        w = padded[first + k]
        if k:
            w = np.where(first + k < end, w, _PAD_WORD)
        acc = acc * _U(_BASE) + w
    return mix64(acc), out_bounds


def pieces(texts: list[str | None], limit: int = PIECE_BYTES,
           rows: int = 4096) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` characters and at most ``rows`` rows each (a longer
    text is a range alone)."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > start and (size + n > limit or i - start >= rows):
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def text_column(batch: pa.RecordBatch, name: str) -> list[str | None]:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def append_columns(df: DataFrame, text_col: str, fields: list[T.StructField],
                   make: Callable[[], Callable[[list], list]], rows: int = 4096) -> DataFrame:
    """``df`` with further columns computed from its texts, in place (no shuffle).

    ``make()`` runs once per task and gives a function from a list of texts to one arrow
    array (or list) per field. A column of ``df`` with a new field's name is replaced.
    """
    new = {f.name.lower() for f in fields}
    kept = [f for f in df.schema.fields if f.name.lower() not in new]
    schema = T.StructType([*kept, *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = None
        for batch in batches:
            work = work or make()
            texts = text_column(batch, text_col)
            for a, b in pieces(texts, rows=rows):
                cols = [batch.column(batch.schema.get_field_index(f.name)).slice(a, b - a) for f in kept]
                cols += [x if isinstance(x, pa.Array) else pa.array(x) for x in work(texts[a:b])]
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return df.mapInArrow(run, schema)


def sample_by_hash(rows: DataFrame, group: str, key: str, k: int, ties: tuple[str, ...] = ()) -> DataFrame:
    """The ``k`` rows of each ``group`` with the least ``key`` (a 64-bit hash column).

    Rows whose hash lies above the share of the hash range in which ``k`` and a margin of six
    standard deviations of the group's rows are expected go first, so a group with most of the
    rows brings little more than ``k`` rows to its task, not all.
    """
    counts = rows.groupBy(F.col(group).alias("__sg")).agg(F.count(F.lit(1)).alias("__sn"))
    if size_in_bytes(counts) <= BROADCAST_BYTES:
        counts = F.broadcast(counts)
    share = F.col(key).cast("double") / float(1 << 64) + F.lit(0.5)
    low = rows.join(counts, F.col(group).eqNullSafe(F.col("__sg"))).where(
        share * F.col("__sn") <= k + 6 * k ** 0.5 + 16)
    first = Window.partitionBy(group).orderBy(key, *ties)
    return (low.withColumn("__srank", F.row_number().over(first)).where(F.col("__srank") <= k)
               .drop("__sg", "__sn", "__srank"))
