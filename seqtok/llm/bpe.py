"""Byte-level BPE encoding and decoding with a given rank file.

Method: every text is cut by the tokenizer's pattern; the distinct pieces that a worker
has not met yet are put into length-bucketed, padded numpy matrices of token ids. Each
round looks up the rank of every adjacent pair in an open-addressing hash table, merges
the leftmost pair of least rank in every row, and drops finished rows (compaction).
Pieces longer than ``MATRIX_BYTES`` merge in the same order through a heap of pairs,
so one very long run of letters costs n log n instead of n squared.

The rank file is read once on the driver and broadcast (its size is checked). Documents
are never shuffled. Decoding goes from ids back to bytes through a flat token-byte array.

Rows: null text counts as empty; an empty text has no tokens, the hash of the empty
string, and decodes to nothing. Repeated rows, null ids and further columns pass through.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from seqtok.llm.common import pieces, text_column

MAX_RANK_FILE_BYTES = 64 << 20
MATRIX_BYTES = 1024        # pieces up to this length are merged in matrices
MATRIX_CELLS = 1 << 20
CACHE_PIECES = 400_000     # distinct pieces a worker remembers before it starts anew
_NONE = np.int32(2**31 - 1)


class PairTable:
    """Open-addressing hash table from an id pair to the id of the merged token."""

    def __init__(self, pairs: np.ndarray, values: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(max(2, len(pairs)) * 2.5))))
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys = np.full(1 << bits, -1, dtype=np.int64)
        self.values = np.full(1 << bits, _NONE, dtype=np.int32)
        todo, slot = np.arange(len(pairs)), self._slot(pairs)
        while len(todo):
            free = todo[self.keys[slot[todo]] < 0]
            self.keys[slot[free]] = pairs[free]        # of several rivals one stays
            self.values[slot[free]] = values[free]
            todo = todo[self.keys[slot[todo]] != pairs[todo]]
            slot[todo] = (slot[todo] + 1) & self.mask

    def _slot(self, pairs: np.ndarray) -> np.ndarray:
        h = pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (h >> self.shift).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged id per pair; ``_NONE`` where the pair does not merge."""
        pair = (left.astype(np.int64) << 32) | (right.astype(np.int64) & 0xFFFFFFFF)
        flat = np.ascontiguousarray(pair).ravel()
        out = np.full(flat.shape, _NONE, dtype=np.int32)
        todo = np.flatnonzero((flat >= 0) & ((flat & 0x80000000) == 0))
        slot = self._slot(flat[todo])
        while len(todo):
            found = self.keys[slot]
            hit = found == flat[todo]
            out[todo[hit]] = self.values[slot[hit]]
            go = ~hit & (found >= 0)
            todo, slot = todo[go], (slot[go] + 1) & self.mask
        return out.reshape(pair.shape)


class ByteBpe:
    """Ranks, pair table and a cache of encoded pieces; one per Python worker."""

    def __init__(self, rank_file: bytes, pattern: str):
        ranks = {base64.b64decode(a): int(b) for a, b in
                 (line.split() for line in rank_file.splitlines() if line)}
        pairs, merged = [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs.append((a << 32) | b)
                    merged.append(rank)
        self.table = PairTable(np.array(pairs, dtype=np.int64), np.array(merged, dtype=np.int32))
        self.byte_id = np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int32)
        size = max(ranks.values()) + 1
        token = [b""] * size
        for k, v in ranks.items():
            token[v] = k
        self.token_len = np.array([len(t) for t in token], dtype=np.int64)
        self.token_start = np.concatenate([[0], np.cumsum(self.token_len)[:-1]])
        self.token_bytes = np.frombuffer(b"".join(token), dtype=np.uint8)
        self.find = regex.compile(pattern).findall
        self.reset()

    def reset(self) -> None:
        self.index = _Numbering()
        self.ids = _Ragged()
        self.text: list[str] = []

    # --- encoding of distinct pieces

    def _merge_matrix(self, rows: np.ndarray) -> list[np.ndarray]:
        """Merge all rows (ids, padded with -1 on the right) to the end."""
        done: list[np.ndarray] = [None] * len(rows)
        at = np.arange(len(rows))
        rank = self.table.get(rows[:, :-1], rows[:, 1:])
        while len(at):
            if rows.shape[1] < 2:
                break
            j = rank.argmin(axis=1)                       # leftmost least rank
            n = np.arange(len(at))
            best = rank[n, j]
            over = best == _NONE
            if over.any():
                for i in np.flatnonzero(over):
                    done[at[i]] = rows[i][rows[i] >= 0]
                keep = ~over                              # compaction of rows
                rows, rank, at, j, best = rows[keep], rank[keep], at[keep], j[keep], best[keep]
                if not len(at):
                    return done
                width = int((rows >= 0).sum(axis=1).max())
                rows, rank = rows[:, :width], rank[:, :max(0, width - 1)]
                n = np.arange(len(at))
            rows = rows.copy()
            rows[n, j] = best
            cols = np.arange(rows.shape[1] - 1)
            after = cols[None, :] > j[:, None]
            rows = np.take_along_axis(rows, cols[None, :] + after, axis=1)
            cols = cols[:-1]
            if len(cols):
                rank = np.take_along_axis(rank, cols[None, :] + (cols[None, :] > j[:, None]), axis=1)
                left = np.flatnonzero(j > 0)
                rank[left, j[left] - 1] = self.table.get(rows[left, j[left] - 1], rows[left, j[left]])
                right = np.flatnonzero(j < rank.shape[1])
                rank[right, j[right]] = self.table.get(rows[right, j[right]], rows[right, j[right] + 1])
            else:
                rank = np.full((len(rows), 0), _NONE, dtype=np.int32)
        for i, r in zip(at, rows):
            done[i] = r[r >= 0]
        return done

    def _merge_long(self, ids: np.ndarray) -> np.ndarray:
        """The same merges for one long piece: a heap of (rank, place) over a linked list."""
        val = ids.tolist()
        n = len(val)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        first = self.table.get(ids[:-1], ids[1:])
        heap = [(int(r), i, val[i], val[i + 1]) for i, r in enumerate(first) if r != _NONE]
        heapq.heapify(heap)
        known: dict[tuple[int, int], int] = {}

        def push(i: int) -> None:
            j = nxt[i]
            if j >= n:
                return
            pair = (val[i], val[j])
            if pair not in known:
                known[pair] = int(self.table.get(np.array([pair[0]]), np.array([pair[1]]))[0])
            if known[pair] != _NONE:
                heapq.heappush(heap, (known[pair], i, *pair))

        while heap:
            r, i, a, b = heapq.heappop(heap)
            if val[i] != a or nxt[i] >= n or val[nxt[i]] != b:
                continue                                  # one of the two has merged already
            j = nxt[i]
            val[i], val[j] = r, -1
            nxt[i] = nxt[j]
            if nxt[j] < n:
                prv[nxt[j]] = i
            if prv[i] >= 0:
                push(prv[i])
            push(i)
        return np.array([v for v in val if v >= 0], dtype=np.int32)

    def _encode_new(self) -> None:
        words = self.index.pending
        if not words:
            return
        raw = [w.encode("utf-8") for w in words]
        size = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        out: list[np.ndarray] = [None] * len(raw)
        order = np.argsort(size, kind="stable")
        at = 0
        while at < len(order):
            width = int(size[order[at]])
            if width > MATRIX_BYTES:
                i = int(order[at])
                out[i] = self._merge_long(self.byte_id[np.frombuffer(raw[i], dtype=np.uint8)])
                at += 1
                continue
            top = max(2, width + max(1, width // 4))       # lengths of one bucket
            stop = min(int(np.searchsorted(size[order], top, side="right")),
                       at + max(1, MATRIX_CELLS // top))
            some = order[at:stop]
            rows = np.full((len(some), int(size[some[-1]])), -1, dtype=np.int32)
            inside = np.arange(rows.shape[1])[None, :] < size[some][:, None]
            rows[inside] = self.byte_id[np.frombuffer(b"".join(raw[i] for i in some), dtype=np.uint8)]
            for i, ids in zip(some, self._merge_matrix(rows)):
                out[i] = ids
            at = stop
        self.ids.extend(out)
        self.text.extend(" ".join(map(str, ids.tolist())) for ids in out)
        self.index.pending = []

    # --- texts

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """``(ids, bounds, decimal)``: ids of all texts in one array, each text's bounds
        in it, and each text's ids as decimals joined by a space."""
        if len(self.text) > CACHE_PIECES:
            self.reset()
        number = self.index.__getitem__
        found = [np.array(list(map(number, self.find(t))) if t else [], dtype=np.int64) for t in texts]
        self._encode_new()
        get = self.text.__getitem__
        decimal = [" ".join(map(get, f.tolist())) for f in found]
        piece = np.concatenate(found) if found else np.zeros(0, dtype=np.int64)
        ids, sizes = self.ids.take(piece)
        per_piece = np.concatenate([[0], np.cumsum(sizes)])
        bounds = per_piece[np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int64)]
        return ids, bounds, decimal

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all texts in one array and each text's bounds in it."""
        sizes = self.token_len[ids]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        place = np.repeat(self.token_start[ids] - ends[:-1], sizes) + np.arange(ends[-1])
        return self.token_bytes[place], ends[bounds]


class _Numbering(dict):
    """Numbers pieces in the order of their first appearance."""

    def __init__(self):
        super().__init__()
        self.pending: list[str] = []

    def __missing__(self, piece: str) -> int:
        self[piece] = n = len(self)
        self.pending.append(piece)
        return n


class _Ragged:
    """Growing list of id arrays kept flat."""

    def __init__(self):
        self.flat = np.zeros(0, dtype=np.int32)
        self.start = np.zeros(0, dtype=np.int64)
        self.size = np.zeros(0, dtype=np.int64)

    def extend(self, arrays: list[np.ndarray]) -> None:
        size = np.fromiter(map(len, arrays), dtype=np.int64, count=len(arrays))
        start = len(self.flat) + np.cumsum(size) - size
        self.flat = np.concatenate([self.flat, *arrays]).astype(np.int32)
        self.start = np.concatenate([self.start, start])
        self.size = np.concatenate([self.size, size])

    def take(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = self.size[which]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        place = np.repeat(self.start[which] - (ends - sizes), sizes) + np.arange(total)
        return self.flat[place], sizes


_WORKER: dict[tuple[int, str], ByteBpe] = {}


def _tokenizer(rank_file: bytes, pattern: str) -> ByteBpe:
    key = (hash(rank_file), pattern)
    if key not in _WORKER:
        _WORKER.clear()
        _WORKER[key] = ByteBpe(rank_file, pattern)
    return _WORKER[key]


def load_ranks(spark: SparkSession, path: str):
    """Broadcast of the rank file (base64 token and rank per line), its size checked."""
    with open(path, "rb") as f:
        data = f.read(MAX_RANK_FILE_BYTES + 1)
    if len(data) > MAX_RANK_FILE_BYTES:
        raise ValueError(f"rank file {path} is larger than {MAX_RANK_FILE_BYTES} bytes")
    return spark.sparkContext.broadcast(data)


def _with_columns(df: DataFrame, extra: list[tuple[str, T.DataType]]) -> T.StructType:
    names = {n.lower() for n, _ in extra}
    kept = [f for f in df.schema.fields if f.name.lower() not in names]
    return T.StructType([*kept, *(T.StructField(n, t) for n, t in extra)])


def encode_texts(df: DataFrame, rank_path: str, pattern: str, text_col: str = "text",
                 ids_col: str = "ids") -> DataFrame:
    """``df`` with the token ids of each text in ``ids_col`` (array of int); a column of
    that name in the input is replaced."""
    ranks = load_ranks(df.sparkSession, rank_path)
    schema = _with_columns(df, [(ids_col, T.ArrayType(T.IntegerType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _tokenizer(ranks.value, pattern)
        for batch in batches:
            texts = text_column(batch, text_col)
            for a, b in pieces(texts):
                ids, bounds, _ = bpe.encode(texts[a:b])
                cols = [batch.column(batch.schema.get_field_index(f.name)).slice(a, b - a)
                        for f in schema.fields[:-1]]
                arr = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([*cols, arr], names=schema.names)

    return df.mapInArrow(run, schema)


def decode_ids(df: DataFrame, rank_path: str, ids_col: str = "ids",
               out_col: str = "decoded") -> DataFrame:
    """``df`` with the bytes of each id list in ``out_col`` (binary; null ids: empty)."""
    ranks = load_ranks(df.sparkSession, rank_path)
    schema = _with_columns(df, [(out_col, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _tokenizer(ranks.value, r"\X")
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(ids_col)).to_pylist()
            sizes = [len(x or ()) for x in lists]
            ids = np.array([i for x in lists for i in (x or ())], dtype=np.int64)
            data, ends = bpe.decode(ids, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64))
            blob = data.tobytes()
            out = pa.array([blob[ends[i]:ends[i + 1]] for i in range(len(lists))], pa.binary())
            cols = [batch.column(batch.schema.get_field_index(f.name)) for f in schema.fields[:-1]]
            yield pa.RecordBatch.from_arrays([*cols, out], names=schema.names)

    return df.mapInArrow(run, schema)


def token_digests(df: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """Encode and decode every text; per row: id, ``n_tokens``, ``ids_sha256`` (decimal
    ids joined by one space) and ``decoded_sha256`` (the decoded bytes)."""
    ranks = load_ranks(df.sparkSession, rank_path)
    schema = T.StructType([
        T.StructField(id_col, df.schema[id_col].dataType), T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _tokenizer(ranks.value, pattern)
        for batch in batches:
            texts = text_column(batch, text_col)
            key = batch.column(batch.schema.get_field_index(id_col))
            for a, b in pieces(texts):
                ids, bounds, decimal = bpe.encode(texts[a:b])
                data, ends = bpe.decode(ids, bounds)
                view = memoryview(np.ascontiguousarray(data))
                yield pa.RecordBatch.from_arrays([
                    key.slice(a, b - a), pa.array(np.diff(bounds), pa.int64()),
                    pa.array([hashlib.sha256(d.encode()).hexdigest() for d in decimal]),
                    pa.array([hashlib.sha256(view[ends[i]:ends[i + 1]]).hexdigest()
                              for i in range(b - a)])], names=schema.names)

    return df.select(id_col, text_col).mapInArrow(run, schema)
