"""Vector code compression: every vector becomes one small code per part.

A vector is turned into integers and cut into ``parts`` consecutive parts; each part position
has a codebook of at most 256 entries, learned by Lloyd rounds on all rows. The nearest entry of
a part (squared Euclidean distance, ties to the lower index) is found by a geometric
near-neighbour access tree over the entries: a node holds split points and, for every pair of
a split point and a child, the range of distances from that split point to the child's entries.
A query measured against the split points eliminates every child whose range proves it strictly
farther than the best entry so far. Roots and ranges are rounded so that no child goes by a
rounding error, and what stays is decided by exact integer distances, so ties are exact too.

Spark partitions the rows: a round is one pass over them, which returns one row of sums per
task, part and entry. Only codebooks (entries x dimension integers, a fixed size) meet on the driver.

Rows: vectors that are null or hold a null or non-finite component are dropped. The dimension is
that of the vector with the smallest id; vectors of another length stay without code and error
(null) and take no part in the codebooks. A dimension that the parts do not divide gives parts
whose lengths differ by one; empty vectors have distance 0 to every entry. Null ids sort last
among the starting entries, rows that share an id by their vector. Fewer rows than entries give
that many entries. Components too large for 64-bit distances are worked on as Python integers;
an error beyond 64 bits is null. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqtok.operators.lookup import join_totals
from seqtok.session import materialize

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
ARITY, LEAF = 8, 8         # LEAF >= ARITY
BLOCK_ROWS = 4096
_WORD = 32
_SLACK = 2.0 ** -50
_LONG = (1 << 63) - 1


# ---------------------------------------------------------------- exact distances, safe roots

def _squares(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances, one row per point; exact (int64 or Python integers)."""
    gap = points[:, None, :] - entries[None, :, :]
    if not gap.shape[2]:
        return np.zeros(gap.shape[:2], dtype=points.dtype)
    return (gap * gap).sum(axis=2)


_ISQRT = np.frompyfunc(math.isqrt, 1, 1)


def _roots(squares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A lower and an upper bound of every root."""
    if squares.dtype == object:
        low = _ISQRT(squares)
        return low, low + (low * low < squares).astype(int)
    root = np.sqrt(squares.astype(np.float64))
    return root * (1 - _SLACK), root * (1 + _SLACK)


def _farther(bound: np.ndarray, best: np.ndarray) -> np.ndarray:
    """Where a lower bound of a distance is surely above the best squared distance."""
    if best.dtype == object:
        return ((bound > 0) & (bound * bound > best)).astype(bool)
    b = bound * (1 - _SLACK)
    return (b > 0) & (b * b * (1 - _SLACK) > best.astype(np.float64) * (1 + _SLACK))


class Gnat:
    """Geometric near-neighbour access tree over the rows of ``entries``."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.root = self._build(np.arange(len(entries)))

    def _build(self, own: np.ndarray) -> tuple:
        """``(split points, children, low, high)``: ``low[i, j]`` and ``high[i, j]`` bound the
        distances from split point i to the entries of child j."""
        if len(own) <= LEAF:
            return own, [], None, None
        chosen = [0]
        near = _squares(self.entries[own], self.entries[own[:1]])[:, 0]
        while len(chosen) < ARITY:          # the entry farthest from all chosen ones
            rest = near.copy()
            rest[chosen] = -1
            chosen.append(int(np.argmax(rest)))
            near = np.minimum(near, _squares(self.entries[own], self.entries[own[chosen[-1:]]])[:, 0])
        chosen.sort()
        splits, others = own[chosen], np.delete(own, chosen)
        squares = _squares(self.entries[others], self.entries[splits])
        home = squares.argmin(axis=1)
        low, high = _roots(squares)
        groups = [j for j in range(ARITY) if (home == j).any()]
        return (splits, [self._build(others[home == j]) for j in groups],
                np.stack([low[home == j].min(axis=0) for j in groups], axis=1),
                np.stack([high[home == j].max(axis=0) for j in groups], axis=1))

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of the nearest entry of every point, ties to the lower index."""
        who = np.full(len(points), len(self.entries), dtype=np.int64)
        best = np.zeros(len(points), dtype=points.dtype)
        todo = [(self.root, np.arange(len(points)), None)]
        while todo:
            (splits, children, low, high), rows, bound = todo.pop()
            if bound is not None:           # the best may have come nearer since
                rows = rows[~_farther(bound, best[rows])]
            if not len(rows):
                continue
            squares = _squares(points[rows], self.entries[splits])
            at = squares.argmin(axis=1)
            found, index = squares[np.arange(len(rows)), at], splits[at]
            better = ((who[rows] == len(self.entries)) | (found < best[rows])
                      | ((found == best[rows]) & (index < who[rows]))).astype(bool)
            best[rows[better]], who[rows[better]] = found[better], index[better]
            if not children:
                continue
            below, above = _roots(squares)
            for j, child in enumerate(children):
                bound = np.maximum((low[None, :, j] - above).max(axis=1), (below - high[None, :, j]).max(axis=1))
                stay = ~_farther(bound, best[rows])
                if stay.any():
                    todo.append((child, rows[stay], bound[stay]))
        return who, best


# ---------------------------------------------------------------- rows

def finite_vectors(df: DataFrame, vec_col: str) -> DataFrame:
    """The rows whose vector is whole, with the vector as doubles in ``__v``."""
    x = F.col(vec_col)
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e.cast("double")) == float("inf")))
    return df.where(x.isNotNull() & ~bad).withColumn("__v", F.transform(x, lambda e: e.cast("double")))


def _integers(values: np.ndarray, scale: int, wide: bool) -> np.ndarray:
    """``floor(scale * x)``, exact."""
    if not wide:
        return np.floor(values * scale).astype(np.int64)
    out = np.empty(values.shape, dtype=object)
    for i, x in np.ndenumerate(values):
        top, bottom = float(x).as_integer_ratio()
        out[i] = top * scale // bottom
    return out


def _blocks(batch: pa.RecordBatch, size: int, scale: int, wide: bool) -> Iterator[tuple[int, int, np.ndarray]]:
    """``(start, stop, integer matrix)`` of the rows of a batch; ``__v`` has ``size`` components."""
    lists = batch.column(batch.schema.get_field_index("__v"))
    for at in range(0, batch.num_rows, BLOCK_ROWS):
        part = lists.slice(at, BLOCK_ROWS)
        flat = part.flatten().to_numpy(zero_copy_only=False)
        yield at, at + len(part), _integers(flat.reshape(len(part), size), scale, wide)


def _limbs(total: np.ndarray, words: int) -> np.ndarray:
    """Integers as ``words`` 32-bit pieces, lowest first, the last one signed."""
    out = []
    for _ in range(words - 1):
        out.append(total & ((1 << _WORD) - 1))
        total = total >> _WORD
    return np.stack([*out, total], axis=-1).astype(np.int64)


def _whole(limbs: np.ndarray) -> np.ndarray:
    total = np.zeros(limbs.shape[:-1], dtype=object)
    for k in range(limbs.shape[-1]):
        total = total + (limbs[..., k].astype(object) << (_WORD * k))
    return total


_SUMS = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("entry", T.IntegerType()),
                      T.StructField("n", T.LongType()), T.StructField("sums", T.ArrayType(T.LongType()))])


class Codebooks:
    """Integer codebooks of the part positions, with the tree of each."""

    def __init__(self, books: list[np.ndarray], scale: int, wide: bool):
        self.books, self.scale, self.wide = books, scale, wide
        self.cuts = np.concatenate([[0], np.cumsum([b.shape[1] for b in books])]).astype(int)
        self.trees = [Gnat(b) for b in books]

    def __reduce__(self):
        return Codebooks, (self.books, self.scale, self.wide)

    @property
    def size(self) -> int:
        return int(self.cuts[-1])

    def nearest(self, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Per part: the rows' part, its nearest entry, its squared distance."""
        for tree, a, b in zip(self.trees, self.cuts, self.cuts[1:]):
            part = rows[:, a:b]
            yield (part, *tree.nearest(part))

    def digest(self) -> str:
        """SHA-256 of all components by part, entry and position."""
        text = ",".join(str(int(c)) for book in self.books for entry in book for c in entry)
        return hashlib.sha256(text.encode()).hexdigest()


def _task_sums(shared, words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Codebooks = shared.value
        counts = [np.zeros(len(b), dtype=np.int64) for b in model.books]
        totals = [np.zeros(b.shape, dtype=b.dtype) for b in model.books]
        for batch in batches:
            for _, _, rows in _blocks(batch, model.size, model.scale, model.wide):
                for p, (part, who, _) in enumerate(model.nearest(rows)):
                    order = np.argsort(who, kind="stable")
                    entry, first = np.unique(who[order], return_index=True)
                    counts[p] += np.bincount(who, minlength=len(counts[p]))
                    if part.shape[1]:
                        totals[p][entry] += np.add.reduceat(part[order], first, axis=0)
        for p, (n, total) in enumerate(zip(counts, totals)):
            used = np.flatnonzero(n)
            if len(used):
                limbs = _limbs(total[used], words).reshape(len(used), -1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(used), p, np.int32)), pa.array(used.astype(np.int32)), pa.array(n[used]),
                     pa.array(list(limbs), type=pa.list_(pa.int64()))], names=_SUMS.names)

    return run


def _merge_sums(words: int):
    def run(table: pa.Table) -> pa.Table:
        rows = np.array(table.column("sums").to_pylist(), dtype=np.int64)
        total = _whole(rows.reshape(len(rows), -1, words).astype(object).sum(axis=0))
        n = sum(table.column("n").to_pylist())
        return pa.table({"part": table.column("part").slice(0, 1), "entry": table.column("entry").slice(0, 1),
                         "n": pa.array([n], pa.int64()),
                         "sums": pa.array([_limbs(total, words).reshape(-1).tolist()], pa.list_(pa.int64()))},
                        schema=pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()),
                                          ("sums", pa.list_(pa.int64()))]))

    return run


def learn_codebooks(vectors: DataFrame, id_col: str, parts: int = PARTS, entries: int = ENTRIES,
                    rounds: int = ROUNDS, scale: int = SCALE) -> Codebooks | None:
    """Codebooks of all rows of ``vectors`` (see ``finite_vectors``); None for an empty table.

    A part position starts with that part of the ``entries`` smallest ids. Each round assigns
    every row and replaces an entry by the floored mean of its rows; unused entries stay.
    """
    if not 1 <= entries <= 256:
        raise ValueError("1 to 256 entries")
    spark = vectors.sparkSession
    order = [F.col(id_col).asc_nulls_last(), F.col("__v").asc()]
    first = vectors.orderBy(*order).select("__v").limit(1).collect()
    if not first:
        return None
    size = len(first[0]["__v"])
    rows = vectors.where(F.size("__v") == size)
    start = rows.orderBy(*order).select("__v").limit(entries).collect()     # at most 256 vectors
    largest = rows.agg(F.max(F.array_max(F.transform("__v", lambda e: F.abs(e)))).alias("m")).first()["m"] or 0.0
    top = int(_integers(np.array([largest]), scale, True)[0]) + 1
    cuts = [size * p // parts for p in range(parts + 1)]
    width = max(b - a for a, b in zip(cuts, cuts[1:]))
    wide = top * top * 4 * max(width, 1) >= 1 << 62
    words = (top << 40).bit_length() // _WORD + 1            # sums of up to 2^40 rows
    matrix = _integers(np.array([r["__v"] for r in start], dtype=np.float64).reshape(len(start), size), scale, wide)
    model = Codebooks([matrix[:, a:b] for a, b in zip(cuts, cuts[1:])], scale, wide)
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(model)
        sums = (rows.select("__v").mapInArrow(_task_sums(shared, words), _SUMS)
                    .groupBy("part", "entry").applyInArrow(_merge_sums(words), _SUMS))
        books = [b.copy() for b in model.books]
        for r in sums.collect():                              # one row per part and entry
            total = _whole(np.array(r["sums"], dtype=np.int64).reshape(-1, words))
            books[r["part"]][r["entry"]] = total // r["n"]
        shared.unpersist()
        model = Codebooks(books, scale, wide)
    return model


def encode(vectors: DataFrame, model: Codebooks, code_col: str = "code", error_col: str = "error") -> DataFrame:
    """``vectors`` without ``__v``, with the code (two hex digits per part) and the squared
    distance to the coded vector. Columns of these names are replaced."""
    new = {"__v", code_col.lower(), error_col.lower()}
    kept = [f for f in vectors.schema.fields if f.name.lower() not in new]
    schema = T.StructType([*kept, T.StructField(code_col, T.StringType()), T.StructField(error_col, T.LongType())])
    shared = vectors.sparkSession.sparkContext.broadcast(model)
    fits = F.when(F.size("__v") == model.size, F.col("__v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book: Codebooks = shared.value
        digits = np.array([f"{i:02x}" for i in range(256)])
        for batch in batches:
            has = np.flatnonzero(batch.column(batch.schema.get_field_index("__v")).is_valid().to_numpy(zero_copy_only=False))
            code = np.full(batch.num_rows, None, dtype=object)
            error = np.full(batch.num_rows, None, dtype=object)
            for a, b, rows in _blocks(batch.take(pa.array(has)), book.size, book.scale, book.wide):
                text, total = np.full(b - a, "", dtype=object), np.zeros(b - a, dtype=object)
                for _, who, best in book.nearest(rows):
                    text = text + digits[who].astype(object)
                    total = total + best.astype(object)
                code[has[a:b]] = text
                error[has[a:b]] = [t if t <= _LONG else None for t in total]
            cols = [batch.column(batch.schema.get_field_index(f.name)) for f in kept]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(code, pa.string()), pa.array(error, pa.int64())],
                                             names=schema.names)

    return vectors.select(*[F.col(f"`{f.name}`") for f in kept], fits.alias("__v")).mapInArrow(run, schema)


def decode(coded: DataFrame, model: Codebooks, code_col: str = "code", out: str = "vector") -> DataFrame:
    """The vector that a code stands for, in the units of the input; null for a null code."""
    books = [F.array(*[F.array(*[F.lit(int(c) / model.scale) for c in e]) for e in b]) for b in model.books]
    entry = [F.get(book, F.conv(F.substring(code_col, 2 * p + 1, 2), 16, 10).cast("int")) for p, book in enumerate(books)]
    return coded.withColumn(out, F.when(F.col(code_col).isNotNull(), F.concat(*entry)))


def compress(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Code and error of every whole vector, the error summed over its label (null labels
    together; null where the sum is beyond 64 bits), and the digest of the codebooks."""
    vectors = finite_vectors(df, vec_col).select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), "__v")
    model = learn_codebooks(vectors, "vec_id")
    if model is None:
        schema = T.StructType([vectors.schema["vec_id"], T.StructField("code", T.StringType()),
                               T.StructField("error", T.LongType()), T.StructField("label_error", T.LongType()),
                               T.StructField("codebooks_sha256", T.StringType())])
        return df.sparkSession.createDataFrame([], schema)
    coded = materialize(encode(vectors, model), "vector-codes")
    totals = coded.groupBy("label").agg(F.count(F.lit(1)).alias("__n"), F.try_sum("error").alias("label_error"))
    out = join_totals(coded, totals, ["label"], "__n", F.xxhash64("vec_id", "code", "error"))
    return out.select("vec_id", "code", "error", "label_error", F.lit(model.digest()).alias("codebooks_sha256"))
