"""N-gram Jaccard self-join of documents by MinHash LSH with exact verification.

Method
------
1. Every whole text becomes its set of hashed word five-grams; texts with equal sets are one
   *text class* (copies), and only the classes go on.
2. A class has a MinHash signature of ``TREES`` times ``MAX_DEPTH`` values. The values of a
   tree, in order, are the label of the class in that tree: a prefix trie. Two classes with
   similarity s share a trie node at depth d with probability ``s ** d``. The depth is the
   longest at which the recall at the similarity threshold, ``1 - (1 - s ** d) ** TREES``,
   reaches ``TARGET_RECALL`` (``forest_depth``). It is fixed before the run whatever the data, so
   this equals banding with ``TREES`` bands of d values; no trie is searched. The values below
   that depth serve only the agreement of step 3.
3. Classes under one node at that depth are compared. A pair is looked at in the first tree
   in which it meets, if the set sizes allow the similarity and the signatures agree
   in as many places as a pair at the threshold would but for a chance of ``TAIL``;
   the members of such pairs fetch their texts and the Jaccard similarity is computed on the sets.
4. Verified links give each class its number of links and a star of edges to the least class it
   is linked with there; components of these edges (alternating large and small stars) are
   the near-duplicate classes.

Scale: the node table holds 40 bytes per class and tree. A node with more than
``NODE_MEMBERS`` members or ``NODE_SHINGLES`` shingles is cut into blocks by a hash, and each
pair of blocks is a unit of its own, so no task holds an unbounded group. Every unit returns at
most one row per member, never its pairs. Texts are fetched for members of candidate pairs
only, by a broadcast of their ids if the measured size is small, else by a shuffle join.
Intermediate tables are written below ``spark.checkpoint.dir``.

Rows: null texts, empty texts and texts without a word are in a class alone, without links; a
text of one to four words has one shingle of all its words. Repeated rows are copies of each
other. Rows with a null id count as documents; a class of null ids only has a null class id.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqtok.config import Params
from seqtok.llm.common import append_columns, mix64, shingle_hashes
from seqtok.operators.lookup import join_totals, size_in_bytes
from seqtok.session import materialize

THRESHOLD = 0.8
TREES = 24
MAX_DEPTH = 5
TARGET_RECALL = 0.99999
TAIL = 1e-9
NODE_MEMBERS = 512
NODE_SHINGLES = 1 << 19
BROADCAST_BYTES = 64 << 20
ROWS_PER_SALT = 100_000
_VALUES = TREES * MAX_DEPTH
_MULTIPLIERS = mix64(np.arange(1, _VALUES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def forest_depth(threshold: float = THRESHOLD, trees: int = TREES, max_depth: int = MAX_DEPTH,
                 target: float = TARGET_RECALL) -> int:
    """The longest prefix whose recall for pairs at the threshold reaches the target."""
    for depth in range(max_depth, 1, -1):
        if 1 - (1 - threshold ** depth) ** trees >= target:
            return depth
    return 1


def least_agreement(threshold: float = THRESHOLD, values: int = _VALUES, tail: float = TAIL) -> int:
    """Signature places in which a pair at the threshold agrees, but for a chance of ``tail``."""
    below = 0.0
    for k in range(values + 1):
        below += math.comb(values, k) * threshold ** k * (1 - threshold) ** (values - k)
        if below > tail:
            return k
    return values


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    h, bounds = shingle_hashes(texts)
    return [np.unique(h[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]


def set_key(shingles: np.ndarray) -> bytes | None:
    """128-bit identity of a shingle set; None for an empty one."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash signature (uint32) of each non-empty set."""
    flat = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((len(sets), _VALUES), dtype=np.uint32)
    for k, a in enumerate(_MULTIPLIERS):
        out[:, k] = np.minimum.reduceat(flat * a, starts) >> np.uint64(32)
    return out


def _text_id(text: Column) -> list[Column]:
    return [F.xxhash64(F.lit(1), text).alias("__t1"), F.xxhash64(F.lit(2), text).alias("__t2")]


def with_signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(__id, __t1, __t2, __key, __n, __sig)`` of every document: its id and text hash, and
    three values that are null without words."""
    fields = [T.StructField("__key", T.BinaryType()), T.StructField("__n", T.LongType()),
              T.StructField("__sig", T.BinaryType())]

    def work(texts: list) -> list:
        sets = shingle_sets(texts)
        live = [i for i, s in enumerate(sets) if len(s)]
        sig: list[bytes | None] = [None] * len(texts)
        if live:
            for i, row in zip(live, signatures([sets[i] for i in live])):
                sig[i] = row.tobytes()
        return [pa.array([set_key(s) for s in sets], pa.binary()),
                pa.array([len(s) or None for s in sets], pa.int64()), pa.array(sig, pa.binary())]

    base = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), *_text_id(F.col(text_col)))
    return append_columns(base, "__text", fields, lambda: work).drop("__text")


def text_classes(signed: DataFrame) -> DataFrame:
    """One row per distinct shingle set: key, ``__size`` (documents), ``__first`` (least
    id), ``__n``, ``__sig``."""
    return signed.where(F.col("__key").isNotNull()).groupBy("__key").agg(
        F.count(F.lit(1)).alias("__size"), F.min("__id").alias("__first"),
        F.max("__n").alias("__n"), F.max("__sig").alias("__sig"))


def shared_nodes(classes: DataFrame, depth: int) -> DataFrame:
    """Members of trie nodes with two classes or more, dealt into units:
    ``(__node, __tree, __i, __j, __block, __key)``."""
    label = [F.struct(F.lit(t).alias("t"),
                      F.xxhash64(F.lit(t), F.substring("__sig", 1 + 4 * MAX_DEPTH * t, 4 * depth)).alias("h"))
             for t in range(TREES)]
    places = classes.select("__key", "__n", F.explode(F.array(*label)).alias("__p")).select(
        "__key", "__n", F.col("__p.t").alias("__tree"), F.col("__p.h").alias("__node"))
    busy = (places.groupBy("__node").agg(F.count(F.lit(1)).alias("__m"), F.sum("__n").alias("__s"))
                  .where(F.col("__m") > 1)
                  .select(F.col("__node").alias("__b"),
                          F.ceil(F.greatest(F.col("__m") / NODE_MEMBERS, F.col("__s") / NODE_SHINGLES))
                           .cast("int").alias("__blocks")))
    dealt = places.join(busy, F.col("__node") == F.col("__b")).withColumn(
        "__block", F.pmod(F.xxhash64("__key"), F.col("__blocks")).cast("int"))
    return dealt.select(
        "__node", "__tree", "__block", "__key",
        F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)).alias("__other")).select(
        "__node", "__tree", F.least("__block", "__other").alias("__i"),
        F.greatest("__block", "__other").alias("__j"), "__block", "__key")


_UNIT = ["__node", "__i", "__j"]


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole units from a sorted stream, with the row where each unit begins."""
    rest = None
    for batch in batches:
        part = pa.Table.from_batches([batch])
        rest = part if rest is None else pa.concat_tables([rest, part])
        begins = _begins(rest)
        if len(begins) > 1:
            yield rest.slice(0, begins[-1]), begins[:-1]
            rest = rest.slice(begins[-1])
    if rest is not None and rest.num_rows:
        yield rest, _begins(rest)


def _begins(table: pa.Table) -> np.ndarray:
    new = np.zeros(table.num_rows, dtype=bool)
    new[:1] = True
    for c in _UNIT:
        v = table.column(c).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


def _candidates(sig: np.ndarray, n: np.ndarray, block: np.ndarray, tree: int, across: bool,
                threshold: float, depth: int, agree: int) -> Iterator[tuple[int, np.ndarray]]:
    """``(a, [b...])``, b after a: the pairs that this unit has to verify."""
    tries = sig.reshape(len(sig), TREES, MAX_DEPTH)
    for a in range(len(sig) - 1):
        rest = np.arange(a + 1, len(sig))
        low, high = np.minimum(n[a], n[rest]), np.maximum(n[a], n[rest])
        ok = low >= threshold * high
        if across:
            ok &= block[rest] != block[a]
        rest = rest[ok]
        if not len(rest):
            continue
        same = tries[rest] == tries[a]
        meets = same[:, :, :depth].all(axis=2)
        ok = meets[:, tree] & ~meets[:, :tree].any(axis=1) & (same.sum(axis=(1, 2)) >= agree)
        if ok.any():
            yield a, rest[ok]


def _sig_matrix(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint32).reshape(-1, _VALUES)


def _prune(threshold: float, depth: int) -> Callable:
    agree = least_agreement(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, begins in _units(batches):
            sig, n = _sig_matrix(table.column("__sig")), table.column("__n").to_numpy()
            block, tree = table.column("__block").to_numpy(), table.column("__tree").to_numpy()
            across = table.column("__i").to_numpy() != table.column("__j").to_numpy()
            keep = np.zeros(table.num_rows, dtype=bool)
            for a, b in zip(begins, [*begins[1:], table.num_rows]):
                for x, ys in _candidates(sig[a:b], n[a:b], block[a:b], int(tree[a]), bool(across[a]),
                                         threshold, depth, agree):
                    keep[a + x] = keep[a + ys] = True
            yield from table.filter(pa.array(keep)).to_batches()

    return run


_LINKS = T.StructType([T.StructField("__key", T.BinaryType()), T.StructField("__links", T.LongType()),
                       T.StructField("__root", T.BinaryType())])


def _verify(threshold: float, depth: int) -> Callable:
    agree = least_agreement(threshold)

    def unit(key: list, sets: list, table: pa.Table, sig: np.ndarray) -> list[tuple]:
        # a fetched text that is not the class's own (ids may repeat) or comes twice is left out
        seen: set[bytes] = set()
        rows = [r for r, k in enumerate(key) if set_key(sets[r]) == k and not (k in seen or seen.add(k))]
        if len(rows) < 2:
            return []
        own = [sets[r] for r in rows]
        n = np.array([len(s) for s in own])
        size = table.column("__size").to_numpy()[rows]
        flat = np.concatenate(own)
        _, local = np.unique(flat, return_inverse=True)
        starts = np.concatenate([[0], np.cumsum(n)])
        mark = np.zeros(int(local.max()) + 1, dtype=np.int32)
        links = np.zeros(len(rows), dtype=np.int64)
        root = list(range(len(rows)))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        across = table.column("__i")[0].as_py() != table.column("__j")[0].as_py()
        for a, bs in _candidates(sig[rows], n, table.column("__block").to_numpy()[rows],
                                 table.column("__tree")[0].as_py(), across, threshold, depth, agree):
            mine = local[starts[a]:starts[a + 1]]
            mark[mine] = 1
            if len(bs) > 8:
                common = np.add.reduceat(mark[local], starts[:-1])[bs]
            else:
                common = np.array([mark[local[starts[b]:starts[b + 1]]].sum() for b in bs])
            mark[mine] = 0
            near = bs[common >= threshold * (n[a] + n[bs] - common) - 1e-9]
            links[a] += size[near].sum()
            links[near] += size[a]
            for b in near:
                x, y = find(a), find(int(b))
                if x != y:
                    root[max(x, y)] = min(x, y)
        return [(key[rows[r]], int(links[r]), key[rows[find(r)]]) for r in np.flatnonzero(links)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, begins in _units(batches):
            ends = [*begins[1:], table.num_rows]
            sig, keys = _sig_matrix(table.column("__sig")), table.column("__key").to_pylist()
            texts = table.column("__text").to_pylist()
            out: list[tuple] = []
            at = 0
            while at < len(begins):            # some units at a time, about 1 MB of text
                stop, chars = at, 0
                while stop < len(begins) and (stop == at or chars < 1 << 20):
                    chars += sum(len(t or "") for t in texts[begins[stop]:ends[stop]])
                    stop += 1
                a0 = begins[at]
                sets = shingle_sets(texts[a0:ends[stop - 1]])
                for a, b in zip(begins[at:stop], ends[at:stop]):
                    out += unit(keys[a:b], sets[a - a0:b - a0], table.slice(a, b - a), sig[a:b])
                at = stop
            if out:
                k, n, r = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(k, pa.binary()), pa.array(n, pa.int64()),
                                                  pa.array(r, pa.binary())], names=_LINKS.names)

    return run


def _fetch_texts(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(__key, __text)`` for the ``(__key, __first)`` in ``wanted``."""
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    if size_in_bytes(wanted) <= BROADCAST_BYTES:
        wanted = F.broadcast(wanted)
    return texts.join(wanted, F.col("__id").eqNullSafe(F.col("__first"))).select("__key", "__text")


def verified_links(docs: DataFrame, classes: DataFrame, id_col: str, text_col: str,
                   threshold: float = THRESHOLD) -> DataFrame:
    """``(__key, __links, __root)`` per unit and linked class: the documents it is linked
    with there and the least class of its local component."""
    depth = forest_depth(threshold)
    members = shared_nodes(classes, depth)
    signed = members.join(classes.select(F.col("__key").alias("__k"), "__n", "__sig", "__size", "__first"),
                          F.col("__key") == F.col("__k")).drop("__k")
    dealt = signed.repartition(*_UNIT).sortWithinPartitions(*_UNIT, "__key")
    kept = materialize(dealt.mapInArrow(_prune(threshold, depth), dealt.schema), "ngram-units")
    wanted = kept.select("__key", "__first").distinct()
    texts = _fetch_texts(docs, wanted, id_col, text_col).withColumnRenamed("__key", "__k")
    full = (kept.join(texts, F.col("__key") == F.col("__k")).drop("__k", "__first")
                .repartition(*_UNIT).sortWithinPartitions(*_UNIT, "__key"))
    return full.mapInArrow(_verify(threshold, depth), _LINKS)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, root)`` for the nodes of ``edges (a, b)``: the least node of the component.

    Alternating large-star and small-star rounds; each round is written as a table. No
    neighbourhood is ever gathered: only its least node is, by a partial aggregate.
    """
    def both(e: DataFrame) -> DataFrame:
        return e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def with_least(e: DataFrame) -> DataFrame:
        """``e`` with ``m``, the least of ``a`` and its neighbours; a hub's edges are dealt over salts."""
        least = e.groupBy("a").agg(F.least("a", F.min("b")).alias("m"), F.count(F.lit(1)).alias("__n"))
        return join_totals(e, materialize(least, "least"), ["a"], "__n", F.xxhash64("b"),
                           Params(salt_rows=ROWS_PER_SALT, broadcast_max_bytes=BROADCAST_BYTES))

    def large_star(e: DataFrame) -> DataFrame:
        return (with_least(both(e)).where(F.col("b") > F.col("a"))
                .select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct())

    def small_star(e: DataFrame) -> DataFrame:
        joined = with_least(e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
        return (joined.select(F.col("b").alias("a"), F.col("m").alias("b"))
                      .unionByName(joined.select("a", F.col("m").alias("b"))).where("a != b").distinct())

    def is_star_forest(e: DataFrame) -> bool:
        """Every node has one edge down, and no root is itself below another."""
        twice = e.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        chained = e.join(e.select(F.col("a").alias("c")), F.col("b") == F.col("c"), "left_semi")
        return twice.isEmpty() and chained.isEmpty()

    now = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = materialize(now, "edges")
    for _ in range(max_rounds):
        if is_star_forest(now):
            break
        now = materialize(small_star(materialize(large_star(now), "large-star")), "edges")
    else:
        raise RuntimeError("connected components did not settle")
    return (now.select(F.col("a").alias("node"), F.col("b").alias("root"))
               .unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: id, ``class_id`` (least id of its near-duplicate class),
    ``n_links`` (other documents whose Jaccard similarity is at least the threshold, copies
    included) and ``n_copies`` (documents with the same shingle set, itself included)."""
    signed, known = _grouped(docs, id_col, text_col, threshold)
    grouped = F.col("__k").isNotNull()
    return _with_class(signed, known, "left").select(
        F.col("__id").alias(id_col),
        F.when(grouped, F.col("__class")).otherwise(F.col("__id")).alias("class_id"),
        F.when(grouped, F.col("__links") + F.col("__size") - 1).otherwise(F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("__size", F.lit(1)).cast("long").alias("n_copies"))


def _grouped(docs: DataFrame, id_col: str, text_col: str, threshold: float) -> tuple[DataFrame, DataFrame]:
    """``with_signatures``, and per text class with copies or links ``(__k, __size, __links,
    __class, __root)``: its near-duplicate class by least id and by least key."""
    signed = materialize(with_signatures(docs, id_col, text_col), "ngram-signatures")
    classes = materialize(text_classes(signed), "ngram-classes")
    found = materialize(verified_links(docs, classes, id_col, text_col, threshold), "ngram-links")
    links = found.groupBy("__key").agg(F.sum("__links").alias("__links"))
    parts = connected_components(found.select(F.col("__key").alias("a"), F.col("__root").alias("b")))
    # only classes with copies or links are looked up; every other document stands alone
    placed = (classes.join(links.withColumnRenamed("__key", "__lk"), F.col("__key") == F.col("__lk"), "left")
                     .join(parts, F.col("__key") == F.col("node"), "left")
                     .where((F.col("__size") > 1) | F.col("__links").isNotNull())
                     .select("__key", "__size", "__first", F.coalesce("__links", F.lit(0)).alias("__links"),
                             F.coalesce("root", "__key").alias("__root")))
    least = placed.groupBy("__root").agg(F.min("__first").alias("__class"))
    known = placed.join(least.withColumnRenamed("__root", "__r"), F.col("__root") == F.col("__r")).select(
        F.col("__key").alias("__k"), "__size", "__links", "__class", "__root")
    return signed, materialize(known, "ngram-known")


def _with_class(signed: DataFrame, known: DataFrame, how: str) -> DataFrame:
    """Rows joined with their text class. Beyond the broadcast limit the rows of a class with many copies
    are dealt over salts by its exact size."""
    if size_in_bytes(known) <= BROADCAST_BYTES:
        return signed.join(F.broadcast(known), F.col("__key") == F.col("__k"), how)
    salts = F.ceil(F.col("__size") / ROWS_PER_SALT).cast("int")
    hot = known.where(F.col("__size") > ROWS_PER_SALT).select(F.col("__k").alias("__hk"), salts.alias("__salts"))
    if size_in_bytes(hot) <= BROADCAST_BYTES:                    # documents / ROWS_PER_SALT rows at most
        hot = F.broadcast(hot)
    rows = signed.join(hot, F.col("__key") == F.col("__hk"), "left").withColumn(
        "__salt", F.pmod(F.xxhash64("__id", "__t1"), F.coalesce("__salts", F.lit(1)))).drop("__hk", "__salts")
    copies = known.withColumn("__ts", F.explode(F.sequence(F.lit(0), salts - 1)))
    return rows.join(copies, (F.col("__key") == F.col("__k")) & (F.col("__salt") == F.col("__ts")), how).drop("__salt", "__ts")


def keep_one_row_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                         threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one row of every near-duplicate class: the one with the least id (null last,
    then by text). Rows are told apart by id and text, so different texts under one id that are
    not near copies all stay, and copies without an id leave one."""
    signed, known = _grouped(docs, id_col, text_col, threshold)
    row = ["__id", "__t1", "__t2"]
    members = materialize(_with_class(signed, known, "inner").groupBy("__root", "__key", *row)
                          .agg(F.count(F.lit(1)).alias("__rows")), "ngram-members")
    # the class's own row first: least id, then the least key and text hash
    order = F.struct(F.col("__id").isNull().alias("n"), F.col("__id").alias("i"), F.col("__key").alias("k"),
                     F.col("__t1").alias("a"), F.col("__t2").alias("b"))
    first = members.groupBy("__root").agg(F.min(order).alias("__f")).select(
        F.col("__f.i").alias("__fi"), F.col("__f.k").alias("__fk"), F.col("__f.a").alias("__fa"), F.col("__f.b").alias("__fb"))
    first = materialize(first, "ngram-first")
    # matched by row, so a large class is no hot key
    own = (F.col("__id").eqNullSafe(F.col("__fi")) & (F.col("__key") == F.col("__fk"))
           & (F.col("__t1") == F.col("__fa")) & (F.col("__t2") == F.col("__fb")))
    named = [F.col("__id").alias("__gi"), F.col("__t1").alias("__g1"), F.col("__t2").alias("__g2")]
    gone = members.join(first, own, "left_anti").select(*named)
    # a row with copies under its id stays once
    twice = materialize(members.where("__rows > 1").join(first, own, "left_semi").select(*named), "ngram-twice")

    def by_row(marked: DataFrame, rows: DataFrame, how: str) -> DataFrame:
        if size_in_bytes(rows) <= BROADCAST_BYTES:
            rows = F.broadcast(rows)
        return marked.join(rows, F.col(id_col).eqNullSafe(F.col("__gi")) & (F.col("__t1") == F.col("__g1"))
                           & (F.col("__t2") == F.col("__g2")), how)

    marked = docs.select("*", *_text_id(F.col(text_col)))
    kept = by_row(marked, materialize(gone.unionByName(twice), "ngram-gone"), "left_anti").drop("__t1", "__t2")
    if twice.isEmpty():
        return kept
    many = by_row(marked, twice, "left_semi").dropDuplicates([id_col, "__t1", "__t2"])
    return kept.unionByName(many.drop("__t1", "__t2"))
