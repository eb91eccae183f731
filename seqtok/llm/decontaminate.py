"""Benchmark decontamination over a distributed positional inverted index.

Words: A-Z are lower-cased; words are the maximal runs of digits, a-z and non-ASCII code points.

``build_index`` cuts the training documents into segments of about ``SEGMENT_BYTES`` of text (whole
documents) and stores, per segment and term, the sorted positions of the term (its postings), and per
document where its words lie. Positions count through a segment with one empty place behind every
document, so no phrase crosses documents. A term that half of all rows hold is one posting list per
segment like any other; nothing is grouped by term. The index of one table can be kept and searched again.

``search_index`` takes benchmark items. A window is a run of ``window`` words of an item (or the whole
item, if shorter). Per segment, all windows start with the postings of their rarest term there, moved
back by its place in the window; the list of the next rarer term, moved likewise, is intersected, and so
on: what is left are exact phrase matches. ``within`` also finds proximity matches: all words of a
window, as often as it has them, in any order within so many consecutive words of a document.

Words are found by 64-bit hash and compared byte by byte, so a collision never gives a match.

The items go to the tasks by broadcast if they are small (``BROADCAST_BYTES``, checked). Beyond that the
windows stay a table: each is joined by its globally rarest term with the segments that hold the
term, and meets only the postings of those segments.

Rows: null texts have no words; every document row comes back, repeated ids too. Items without words
have no window, rows of one item id are one item, a null id is the empty string. Empty tables give
no rows, or documents without hits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pyspark
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqtok.llm.common import BROADCAST_BYTES, mix64
from seqtok.operators.lookup import size_in_bytes
from seqtok.session import materialize

WINDOW_WORDS = 10
SEGMENT_BYTES = 4 << 20
MAX_CANDIDATES = 1 << 20
_LONG_WORD = 64
_U = np.uint64
_FOLD = bytes((c | 32 if 65 <= c <= 90 else c) if 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 else 32
              for c in range(256))
_MASKS = np.array([(1 << (8 * n)) - 1 for n in range(9)], dtype=_U)


# ---------------------------------------------------------------- words

def words_of(text: str | bytes | None) -> list[bytes]:
    raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text or b""
    return raw.translate(_FOLD).split()


class Words:
    """The words of a list of UTF-8 texts: ``starts, sizes, hashes`` (one per word) and ``bounds``
    (words of text i are ``bounds[i]:bounds[i + 1]``)."""

    def __init__(self, raw: list[bytes]):
        lengths = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        self.data = b" ".join([*raw, b"        "]).translate(_FOLD)
        buf = np.frombuffer(self.data, dtype=np.uint8)
        edges = np.flatnonzero(np.diff(buf != 32, prepend=False, append=False))
        self.starts, stops = edges[0::2], edges[1::2]
        self.sizes = stops - self.starts
        # eight bytes from every offset on
        self.eights = np.ndarray((len(buf) - 7,), dtype="<u8", buffer=self.data, strides=(1,))
        self.bounds = np.searchsorted(self.starts, np.concatenate([[0], np.cumsum(lengths + 1)]))
        h = self.sizes.astype(_U)
        for k, rows in self._chunks(np.arange(len(self.starts))):
            h[rows] = mix64(h[rows] * _U(0x9E3779B97F4A7C15) ^ self._eight(rows, k))
        for i in np.flatnonzero(self.sizes > _LONG_WORD):
            h[i] = xxhash.xxh3_64_intdigest(self.word(i))
        self.hashes = h

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i]:self.starts[i] + self.sizes[i]]

    def _chunks(self, rows: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        for k in range(0, _LONG_WORD, 8):
            rows = rows[self.sizes[rows] > k]
            if not len(rows):
                return
            yield k, rows

    def _eight(self, rows: np.ndarray, k: int) -> np.ndarray:
        return self.eights[self.starts[rows] + k] & _MASKS[np.minimum(self.sizes[rows] - k, 8)]

    def same_as(self, rows: np.ndarray, other: Words, index: np.ndarray) -> np.ndarray:
        """Whether word ``rows[i]`` equals word ``index[i]`` of ``other``."""
        same = self.sizes[rows] == other.sizes[index]
        for k in range(0, _LONG_WORD, 8):
            at = np.flatnonzero(same & (self.sizes[rows] > k))
            if not len(at):
                return same
            same[at] &= self._eight(rows[at], k) == other._eight(index[at], k)
        for i in np.flatnonzero(same & (self.sizes[rows] > _LONG_WORD)):
            same[i] = self.word(rows[i]) == other.word(index[i])
        return same


class Vocabulary:
    """Distinct words with fast exact lookup."""

    def __init__(self, words: list[bytes]):
        self.words = sorted(set(words))
        self.index = Words(self.words)
        self.order = np.argsort(self.index.hashes)
        self.hashes = self.index.hashes[self.order]
        if len(np.unique(self.hashes)) < len(self.hashes):
            raise ValueError("two terms share a 64-bit hash")       # about n * n / 2 ** 65

    def __reduce__(self):
        return Vocabulary, (self.words,)

    def find(self, words: Words) -> np.ndarray:
        """Number of every word, -1 for words outside of the vocabulary."""
        out = np.full(len(words.hashes), -1, dtype=np.int64)
        if not self.words:
            return out
        at = np.minimum(np.searchsorted(self.hashes, words.hashes), len(self.hashes) - 1)
        rows = np.flatnonzero(self.hashes[at] == words.hashes)
        number = self.order[at[rows]]
        ok = words.same_as(rows, self.index, number)
        out[rows[ok]] = number[ok]
        return out


# ---------------------------------------------------------------- index

def index_schema(id_type: T.DataType) -> T.StructType:
    """Rows with a term hold its postings in a segment, rows without one a document of the segment."""
    f = T.StructField
    return T.StructType([f("segment", T.LongType()), f("doc_id", id_type), f("n_words", T.LongType()),
                         f("base", T.IntegerType()), f("term", T.BinaryType()), f("positions", T.ArrayType(T.IntegerType()))])


def _segments(column: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    sizes = np.zeros(len(column), dtype=np.int64)
    lengths = pa.compute.binary_length(column)
    sizes[:] = lengths.fill_null(0).to_numpy(zero_copy_only=False)
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += int(n)
    if start < len(sizes):
        yield start, len(sizes)


def _postings(words: Words, vocabulary: Vocabulary | None, base: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """``(terms, offsets, positions)`` of a segment."""
    place = np.arange(len(words.hashes)) + np.repeat(base[:-1] - words.bounds[:-1], np.diff(words.bounds))
    if vocabulary is not None:
        number = vocabulary.find(words)
        known = np.flatnonzero(number >= 0)
        order = known[np.argsort(number[known], kind="stable")]
        cut = np.flatnonzero(np.diff(number[order], prepend=-1))
        return [vocabulary.words[number[i]] for i in order[cut]], np.append(cut, len(order)), place[order]
    _, first, group = np.unique(words.hashes, return_index=True, return_inverse=True)
    terms = [words.word(i) for i in first]
    rows = np.arange(len(group))
    extra: dict[bytes, int] = {}
    for i in np.flatnonzero(~words.same_as(rows, words, first[group])):        # hash collisions
        group[i] = extra.setdefault(words.word(i), len(terms) + len(extra))
    terms += list(extra)
    order = np.argsort(group, kind="stable")
    cut = np.flatnonzero(np.diff(group[order], prepend=-1))
    return [terms[group[i]] for i in order[cut]], np.append(cut, len(order)), place[order]


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: Vocabulary | None = None,
                segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Positional index of ``docs`` (see ``index_schema``), of all terms or of a vocabulary (sent to the
    tasks, so of a checked size). Not stored yet: write it, or ``materialize`` it."""
    schema = index_schema(docs.schema[id_col].dataType)
    shared = None if vocabulary is None else docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)
        segment = pyspark.TaskContext.get().partitionId() << 32
        terms = None if shared is None else shared.value

        def rows(n: int, **given) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [given.get(f.name, pa.nulls(n, f.type)) for f in target], schema=target)

        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for a, b in _segments(texts, segment_bytes):
                words = Words([x or b"" for x in texts.slice(a, b - a).to_pylist()])
                counts = np.diff(words.bounds)
                base = np.concatenate([[0], np.cumsum(counts + 1)])
                found, offsets, positions = _postings(words, terms, base)
                own = pa.array(np.full(b - a, segment, np.int64))
                yield rows(b - a, segment=own, doc_id=ids.slice(a, b - a), n_words=pa.array(counts.astype(np.int64)),
                           base=pa.array(base[:-1].astype(np.int32)))
                if found:
                    lists = pa.ListArray.from_arrays(offsets.astype(np.int32), positions.astype(np.int32))
                    yield rows(len(found), segment=pa.array(np.full(len(found), segment, np.int64)),
                               term=pa.array(found, pa.binary()), positions=lists)
                segment += 1

    return docs.select(F.col(id_col), F.col(text_col).cast("string").cast("binary")).mapInArrow(run, schema)


# ---------------------------------------------------------------- windows of the items

def item_windows(words: list[bytes], size: int = WINDOW_WORDS) -> list[tuple[bytes, ...]]:
    """Runs of ``size`` words; a shorter item is one window, one without words has none."""
    return [tuple(words[i:i + size]) for i in range(max(len(words) - size + 1, 1))] if words else []


class Windows:
    """Distinct windows with the items that hold them, ready to be searched in a segment."""

    def __init__(self, windows: dict[tuple[bytes, ...], list[str]], size: int = WINDOW_WORDS):
        self.windows, self.size = windows, size
        self.vocabulary = Vocabulary([w for window in windows for w in window])
        number = {w: k for k, w in enumerate(self.vocabulary.words)}
        self.sizes = np.array([len(w) for w in windows], dtype=np.int64)
        self.terms = np.full((len(windows), size), -1, dtype=np.int64)
        for i, window in enumerate(windows):
            self.terms[i, :len(window)] = [number[w] for w in window]
        self.items = [sorted(set(x)) for x in windows.values()]
        # how often the window holds the word at each place; words at their first place only
        self.needs = (self.terms[:, :, None] == self.terms[:, None, :]).sum(axis=2)
        again = np.tril(self.terms[:, :, None] == self.terms[:, None, :], -1).any(axis=2)
        self.needs[again | (self.terms < 0)] = 0

    def __reduce__(self):
        return Windows, (self.windows, self.size)

    @classmethod
    def of_items(cls, items: list[tuple[str | None, list[bytes]]], size: int = WINDOW_WORDS) -> Windows:
        held: dict[tuple[bytes, ...], list[str]] = {}
        for item, words in items:
            for w in set(item_windows(words, size)):
                held.setdefault(w, []).append("" if item is None else item)
        return cls(held, size)


class Segment:
    """Postings of a segment for the terms of some windows."""

    def __init__(self, windows: Windows, terms: list[bytes], offsets: np.ndarray, positions: np.ndarray,
                 base: np.ndarray, n_words: np.ndarray):
        number = {w: k for k, w in enumerate(windows.vocabulary.words)}
        found = np.array([number.get(t, -1) for t in terms], dtype=np.int64)
        sizes = np.diff(offsets)
        keep = np.flatnonzero(found >= 0)
        keep = keep[np.argsort(found[keep])]
        self.count = np.zeros(len(number) + 1, dtype=np.int64)          # the last one: no term
        self.count[found[keep]] = sizes[keep]
        self.first = np.concatenate([[0], np.cumsum(self.count)])
        self.span = int(base[-1] + n_words[-1] + 2) if len(base) else 1
        rows = _ranges(offsets[keep], sizes[keep])
        self.positions = positions[rows]
        self.keys = np.repeat(found[keep], sizes[keep]) * self.span + self.positions
        self.windows, self.base, self.n_words = windows, base, n_words

    def rarest_first(self) -> tuple[np.ndarray, np.ndarray]:
        """Windows all of whose terms occur, and their places from the rarest term on."""
        w = self.windows
        count = np.where(w.terms < 0, 1 << 40, self.count[w.terms])
        live = np.flatnonzero((count > 0).all(axis=1))
        return live, np.argsort(count[live], axis=1, kind="stable")

    def starts(self, live: np.ndarray, order: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Blocks of ``(window, row of order, posting of its rarest term)``."""
        rare = self.windows.terms[live, order[:, 0]]
        sizes = self.count[rare]
        cuts = np.searchsorted(np.cumsum(sizes), np.arange(MAX_CANDIDATES, sizes.sum(), MAX_CANDIDATES)) + 1
        for rows in np.split(np.arange(len(live)), cuts):
            if len(rows):
                at = np.repeat(rows, sizes[rows])
                yield live[at], at, self.positions[_ranges(self.first[rare[rows]], sizes[rows])]

    def phrases(self) -> tuple[np.ndarray, np.ndarray]:
        """``(window, start)`` of all exact matches: offset-adjusted lists intersected from the rarest on."""
        live, order = self.rarest_first()
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for window, at, place in self.starts(live, order):
            start = place - order[at, 0]
            for k in range(1, self.windows.size):
                more = k < self.windows.sizes[window]
                term = self.windows.terms[window, order[at, k]]
                stay = ~more | self._has(term, start + order[at, k])
                window, at, start = window[stay], at[stay], start[stay]
                if not len(window):
                    break
            out.append((window, start))
        return tuple(np.concatenate(x) for x in zip(*out))

    def _has(self, term: np.ndarray, place: np.ndarray) -> np.ndarray:
        key = term * self.span + place
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return (self.keys[at] == key) & (place >= 0)

    def _within(self, term: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Occurrences of a term at places low..high."""
        return (np.searchsorted(self.keys, term * self.span + high, side="right")
                - np.searchsorted(self.keys, term * self.span + low))

    def near(self, within: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct ``(window, document)`` with all words of the window, as often as it has them, in any
        order within ``within`` consecutive words."""
        live, order = self.rarest_first()
        out = [np.zeros((0, 2), np.int64)]
        w = self.windows
        for window, at, place in self.starts(live, order):
            doc = np.searchsorted(self.base, place, side="right") - 1
            low = np.maximum(place - within + 1, self.base[doc])
            high = np.minimum(place + within - 1, self.base[doc] + self.n_words[doc] - 1)
            stay = np.arange(len(window))
            for k in range(w.size):                     # enough of every word around the rarest one
                need, term = w.needs[window[stay], order[at[stay], k]], w.terms[window[stay], order[at[stay], k]]
                stay = stay[(need == 0) | (self._within(term, low[stay], high[stay]) >= need)]
            for edge in range(within):                  # the stretch that ends `edge` words behind it
                left = place[stay] + edge - within + 1
                a, b = np.maximum(left, low[stay]), np.minimum(place[stay] + edge, high[stay])
                hit = np.arange(len(stay))
                for k in range(w.size):
                    rows = stay[hit]
                    need, term = w.needs[window[rows], order[at[rows], k]], w.terms[window[rows], order[at[rows], k]]
                    hit = hit[(need == 0) | (self._within(term, a[hit], b[hit]) >= need)]
                out.append(np.stack([window[stay[hit]], doc[stay[hit]]], axis=1))
        pairs = np.unique(np.concatenate(out), axis=0)
        return pairs[:, 0], pairs[:, 1]


def _ranges(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``first[0], first[0] + 1, .., first[1], ..`` with ``sizes[i]`` numbers each."""
    total = int(sizes.sum())
    return np.arange(total) + np.repeat(first - (np.cumsum(sizes) - sizes), sizes)


# ---------------------------------------------------------------- search

def _hit_schema(id_type: T.DataType) -> T.StructType:
    span = T.StructType([T.StructField("first_word", T.LongType()), T.StructField("n_words", T.LongType())])
    return T.StructType([T.StructField("doc_id", id_type), T.StructField("n_words", T.LongType()),
                         T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())),
                         T.StructField("spans", T.ArrayType(span)),
                         T.StructField("near_items", T.ArrayType(T.StringType()))])


def _items_by_doc(windows: Windows, window: np.ndarray, doc: np.ndarray, n: int) -> list[list[str]]:
    out: list[set[str]] = [set() for _ in range(n)]
    for w, d in np.unique(np.stack([window, doc], axis=1), axis=0) if len(window) else ():
        out[d].update(windows.items[w])
    return [sorted(x) for x in out]


def _search(windows: Windows, table: pa.Table, within: int, schema: T.StructType) -> pa.Table:
    """The documents of one segment with their hits."""
    from pyspark.sql.pandas.types import to_arrow_schema

    is_doc = table.column("term").is_null()
    docs, lists = table.filter(is_doc).sort_by("base"), table.filter(pa.compute.invert(is_doc)).combine_chunks()
    base, n_words = (docs.column(c).to_numpy().astype(np.int64) for c in ("base", "n_words"))
    column = lists.column("positions")
    column = column.chunk(0) if column.num_chunks else pa.array([], column.type)
    offsets = column.offsets.to_numpy().astype(np.int64) if len(column) else np.zeros(1, np.int64)
    segment = Segment(windows, lists.column("term").to_pylist(), offsets - offsets[0],
                      column.flatten().to_numpy().astype(np.int64), base, n_words)
    window, start = segment.phrases()
    doc = np.searchsorted(base, start, side="right") - 1
    cover = np.zeros(segment.span + 1, dtype=np.int64)      # words that some match covers
    np.add.at(cover, start, 1)
    np.add.at(cover, start + windows.sizes[window], -1)
    edge = np.flatnonzero(np.diff(np.cumsum(cover) > 0, prepend=False, append=False))
    first, size = edge[0::2], edge[1::2] - edge[0::2]
    home = np.searchsorted(base, first, side="right") - 1
    spans: list[list] = [[] for _ in base]
    for f, s, d in zip(first.tolist(), size.tolist(), home.tolist()):
        spans[d].append({"first_word": f - int(base[d]), "n_words": s})
    n_hit = np.bincount(home, weights=size, minlength=len(base)).astype(np.int64)
    items = _items_by_doc(windows, window, doc, len(base))
    near = _items_by_doc(windows, *segment.near(within), len(base)) if within else [None] * len(base)
    target = to_arrow_schema(schema)
    cols = [docs.column("doc_id"), docs.column("n_words"), pa.array(n_hit), *[
        pa.array(x, type=target.field(c).type) for c, x in (("items", items), ("spans", spans), ("near_items", near))]]
    return pa.table(cols, schema=target)


def _item_words(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return items.select(F.col(id_col).cast("string").alias("item_id"), F.col(text_col).cast("string").alias("text")).where(
        F.col("text").isNotNull())


def search_index(index: DataFrame, windows: Windows, within: int = 0) -> DataFrame:
    """Per document of the index: ``n_words``, ``n_hit`` (words inside of phrase matches), ``items`` (ids of
    the items with a phrase match), ``spans`` (maximal stretches of hit words), and for ``within`` > 0
    ``near_items``. ``windows`` goes to the tasks, so its size is to be checked before."""
    schema = _hit_schema(index.schema["doc_id"].dataType)
    shared = index.sparkSession.sparkContext.broadcast(windows)
    return index.groupBy("segment").applyInArrow(lambda t: _search(shared.value, t, within, schema), schema)


def search_by_join(index: DataFrame, items: DataFrame, id_col: str, text_col: str, size: int = WINDOW_WORDS,
                   within: int = 0) -> DataFrame:
    """``search_index`` for items of any size: windows reach the segments that hold their rarest term by
    a join, nothing is broadcast. The index holds all terms."""
    schema = _hit_schema(index.schema["doc_id"].dataType)
    made = T.StructType([T.StructField("item_id", T.StringType()), T.StructField("window", T.ArrayType(T.BinaryType()))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(*(batch.column(i).to_pylist() for i in (0, 1))):
                found = list(set(item_windows(words_of(text), size)))
                for a in range(0, len(found), 4096):
                    part = [list(w) for w in found[a:a + 4096]]
                    yield pa.RecordBatch.from_arrays([pa.array([item or ""] * len(part), pa.string()),
                                                      pa.array(part, pa.list_(pa.binary()))], names=made.names)

    held = _item_words(items, id_col, text_col).mapInArrow(cut, made).groupBy("window").agg(
        F.collect_set("item_id").alias("items"))
    held = materialize(held, "item-windows")
    counts = index.where(F.col("term").isNotNull()).groupBy("term").agg(F.sum(F.size("positions").cast("long")).alias("__n"))
    rare = held.select("window", F.explode(F.array_distinct("window")).alias("term")).join(counts, "term", "left").groupBy(
        "window").agg(F.min(F.struct(F.coalesce("__n", F.lit(0)).alias("n"), "term")).alias("r"))
    # a term that no segment holds drops its window here, and rightly
    asked = held.join(rare.select("window", F.col("r.term").alias("term")), "window").join(
        index.where(F.col("term").isNotNull()).select("term", F.col("segment").alias("__at")), "term").select(
        "__at", "window", "items")

    def search(table: pa.Table, given: pa.Table) -> pa.Table:
        pairs = zip(given.column("window").to_pylist(), given.column("items").to_pylist())
        return _search(Windows({tuple(w): x for w, x in pairs}, size), table, within, schema)

    return index.groupBy("segment").cogroup(asked.groupBy("__at")).applyInArrow(search, schema)


def find_contamination(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text",
                       item_id: str = "item_id", item_text: str = "text", size: int = WINDOW_WORDS, within: int = 0,
                       broadcast_bytes: int = BROADCAST_BYTES, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Index ``docs``, store the index, search all ``items`` in it (see ``search_index``)."""
    asked = _item_words(items, item_id, item_text)
    if size_in_bytes(asked) * size <= broadcast_bytes:        # a text of n words has up to n windows of `size`
        windows = Windows.of_items([(r["item_id"], words_of(r["text"])) for r in asked.collect()], size)
        index = materialize(build_index(docs, doc_id, doc_text, windows.vocabulary, segment_bytes), "term-index")
        return search_index(index, windows, within)
    index = materialize(build_index(docs, doc_id, doc_text, None, segment_bytes), "term-index")
    return search_by_join(index, items, item_id, item_text, size, within)


def contamination_report(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """Per document: words, hit words, number and digest of the items found, and whether it is contaminated."""
    found = find_contamination(docs, items, **options)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))
