"""Language identification by cross-parsing entropy.

Method: per language a suffix automaton is built over a bounded sample of labelled text:
up to ``SAMPLE_DOCS`` documents of a language in hash order, whose whole texts are cut into pieces of
``SAMPLE_CHARS`` code points, and of all these pieces as many as documents, again in hash order. With more than
``MAX_LANGUAGES`` languages each has fewer documents and pieces, none is left out. A text is cut greedily into the longest phrases that occur in the language's
sample; the walk through the automaton gives each longest match. The language whose
parse needs the fewest phrases, each weighted by the bits that point into its sample
(log2 of the sample length) and divided by the text length, wins.

Symbols: letters are lower-cased, the most frequent letters of all samples have a symbol of
their own, other letters share one, and a run of anything else is one space. A text is
parsed whole, in blocks of ``BLOCK`` symbols (the parse restarts at each block), so that all
blocks of a batch walk in lockstep and a very long text is no slower per character.

The automata are built on the driver from the bounded sample and broadcast; documents are
never shuffled. Text null or without a letter: ``und`` with score 0; the same if nothing
could be learned. Equal languages: the first by name. Rows with null lang or text teach nothing;
null ids are not learned from. Repeated rows and further columns pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqtok.llm.common import append_columns, sample_by_hash
from seqtok.session import materialize

SAMPLE_DOCS = 64
SAMPLE_CHARS = 600
BLOCK = 256
SYMBOLS = 62               # letters with a symbol of their own
MAX_LANGUAGES = 200
SHARPNESS = 8
UNDETERMINED = "und"
_SPACE, _OTHER = 0, 1


class SuffixAutomaton:
    """All substrings of a symbol sequence; ``next[state]`` maps a symbol to a state."""

    def __init__(self, symbols: list[int]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        last = 0
        for s in symbols:
            new = self._state({}, 0, self.length[last] + 1)
            p = last
            while p >= 0 and s not in self.next[p]:
                self.next[p][s] = new
                p = self.link[p]
            if p >= 0:
                q = self.next[p][s]
                if self.length[q] == self.length[p] + 1:
                    self.link[new] = q
                else:
                    twin = self._state(dict(self.next[q]), self.link[q], self.length[p] + 1)
                    while p >= 0 and self.next[p].get(s) == q:
                        self.next[p][s] = twin
                        p = self.link[p]
                    self.link[q] = self.link[new] = twin
            last = new

    def _state(self, edges: dict[int, int], link: int, length: int) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def walk_table(self, width: int) -> np.ndarray:
        """Flat table of the greedy parse: entry ``state * width + symbol`` holds
        ``2 * width * next state``, plus 1 where a new phrase begins."""
        root = np.zeros(width, dtype=np.int64)
        for s, t in self.next[0].items():
            root[s] = t
        table = np.empty((len(self.next), width), dtype=np.int64)
        table[:] = root * (2 * width) + 1          # no edge: the phrase ends, a new one begins
        for state, edges in enumerate(self.next):
            if state:
                for s, t in edges.items():
                    table[state, s] = t * (2 * width)
        if table.max(initial=0) < 2**31:
            table = table.astype(np.int32)
        return table.ravel()


def is_letter_table() -> np.ndarray:
    return np.fromiter((not 0xD800 <= c < 0xE000 and chr(c).isalpha() for c in range(0x110000)),
                       dtype=bool, count=0x110000)


class CrossParser:
    """Languages with their automata over a common alphabet."""

    def __init__(self, samples: dict[str, list[str]], letters: int = SYMBOLS):
        self.names = sorted(samples)
        letter = is_letter_table()
        self.symbol = np.where(letter, _OTHER, _SPACE).astype(np.uint8)
        seen = np.zeros(0x110000, dtype=np.int64)
        for texts in samples.values():
            for t in texts:
                points = _points(t.lower())
                seen += np.bincount(points[letter[points]], minlength=0x110000)
        chosen = sorted(np.flatnonzero(seen).tolist(), key=lambda c: (-seen[c], c))[:letters]
        for i, c in enumerate(chosen):
            self.symbol[c] = i + 2
        for c in chosen:                           # upper case of a chosen letter
            up = chr(c).upper()
            if len(up) == 1 and up.lower() == chr(c):
                self.symbol[ord(up)] = self.symbol[c]
        self.width = len(chosen) + 3
        self.pad = self.width - 1
        self.tables, self.bits = [], []
        for name in self.names:
            joined: list[int] = []
            for t in samples[name]:
                joined += [*self.symbols([t])[0].tolist(), self.pad]   # no phrase spans two texts
            self.tables.append(SuffixAutomaton(joined).walk_table(self.width))
            self.bits.append(float(np.log2(max(2, len(joined)))))

    def symbols(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all texts and each text's bounds; leading spaces are dropped."""
        raw = [_points(t) if t else np.zeros(0, np.uint32) for t in texts]
        sizes = np.array([len(r) for r in raw], dtype=np.int64)
        ends = np.cumsum(sizes)
        sym = self.symbol[np.concatenate(raw)] if len(raw) else np.zeros(0, np.uint8)
        before = np.empty_like(sym)
        before[1:] = sym[:-1]
        starts = (ends - sizes)[sizes > 0]
        before[starts] = _SPACE
        keep = (sym != _SPACE) | (before != _SPACE)
        bounds = np.concatenate([[0], np.cumsum(keep)])[np.concatenate([[0], ends])]
        return sym[keep], bounds

    def phrases(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """``(phrases per text and language, symbols per text)``."""
        sym, bounds = self.symbols(texts)
        size = np.diff(bounds)
        blocks = -(-size // BLOCK)
        text = np.repeat(np.arange(len(texts)), blocks)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        begin = bounds[text] + nth * BLOCK
        length = np.minimum(BLOCK, bounds[text + 1] - begin)
        order = np.argsort(-length, kind="stable")  # the live blocks of a step are a prefix
        begin, length, text = begin[order], length[order], text[order]
        live = np.searchsorted(-length, -np.arange(BLOCK), side="left")
        counts = np.zeros((len(texts), len(self.names)), dtype=np.int64)
        rows = np.zeros((BLOCK, len(begin)), dtype=np.uint8)
        for t in range(BLOCK):
            rows[t, :live[t]] = sym[begin[:live[t]] + t]
        for k, table in enumerate(self.tables):
            state = np.zeros(len(begin), dtype=table.dtype)
            count = np.zeros(len(begin), dtype=np.int32)
            for t in range(BLOCK):
                n = live[t]
                if not n:
                    break
                step = table.take(state[:n] + rows[t, :n])
                count[:n] += step & 1
                state[:n] = step >> 1
            counts[:, k] = np.bincount(text, weights=count, minlength=len(texts)).astype(np.int64)
        return counts, size

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """``(language, score, bits per symbol)`` per text."""
        if not self.names:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        counts, size = self.phrases(texts)
        rate = counts * np.array(self.bits) / np.maximum(size, 1)[:, None]
        best = rate.argmin(axis=1)
        least = np.take_along_axis(rate, best[:, None], axis=1)
        known = size > 0
        weight = (least / np.maximum(rate, 1e-12)) ** SHARPNESS
        score = np.where(known, 1 / np.maximum(weight.sum(axis=1), 1.0), 0.0)
        names = [self.names[b] if k else UNDETERMINED for b, k in zip(best, known)]
        return names, score, np.where(known, least[:, 0], 0.0)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)


def language_samples(labelled: DataFrame, id_col: str, text_col: str, lang_col: str,
                     docs: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS) -> dict[str, list[str]]:
    """Pieces of ``chars`` code points from anywhere in the texts of up to ``docs`` documents of each
    language, up to ``docs`` pieces; fewer beyond ``MAX_LANGUAGES`` languages, so that the sample on the
    driver is bounded."""
    rows = labelled.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()
                          & F.col(lang_col).isNotNull())
    languages = rows.select(lang_col).distinct().count()
    docs = max(1, min(docs, docs * MAX_LANGUAGES // max(languages, 1)))
    whole = rows.select(F.col(lang_col).alias("lang"), F.xxhash64(F.col(id_col)).alias("h"), F.col(text_col).alias("text"))
    chosen = materialize(sample_by_hash(whole, "lang", "h", docs, ("text",)), "language-documents")
    cut = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{chars}}}"), F.lit(0))
    pieces = chosen.select("lang", F.posexplode(cut).alias("i", "piece"), "h").select(
        "lang", F.xxhash64("h", "i").alias("h"), F.col("piece").alias("text"))
    out: dict[str, list[str]] = {}
    for r in sample_by_hash(pieces, "lang", "h", docs, ("text",)).orderBy("lang", "h", "text").collect():
        out.setdefault(r["lang"], []).append(r["text"])
    return out


def learn_languages(spark: SparkSession, labelled: DataFrame, id_col: str = "doc_id",
                    text_col: str = "text", lang_col: str = "lang"):
    """Broadcast ``CrossParser`` learned from the labelled rows."""
    return spark.sparkContext.broadcast(
        CrossParser(language_samples(labelled, id_col, text_col, lang_col)))


def with_language(df: DataFrame, parser, text_col: str = "text", lang_out: str = "lang_pred",
                  score_out: str = "score", bits_out: str = "bits_per_symbol") -> DataFrame:
    """``df`` with the predicted language, its score, and the bits per symbol of its parse."""

    def make():
        model = parser.value

        def work(texts: list) -> list:
            names, score, bits = model.predict(texts)
            return [pa.array(names, pa.string()), pa.array(score, pa.float64()),
                    pa.array(bits, pa.float64())]

        return work

    return append_columns(df, text_col, [
        T.StructField(lang_out, T.StringType()), T.StructField(score_out, T.DoubleType()),
        T.StructField(bits_out, T.DoubleType())], make)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that are not learned from: crc32 of the id's decimal text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def identify_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       lang_col: str = "lang") -> DataFrame:
    """Id, ``held_out``, ``lang_pred`` and ``score`` of every document; learns from the
    rows that are not held out."""
    parser = learn_languages(docs.sparkSession, docs.where(~held_out(id_col)), id_col, text_col, lang_col)
    return with_language(docs.select(id_col, text_col), parser, text_col).select(
        id_col, held_out(id_col).alias("held_out"), "lang_pred", "score", "bits_per_symbol")
