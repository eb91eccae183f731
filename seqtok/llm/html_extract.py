"""Main-text extraction by wrapper induction.

Method, for the pages of one host:

1. Every page is parsed to a DOM tree. Like siblings are folded into one place (a signature is the tag with its
   class and role). The different folded trees of all the host's pages, those of most pages first, are aligned
   one after another by simple tree matching: the ordered alignment of children with the most matched nodes. The
   merged tree is the host's template tree; it gives the places, not the texts.
2. Every page of the host is aligned with that tree. A text at a matched place is constant if it is there on
   ``CONSTANT_SHARE`` of the host's pages (``MAIN_SHARE`` inside of ``article`` and ``main``), counted over all pages.
   Copies count once: pages are told apart by a bottom sketch of their words, so that near copies of one article
   count little and do not make its paragraphs look like template. Below ``CONSTANT_PAGES`` (``MAIN_PAGES``) such pages nothing is constant.
3. Constant texts are template and go, on every page and inside of ``article`` and ``main`` too. Varying slots and
   unmatched places are content, unless their element says that they never are: menus, headers, footers,
   sidebars, adverts, notices, forms, reader comments (by element, role, or class and id). A class or id counts only if
   all its words name such a region or are words of layout, never on ``article``, ``main`` or what is around the
   main element, and not on a region that holds most of the varying text (beside a main element it counts
   whatever its size). Where ``article`` and ``main`` hold at
   least half of the varying text, only they are content.

Character references are decoded; white space inside a block is one space; blocks are
joined by an empty line in page order. Nothing is capped.

Scale: pages are parsed and aligned where they lie. Folded trees are counted per host before they move; a host with
more than ``MERGE_TREES`` different ones merges them by groups (by their hash), then the merged ones. Per text one small row (host, place, hashes) is
pre-aggregated and shuffled by all its columns, so a hot host is no hot key. Wrappers (one row per host; their size
does not grow with the pages of a host) are broadcast if their measured size is small, else joined by a shuffle that deals the
pages of a hot host over salts. Siblings of many signatures are aligned in ``k log k``.

Rows: null and empty html gives an empty text; null or odd urls share one wrapper; repeated rows
stay. Broken markup: an unclosed tag at the end is dropped, unclosed elements end with
their parents. Alignment looks at the outer ``MAX_DEPTH`` levels; what is deeper belongs to the place there.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqtok.config import Params
from seqtok.llm.common import text_column
from seqtok.llm.url_filters import url_host
from seqtok.operators.lookup import join_totals, size_in_bytes
from seqtok.session import materialize

MERGE_TREES = 1000           # folded trees of a host that one task merges
CONSTANT_SHARE, CONSTANT_PAGES = 0.5, 3       # share of a host's pages, and pages, that make a text constant
MAIN_SHARE, MAIN_PAGES = 0.9, 8               # the same inside of article and main
MAX_DEPTH = 150
BROADCAST_BYTES = 32 << 20
ROWS_PER_SALT = 100_000
MOST = 0.5                 # of a page's varying text

# fixed values of HTML: elements without content, elements whose content is not text,
# inline elements (all others begin and end a block), elements closed by a like start tag
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg select object".split())
INLINE = frozenset("""a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd
    label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr
    math mrow mi mn mo ms mtext msup msub mfrac msqrt""".split())
SELF_CLOSING = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
                "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("ul ol dl table div section article main body nav aside footer header form".split())
# elements, roles, and words of class or id that mark regions without content
CHROME_TAGS = frozenset("nav header footer aside form menu dialog button".split())
CHROME_WORDS = frozenset("""ad ads advert adverts advertisement sponsor sponsored promo banner nav navbar
    navigation menu breadcrumb breadcrumbs sidebar header footer masthead cookie cookies consent notice
    alert popup modal newsletter subscribe share social related comment comments disqus reply replies
    responses discussion reactions reader readers complementary contentinfo search widget""".split())
LAYOUT_WORDS = frozenset("""area bar block bottom box container content group inner item left list outer panel
    right section site top user wrap wrapper""".split())
MAIN_TAGS = frozenset(["article", "main"])

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>"""
                    r"""|<[!?/][^>]*>|<(?=[a-zA-Z/!?])[^>]*\Z""", re.S)
_LABEL = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_WORDS = re.compile(r"[a-z]+")
_BREAK = "\x00"


class Node:
    """Element with its signature; children are Nodes and text strings, in page order."""

    __slots__ = ("tag", "sig", "kids", "chrome", "named")

    def __init__(self, tag: str, sig: str, chrome: bool, named: bool = False):
        self.tag, self.sig, self.chrome, self.named = tag, sig, chrome, named
        self.kids: list = []


def _names_chrome(words: list[str]) -> bool:
    return not CHROME_WORDS.isdisjoint(words) and all(w in CHROME_WORDS or w in LAYOUT_WORDS for w in words)


def _element(tag: str, attributes: str) -> Node:
    labels, chrome, named = [], tag in CHROME_TAGS, False
    if attributes and "=" in attributes:
        for name, value in _LABEL.findall(attributes):
            value, name = value.strip("\"'").lower(), name.lower()
            if any(_names_chrome(_WORDS.findall(part)) for part in value.split()):
                chrome, named = chrome or name == "role", named or name != "role"
            if name != "id":
                labels.append(value)
    chrome = chrome and tag not in MAIN_TAGS
    return Node(tag, ".".join([tag, *labels]), *((x and tag not in ("html", "body")) for x in (chrome, named)))


def parse(page: str) -> Node:
    """DOM tree of a page; scripts, styles, titles and comments are not in it."""
    root = Node("#root", "#root", False)
    stack = [root]
    at, end = 0, len(page)
    lower = None
    while at < end:
        m = _TOKEN.search(page, at)
        if not m:
            stack[-1].kids.append(page[at:])
            break
        if m.start() > at:
            stack[-1].kids.append(page[at:m.start()])
        at = m.end()
        tag = m.group(2)
        if not tag:
            continue
        tag = tag.lower()
        if m.group(1):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if stack[i].tag in SCOPE and tag not in SCOPE:
                    break                          # a stray end tag stays in its region
            continue
        if tag in RAW:
            if not m.group(3).rstrip().endswith("/"):
                lower = page.lower() if lower is None else lower
                close = lower.find("</" + tag, at) if len(lower) == end else _find_close(page, tag, at)
                at = end if close < 0 else close   # its end tag is then a stray one
            stack[-1].kids.append(" ")
            continue
        if tag in VOID:
            stack[-1].kids.append(" " if tag in INLINE else _BREAK)
            continue
        if tag not in INLINE:                      # a block ends open inline elements
            while len(stack) > 1 and stack[-1].tag in INLINE:
                stack.pop()
            closes = SELF_CLOSING.get(tag, {"p"})
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in closes:
                    del stack[i:]
                    break
                if stack[i].tag in SCOPE:
                    break
        node = _element(tag, m.group(3))
        stack[-1].kids.append(node)
        stack.append(node)
    return root


def _find_close(page: str, tag: str, at: int) -> int:
    m = re.compile("</" + re.escape(tag), re.I).search(page, at)
    return m.start() if m else -1


def clean(text: str) -> str:
    """Decoded text with white space turned into single spaces, trimmed."""
    return " ".join((html.unescape(text) if "&" in text else text).split())


class Run:
    """A text of a page: its place, whether its place has a counterpart, where it lies."""

    __slots__ = ("place", "text", "chrome", "main", "block", "named")

    def __init__(self, place: int, text: str, chrome: bool, main: bool, block: int, named: tuple):
        self.place, self.text, self.chrome, self.main, self.block, self.named = place, text, chrome, main, block, named


def _hash64(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


_PLACES: dict[tuple[int, str], int] = {}


def place_of(above: int, sig: str) -> int:
    """64-bit identity of a place by its signatures from the root on."""
    key = (above, sig)
    if key not in _PLACES:
        if len(_PLACES) > 100_000:
            _PLACES.clear()
        _PLACES[key] = _hash64(above.to_bytes(8, "little", signed=True) + sig.encode("utf-8", "replace"))
    return _PLACES[key]


def text_runs(root: Node) -> list[Run]:
    """All texts in page order. ``named``: the elements around it whose class or id names chrome."""
    out: list[Run] = []
    block = 0
    todo: list = [(root, 0, 0, False, False, ())]
    while todo:
        item, place, depth, chrome, main, named = todo.pop()
        if item is None:
            block += 1
        elif isinstance(item, str):
            if item == _BREAK:
                block += 1
            else:
                out.append(Run(place, item, chrome, main, block, named))
        else:
            place = place_of(place, item.sig) if depth < MAX_DEPTH else place
            chrome, main = chrome or item.chrome, main or item.tag in MAIN_TAGS
            if item.named and not chrome:
                named = (*named, item)
            edge = item.tag not in INLINE
            if edge:
                block += 1
                todo.append((None, 0, 0, False, False, ()))
            todo.extend((k, place, depth + 1, chrome, main, named) for k in reversed(item.kids))
    return out


def _around_main(root: Node) -> set[int]:
    """Identities of the elements around the largest main element (``main`` before ``article``)."""
    best, path = (False, -1), []
    todo: list = [(root, [])]
    while todo:
        node, above = todo.pop()
        if node.tag in MAIN_TAGS:
            size = sum(len(r.text) for r in text_runs(node))
            if (node.tag == "main", size) > best:
                best, path = (node.tag == "main", size), above
            continue                                  # what is inside of it is not around it
        todo.extend((k, [*above, id(node)] if len(above) < MAX_DEPTH else above) for k in node.kids if not isinstance(k, str))
    return set(path)


# --- trees and their alignment

class Place:
    """A place of a folded tree: signature, identity, children by signature in page order."""

    __slots__ = ("sig", "id", "kids")

    def __init__(self, sig: str, ident: int):
        self.sig, self.id, self.kids = sig, ident, {}


def shape(root: Node) -> Place:
    """The folded tree of a page: all siblings of one signature are one place."""
    top = Place(root.sig, place_of(0, root.sig))
    todo: list = [(root, top, 1)]
    while todo:
        node, place, depth = todo.pop()
        for k in node.kids:
            if isinstance(k, str) or depth >= MAX_DEPTH:
                continue
            kid = place.kids.get(k.sig)
            if kid is None:
                kid = place.kids[k.sig] = Place(k.sig, place_of(place.id, k.sig))
            todo.append((k, kid, depth + 1))
    return top


def tree_match(a: Place, b: Place) -> tuple[int, list]:
    """Simple tree matching of two places of one signature: the number of matched nodes and the matched child
    pairs ``(x, y, their pairs)`` of the best ordered alignment. Siblings have different signatures, so this is
    the heaviest increasing run of common signatures, found with a Fenwick tree of best sums."""
    where = {sig: j + 1 for j, sig in enumerate(b.kids)}
    n = len(where)
    best: list[tuple[int, int]] = [(0, -1)] * (n + 1)        # (sum, last pair) over prefixes of b
    found: list[tuple[Place, Place, list, int]] = []         # x, y, inner pairs, pair before
    for sig, x in a.kids.items():
        j = where.get(sig)
        if j is None:
            continue
        y = b.kids[sig]
        weight, inner = tree_match(x, y)
        top, k = (0, -1), j - 1
        while k:
            top = max(top, best[k])
            k &= k - 1
        found.append((x, y, inner, top[1]))
        now, k = (top[0] + weight, len(found) - 1), j
        while k <= n:
            best[k] = max(best[k], now)
            k += k & -k
    top, k = (0, -1), n
    while k:
        top = max(top, best[k])
        k &= k - 1
    pairs, at = [], top[1]
    while at >= 0:
        x, y, inner, before = found[at]
        pairs.append((x, y, inner))
        at = before
    return top[0] + 1, pairs[::-1]


def merge(template: Place, page: Place, pairs: list) -> None:
    """Puts the places of an aligned page that the template has not into it, behind the last matched sibling.
    A place whose signature the template has elsewhere among the siblings stays unmatched."""
    partner = {y.sig: (x, inner) for x, y, inner in pairs}
    order = list(template.kids.values())
    at = 0
    for y in page.kids.values():
        if y.sig in partner:
            x, inner = partner[y.sig]
            merge(x, y, inner)
            at = next(i for i, k in enumerate(order) if k is x) + 1
        elif y.sig not in template.kids:
            order.insert(at, y)
            at += 1
    template.kids = {k.sig: k for k in order}


def template_tree(pages: list[str]) -> Place:
    """The merged tree of all pages of a host."""
    counts: dict[str, int] = {}
    for p in pages:
        if p:
            packed = page_shape(p)
            counts[packed] = counts.get(packed, 0) + 1
    return merged_tree(counts) if counts else shape(parse(""))


def page_shape(page: str) -> str:
    """The folded tree of a page as JSON."""
    return json.dumps(pack_tree(shape(parse(page))))


def merged_tree(counts: dict[str, int]) -> Place:
    """The merged tree of folded trees (JSON, and their pages), those of most pages first."""
    order = sorted(counts, key=lambda t: (-counts[t], t))
    template = unpack_tree(json.loads(order[0]))
    for t in order[1:]:
        tree = unpack_tree(json.loads(t))
        merge(template, tree, tree_match(template, tree)[1])
    return template


def pack_tree(place: Place) -> list:
    return [place.sig, [pack_tree(k) for k in place.kids.values()]]


def unpack_tree(packed: list, above: int = 0) -> Place:
    place = Place(packed[0], place_of(above, packed[0]))
    place.kids = {k[0]: unpack_tree(k, place.id) for k in packed[1]}
    return place


def matched_places(template: Place, page: Place) -> set[int]:
    """Identities of the places of a page that have a counterpart in the template."""
    out, todo = {page.id}, tree_match(template, page)[1]
    while todo:
        _, y, inner = todo.pop()
        out.add(y.id)
        todo.extend(inner)
    return out


# --- pages under a wrapper

class Wrapper:
    """Template tree of a host and its constant texts as ``(place, text hash)``."""

    def __init__(self, tree: Place | None = None, constant: frozenset | set = frozenset()):
        self.tree, self.constant = tree, constant


def text_hash(text: str) -> int:
    return _hash64(clean(text).encode("utf-8", "replace"))


def page_key(runs: list[Run]) -> int:
    """Hash of the three least values of the three-word shingles of a page (a bottom sketch): mostly the
    same for near copies, and different for other pages even where template is most of them."""
    words = " ".join(r.text for r in runs).encode("utf-8", "replace").split()
    codes = np.fromiter(map(zlib.crc32, words), dtype=np.uint32, count=len(words))
    codes = np.concatenate([codes, np.zeros(max(3 - len(words), 0), dtype=np.uint32)])
    mixed = (codes[:-2] * np.uint32(0x85EBCA6B) ^ codes[1:-1] * np.uint32(0xC2B2AE35) ^ codes[2:]) * np.uint32(0x9E3779B1)
    return _hash64(np.unique(mixed)[:3].tobytes())


def page_texts(page: str | None, tree: Place) -> tuple[int, set[tuple[int, int, bool]]]:
    """Of a page: its key and its texts at matched places, ``(place, text hash, in a main element)``."""
    root = parse(page or "")
    places = matched_places(tree, shape(root))
    runs = text_runs(root)
    return page_key(runs), {(r.place, text_hash(r.text), r.main) for r in runs
                            if not r.chrome and r.place in places and not r.text.isspace()}


def extract(page: str | None, wrapper: Wrapper | None = None) -> str:
    """Main text of a page under the wrapper of its host."""
    if not page:
        return ""
    root = parse(page)
    runs = [r for r in text_runs(root) if not r.chrome]
    if wrapper is not None and wrapper.constant:
        places = matched_places(wrapper.tree, shape(root))
        runs = [r for r in runs if not (r.place in places and (r.place, text_hash(r.text)) in wrapper.constant)]
    # what is left varies; regions that only a class or id names go unless they hold most of it
    size = sum(len(r.text.strip()) for r in runs)
    inside: dict[int, int] = {}
    for r in runs:
        for node in r.named:
            inside[id(node)] = inside.get(id(node), 0) + len(r.text.strip())
    if inside:
        around = _around_main(root)
        main = {id(node) for r in runs if r.main for node in r.named}
        has_main = any(r.main and not r.text.isspace() for r in runs)
        out = {k for k, n in inside.items() if k not in around and (n <= MOST * size or (has_main and k not in main))}
        runs = [r for r in runs if not any(id(node) in out for node in r.named)]
    size = sum(len(r.text.strip()) for r in runs)
    main = sum(len(r.text.strip()) for r in runs if r.main)
    if main and main >= MOST * size:
        runs = [r for r in runs if r.main]
    blocks: dict[int, list[str]] = {}
    for r in runs:
        blocks.setdefault(r.block, []).append(r.text)
    done = (clean("".join(parts)) for parts in blocks.values())
    return "\n\n".join(t for t in done if t)


def constant_texts(counts: list[tuple[int, int, bool, int]], pages: int) -> set[tuple[int, int]]:
    """``(place, text)`` of the constant ones among ``(place, text, in main, pages)`` of a host."""
    return {(p, t) for p, t, main, n in counts
            if n >= (MAIN_SHARE if main else CONSTANT_SHARE) * pages and n >= (MAIN_PAGES if main else CONSTANT_PAGES)}


def induce(pages: list[str]) -> Wrapper:
    """The wrapper of a host from all its pages, without Spark."""
    tree = template_tree(pages)
    seen: dict[tuple[int, int, bool], set[int]] = {}
    keys = set()
    for page in pages:
        key, texts = page_texts(page, tree)
        keys.add(key)
        for t in texts:
            seen.setdefault(t, set()).add(key)
    return Wrapper(tree, constant_texts([(*t, len(k)) for t, k in seen.items()], len(keys)))


# --- tables

def _hosts(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    return pages.select(F.coalesce(url_host(F.col(url_col)), F.lit("")).alias("__host"),
                        F.xxhash64(F.col(html_col)).alias("__h"), F.col(html_col).alias("__html")).where(
        F.col("__html").isNotNull() & (F.col("__html") != ""))


_SHAPES = T.StructType([T.StructField("__host", T.StringType()), T.StructField("__tree", T.StringType())])


def _shape_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        shapes = [page_shape(p) for p in text_column(batch, "__html")]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shapes, pa.string())], names=_SHAPES.names)


def _merge_group(group: pd.DataFrame) -> pd.DataFrame:
    tree = merged_tree(dict(zip(group["__tree"], group["__n"])))
    return pd.DataFrame({"__host": [group["__host"].iloc[0]], "__tree": [json.dumps(pack_tree(tree))], "__n": [int(group["__n"].sum())]})


def _template_trees(page: DataFrame) -> DataFrame:
    """``(__host, __tree, __n)``: the merged tree of all pages of a host, and their number."""
    shapes = page.select("__host", "__html").mapInArrow(_shape_rows, _SHAPES)
    trees = materialize(shapes.groupBy("__host", "__tree").agg(F.count(F.lit(1)).alias("__n")), "page-shapes")
    while True:
        sizes = materialize(trees.groupBy(F.col("__host").alias("__sh")).agg(F.count(F.lit(1)).alias("__t")), "shape-counts")
        most = sizes.agg(F.max("__t")).first()[0] or 0
        groups = F.ceil(F.col("__t") / MERGE_TREES)
        dealt = trees.join(sizes, F.col("__host") == F.col("__sh")).select(
            "__host", "__tree", "__n", F.pmod(F.xxhash64("__tree"), groups).alias("__g"))
        merged = dealt.groupBy("__host", "__g").applyInPandas(_merge_group, "__host string, __tree string, __n long")
        # different groups may have merged to one tree
        trees = merged.groupBy("__host", "__tree").agg(F.sum("__n").alias("__n"))
        if most <= MERGE_TREES:
            return trees
        trees = materialize(trees, "page-shapes")


def _with_host(rows: DataFrame, hosts: DataFrame, spread: str) -> DataFrame:
    """Rows joined with the one row of their host; a hot host's rows are dealt over salts."""
    params = Params(salt_rows=ROWS_PER_SALT, broadcast_max_bytes=BROADCAST_BYTES)
    return join_totals(rows, hosts, ["__host"], "__n", F.xxhash64(spread), params)


_TEXTS = T.StructType([T.StructField("__host", T.StringType()), T.StructField("__place", T.LongType()),
                       T.StructField("__text", T.LongType()), T.StructField("__main", T.BooleanType()),
                       T.StructField("__key", T.LongType())])


class _Cache(dict):
    """What was made of the strings of the last hosts."""

    def get_or(self, text: str, make):
        if text not in self:
            if len(self) > 1000:
                self.clear()
            self[text] = make(text)
        return self[text]


def _text_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per different text at a matched place of a page, and one with place 0 for the page itself."""
    trees = _Cache()
    for batch in batches:
        out: list[tuple] = []
        for host, page, tree in zip(*(text_column(batch, c) for c in ("__host", "__html", "__tree"))):
            key, texts = page_texts(page, trees.get_or(tree, lambda t: unpack_tree(json.loads(t))))
            out.append((host, 0, 0, False, key))
            out += [(host, *t, key) for t in texts]
        yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(
            zip(*out), (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int64()))], names=_TEXTS.names)


def wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(__host, __tree, __constant, __n)``: one row per host that has pages; the template tree as JSON, the
    constant texts as ``place:text`` hashes. Counted over all pages of the host."""
    page = _hosts(pages, url_col, html_col)
    trees = materialize(_template_trees(page), "template-trees")
    ready = _with_host(page, trees, "__h").select("__host", "__html", "__tree")
    texts = ready.mapInArrow(_text_rows, _TEXTS)
    # one row per (place, text) and page key, then pages per (place, text)
    counts = texts.distinct().groupBy("__host", "__place", "__text", "__main").agg(F.count(F.lit(1)).alias("__pages"))
    counts = materialize(counts.where((F.col("__pages") >= CONSTANT_PAGES) | (F.col("__place") == 0)), "text-pages")
    all_pages = counts.where("__place = 0").select(F.col("__host").alias("__ah"), F.col("__pages").alias("__all"))
    share = F.when(F.col("__main"), MAIN_SHARE).otherwise(CONSTANT_SHARE) * F.col("__all")
    least = F.when(F.col("__main"), MAIN_PAGES).otherwise(CONSTANT_PAGES)
    constant = (counts.where("__place != 0").join(all_pages, F.col("__host") == F.col("__ah"))
                      .where((F.col("__pages") >= share) & (F.col("__pages") >= least))
                      .groupBy(F.col("__host").alias("__kh"))
                      .agg(F.collect_set(F.concat_ws(":", "__place", "__text")).alias("__constant")))
    return trees.join(constant, F.col("__host") == F.col("__kh"), "left").select(
        "__host", F.when(F.col("__constant").isNotNull(), F.col("__tree")).alias("__tree"), "__constant", "__n")


def _wrapper_of(packed: str) -> Wrapper:
    tree, constant = json.loads(packed)
    return Wrapper(unpack_tree(tree), {tuple(map(int, c.split(":"))) for c in constant})


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
                  html_col: str = "html") -> DataFrame:
    """Id, url, main ``text`` and ``n_chars`` of every page."""
    packed = F.when(F.col("__tree").isNotNull(), F.concat(
        F.lit("["), "__tree", F.lit(","), F.to_json("__constant"), F.lit("]")))
    known = materialize(wrappers(pages, url_col, html_col).select("__host", packed.alias("__wrapper"), "__n"), "wrappers")
    base = pages.select(id_col, url_col, F.col(html_col).alias("__html"),
                        F.coalesce(url_host(F.col(url_col)), F.lit("")).alias("__host"))
    # hosts without any page text have no wrapper
    none = base.where(F.col("__html").isNull() | (F.col("__html") == "")).withColumn("__wrapper", F.lit(None).cast("string"))
    full = _with_host(base.where(F.col("__html") != ""), known, "__html")
    ready = full.unionByName(none).select(id_col, url_col, "__html", "__wrapper")
    schema = T.StructType([pages.schema[id_col], pages.schema[url_col], T.StructField("text", T.StringType()),
                           T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Cache()
        for batch in batches:
            texts = [extract(page, None if w is None else known.get_or(w, _wrapper_of))
                     for page, w in zip(text_column(batch, "__html"), text_column(batch, "__wrapper"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                 pa.array(np.array([len(t) for t in texts], dtype=np.int64))], names=schema.names)

    return ready.mapInArrow(run, schema)
