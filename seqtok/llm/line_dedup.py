"""Site-relative line dedup: drop lines that too large a share of a host's pages contain.

Method (DataFrame and SQL functions only): texts are cut at line feeds; a line's identity
is a 128-bit hash of the line without outer spaces (tabs and carriage returns count). Per host and line the pages
containing it are counted (once per page), divided by the host's page total, and the lines
whose share exceeds ``max_ratio`` on at least ``min_pages`` pages are boilerplate. They
are taken out of every page of the host; the other lines stay in order.

Scale: lines are counted with a partial aggregate, so a host with a third of all rows sends
one row per line and task. A host has at most (lines per page / max_ratio) boilerplate
lines, so each host's list is short; the lists are broadcast if their measured size is
small, else they are replicated over salts sized by the host's rows and joined by shuffle.

Rows: null text stays null; an empty text and blank lines stay; a null host is a host of its
own; repeated rows count as pages of their own. Further columns pass through unchanged.

With ``by_text`` a whole text counts once per host however many rows hold it (each row of c
copies weighs 1/c in a line's pages, and the page total is the number of different texts), and a
text that would lose every line with words stays whole: copies are left to later stages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqtok.operators.lookup import size_in_bytes
from seqtok.session import materialize

MAX_RATIO = 0.02
MIN_PAGES = 5
BROADCAST_BYTES = 32 << 20
ROWS_PER_SALT = 200_000


def line_key(line: Column) -> Column:
    """128-bit identity of a line; null for a blank one."""
    bare = F.trim(line)
    return F.when(bare != "", F.concat_ws(":", F.xxhash64(F.lit(1), bare),
                                          F.xxhash64(F.lit(2), bare)))


def _keys(text: Column) -> Column:
    return F.transform(F.split(text, "\n"), line_key)


def _text_id(text: Column) -> list[Column]:
    return [F.xxhash64(F.lit(1), text).alias("__t1"), F.xxhash64(F.lit(2), text).alias("__t2")]


def _weighed(cut: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``cut`` with ``__weight`` 1/c for each of c rows of one text on a host, and the number of
    different texts per host."""
    # written: it is measured, joined and summed
    texts = materialize(cut.select("__host", *_text_id(F.col("__text")))
                           .groupBy("__host", "__t1", "__t2").agg(F.count(F.lit(1)).alias("__copies")), "texts")
    totals = texts.groupBy("__host").agg(F.count(F.lit(1)).alias("__total"))
    copies = texts.where("__copies > 1").select(F.col("__host").alias("__ch"), F.col("__t1").alias("__c1"),
                                                F.col("__t2").alias("__c2"), "__copies")
    if size_in_bytes(copies) <= BROADCAST_BYTES:
        copies = F.broadcast(copies)
    known = cut.select("__host", "__text", *_text_id(F.col("__text"))).join(
        copies, F.col("__host").eqNullSafe(F.col("__ch")) & (F.col("__t1") == F.col("__c1"))
        & (F.col("__t2") == F.col("__c2")), "left")
    return known.select("__host", "__text",
                        (F.lit(1.0) / F.coalesce("__copies", F.lit(1))).alias("__weight")), totals


def boilerplate_lines(pages: DataFrame, host: Column, text_col: str = "text",
                      max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES,
                      by_text: bool = False) -> DataFrame:
    """``(__host, __line, __pages, __total)``: every line on more than ``max_ratio`` of its
    host's pages. ``__host`` is null for pages without a host."""
    cut = pages.select(host.alias("__host"), F.col(text_col).alias("__text"))
    if by_text:
        cut, totals = _weighed(cut)
        counted = F.round(F.sum("__weight")).cast("long")      # a sum of whole groups of copies
    else:
        totals = cut.groupBy("__host").agg(F.count(F.lit(1)).alias("__total"))
        counted = F.count(F.lit(1))
    lines = (cut.where(F.col("__text").isNotNull())
                .select(*[c for c in cut.columns if c != "__text"],
                        F.explode(F.array_distinct(_keys(F.col("__text")))).alias("__line"))
                .where(F.col("__line").isNotNull())
                .groupBy("__host", "__line").agg(counted.alias("__pages"))
                .where(F.col("__pages") >= min_pages))
    joined = lines.join(totals.withColumnRenamed("__host", "__th"),
                        F.col("__host").eqNullSafe(F.col("__th"))).drop("__th")
    return joined.where(F.col("__pages") > F.col("__total") * F.lit(max_ratio))


def drop_boilerplate(pages: DataFrame, host: Column, text_col: str = "text",
                     max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES,
                     dropped_col: str | None = None, by_text: bool = False) -> DataFrame:
    """``pages`` with the boilerplate lines of each page's host taken out of its text;
    ``dropped_col``: also the number of lines taken out; a column of that name (in any case of letters) is
    replaced."""
    # written: it is measured, then joined; the lines are counted once
    found = materialize(boilerplate_lines(pages, host, text_col, max_ratio, min_pages, by_text), "boilerplate")
    lists = (found.groupBy("__host").agg(F.collect_set("__line").alias("__bad"),
                                         F.first("__total").alias("__total")))
    cols = [c for c in pages.columns if dropped_col is None or c.lower() != dropped_col.lower()]
    marked = pages.withColumn("__h", host)
    if size_in_bytes(found.select("__host", "__line")) <= BROADCAST_BYTES:
        joined = marked.join(F.broadcast(lists), F.col("__h").eqNullSafe(F.col("__host")), "left")
    else:
        salts = F.greatest(F.lit(1), F.ceil(F.col("__total") / ROWS_PER_SALT)).cast("int")
        # only hosts of more than ROWS_PER_SALT pages: pages / ROWS_PER_SALT rows at most
        sized = lists.where(F.col("__total") > ROWS_PER_SALT).select("__host", salts.alias("__salts"))
        if size_in_bytes(sized) <= BROADCAST_BYTES:
            sized = F.broadcast(sized)
        # page side: a salt below its host's number of salts, from a hash of the text
        page = (marked.join(sized, F.col("__h").eqNullSafe(F.col("__host")), "left").drop("__host")
                      .withColumn("__salt", F.pmod(F.xxhash64(text_col),
                                                   F.coalesce("__salts", F.lit(1))).cast("int")))
        spread = lists.select("__host", "__bad", F.explode(F.sequence(F.lit(0), salts - 1)).alias("__s"))
        joined = page.join(spread, F.col("__h").eqNullSafe(F.col("__host"))
                           & (F.col("__salt") == F.col("__s")), "left")
    lines = F.split(F.col(text_col), "\n")
    kept = F.filter(lines, lambda x: F.coalesce(~F.array_contains(F.col("__bad"), line_key(x)), F.lit(True)))
    touched = F.col("__bad").isNotNull() & F.col(text_col).isNotNull()
    out = joined.withColumn("__kept", F.when(touched, kept))
    if by_text:
        touched = touched & F.exists("__kept", lambda x: F.trim(x) != "")
    outs = [F.when(touched, F.concat_ws("\n", "__kept")).otherwise(F.col(text_col)).alias(text_col)
            if c == text_col else F.col(f"`{c}`") for c in cols]
    if dropped_col:
        outs.append(F.when(touched, F.size(lines) - F.size("__kept")).otherwise(F.lit(0))
                     .cast("long").alias(dropped_col))
    return out.select(*outs)
