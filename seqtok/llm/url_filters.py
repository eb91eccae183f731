"""URL filters: dated block-list entries joined to captures as of their fetch time.

Method (DataFrame and SQL functions only): the changelog of a list (``list_name, pattern,
action add/remove, entry_date``) becomes validity intervals ``[valid_from, valid_to)``: an
added pattern is active from its date until the date of its next removal. Each capture is
evaluated against the entries active on its fetch date: its candidate patterns (the host,
its parent domains, and host plus each path prefix) are joined on the pattern with the
fetch date inside the interval.

Scale: the changelog is first reduced to one row per list, pattern and day, so one hot
pattern has at most as many rows as there are days. Captures are reduced to distinct (url,
day) pairs before they are exploded. The intervals are broadcast if their measured size is
small; else patterns are spread over salts sized by the captures that carry them.

Rows: null or host-less urls and null fetch times match nothing and stay unblocked; entries
with a null list, pattern or date are ignored; an action other than ``add`` removes. An add
and a removal on one day count as a removal; repeated entries count once; repeated captures
stay. Patterns and hosts compare in lower case. Empty lists block nothing. Further columns
of the captures pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqtok.operators.lookup import size_in_bytes
from seqtok.session import materialize

BROADCAST_BYTES = 32 << 20
ROWS_PER_SALT = 200_000
FAR_FUTURE = "9999-12-31"


def url_host(url: Column) -> Column:
    """Lower-case host of an absolute http(s) url, without user and port; null if none."""
    host = F.regexp_extract(F.lower(url), r"^https?://(?:[^/?#@]*@)?([^/?#:@]+)", 1)
    return F.when(host != "", host)


def url_path(url: Column) -> Column:
    """Path of the url in lower case, without query and fragment ('' if none)."""
    return F.regexp_extract(F.lower(url), r"^https?://[^/?#]+([^?#]*)", 1)


def candidate_patterns(url: Column) -> Column:
    """The host, each parent domain of two labels or more, and host + each path prefix."""
    host, path = url_host(url), url_path(url)
    labels = F.split(host, r"\.")
    n = F.size(labels)
    domains = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n - 1)),
                          lambda i: F.concat_ws(".", F.slice(labels, i, n)))
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    prefixes = F.transform(
        F.when(F.size(parts) > 0, F.sequence(F.lit(1), F.size(parts))).otherwise(
            F.array().cast("array<int>")),
        lambda i: F.concat(host, F.lit("/"), F.concat_ws("/", F.slice(parts, 1, i))))
    return F.when(host.isNotNull(), F.array_distinct(F.concat(domains, prefixes)))


def validity_intervals(entries: DataFrame) -> DataFrame:
    """``(list_name, pattern, valid_from, valid_to)`` of the times a pattern is listed."""
    days = (entries.select("list_name", F.lower("pattern").alias("pattern"),
                           F.col("entry_date").cast("date").alias("day"),
                           F.coalesce(F.lower("action") == "add", F.lit(False)).alias("adds"))
                   .where("list_name is not null and pattern is not null and day is not null")
                   .groupBy("list_name", "pattern", "day").agg(F.min("adds").alias("adds")))
    after = Window.partitionBy("list_name", "pattern").orderBy("day")
    spans = days.withColumn("until", F.lead("day").over(after))
    return spans.where("adds").select(
        "list_name", "pattern", F.col("day").alias("valid_from"),
        F.coalesce("until", F.lit(FAR_FUTURE).cast("date")).alias("valid_to"))


def filter_urls(captures: DataFrame, entries: DataFrame, url_col: str = "url",
                time_col: str = "fetch_time") -> DataFrame:
    """``captures`` with ``blocked`` (boolean), ``lists`` (sorted names of the lists with
    an active match) and ``patterns`` (sorted matching patterns)."""
    spans = validity_intervals(entries)
    visits = (captures.select(F.col(url_col).alias("__u"), F.to_date(F.col(time_col)).alias("__d"))
                      .where("__u is not null and __d is not null").distinct())
    probes = visits.select("__u", "__d", F.explode(candidate_patterns(F.col("__u"))).alias("__p"))
    active = (F.col("__d") >= F.col("valid_from")) & (F.col("__d") < F.col("valid_to"))
    if size_in_bytes(spans) <= BROADCAST_BYTES:
        hits = probes.join(F.broadcast(spans), (F.col("__p") == F.col("pattern")) & active)
    else:
        hits = _salted(probes, spans, active)
    verdict = hits.groupBy("__u", "__d").agg(
        F.array_sort(F.collect_set("list_name")).alias("__lists"),
        F.array_sort(F.collect_set("pattern")).alias("__patterns"))
    verdict = materialize(verdict, "verdicts")
    if size_in_bytes(verdict) <= BROADCAST_BYTES:          # then a URL with most captures is no hot key
        verdict = F.broadcast(verdict)
    none = F.array().cast("array<string>")
    joined = captures.withColumns({"__cu": F.col(url_col), "__cd": F.to_date(F.col(time_col))}).join(
        verdict, (F.col("__cu") == F.col("__u")) & (F.col("__cd") == F.col("__d")), "left")
    return joined.select(
        *[F.col(f"`{c}`") for c in captures.columns if c.lower() not in ("blocked", "lists", "patterns")],
        F.col("__u").isNotNull().alias("blocked"),
        F.coalesce("__lists", none).alias("lists"), F.coalesce("__patterns", none).alias("patterns"))


def _salted(probes: DataFrame, spans: DataFrame, active: Column) -> DataFrame:
    """Shuffle join whose hot patterns are spread over ceil(probes / ROWS_PER_SALT) salts."""
    weight = (probes.groupBy("__p").count().where(F.col("count") > ROWS_PER_SALT)
                    .select(F.col("__p").alias("__hot"),
                            F.ceil(F.col("count") / ROWS_PER_SALT).cast("int").alias("__n")))
    # patterns above ROWS_PER_SALT probes: at most probes / ROWS_PER_SALT of them
    weight = materialize(weight, "hot-patterns")
    if size_in_bytes(weight) <= BROADCAST_BYTES:
        weight = F.broadcast(weight)
    salts = F.coalesce(F.col("__n"), F.lit(1))
    left = (probes.join(weight, F.col("__p") == F.col("__hot"), "left")
                  .withColumn("__s", F.pmod(F.xxhash64("__u", "__d"), salts).cast("int")))
    right = (spans.join(weight, F.col("pattern") == F.col("__hot"), "left")
                  .withColumn("__t", F.explode(F.sequence(F.lit(0), salts - 1)))
                  .drop("__hot", "__n"))
    return left.drop("__hot", "__n").join(
        right, (F.col("__p") == F.col("pattern")) & (F.col("__s") == F.col("__t")) & active)
