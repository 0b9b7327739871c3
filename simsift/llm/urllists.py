"""Captures against dated URL lists: an as-of join on validity intervals.

A list entry says that from a day on a pattern is listed (``add``) or no longer listed
(``remove``) under a category. Per (pattern, category) the entries become validity
intervals [from, to). A capture is blocked by the intervals that hold at its fetch day.

Patterns are a domain ("example.com": it and all below it), or a host with the first
path segment ("www.example.com/shop"). So a capture has a few keys: its host, the
domains above it and host/segment; matching is by equality of keys.

Scale. Entries of one day and key are one change (the last by ``entry_id`` holds), so
a key has one change a day at most, however many entries it has, before anything is
ordered. Captures are reduced to distinct (host, segment, day) first; a host with a third of
all captures is a few rows a day. Intervals are cut at months and joined on (key, month),
so a row meets 31 intervals per category at most. Captures get their verdict back in
a join that Spark splits where a host is hot.

Capture rows travel as one struct ``row``, so no column name of theirs can clash.
Nulls: entries without pattern, category, day or action are ignored; captures
without URL, host or fetch day are kept and not blocked. Equal rows count as one entry, and
each as a capture. Empty tables give empty results or unblocked captures.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored


def host(url: Column) -> Column:
    """Lower-case host without user, port and final dot; null if there is none."""
    authority = F.regexp_extract(url, r"^(?i:[a-z][a-z0-9+.-]*)://([^/?#]*)", 1)
    name = F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":\d*$|\.$", "")
    return F.nullif(F.lower(name), F.lit(""))


def segment(url: Column) -> Column:
    """First path segment, or an empty text."""
    return F.regexp_extract(url, r"^(?i:[a-z][a-z0-9+.-]*)://[^/?#]*/([^/?#]*)", 1)


def keys(host_name: Column, first: Column) -> Column:
    """The host, every domain above it and, if there is one, host/segment."""
    labels = F.split(host_name, r"\.")
    domains = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
    path = F.when(first != "", F.array(F.concat_ws("/", host_name, first))).otherwise(F.array())
    return F.array_distinct(F.concat(domains, path))


def intervals(entries: DataFrame, end: Column) -> DataFrame:
    """(pattern, category, valid_from, valid_to): when a pattern is listed.

    entries: entry_id, pattern, category, action, day. Open intervals end at ``end``.
    """
    known = entries.filter(
        "pattern IS NOT NULL AND category IS NOT NULL AND day IS NOT NULL AND action IN ('add', 'remove')"
    )
    changes = known.groupBy(F.lower("pattern").alias("pattern"), "category", "day").agg(
        F.max_by("action", F.struct("entry_id", "action")).alias("action")
    )
    following = Window.partitionBy("pattern", "category").orderBy("day")
    spans = changes.withColumn("valid_to", F.coalesce(F.lead("day").over(following), end))
    return spans.filter((F.col("action") == "add") & (F.col("day") < F.col("valid_to"))).select(
        "pattern", "category", F.col("day").alias("valid_from"), "valid_to"
    )


def _month(day: Column) -> Column:
    return F.year(day) * 12 + F.month(day)


def judged(captures: DataFrame, entries: DataFrame, url: str = "url", fetched: str = "fetched_on") -> DataFrame:
    """(row, verdict) per capture: its columns, and a struct (host, blocked, categories, n_entries)."""
    last = captures.agg(F.max(F.col(fetched).cast("date"))).first()[0]  # one value
    day_after = F.date_add(F.lit(last).cast("date"), 1)
    spans = intervals(entries.filter(F.col("day") < day_after), day_after)
    monthly = spans.select(
        F.col("pattern").alias("key"), "category", "valid_from", "valid_to",
        F.explode(F.sequence(_month(F.col("valid_from")), _month(F.date_sub("valid_to", 1)))).alias("month"),
    )
    found = captures.select(
        F.struct("*").alias("row"), host(F.col(url)).alias("host"), segment(F.col(url)).alias("segment"),
        F.col(fetched).cast("date").alias("day"),
    )
    sites = found.select("host", "segment", "day").filter("host IS NOT NULL AND day IS NOT NULL").distinct()
    asked = sites.select(
        "*", F.explode(keys(F.col("host"), F.col("segment"))).alias("key"), _month(F.col("day")).alias("month")
    )
    active = asked.join(monthly, ["key", "month"]).filter("valid_from <= day AND day < valid_to")
    verdicts = stored(
        active.groupBy("host", "segment", "day").agg(
            F.array_sort(F.collect_set("category")).alias("categories"), F.count(F.lit(1)).alias("n_entries")
        ),
        "verdicts",
    )
    verdict = F.struct(
        "host", F.col("n_entries").isNotNull().alias("blocked"),
        F.coalesce("categories", F.array().cast("array<string>")).alias("categories"),
        F.coalesce("n_entries", F.lit(0)).cast("bigint").alias("n_entries"),
    )
    return found.join(verdicts, ["host", "segment", "day"], "left").select("row", verdict.alias("verdict"))
