"""URL filters: temporal list join.

A list is a table of dated events (entry, action 'add' or 'remove', moment).
Events become validity intervals [from, until) per entry; a capture is evaluated
against the entries active when it was fetched, by an equi-join on the keys that
its URL can match (its host and every parent domain, and its host with every
leading path), narrowed by the interval: as of the fetch, one at most per entry.

Intervals are written first and captures exploded beside them, so both sides of
the join are plain exchanges that AQE may split where one host has most rows.
Names without a dot (top-level domains, which a third of all captures may share)
are keys only where the list has them: they are collected up to ``TOP_NAMES``,
beyond which every capture keeps its key.

Edge cases: of several events at one moment an 'add' wins; unknown actions and
events without entry or moment are ignored; an 'add' while active changes
nothing; captures with a null URL or moment, or without a host, are kept and not
blocked; equal captures are judged alike; columns of the captures that are named
as a result (blocked, n_entries, entry) are replaced by it, all others kept.  Hosts compare in lower case without a
trailing dot, paths as they are, without query or fragment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..runtime import ship
from .common import materialize

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)"
#: Names without a dot that are sent to the captures as a list.
TOP_NAMES = 4096
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"


def host(url: Column) -> Column:
    """Lower-case host of a URL; empty if there is none."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, HOST, 1)), r"\.$", "")


def match_keys(url: Column) -> Column:
    """Entries that may cover a URL: 'b.c' of host a.b.c, and 'a.b.c/x/y' of its leading paths."""
    name = host(url)
    labels = F.split(name, r"\.", -1)
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    steps = F.filter(F.split(F.regexp_extract(url, PATH, 1), "/", -1), lambda s: s != "")
    numbers = F.when(F.size(steps) > 0, F.sequence(F.lit(1), F.size(steps))).otherwise(F.array().cast("array<int>"))
    paths = F.transform(numbers, lambda i: F.concat(name, F.lit("/"), F.array_join(F.slice(steps, F.lit(1), i), "/")))
    return F.when(name != "", F.array_distinct(F.concat(domains, paths))).otherwise(F.array().cast("array<string>"))


def validity(events: DataFrame, entry_col: str = "entry", action_col: str = "action", at_col: str = "effective_at") -> DataFrame:
    """(entry, valid_from, valid_until): when each entry is active; no end is null."""
    rows = events.where(F.col(entry_col).isNotNull() & F.col(at_col).isNotNull() & F.col(action_col).isin("add", "remove"))
    entry = F.regexp_replace(F.lower(F.col(entry_col)), r"\.$", "")
    entry = F.when(F.col(entry_col).contains("/"), F.concat(F.lower(F.substring_index(entry_col, "/", 1)), F.expr(f"substring(`{entry_col}`, instr(`{entry_col}`, '/'))"))).otherwise(entry)
    moments = rows.groupBy(entry.alias("entry"), F.col(at_col).alias("valid_from")).agg(F.max(F.col(action_col) == "add").alias("active"))
    in_time = Window.partitionBy("entry").orderBy("valid_from")
    changes = moments.withColumn("was", F.lag("active").over(in_time)).where(F.col("was").isNull() | (F.col("was") != F.col("active")))
    ends = changes.withColumn("valid_until", F.lead("valid_from").over(in_time))
    return ends.where("active").select("entry", "valid_from", "valid_until")


def temporal_filter(captures: DataFrame, events: DataFrame, url_col: str = "url", at_col: str = "fetched_at") -> DataFrame:
    """``captures`` with blocked (boolean), n_entries (long) and entry (the longest active one, then the least)."""
    ship(captures.sparkSession)
    intervals = materialize(validity(events), "intervals")
    asked = captures.select(F.col(url_col).alias("asked_url"), F.col(at_col).alias("asked_at")).where("asked_url is not null and asked_at is not null").distinct()
    tops = [r.entry for r in intervals.where(~F.col("entry").contains(".") & ~F.col("entry").contains("/")).select("entry").distinct().limit(TOP_NAMES + 1).collect()]
    keys = match_keys(F.col("asked_url"))
    if len(tops) <= TOP_NAMES:
        keys = F.filter(keys, lambda k: k.contains(".") | k.contains("/") | k.isin(tops))
    keyed = asked.select("asked_url", "asked_at", F.explode(keys).alias("entry"))
    active = keyed.join(intervals, "entry").where((F.col("asked_at") >= F.col("valid_from")) & (F.col("valid_until").isNull() | (F.col("asked_at") < F.col("valid_until"))))
    best = F.min(F.struct((-F.length("entry")).alias("shorter"), F.col("entry")))
    verdicts = active.groupBy("asked_url", "asked_at").agg(F.count("*").alias("n"), best.alias("best"))
    rows = captures.select(F.struct(*captures.columns).alias("row"), F.col(url_col).alias("own_url"), F.col(at_col).alias("own_at"))
    joined = rows.join(verdicts, (F.col("own_url") == F.col("asked_url")) & (F.col("own_at") == F.col("asked_at")), "left")
    added = {"blocked": F.col("n").isNotNull(), "n_entries": F.coalesce("n", F.lit(0).cast("long")), "entry": F.col("best.entry")}
    kept = [F.col("row").getField(c).alias(c) for c in captures.columns if c not in added]
    return joined.select(*kept, *[v.alias(k) for k, v in added.items()])
