"""3. URL filters: temporal list join of captures with dated list entries.

DataFrame functions only. List entries are dated events (add, remove) of a key: a domain, which covers its subdomains,
or a URL prefix of whole path segments. Events become validity intervals ``[day, next day)``; each capture is joined
as of its fetch day with the entries on its host's suffixes and its path's prefixes. The longest active key
decides; on equal keys the allow list does.

Cases: a null URL or one without a host matches nothing and is allowed; null days match nothing; of events of one key
on one day a remove comes last; an add while active changes nothing; repeated captures give repeated results; events
with nulls are left out;
an empty list allows all; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import small, written

FOREVER = 1 << 40
_HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#]*@)?(\[[^\]/?#]*\]|[^/?#:@]*)"
_PATH = r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*(/[^?#]*)"


def host_of(url: str) -> Column:
    """Lower-case host without user, port or final dot, an IPv6 address in its brackets; empty where there is none."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, _HOST, 1)), r"\.$", "")


def keys_of(url: str) -> Column:
    """List keys that cover a URL: ``d:`` and each suffix of the host, ``p:`` and the host with each path prefix."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    steps = F.filter(F.split(F.regexp_extract(url, _PATH, 1), "/"), lambda s: s != "")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.lit("d:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    domains = F.when(host.startswith("["), F.array(F.concat(F.lit("d:"), host))).otherwise(suffixes)
    prefixes = F.when(F.size(steps) > 0, F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.concat(F.lit("p:"), host, F.lit("/"), F.array_join(F.slice(steps, F.lit(1), i), "/")))).otherwise(F.array().cast("array<string>"))
    return F.when(host != "", F.array_distinct(F.concat(domains, prefixes))).otherwise(F.array().cast("array<string>"))


def intervals(events: DataFrame) -> DataFrame:
    """``list, key, from_day, to_day`` from ``list, key, day, op``."""
    clean = events.where("list is not null and key is not null and day is not null and op in ('add', 'remove')")
    by = Window.partitionBy("list", "key").orderBy("day", "op")
    then = clean.select("list", "key", "op", F.col("day").alias("from_day"), F.coalesce(F.lead("day").over(by), F.lit(FOREVER)).alias("to_day"))
    return then.where("op = 'add' and to_day > from_day").drop("op")


def filtered(captures: DataFrame, events: DataFrame) -> DataFrame:
    """``page_id, url, fetch_day, host, verdict, list, rule`` of every capture (``page_id, url, fetch_day``)."""
    source = captures.select("page_id", "url", "fetch_day")
    valid = small(written(intervals(events), "intervals"))
    asked = source.distinct().select("page_id", "url", "fetch_day", F.explode(keys_of("url")).alias("key"))
    met = asked.join(valid, "key").where("from_day <= fetch_day and fetch_day < to_day")
    order = F.struct(F.length("key").alias("n"), (F.col("list") == "allow").alias("allows"), F.col("key"), F.col("list"))
    best = met.groupBy("page_id", "url", "fetch_day").agg(F.max(order).alias("best"))
    out = source.join(best, ["page_id", "url", "fetch_day"], "left")
    blocked = F.coalesce(F.col("best.list") == "block", F.lit(False))
    return out.select("page_id", "url", "fetch_day", host_of("url").alias("host"), F.when(blocked, "blocked").otherwise("allowed").alias("verdict"), F.col("best.list").alias("list"), F.col("best.key").alias("rule"))


def _number(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, 7), 16, 10).cast("bigint")


def derived_events(pages: DataFrame) -> DataFrame:
    """List events made from the pages' own hosts and paths: their hashes say which are listed, and when."""
    hosts = pages.select(host_of("url").alias("host")).where("host <> ''").distinct()
    domains = hosts.select("host").union(hosts.select(F.substring_index("host", ".", -2))).distinct().select(F.concat(F.lit("d:"), "host").alias("key"), _number(F.col("host")).alias("x")).where("x % 3 = 0")
    start = F.col("x") % 200 + 19000
    event = lambda df, name, day, op: df.select(F.lit(name).alias("list"), "key", day.alias("day"), F.lit(op).alias("op"))
    blocks = event(domains, "block", start, "add").union(event(domains.where("x % 2 = 0"), "block", start + 50 + F.col("x") % 100, "remove")).union(event(domains.where("x % 4 = 0"), "block", start + 200 + F.col("x") % 150, "add"))
    step = F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*/+([^/?#]+)", 1)
    prefixes = pages.select(host_of("url").alias("host"), step.alias("step")).where("host <> '' and step <> ''").distinct()
    prefixes = prefixes.select(F.concat(F.lit("p:"), "host", F.lit("/"), "step").alias("key")).withColumn("x", _number(F.col("key"))).where("x % 5 = 0")
    return blocks.union(event(prefixes, "allow", F.col("x") % 250 + 19000, "add"))


def url_report(pages: DataFrame) -> DataFrame:
    """Verdicts on all pages; the fetch day follows from the page's number."""
    captures = pages.select("page_id", "url", (F.pmod("page_id", F.lit(365)) + 19000).alias("fetch_day"))
    return filtered(captures, derived_events(pages))
