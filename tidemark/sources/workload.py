"""Deterministic synthetic revisions of any size, made on the executors, and corrections injected into a feed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.schemas import REVISION_FIELDS

PROFILES = ("balanced", "skewed", "high-cardinality")


def synthetic_revisions(spark: SparkSession, profile: str, seed: int, customers: int, events: int, start: int = 1_700_000_000) -> DataFrame:
    """``events`` first revisions. Skewed: four fifths on one customer; high-cardinality: customers as many as events.

    All values are hashes of (row number, seed), so partitioning can't change them."""
    if profile not in PROFILES:
        raise ValueError(f"unknown profile {profile!r}")
    h = lambda salt: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), F.lit(1 << 31))
    pool = max(customers, events) if profile == "high-cardinality" else customers
    who = h(1) % pool
    if profile == "skewed":
        who = F.when(h(2) % 5 < 4, 0).otherwise(who)
    rows = spark.range(events).withColumns({"_who": who, "_t": F.lit(start) + h(3) % (40 * 86_400)})
    return rows.select(
        F.concat(F.lit("e-"), F.col("id").cast("string")).alias("event_id"), F.concat(F.lit("e-"), F.col("id").cast("string"), F.lit("-r1")).alias("revision_id"), F.concat(F.lit("c-"), F.col("_who").cast("string")).alias("customer_id"),
        F.col("_t").alias("event_time"), (F.col("_t") + h(4) % 7200).alias("knowledge_time"), F.lit("upsert").alias("operation"), (h(5) % 100_000).alias("amount_cents"),
        F.when(h(6) % 10 == 0, "failed").otherwise("succeeded").alias("status"), ((h(7) % 101) / 100).alias("merchant_risk"),
    )


def _share(key: Column) -> Column:
    """A number from 0 to 99 that follows from the key's MD5."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 7), 16, 10).cast("bigint") % 100


def with_corrections(revisions: DataFrame, percent: int, later: int = 7200, extra_cents: int = 100) -> DataFrame:
    """The feed and a second revision of about ``percent`` per cent of its events, chosen by the event's hash."""
    chosen = revisions.where((F.col("operation") == "upsert") & (_share(F.col("event_id")) < percent))
    new = chosen.withColumns({"revision_id": F.concat(F.col("revision_id"), F.lit("-c")), "knowledge_time": F.col("knowledge_time") + later, "amount_cents": F.col("amount_cents") + extra_cents})
    return revisions.unionByName(new).select(*REVISION_FIELDS)
