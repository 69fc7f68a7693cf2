"""Revisions, labels and customers derived from an ``events`` table, for tests, benchmarks and examples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.schemas import REVISION_FIELDS

_EPOCH = "timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', ts)"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``event_id, user_id, event_type, value, t, k``: epoch seconds and the number in ``props``."""
    source = spark.read.parquet(f"{sf_dir}/events.parquet")
    return source.select("event_id", "user_id", "event_type", "value", F.expr(_EPOCH).alias("t"), F.get_json_object("props", "$.k").cast("double").alias("k"))


def base_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First revisions: each event but views as a payment."""
    e = events(spark, sf_dir).where("event_type <> 'view'")
    return e.select(
        "event_id", F.concat(F.col("event_id").cast("string"), F.lit("-r1")).alias("revision_id"), F.col("user_id").alias("customer_id"), F.col("t").alias("event_time"), (F.col("t") + (F.col("event_id") * 37) % 7200).alias("knowledge_time"),
        F.lit("upsert").alias("operation"), F.round(F.col("value") * 100).cast("bigint").alias("amount_cents"), F.when(F.col("event_type") == "error", "failed").otherwise("succeeded").alias("status"), (F.col("k") / 100).alias("merchant_risk"),
    )


def revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First revisions, corrections of every seventh event (half of them move it), retractions of every eleventh."""
    base = base_revisions(spark, sf_dir)
    text = F.col("event_id").cast("string")
    corrected = base.where("event_id % 7 = 0").withColumns({
        "revision_id": F.concat(text, F.lit("-r2")), "knowledge_time": F.col("knowledge_time") + 7200 + 86400 * (F.col("event_id") % 5),
        "amount_cents": F.col("amount_cents") + 100, "event_time": F.col("event_time") + F.when(F.col("event_id") % 14 == 0, 3600).otherwise(0),
    })
    retracted = base.where("event_id % 11 = 0").withColumns({
        "revision_id": F.concat(text, F.lit("-r3")), "knowledge_time": F.col("knowledge_time") + 700000 + 86400 * (F.col("event_id") % 5), "operation": F.lit("retract"),
        "amount_cents": F.lit(None).cast("bigint"), "status": F.lit(None).cast("string"), "merchant_risk": F.lit(None).cast("double"),
    })
    return base.unionByName(corrected).unionByName(retracted).select(*REVISION_FIELDS)


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases as labels, whose prediction cutoff is up to an hour earlier."""
    e = events(spark, sf_dir).where("event_type = 'purchase'")
    return e.select(F.col("event_id").alias("label_id"), F.col("user_id").alias("customer_id"), F.col("t").alias("label_time"), (F.col("t") - (F.col("event_id") % 3) * 1800).alias("prediction_knowledge_time"), (F.col("event_id") % 2).alias("value"))


def spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select(F.col("user_id").alias("customer_id")).distinct()
