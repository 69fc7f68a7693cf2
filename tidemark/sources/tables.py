"""Readers and writers of the library's tables, always with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import schemas

FORMATS = ("parquet", "json", "orc", "csv")


def read_table(spark: SparkSession, path: str, schema: str, kind: str = "parquet") -> DataFrame:
    """A table of fixed schema; text formats fail on rows that don't fit it."""
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind!r}")
    reader = spark.read.schema(schema)
    return reader.option("mode", "FAILFAST").format(kind).load(path) if kind in ("json", "csv") else reader.format(kind).load(path)


def read_revisions(spark: SparkSession, path: str, kind: str = "parquet", schema: str = schemas.REVISIONS) -> DataFrame:
    return read_table(spark, path, schema, kind)


def read_labels(spark: SparkSession, path: str, kind: str = "parquet", schema: str = schemas.LABELS) -> DataFrame:
    """Labels; the prediction cutoff defaults to the label's time."""
    return read_table(spark, path, schema, kind).withColumn("prediction_knowledge_time", F.coalesce("prediction_knowledge_time", "label_time"))


def in_order(revisions: DataFrame) -> DataFrame:
    """Revisions by knowledge time, event and revision, for outputs that people read."""
    return revisions.orderBy("knowledge_time", "event_id", "revision_id")


def write_values(values: DataFrame, path: str) -> None:
    """Feature values as a table partitioned by generation; other generations stay as they are."""
    values.repartition("generation_id", "customer_id").sortWithinPartitions("customer_id", "feature_name").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("generation_id").parquet(path)
