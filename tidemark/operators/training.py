"""Point-in-time training sets: no later event and no later correction reaches a label's features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.definitions import FeatureDefinition, check_definitions, widest_window
from tidemark.functions.values import digest_of, row_digest
from tidemark.operators.features import aggregates, with_default
from tidemark.operators.temporal import valid_at, validity_intervals


#: Buckets into which the widest window is cut for joins.
SLICES = 6


def label_cutoffs(labels: DataFrame, dataset_as_of: int) -> DataFrame:
    """Labels with requested and effective cutoffs: the effective one is the smaller of request and dataset time."""
    requested = F.coalesce("prediction_knowledge_time", "label_time")
    out = labels.withColumn("requested_cutoff", requested).withColumn("effective_cutoff", F.least("requested_cutoff", F.lit(dataset_as_of).cast("bigint")))
    return out.withColumns({"dataset_as_of": F.lit(dataset_as_of).cast("bigint"), "truncated": F.col("effective_cutoff") < F.col("requested_cutoff")})


def windowed_join(cut: DataFrame, events: DataFrame, definitions: Sequence[FeatureDefinition], extra: Column) -> DataFrame:
    """Labels with the events of their customer inside the widest window, where ``extra`` holds too.

    Time is cut into ``SLICES`` buckets a window, so a label meets the events of a few buckets of its customer and
    never the customer's whole history; a customer with many events spreads over many keys, and beyond that Spark's
    adaptive execution splits a skewed join, which has no order to keep.
    """
    widest = widest_window(definitions)
    right = events.withColumnRenamed("customer_id", "_customer")
    same = F.col("customer_id") == F.col("_customer")
    window = F.col("event_time") <= F.col("label_time")
    if widest is not None:
        width = -(-widest // SLICES)
        bucket = lambda c: F.floor(F.col(c) / width)
        cut = cut.withColumn("_at", F.explode(F.sequence(F.floor((F.col("label_time") - widest + 1) / width), bucket("label_time"))))
        right = right.withColumn("_bucket", bucket("event_time"))
        same = same & (F.col("_at") == F.col("_bucket"))
        window = window & (F.col("event_time") > F.col("label_time") - widest)
    return cut.join(right, same & window & extra)


def _dataset(labels: DataFrame, cut: DataFrame, joined: DataFrame, definitions: Sequence[FeatureDefinition]) -> DataFrame:
    found = joined.groupBy("label_id", "label_time").agg(*aggregates(definitions, F.col("label_time"))).drop("label_time")
    return cut.join(found, "label_id", "left").select(*cut.columns, *[with_default(d).alias(d.name) for d in definitions])


def point_in_time_dataset(labels: DataFrame, revisions: DataFrame, definitions: Sequence[FeatureDefinition], dataset_as_of: int) -> DataFrame:
    """One row per label: its columns, its cutoffs, and each feature as known at the effective cutoff."""
    check_definitions(definitions)
    cut = label_cutoffs(labels, dataset_as_of)
    events = validity_intervals(revisions).where("operation = 'upsert'").select("customer_id", "event_time", "known_from", "known_to", "status", "amount_cents", "merchant_risk")
    return _dataset(labels, cut, windowed_join(cut, events, definitions, valid_at(F.col("effective_cutoff"))), definitions)


def leaky_dataset(labels: DataFrame, revisions: DataFrame, definitions: Sequence[FeatureDefinition], dataset_as_of: int) -> DataFrame:
    """The wrong join, for audits: the state of events as known in the end, joined by event time only."""
    check_definitions(definitions)
    cut = label_cutoffs(labels, dataset_as_of)
    events = validity_intervals(revisions).where(f"operation = 'upsert' and known_to > {1 << 61}").select("customer_id", "event_time", "status", "amount_cents", "merchant_risk")
    return _dataset(labels, cut, windowed_join(cut, events, definitions, F.lit(True)), definitions)


def leakage_report(labels: DataFrame, revisions: DataFrame, definitions: Sequence[FeatureDefinition], dataset_as_of: int) -> DataFrame:
    """``feature_name, labels, leaked``: for how many labels the event-time-only join gives another value."""
    names = [d.name for d in definitions]
    right = point_in_time_dataset(labels, revisions, definitions, dataset_as_of).select("label_id", *names)
    wrong = leaky_dataset(labels, revisions, definitions, dataset_as_of).select("label_id", *[F.col(n).alias(f"_{n}") for n in names])
    both = right.join(wrong, "label_id")
    pairs = F.array(*[F.struct(F.lit(n).alias("feature_name"), (~F.col(n).eqNullSafe(F.col(f"_{n}"))).alias("leaks")) for n in names])
    return both.select(F.explode(pairs).alias("p")).groupBy("p.feature_name").agg(F.count("*").alias("labels"), F.count_if(F.col("p.leaks")).alias("leaked"))


def dataset_manifest(dataset: DataFrame, source_digest: str, label_digest: str, definition_set_digest: str, code_digest: str) -> DataFrame:
    """One row that binds a training set's rows to what they were made from."""
    body = dataset.select(row_digest(dataset).alias("row_hash")).agg(*digest_of())
    bound = {"source_digest": source_digest, "label_digest": label_digest, "definition_set_digest": definition_set_digest, "code_digest": code_digest}
    out = body.withColumns({k: F.lit(v) for k, v in bound.items()})
    return out.withColumn("manifest_digest", row_digest(out))
