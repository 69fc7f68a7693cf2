"""Windowed features of all entities at one frontier, in one pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.definitions import FeatureDefinition, check_definitions, widest_window
from tidemark.operators.temporal import standing


def aggregates(definitions: Sequence[FeatureDefinition], anchor: Column) -> list[Column]:
    """One conditional aggregate per definition; they share a scan, a shuffle and a grouping."""
    return [d.raw(anchor).alias(d.name) for d in definitions]


def with_default(d: FeatureDefinition) -> Column:
    value = F.col(d.name).cast("bigint" if d.value_type == "integer" else "double")
    return value if d.default is None else F.coalesce(value, F.lit(d.default).cast("bigint" if d.value_type == "integer" else "double"))


def wide_features(revisions: DataFrame, spine: DataFrame, definitions: Sequence[FeatureDefinition], event_cutoff: int, knowledge_cutoff: int) -> DataFrame:
    """``customer_id`` and one column per feature for every customer of the spine, with or without events.

    Events are chosen, cut to the widest window and aggregated before the spine joins, so the join moves one row per
    customer, never one per event.
    """
    check_definitions(definitions)
    events = standing(revisions, event_cutoff, knowledge_cutoff)
    widest = widest_window(definitions)
    if widest is not None:
        events = events.where(F.col("event_time") > event_cutoff - widest)
    found = events.groupBy("customer_id").agg(*aggregates(definitions, F.lit(event_cutoff).cast("bigint")))
    joined = spine.select("customer_id").join(found, "customer_id", "left")
    return joined.select("customer_id", *[with_default(d).alias(d.name) for d in definitions])


def long_form(wide: DataFrame, definitions: Sequence[FeatureDefinition], event_cutoff: int, knowledge_cutoff: int, generation_id: str) -> DataFrame:
    """Feature values, a row each, with integers and floats in columns of their own."""
    rows = F.array(
        *[
            F.struct(
                F.lit(d.name).alias("feature_name"),
                (F.col(d.name) if d.value_type == "integer" else F.lit(None)).cast("bigint").alias("value_long"),
                (F.col(d.name) if d.value_type == "float" else F.lit(None)).cast("double").alias("value_double"),
                F.lit(d.digest).alias("definition_digest"),
            )
            for d in definitions
        ]
    )
    each = wide.select("customer_id", F.explode(rows).alias("f"))
    return each.select("customer_id", "f.feature_name", "f.value_long", "f.value_double", F.lit(event_cutoff).cast("bigint").alias("event_time"), F.lit(knowledge_cutoff).cast("bigint").alias("knowledge_time"), "f.definition_digest", F.lit(generation_id).alias("generation_id"))


def build_generation(revisions: DataFrame, spine: DataFrame, definitions: Sequence[FeatureDefinition], event_cutoff: int, knowledge_cutoff: int, generation_id: str) -> DataFrame:
    """All customers by all definitions, long form, lazily."""
    wide = wide_features(revisions, spine, definitions, event_cutoff, knowledge_cutoff)
    return long_form(wide, definitions, event_cutoff, knowledge_cutoff, generation_id)
