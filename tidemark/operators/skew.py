"""Plans for skewed customers: a pass that finds what is hot, timelines for them, and a join whose hot stretches are dealt to many tasks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.definitions import FeatureDefinition, check_definitions, widest_window
from tidemark.operators.features import aggregates, with_default
from tidemark.operators.temporal import valid_at, validity_intervals
from tidemark.operators.timelines import suits, timeline_features
from tidemark.operators.training import SLICES, label_cutoffs, windowed_join
from tidemark.sources.shared import stored

#: Pairs of label and event that one part of a stretch may make.
PAIRS = 2_000_000


def heavy_stretches(asked: DataFrame, events: DataFrame, pairs: int = PAIRS) -> DataFrame:
    """``customer_id, _at, label_parts, event_parts`` of the stretches of time (``_at``) in which a customer's labels and events make more pairs.

    Both sides are counted by partial aggregates, so the pass moves a row for each stretch. One side of a heavy stretch
    is longer than the root of ``pairs``, which bounds their number. A side shorter than the root stays whole, and the
    other is cut, so that a part has about ``pairs`` pairs.
    """
    left = asked.groupBy("customer_id", "_at").agg(F.count("*").alias("labels"))
    right = events.groupBy("customer_id", "_at").agg(F.count("*").alias("events"))
    both = left.join(right, ["customer_id", "_at"]).where(F.col("labels") * F.col("events") > pairs)
    side = float(pairs) ** 0.5
    whole_l, whole_e = F.least(F.col("labels"), F.lit(side)), F.least(F.col("events"), F.lit(side))
    return both.select("customer_id", "_at", F.ceil(F.col("labels") * whole_e / pairs).cast("int").alias("label_parts"), F.ceil(F.col("events") * whole_l / pairs).cast("int").alias("event_parts"))


def _stretches(labels: DataFrame, events: DataFrame, definitions: Sequence[FeatureDefinition]) -> tuple[DataFrame, DataFrame]:
    """Labels with each stretch (``_at``) that their widest window meets, and events with theirs."""
    widest = widest_window(definitions)
    if widest is None:
        raise ValueError("stretches of time need bounded windows")
    width = -(-widest // SLICES)
    asked = labels.withColumn("_at", F.explode(F.sequence(F.floor((F.col("label_time") - widest + 1) / width), F.floor(F.col("label_time") / width))))
    return asked, events.withColumn("_at", F.floor(F.col("event_time") / width))


def dealt_join(labels: DataFrame, events: DataFrame, definitions: Sequence[FeatureDefinition], pairs: int = PAIRS) -> DataFrame:
    """Labels (``label_id, customer_id, label_time, effective_cutoff``) with the valid events of their widest window.

    Stretches that are too heavy are dealt: a label goes to one of the label parts and is copied to each event part, an
    event the other way round, so each pair meets once. What is copied are the rows of heavy stretches only.
    """
    widest = widest_window(definitions)
    asked, there = _stretches(labels, events, definitions)
    heavy = stored(heavy_stretches(asked, there, pairs), "heavy")  # its size is known, so Spark broadcasts it where it is small
    one = F.lit(1)

    def dealt(rows: DataFrame, own: str, other: str, key: str, mine: str, theirs: str) -> DataFrame:
        marked = rows.join(heavy, ["customer_id", "_at"], "left")
        part = F.pmod(F.xxhash64(key), F.coalesce(own, one)).cast("int")
        copies = F.explode(F.sequence(F.lit(0), F.coalesce(F.col(other), one) - 1))
        return marked.withColumn(mine, part).withColumn(theirs, copies).drop("label_parts", "event_parts")

    left = dealt(asked, "label_parts", "event_parts", "label_id", "_l", "_e")
    right = dealt(there, "event_parts", "label_parts", "event_id", "_e", "_l")
    inside = (F.col("event_time") <= F.col("label_time")) & (F.col("event_time") > F.col("label_time") - widest)
    return left.join(right, ["customer_id", "_at", "_l", "_e"]).where(inside & valid_at(F.col("effective_cutoff")))


def dealt_dataset(labels: DataFrame, revisions: DataFrame, definitions: Sequence[FeatureDefinition], dataset_as_of: int, pairs: int = PAIRS) -> DataFrame:
    """What ``training.point_in_time_dataset`` gives, whatever share of labels and events one customer has.

    Customers with a heavy stretch get their features from timelines, which make no pairs; where a computation doesn't come
    in parts that timelines merge, their heavy stretches are dealt out.
    """
    check_definitions(definitions)
    cut = label_cutoffs(labels, dataset_as_of)
    events = validity_intervals(revisions).where("operation = 'upsert'").select("event_id", "customer_id", "event_time", "known_from", "known_to", "status", "amount_cents", "merchant_risk")
    who = cut.select("label_id", "customer_id", "label_time", "effective_cutoff")
    grouped = lambda joined: joined.groupBy("label_id", "label_time").agg(*aggregates(definitions, F.col("label_time"))).drop("label_time")
    if not suits(definitions):
        found = grouped(dealt_join(who, events, definitions, pairs))
    else:
        events = stored(events.drop("event_id"), "intervals")  # read by all that follows
        heavy = stored(heavy_stretches(*_stretches(who, events, definitions), pairs).select("customer_id").distinct(), "heavy")
        some = lambda rows, how: rows.join(heavy, "customer_id", how)
        light = grouped(windowed_join(some(who, "left_anti"), some(events, "left_anti"), definitions, valid_at(F.col("effective_cutoff"))))
        found = light.unionByName(timeline_features(some(who, "left_semi"), some(events, "left_semi"), definitions))
    return cut.join(found, "label_id", "left").select(*cut.columns, *[with_default(d).alias(d.name) for d in definitions])
