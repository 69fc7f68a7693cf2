"""The state of events kept at a frontier: refreshes read what changed and whom it touches, not the history.

``root`` holds, for every frontier that was reached, a layer of the events that changed since the one before (the first
layer: all events), each with its latest revision, dealt to buckets by customer. As an event keeps its customer, what a
delta changes is found in the buckets of its customers. Layers that have grown beyond a share of the first are merged.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.definitions import FeatureDefinition, check_definitions
from tidemark.operators.features import aggregates, long_form, with_default
from tidemark.operators.temporal import latest_known
from tidemark.schemas import REVISION_FIELDS
from tidemark.sources.shared import exists, listed, mark, remove, size_of, stored

#: Buckets of a state, and the share of the first layer that later ones reach before all are merged.
BUCKETS, SHARE = 16, 0.5
#: What a layer keeps of the state before its own.
_PRIOR = "struct<revision_id: string, operation: string, event_time: bigint, knowledge_time: bigint>"


def bucket_of(customer: str = "customer_id") -> Column:
    return F.pmod(F.xxhash64(F.col(customer).cast("string")), F.lit(BUCKETS)).cast("int")


def _number(name: str) -> int:
    return int(name.partition("=")[2])


def layers(spark: SparkSession, root: str, frontier: int | None = None) -> list[str]:
    """Names of the complete layers up to a frontier: the latest whole one, and those after it. Numbers are frontiers."""
    found = [n for n in listed(spark, root) if n.startswith(("whole=", "layer=")) and exists(spark, f"{root}/{n}/_complete")]
    found = sorted((n for n in found if frontier is None or _number(n) <= frontier), key=_number)
    whole = [n for n in found if n.startswith("whole=")][-1:]
    return whole + [n for n in found if whole and n.startswith("layer=") and _number(n) > _number(whole[0])]


def _write(rows: DataFrame, root: str, name: str) -> None:
    path = f"{root}/{name}"
    told = rows if "_prior" in rows.columns else rows.withColumn("_prior", F.lit(None).cast(_PRIOR))
    told.select(*REVISION_FIELDS, "_prior", bucket_of().alias("_bucket")).repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(path)
    mark(rows.sparkSession, f"{path}/_complete")


def _read(spark: SparkSession, path: str, kinds: StructType) -> DataFrame:
    """A layer. ``kinds``: a schema that has the revisions' fields."""
    fields = ", ".join(f"{c} {kinds[c].dataType.simpleString()}" for c in REVISION_FIELDS)
    return spark.read.schema(f"{fields}, _prior {_PRIOR}, _bucket int").parquet(path)


def keep_state(revisions: DataFrame, frontier: int, root: str, layer: int | None = None) -> None:
    """The first layer: the latest revision of every event known at the frontier, retractions included.

    An empty table beside ``root`` keeps the columns' types, as layers may have no rows.
    """
    revisions.select(*REVISION_FIELDS).limit(0).write.mode("overwrite").parquet(f"{root}-types")
    _write(latest_known(revisions.select(*REVISION_FIELDS), frontier), root, f"whole={frontier if layer is None else layer}")


def kept_state(spark: SparkSession, root: str, frontier: int | None = None, buckets: Sequence[int] | None = None, kinds: StructType | None = None) -> DataFrame:
    """The latest revision of each event at a kept frontier, from some or all buckets. Later layers hide what they changed."""
    names = layers(spark, root, frontier)
    if not names:
        raise ValueError(f"no state is kept at {root}")
    kinds = spark.read.parquet(f"{root}-types").schema if kinds is None else kinds

    def layer(name: str) -> DataFrame:
        rows = _read(spark, f"{root}/{name}", kinds)
        return (rows if buckets is None else rows.where(F.col("_bucket").isin(list(buckets)))).select(*REVISION_FIELDS, F.lit(_number(name)).alias("_layer"))

    first, *later = [layer(n) for n in names]
    if not later:
        return first.drop("_layer")
    new = later[0]
    for x in later[1:]:
        new = new.unionByName(x)
    if len(later) > 1:
        newest = new.groupBy("event_id").agg(F.max("_layer").alias("_layer"))
        new = new.join(newest, ["event_id", "_layer"], "left_semi")
    # what later layers hold is a share of the first: small beside it, and its size is known
    return first.join(new.select("event_id"), "event_id", "left_anti").unionByName(new).drop("_layer")


def buckets_of(revisions: DataFrame) -> list[int]:
    """The buckets that rows fall into, ``BUCKETS`` at most."""
    return [r[0] for r in revisions.select(bucket_of().alias("b")).distinct().collect()]


def advance(spark: SparkSession, root: str, delta: DataFrame, frontier: int, buckets: Sequence[int] | None = None) -> DataFrame:
    """``event_id, customer_id, prior, current`` of the events that ``delta`` changes, which become a new layer.

    ``delta``: revisions that weren't seen yet, late ones too; of those behind an event's state nothing comes. A frontier
    that is advanced to again gives the same. ``buckets``: those of the delta. Both states are (revision_id, operation,
    event_time, knowledge_time), null where an event doesn't stand.
    """
    last = [_number(n) for n in layers(spark, root, frontier - 1)][-1:]
    if not last:
        raise ValueError(f"no state is kept at {root} before {frontier}")
    fields = [c for c in REVISION_FIELDS if c != "event_id"]
    known = F.struct("knowledge_time", F.col("revision_id").cast("string"))
    # stored, so that its size is known: the state is looked up by it where it is small, and not shuffled
    new = stored(delta.groupBy("event_id").agg(F.max_by(F.struct(*fields), known).alias("_new")), "delta")
    state = kept_state(spark, root, last[0], buckets_of(delta) if buckets is None else buckets, delta.schema)
    old = state.select("event_id", F.struct(F.col("revision_id").cast("string").alias("revision_id"), "operation", "event_time", "knowledge_time").alias("_prior"))
    met = old.join(new.select("event_id"), "event_id", "left_semi")
    both = new.join(met, "event_id", "left")
    newer = F.col("_prior").isNull() | (F.struct("_new.knowledge_time", F.col("_new.revision_id").cast("string")) > F.struct("_prior.knowledge_time", "_prior.revision_id"))
    _write(both.where(newer).select("event_id", "_new.*", "_prior"), root, f"layer={frontier}")
    layer = _read(spark, f"{root}/layer={frontier}", delta.schema)
    current = F.struct(F.col("revision_id").cast("string").alias("revision_id"), "operation", "event_time", "knowledge_time")
    return layer.select("event_id", "customer_id", F.when(F.col("_prior.operation") == "upsert", F.col("_prior")).alias("prior"), F.when(F.col("operation") == "upsert", current).alias("current"))


def merge_layers(spark: SparkSession, root: str, share: float = SHARE) -> bool:
    """If later layers have reached a share of the first, all become one. Older layers can go after that (``forget``)."""
    names = layers(spark, root)
    sizes = [size_of(spark, f"{root}/{n}") for n in names]
    if len(names) < 2 or sum(sizes[1:]) < share * sizes[0]:
        return False
    _write(kept_state(spark, root), root, f"whole={_number(names[-1])}")
    return True


def forget(spark: SparkSession, root: str) -> None:
    """Remove the layers that the latest whole one holds."""
    kept = layers(spark, root)
    for n in listed(spark, root):
        if n.startswith(("whole=", "layer=")) and kept and n not in kept and _number(n) <= _number(kept[0]):
            remove(spark, f"{root}/{n}")


def touched_customers(changed: DataFrame, definitions: Sequence[FeatureDefinition], event_cutoff: int) -> DataFrame:
    """``customer_id`` of changed events whose state before or after can stand in a window."""
    check_definitions(definitions)
    widest = None if any(d.window_seconds is None for d in definitions) else max(d.window_seconds for d in definitions)
    time = lambda c: F.col(f"{c}.event_time")
    inside = lambda c: F.coalesce((time(c) <= event_cutoff) & (F.lit(True) if widest is None else time(c) > event_cutoff - widest), F.lit(False))
    return changed.where(inside("prior") | inside("current")).select("customer_id").distinct()


def features_of(state: DataFrame, spine: DataFrame, definitions: Sequence[FeatureDefinition], event_cutoff: int, knowledge_cutoff: int, generation_id: str) -> DataFrame:
    """A generation from the latest revisions of events: no choice of revisions is left to make."""
    widest = None if any(d.window_seconds is None for d in definitions) else max(d.window_seconds for d in definitions)
    events = state.where((F.col("operation") == "upsert") & (F.col("event_time") <= event_cutoff))
    events = events if widest is None else events.where(F.col("event_time") > event_cutoff - widest)
    found = events.groupBy("customer_id").agg(*aggregates(definitions, F.lit(event_cutoff).cast("bigint")))
    wide = spine.select("customer_id").join(found, "customer_id", "left").select("customer_id", *[with_default(d).alias(d.name) for d in definitions])
    return long_form(wide, definitions, event_cutoff, knowledge_cutoff, generation_id)


def recomputed_from_state(root: str, delta: DataFrame, spine: DataFrame, definitions: Sequence[FeatureDefinition], event_cutoff: int, target: int, generation_id: str, layer: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows at ``target`` of the customers that ``delta`` touches, those customers); the kept state is advanced."""
    spark, layer = delta.sparkSession, target if layer is None else layer
    check_definitions(definitions)
    buckets = buckets_of(delta)
    changed = advance(spark, root, delta, layer, buckets)
    touched = stored(touched_customers(changed, definitions, event_cutoff), "touched")
    state = kept_state(spark, root, layer, buckets, delta.schema).join(touched, "customer_id", "left_semi")
    return features_of(state, spine.join(touched, "customer_id", "left_semi"), definitions, event_cutoff, target, generation_id), touched


def refreshed_from_state(predecessor: DataFrame, root: str, delta: DataFrame, spine: DataFrame, definitions: Sequence[FeatureDefinition], event_cutoff: int, target: int, generation_id: str, layer: int | None = None) -> DataFrame:
    """The generation at ``target`` from the one before and the state kept there; ``delta`` is what became known since.

    Only the buckets of touched customers are read, and of their rows the latest revisions only. Layers are numbered by
    their frontiers, or by ``layer``, where frontiers needn't grow. ``spine``: distinct customers. The predecessor is
    taken as it is (``sources.generations`` checks it by bucket).
    """
    fresh, touched = recomputed_from_state(root, delta, spine, definitions, event_cutoff, target, generation_id, layer)
    held = predecessor.join(touched, "customer_id", "left_anti").withColumns({"knowledge_time": F.lit(target).cast("bigint"), "generation_id": F.lit(generation_id)})
    return fresh.unionByName(held.select(*fresh.columns))
