"""Incremental refresh: which entity-feature pairs a new frontier touches, and a generation made from the last one."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.definitions import FeatureDefinition, check_definitions
from tidemark.functions.values import rows_digest
from tidemark.operators.features import build_generation
from tidemark.operators.temporal import known, moved_events, state_diff
from tidemark.sources.shared import stored


def affected_pairs(revisions: DataFrame, definitions: Sequence[FeatureDefinition], event_cutoff: int, base: int, target: int, moved: DataFrame | None = None) -> DataFrame:
    """``customer_id, feature_name`` pairs that may change between two knowledge frontiers.

    A changed event affects a feature if its prior or its current state can stand in the feature's window; it then
    affects the customers of both states. Definitions are a literal array, so no join takes part.
    """
    if base > target or base < 0:
        raise ValueError("the base frontier must not be negative or after the target")
    check_definitions(definitions)
    changed = state_diff(revisions, base, target, moved)
    windows = F.array(*[F.struct(F.lit(d.name).alias("feature_name"), F.lit(d.window_seconds).cast("bigint").alias("window")) for d in definitions])
    inside = lambda c: (F.col(f"{c}.event_time") <= event_cutoff) & (F.col("d.window").isNull() | (F.col(f"{c}.event_time") > event_cutoff - F.col("d.window")))
    hit = changed.select("prior", "current", F.explode(windows).alias("d")).where(F.coalesce(inside("prior"), F.lit(False)) | F.coalesce(inside("current"), F.lit(False)))
    who = F.explode(F.array_distinct(F.array_compact(F.array("prior.customer_id", "current.customer_id"))))
    return hit.select(who.alias("customer_id"), "d.feature_name").distinct()


def scope_reasons(revisions: DataFrame, summary: DataFrame, base: int, target: int) -> DataFrame:
    """``reason`` rows of a scope: one for each changed event, and one more if the summary's mode is full."""
    changed = state_diff(revisions, base, target).select(F.concat(F.lit("revision-change:"), F.col("event_id").cast("string")).alias("reason"))
    return changed.unionByName(summary.where("mode = 'full'").select(F.lit("affected-scope-threshold").alias("reason")))


def scope_summary(revisions: DataFrame, pairs: DataFrame, definitions: Sequence[FeatureDefinition], target: int, maximum_fraction: float = 0.75) -> DataFrame:
    """One row: ``affected_pairs, customers, total_pairs, fraction, mode``; above the fraction a full build is due.

    The denominator counts customers seen in events known at the target.
    """
    if not 0 < maximum_fraction <= 1:
        raise ValueError("maximum_fraction must be in (0, 1]")
    customers = known(revisions, target).agg(F.count_distinct("customer_id").alias("customers"))
    counted = pairs.agg(F.count("*").alias("affected_pairs")).join(customers)
    total = F.col("customers") * len(definitions)
    fraction = F.when(total > 0, F.col("affected_pairs") / total).otherwise(0.0)
    return counted.select("affected_pairs", "customers", total.alias("total_pairs"), fraction.alias("fraction"), F.when(fraction > maximum_fraction, "full").otherwise("incremental").alias("mode"))


def predecessor_problems(predecessor: DataFrame, spine: DataFrame, definitions: Sequence[FeatureDefinition], event_cutoff: int, base: int) -> DataFrame:
    """One row of counts that must all be 0: the predecessor holds each customer by definition once, at its frontier.

    Rows are counted by customer first, so the join with the spine has one row for each.
    """
    mine = [(F.col("feature_name") == d.name) & (F.col("definition_digest") == d.digest) for d in definitions]
    names = [f"_{i}" for i in range(len(definitions))]
    off = (F.col("event_time") != event_cutoff) | (F.col("knowledge_time") != base)
    held = predecessor.groupBy("customer_id").agg(*[F.count_if(m).alias(n) for m, n in zip(mine, names, strict=True)], F.count("*").alias("_rows"), F.count_if(off).alias("_off"))
    both = spine.select("customer_id").distinct().withColumn("_wanted", F.lit(True)).join(held, "customer_id", "full_outer")
    total = lambda f: sum((f(F.coalesce(n, F.lit(0))) for n in names), F.lit(0))
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    extra = F.when(F.col("_wanted").isNull(), F.col("_rows")).otherwise(F.coalesce("_rows", F.lit(0)) - total(lambda n: n))
    return both.agg(
        zero(F.when(F.col("_wanted"), total(lambda n: (n == 0).cast("int")))).alias("missing"), zero(extra).alias("extra"),
        zero(total(lambda n: (n > 1).cast("int"))).alias("repeated"), zero("_off").alias("wrong_frontier"),
    )


def merged(predecessor: DataFrame, recomputed: DataFrame, pairs: DataFrame, target: int, generation_id: str) -> DataFrame:
    """Recomputed rows of the affected pairs and the predecessor's rows, re-stamped, of all others."""
    keys = ["customer_id", "feature_name"]
    kept = predecessor.join(pairs, keys, "left_anti").withColumns({"knowledge_time": F.lit(target).cast("bigint"), "generation_id": F.lit(generation_id)})
    return recomputed.join(pairs, keys, "left_semi").unionByName(kept.select(*recomputed.columns))


def manifest_problems(predecessor: DataFrame, manifest: Mapping, event_cutoff: int, base: int) -> list[str]:
    """What keeps a stored predecessor from being the one of its manifest (``sources.generations.manifest_of``).

    Rows are digested only where the manifest given has their digest: who has checked them by bucket leaves it out.
    """
    wanted = {"kind": "generation", "event_cutoff": str(event_cutoff), "knowledge_cutoff": str(base)}
    if manifest.get("rows_digest") is not None:
        found = rows_digest(predecessor, manifest["columns"].split(",")).first()
        wanted |= {"row_count": found.row_count, "rows_digest": found.rows_digest}
    return [k for k, v in wanted.items() if manifest.get(k) is not None and manifest[k] != v]


def refreshed_generation(predecessor: DataFrame, revisions: DataFrame, spine: DataFrame, definitions: Sequence[FeatureDefinition], event_cutoff: int, base: int, target: int, generation_id: str, maximum_fraction: float = 0.75, manifest: Mapping | None = None) -> tuple[DataFrame, DataFrame]:
    """(generation at ``target``, one-row summary of the work).

    Moved events and affected pairs are stored once in the shared folder; all later steps read them, and as their sizes
    are known Spark broadcasts them while they are small. Only customers with an affected pair are recomputed, from
    their own revisions (an event's customer doesn't change, see ``quality.conflicts``); above ``maximum_fraction`` of
    all pairs the whole generation is built. Raises if the predecessor isn't complete at the base frontier, or isn't
    the table of its manifest, where one is given.
    """
    if manifest is not None and (wrong := manifest_problems(predecessor, manifest, event_cutoff, base)):
        raise ValueError(f"the predecessor isn't the table of its manifest: {', '.join(wrong)}")
    problems = predecessor_problems(predecessor, spine, definitions, event_cutoff, base).first().asDict()
    if any(problems.values()):
        raise ValueError(f"the predecessor can't be refreshed: {problems}")
    moved = stored(moved_events(revisions, base, target), "moved")
    touching = affected_pairs(revisions, definitions, event_cutoff, base, target, moved)
    pairs = stored(touching.join(spine.select("customer_id").distinct(), "customer_id", "left_semi"), "pairs")
    told = scope_summary(revisions, pairs, definitions, target, maximum_fraction)
    scope = told.first()
    summary = revisions.sparkSession.createDataFrame([scope], told.schema)  # one row
    touched = pairs.select("customer_id").distinct()
    work = summary.join(touched.agg(F.count("*").alias("affected_customers"))).join(predecessor.agg(F.count("*").alias("predecessor_rows")))
    work = work.select("*", (F.col("affected_customers") * len(definitions)).alias("recomputed_rows"), (F.col("predecessor_rows") - F.col("affected_pairs")).alias("preserved_rows"))
    if scope.mode == "full":
        return build_generation(revisions, spine, definitions, event_cutoff, target, generation_id), work
    part = revisions.join(touched, "customer_id", "left_semi")
    recomputed = build_generation(part, spine.join(touched, "customer_id", "left_semi"), definitions, event_cutoff, target, generation_id)
    return merged(predecessor, recomputed, pairs, target, generation_id), work
