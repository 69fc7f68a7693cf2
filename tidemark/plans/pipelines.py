"""User-level entry points: full build, refresh, training set, publication check, independent re-computation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.definitions import FeatureDefinition, definition_set_digest, definitions_frame
from tidemark.functions.values import rows_digest
from tidemark.operators import kept
from tidemark.operators.assurance import publish_verdict
from tidemark.operators.features import build_generation, long_form, with_default
from tidemark.operators.incremental import refreshed_generation
from tidemark.operators.online import online_records
from tidemark.operators.parity import parity_summary
from tidemark.operators.quality import assert_clean, assert_spine
from tidemark.sources.generations import damaged_buckets, manifest_of, stored_rows, write_once
from tidemark.sources.layered import write_layer


def full_rebuild(revisions: DataFrame, spine: DataFrame, definitions: Sequence[FeatureDefinition], event_cutoff: int, knowledge_cutoff: int, generation_id: str, root: str) -> str:
    """Check, build and store a generation: ``written`` or ``replayed``. Unsound revisions, customers, cutoffs or definitions raise."""
    if event_cutoff < 0 or knowledge_cutoff < 0:
        raise ValueError("cutoffs must not be negative")
    assert_clean(revisions)
    assert_spine(spine)
    values = build_generation(revisions, spine, definitions, event_cutoff, knowledge_cutoff, generation_id)
    return write_once(values, root, generation_id, definition_set=definition_set_digest(definitions), event_cutoff=str(event_cutoff), knowledge_cutoff=str(knowledge_cutoff))


def stored_refresh(root: str, predecessor_id: str, revisions: DataFrame, spine: DataFrame, definitions: Sequence[FeatureDefinition], event_cutoff: int, base: int, target: int, generation_id: str, maximum_fraction: float = 0.75) -> str:
    """Refresh a stored generation to a new frontier and store the result: ``written`` or ``replayed``.

    The predecessor's rows must be those of its manifest, at the base frontier.
    """
    assert_spine(spine)
    spark = revisions.sparkSession
    if wrong := damaged_buckets(spark, root, predecessor_id):
        raise ValueError(f"the predecessor isn't the table of its manifest: row_count, rows_digest of buckets {', '.join(map(str, wrong))}")
    manifest = {k: v for k, v in manifest_of(spark, root, predecessor_id).items() if k != "rows_digest"}
    values, _ = refreshed_generation(stored_rows(spark, root, predecessor_id), revisions, spine, definitions, event_cutoff, base, target, generation_id, maximum_fraction, manifest)
    return write_once(values, root, generation_id, definition_set=definition_set_digest(definitions), event_cutoff=str(event_cutoff), knowledge_cutoff=str(target))


def layered_refresh(root: str, predecessor_id: str, state: str, delta: DataFrame, spine: DataFrame, definitions: Sequence[FeatureDefinition], event_cutoff: int, base: int, target: int, generation_id: str) -> str:
    """Refresh a stored generation from the kept state, and store the touched customers' rows only: ``written`` or ``replayed``.

    ``spine``: distinct customers, those of the predecessor. The predecessor must be at the base frontier with the same
    definitions and event cutoff; its rows aren't read. ``sources.layered`` checks and reads the result.
    """
    told = manifest_of(delta.sparkSession, root, predecessor_id)
    bound = {"definition_set": definition_set_digest(definitions), "event_cutoff": str(event_cutoff)}
    if wrong := [k for k, v in (bound | {"knowledge_cutoff": str(base)}).items() if told.get(k) != v]:
        raise ValueError(f"the predecessor can't be refreshed: other {', '.join(wrong)}")
    recomputed, _ = kept.recomputed_from_state(state, delta, spine, definitions, event_cutoff, target, generation_id)
    shared = {"knowledge_time": target, "generation_id": generation_id}
    return write_layer(recomputed, root, generation_id, predecessor_id, shared, knowledge_cutoff=str(target), **bound)


def expected_values(revisions: DataFrame, spine: DataFrame, definitions: Sequence[FeatureDefinition], event_cutoff: int, knowledge_cutoff: int, generation_id: str) -> DataFrame:
    """The same values by another formulation, for comparisons: ranked revisions, one join and grouping per feature."""
    rank = F.row_number().over(Window.partitionBy("event_id").orderBy(F.desc("knowledge_time"), F.desc("revision_id")))
    state = revisions.where(F.col("knowledge_time") <= knowledge_cutoff).withColumn("_r", rank).where("_r = 1 and operation = 'upsert'")
    out = None
    for d in definitions:
        low = F.lit(True) if d.window_seconds is None else F.col("event_time") > event_cutoff - d.window_seconds
        inside = state.where((F.col("event_time") <= event_cutoff) & low)
        one = inside.groupBy("customer_id").agg(d.raw(F.lit(event_cutoff).cast("bigint")).alias(d.name))
        wide = spine.join(one, "customer_id", "left").select("customer_id", with_default(d).alias(d.name))
        rows = long_form(wide, [d], event_cutoff, knowledge_cutoff, generation_id)
        out = rows if out is None else out.unionByName(rows)
    return out


def publish_check(values: DataFrame, revisions: DataFrame, spine: DataFrame, definitions: Sequence[FeatureDefinition], event_cutoff: int, knowledge_cutoff: int, feature_set: str, gates: DataFrame, materialized_at: int) -> tuple[DataFrame, DataFrame]:
    """(parity summary, gate decisions): a generation's records against those of an independent computation."""
    frame = definitions_frame(values.sparkSession, definitions)
    source = rows_digest(revisions).first().rows_digest
    generation_id = values.select("generation_id").first()[0]
    actual = online_records(values, frame, feature_set, f"op-{generation_id}", source, materialized_at)
    again = expected_values(revisions, spine, definitions, event_cutoff, knowledge_cutoff, generation_id)
    expected = online_records(again, frame, feature_set, f"op-{generation_id}", source, materialized_at)
    parity = parity_summary(expected, actual)
    return parity, publish_verdict(parity, gates)
