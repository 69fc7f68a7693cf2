"""Which revision of an event counts, as known at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The end of a validity interval that no later revision has ended.
FOREVER = (1 << 62) - 1


def known(df: DataFrame, knowledge_cutoff: int) -> DataFrame:
    """Rows known at the cutoff, which is inclusive."""
    return df.where(F.col("knowledge_time") <= knowledge_cutoff)


def latest_known(revisions: DataFrame, knowledge_cutoff: int) -> DataFrame:
    """The authoritative revision of each event at one frontier, retractions included: one shuffle and one sort.

    It is the revision whose validity hasn't ended. (A ``max_by`` over structs would sort before the shuffle too.)
    """
    return validity_intervals(known(revisions, knowledge_cutoff)).where(F.col("known_to") == FOREVER).select(*revisions.columns)


def standing(revisions: DataFrame, event_cutoff: int, knowledge_cutoff: int) -> DataFrame:
    """Events that stand at a frontier: the latest revision is an upsert and its event time is within the cutoff.

    The event-time filter comes after the choice of revision, as a correction may move an event.
    """
    return latest_known(revisions, knowledge_cutoff).where((F.col("operation") == "upsert") & (F.col("event_time") <= event_cutoff))


def validity_intervals(revisions: DataFrame) -> DataFrame:
    """Each revision with ``known_from`` and ``known_to``: it counts for frontiers in [known_from, known_to).

    Expects revisions without exact replays and without two of one event at one time (see ``quality.conflicts``).
    """
    by = Window.partitionBy("event_id").orderBy("knowledge_time", "revision_id")
    end = F.coalesce(F.lead("knowledge_time").over(by), F.lit(FOREVER))
    return revisions.withColumns({"known_from": F.col("knowledge_time"), "known_to": end})


def valid_at(frontier: Column) -> Column:
    return (F.col("known_from") <= frontier) & (frontier < F.col("known_to"))


def moved_events(revisions: DataFrame, base: int, target: int) -> DataFrame:
    """``event_id`` of the events with a revision that became known between two frontiers; no others can differ."""
    return revisions.where((F.col("knowledge_time") > base) & (F.col("knowledge_time") <= target)).select("event_id").distinct()


def state_diff(revisions: DataFrame, base: int, target: int, moved: DataFrame | None = None) -> DataFrame:
    """``event_id, prior, current`` of events whose authoritative state differs at two frontiers.

    A retracted event has no state. Only the history of moved events is sorted and grouped. ``moved``:
    ``moved_events`` as a stored table, whose known size lets Spark broadcast it instead of shuffling the history.
    """
    row = F.struct("revision_id", "customer_id", "event_time", "knowledge_time", "operation", "amount_cents", "status", "merchant_risk")
    at_base, at_target = valid_at(F.lit(base)), valid_at(F.lit(target))
    part = known(revisions, target).join(moved_events(revisions, base, target) if moved is None else moved, "event_id", "left_semi")
    changed = validity_intervals(part).where(at_base != at_target)
    both = changed.groupBy("event_id").agg(F.max(F.when(at_base, row)).alias("_p"), F.max(F.when(at_target, row)).alias("_c"))
    stands = lambda c: F.when(F.col(f"{c}.operation") == "upsert", F.col(c))
    return both.select("event_id", stands("_p").alias("prior"), stands("_c").alias("current")).where(~F.col("prior.revision_id").eqNullSafe(F.col("current.revision_id")))


def latest_per_key(values: DataFrame, *keys: str, order: tuple[str, ...] = ("event_time", "knowledge_time")) -> DataFrame:
    """The newest row of each key by ``order``; other columns break ties, largest first."""
    rank = F.struct(*order, *[F.col(c) for c in values.columns if c not in keys and c not in order])
    return values.groupBy(*keys).agg(F.max_by(F.struct(*values.columns), rank).alias("_row")).select("_row.*")
