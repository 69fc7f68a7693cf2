"""Online records, what is missing, reconciliation, serving lookups, keyset pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.values import decoded_value, digest_of, encoded_value, partition_key, row_digest, rows_digest, sort_key, value_is_sound
from tidemark.sources.shared import stored

RECORD_BODY = ("feature_set", "generation_id", "customer_id", "feature_name", "definition_digest", "value_kind", "value_integer", "value_decimal", "event_cutoff", "knowledge_cutoff", "materialized_at", "expires_at", "source_digest", "offline_rows_digest", "operation_id", "partition_key", "sort_key")


def _flat(records: DataFrame) -> DataFrame:
    return records.withColumns({"value_kind": F.col("value.kind"), "value_integer": F.col("value.integer"), "value_decimal": F.col("value.decimal")})


def record_digest(records: DataFrame) -> DataFrame:
    """``records`` with ``record_digest`` over every other field."""
    flat = _flat(records)
    return flat.withColumn("record_digest", row_digest(flat, RECORD_BODY)).drop("value_kind", "value_integer", "value_decimal")


def _with_actual(records: DataFrame) -> DataFrame:
    """Stored records with ``_actual``, the digest that their fields have."""
    flat = _flat(records)
    return flat.withColumn("_actual", row_digest(flat, RECORD_BODY)).drop("value_kind", "value_integer", "value_decimal")


def value_problems(values: DataFrame, definitions: DataFrame) -> DataFrame:
    """One row of counts that must be 0: repeated keys, several generations, unknown or mismatched definitions."""
    by_key = values.groupBy("customer_id", "feature_name").agg(F.count("*").alias("n"), F.min("generation_id").alias("lo"), F.max("generation_id").alias("hi"), F.min("definition_digest").alias("definition_digest"), F.max("definition_digest").alias("_other"))
    known = by_key.join(F.broadcast(definitions.select("definition_digest", F.col("feature_name").alias("_name"))), "definition_digest", "left")
    return known.agg(F.count_if(F.col("n") > 1).alias("repeated_keys"), F.coalesce(F.count_distinct("lo", "hi") - 1, F.lit(0)).alias("extra_generations"), F.count_if(~F.col("_name").eqNullSafe(F.col("feature_name"))).alias("unknown_definitions"), F.count("*").alias("keys"))


def online_records(values: DataFrame, definitions: DataFrame, feature_set: str, operation_id: str, source_digest: str, materialized_at: int, checked: bool = True) -> DataFrame:
    """Typed records of one generation of feature values. ``definitions``: ``definitions_frame``, a few rows by nature.

    The digest of all offline rows stands in every record, so it is made first and joined as a one-row table.
    """
    if checked:
        found = value_problems(values, definitions).first().asDict()
        if not found.pop("keys") or any(found.values()):
            raise ValueError(f"values can't become online records: {found}")
    whole = rows_digest(values).select(F.col("rows_digest").alias("offline_rows_digest"))
    typed = values.join(F.broadcast(definitions.select("definition_digest", "value_type", "ttl_seconds")), "definition_digest")
    out = typed.join(F.broadcast(whole)).select(
        F.lit(feature_set).alias("feature_set"), "generation_id", "customer_id", "feature_name", "definition_digest",
        encoded_value(F.col("value_type"), F.col("value_long"), F.col("value_double")).alias("value"),
        F.col("event_time").alias("event_cutoff"), F.col("knowledge_time").alias("knowledge_cutoff"), F.lit(materialized_at).cast("bigint").alias("materialized_at"),
        (F.col("event_time") + F.col("ttl_seconds")).alias("expires_at"), F.lit(source_digest).alias("source_digest"), "offline_rows_digest", F.lit(operation_id).alias("operation_id"),
        partition_key().alias("partition_key"), sort_key().alias("sort_key"),
    )
    return record_digest(out)


def plan_summary(records: DataFrame) -> DataFrame:
    """One row per generation: ``expected_count, records_digest``."""
    count, digest = digest_of("record_digest")
    return records.groupBy("feature_set", "generation_id", "operation_id").agg(count.alias("expected_count"), digest.alias("records_digest"))


def missing_records(planned: DataFrame, held: DataFrame) -> DataFrame:
    """Planned records that aren't stored yet: what an interrupted write still owes."""
    return planned.join(held.select("partition_key", "sort_key"), ["partition_key", "sort_key"], "left_anti")


def upsert_outcomes(existing: DataFrame, incoming: DataFrame, keys: list[str], digest: str) -> DataFrame:
    """``keys``, ``digest`` and ``outcome`` of each incoming row: written, replayed, or conflict.

    Equal incoming rows count once; several digests of one new key are conflicts all.
    """
    new = incoming.select(*keys, digest).distinct()
    variants = Window.partitionBy(*keys)
    new = new.withColumn("_n", F.count("*").over(variants))
    old = existing.groupBy(*keys).agg(F.min(digest).alias("_old"))
    both = new.join(old, keys, "left")
    outcome = F.when(F.col("_old").isNull(), F.when(F.col("_n") > 1, "conflict").otherwise("written")).when(F.col("_old") == F.col(digest), "replayed").otherwise("conflict")
    return both.select(*keys, digest, outcome.alias("outcome"))


def reconciliation(planned: DataFrame, held: DataFrame) -> DataFrame:
    """One row: counts of missing, extra, differing and corrupt records, both digests, and ``passed``.

    Stored rows are grouped by key before the join: of rows that repeat a key all but one are extra.
    """
    keys = ["partition_key", "sort_key"]
    told = _with_actual(held).groupBy(*keys).agg(F.count("*").alias("n"), F.min("record_digest").alias("low"), F.max("record_digest").alias("high"), F.count_if(~F.col("record_digest").eqNullSafe(F.col("_actual"))).alias("bad"))
    both = planned.select(*keys, F.col("record_digest").alias("wanted")).join(told, keys, "full_outer")
    n = F.coalesce("n", F.lit(0))
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    out = both.agg(
        F.count("wanted").alias("planned_count"), zero(n).alias("stored_count"),
        F.count_if(F.col("n").isNull()).alias("missing"), zero(F.when(F.col("wanted").isNull(), n).otherwise(F.greatest(n - 1, F.lit(0)))).alias("extra"),
        F.count_if((F.col("wanted") != F.col("low")) | (F.col("wanted") != F.col("high"))).alias("differing"), zero("bad").alias("corrupt"),
    )
    return out.withColumn("passed", (F.col("missing") + F.col("extra") + F.col("differing") + F.col("corrupt")) == 0)


def active_generations(history: DataFrame) -> DataFrame:
    """The generation each feature set serves now."""
    return history.groupBy("feature_set").agg(F.max_by("to_generation", F.struct("pointer_version", "activated_at", "to_generation")).alias("generation_id"), F.max("pointer_version").alias("pointer_version"))


def pinned_at(requests: DataFrame, history: DataFrame, width: int = 86_400) -> DataFrame:
    """Requests with the generation that was active at ``request_time``: an as-of join on the pointer's history.

    Requests and moves are sorted together inside slices of ``width`` seconds of a feature set; what a slice starts with
    comes from the last moves of the slices before it, a row for each slice. So one set's history isn't one task's.
    """
    at = F.struct("activated_at", "pointer_version", "to_generation")
    moves = history.where("activated_at is not null").select("feature_set", F.floor(F.col("activated_at") / width).alias("_slice"), F.col("activated_at").alias("_at"), F.struct("to_generation", "pointer_version").alias("_move"), at.alias("_order"))
    asked = requests.withColumn("_slice", F.floor(F.col("request_time") / width))
    last = moves.groupBy("feature_set", "_slice").agg(F.max_by("_move", "_order").alias("_last"))
    slices = asked.select("feature_set", "_slice").distinct().join(last, ["feature_set", "_slice"], "full_outer")
    before = Window.partitionBy("feature_set").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = slices.select("feature_set", "_slice", F.last("_last", ignorenulls=True).over(before).alias("_carried"))
    row = F.struct(*requests.columns)
    none = F.lit(None).cast(moves.schema["_order"].dataType)
    both = moves.select("feature_set", "_slice", "_at", "_move", "_order", F.lit(None).cast(asked.select(row).schema[0].dataType).alias("_request")).unionByName(
        asked.select("feature_set", "_slice", F.col("request_time").alias("_at"), F.lit(None).cast(moves.schema["_move"].dataType).alias("_move"), none.alias("_order"), row.alias("_request"))
    )
    # a move counts for requests of its own second, so moves come first, in their order
    inside = Window.partitionBy("feature_set", "_slice").orderBy("_at", F.col("_request").isNotNull(), "_order").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("_seen", F.last("_move", ignorenulls=True).over(inside)).where("_request is not null")
    out = seen.join(carried, ["feature_set", "_slice"], "left").withColumn("_active", F.coalesce("_seen", "_carried"))
    return out.select("_request.*", F.col("_active.to_generation").alias("generation_id"), F.col("_active.pointer_version").alias("pointer_version"))


def serving_outcomes(requests: DataFrame, generations: DataFrame, records: DataFrame) -> DataFrame:
    """Each request (``request_id, feature_set, generation_id, customer_id, feature_name, definition_digest,
    request_time, maximum_freshness_age``) with a typed ``status`` and ``value``.

    The first rule that applies decides: generation unavailable, absent, definition mismatch, corrupt, expired, stale.
    Of stored records that repeat a key the latest materialised answers, so a request has one answer.
    """
    served = generations.where(F.col("state").isin("ACTIVE", "RETIRED")).select("feature_set", "generation_id", F.lit(True).alias("_held"))
    found = _with_actual(records).select("generation_id", "customer_id", "feature_name", F.col("definition_digest").alias("_definition"), "value", "knowledge_cutoff", "expires_at", "record_digest", "_actual", "materialized_at")
    keys = ["generation_id", "customer_id", "feature_name"]
    found = found.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in found.columns if c not in keys]), F.struct("materialized_at", "record_digest")).alias("_r")).select(*keys, "_r.*").drop("materialized_at")
    joined = requests.join(served, ["feature_set", "generation_id"], "left").join(found, ["generation_id", "customer_id", "feature_name"], "left")
    status = (
        F.when(F.col("_held").isNull(), "GENERATION_UNAVAILABLE")
        .when(F.col("record_digest").isNull(), "ABSENT")
        .when(F.col("_definition") != F.col("definition_digest"), "DEFINITION_MISMATCH")
        .when((F.col("record_digest") != F.col("_actual")) | ~value_is_sound(F.col("value")), "CORRUPT_RECORD")
        .when(F.col("request_time") >= F.col("expires_at"), "EXPIRED")
        .when(F.col("request_time") - F.col("knowledge_cutoff") > F.col("maximum_freshness_age"), "STALE")
        .otherwise("FOUND")
    )
    return joined.withColumn("status", status).select(*requests.columns, "status", F.when(F.col("status") == "FOUND", decoded_value(F.col("value"))).alias("value"))


def keyset_page(records: DataFrame, size: int, after: tuple | None = None) -> DataFrame:
    """``size`` records after a (customer_id, feature_name) cursor, and one more if there is a next page."""
    rows = records
    if after is not None:
        c, f = after
        rows = rows.where((F.col("customer_id") > c) | ((F.col("customer_id") == c) & (F.col("feature_name") > f)))
    return rows.orderBy("customer_id", "feature_name").limit(size + 1)


def page_numbers(records: DataFrame, size: int) -> DataFrame:
    """All records with the ``page`` they stand on in key order, for keys of any type and distribution.

    Records are dealt by ranges of the whole key, sorted inside them and stored; the rank inside a range is the row's
    number there, and a table of range sizes shifts it. No sort runs on one task, whatever the keys.
    """
    number = F.monotonically_increasing_id()  # the partition's number above 33 bits of the row's
    ranged = records.repartitionByRange("customer_id", "feature_name").sortWithinPartitions("customer_id", "feature_name")
    placed = stored(ranged.withColumns({"_b": F.shiftright(number, 33), "_r": number.bitwiseAND(F.lit((1 << 33) - 1))}), "ranges")
    sizes = placed.groupBy("_b").agg(F.count("*").alias("_n"))
    shift = sizes.select("_b", (F.sum("_n").over(Window.orderBy("_b")) - F.col("_n")).alias("_before"))
    return placed.join(F.broadcast(shift), "_b").withColumn("page", F.floor((F.col("_before") + F.col("_r")) / size).cast("bigint")).drop("_b", "_r", "_before")


def eligibility(request_time: Column, maximum_age: Column | None = None) -> Column:
    """Why a record isn't eligible at a time: EXPIRED, STALE, or null."""
    out = F.when(request_time >= F.col("expires_at"), "EXPIRED")
    return out if maximum_age is None else out.when(request_time - F.col("knowledge_cutoff") > maximum_age, "STALE")


