"""Gates, lags, telemetry, trial summaries, history audits, sizing and skew reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.values import ceil_div, finite, partition_key, reasons, row_digest

# The facts of an activation gate, in order, and the reason each gives when it fails.
GATES = (
    ("source_complete", "SOURCE_INCOMPLETE"),
    ("manifests_valid", "MANIFEST_INVALID"),
    ("offline_valid", "OFFLINE_INVALID"),
    ("online_reconciled", "ONLINE_RECONCILIATION_FAILED"),
    ("parity_passed", "PARITY_FAILED"),
    ("freshness_passed", "FRESHNESS_FAILED"),
    ("candidate_consistent", "CANDIDATE_INCONSISTENT"),
    ("unique_candidate", "DUPLICATE_OR_CONFLICTING_CANDIDATE"),
    ("pointer_current", "STALE_POINTER"),
)

# What telemetry may hold.
TELEMETRY_EVENTS = (
    "source.completeness.checked",
    "spark.build.completed",
    "spark.scope.planned",
    "candidate.materialization.completed",
    "candidate.retry.recorded",
    "candidate.reconciliation.completed",
    "candidate.parity.completed",
    "candidate.freshness.completed",
    "candidate.activation.rejected",
    "candidate.activation.committed",
    "serving.outcome",
    "generation.rollback.completed",
    "generation.retirement.eligible",
)
TELEMETRY_LABELS = ("phase", "profile", "reason_code", "size_class", "status")
TELEMETRY_TRACE = ("definition_set_digest", "generation_id", "operation_id", "source_frontier_digest")

# Signal, layer, impact, action.
DIAGNOSES = (
    ("SOURCE_INCOMPLETE", "source admission", "candidate rejected", "repair frontier completeness and rebuild immutable receipts"),
    ("affected-scope-threshold", "Spark planner", "full fallback", "inspect changed entities and accept deterministic full rebuild"),
    ("ONLINE_RECONCILIATION_FAILED", "materialization", "candidate isolated", "resume idempotent missing writes and reconcile exact keyset"),
    ("PARITY_FAILED", "independent comparator", "activation blocked", "reduce mismatch to primitive revisions and rebuild the defective path"),
    ("FRESHNESS_FAILED", "eligibility", "activation blocked", "advance the source frontier and regenerate candidate evidence"),
    ("STALE_POINTER", "activation CAS", "candidate not visible", "rebase the decision on the current pointer; never edit the pointer"),
    ("STALE", "serving", "typed ineligible read", "inspect record frontier and latest active generation"),
    ("EXPIRED", "serving", "typed ineligible read", "materialize and activate a valid generation; do not wait for TTL deletion"),
    ("CORRUPT_RECORD", "serving integrity", "typed failed read", "isolate generation and rebuild from immutable offline evidence"),
    ("STORAGE_FAILURE", "adapter", "typed unavailable read", "contain dependency failure and retry under the existing bounded policy"),
)

# Legal moves of offline generations and of online candidates.
OFFLINE_MOVES = (("CREATED", "BUILDING"), ("BUILDING", "BUILDING"), ("BUILDING", "VALIDATING"), ("VALIDATING", "READY"), ("VALIDATING", "FAILED"), ("READY", "ACTIVE"), ("ACTIVE", "RETIRED"), ("RETIRED", "ACTIVE"))
ONLINE_MOVES = (("ABSENT", "WRITING"), ("WRITING", "WRITING"), ("WRITING", "VALIDATED"), ("VALIDATED", "ACTIVE"), ("ACTIVE", "RETIRED"))


def gate_decisions(gates: DataFrame) -> DataFrame:
    """Each candidate with ``status``, all failed ``reasons`` in order, and digests of facts and decision."""
    facts = [g for g, _ in GATES]
    failed = reasons(*[(~F.coalesce(F.col(g), F.lit(False)), code) for g, code in GATES])
    out = gates.withColumn("reasons", failed).withColumn("status", F.when(F.size("reasons") > 0, "REJECTED").otherwise("ELIGIBLE"))
    identity = [c for c in ("feature_set", "generation_id", "operation_id") if c in gates.columns]
    out = out.withColumn("input_digest", row_digest(gates, [*identity, *facts]))
    shown = out.withColumn("_reasons", F.array_join("reasons", ","))
    return shown.withColumn("decision_digest", row_digest(shown, [*identity, "input_digest", "status", "_reasons"])).drop("_reasons")


def publish_verdict(parity: DataFrame, gates: DataFrame) -> DataFrame:
    """Candidates with their gate decision once the parity verdict is put in: ELIGIBLE or QUARANTINED."""
    verdict = parity.select(F.col("passed").alias("_passed"))
    joined = gates.drop("parity_passed").join(F.broadcast(verdict.limit(1))).withColumnRenamed("_passed", "parity_passed")
    return gate_decisions(joined).withColumn("verdict", F.when(F.col("status") == "ELIGIBLE", "ELIGIBLE").otherwise("QUARANTINED"))


# name of a lag: later clock, earlier clock, may be negative
_LAGS = (
    ("source_arrival_lag", "knowledge_time", "event_time", False),
    ("build_duration", "build_completed", "build_started", False),
    ("materialization_duration", "materialization_completed", "materialization_started", False),
    ("build_materialization_lag", "materialization_completed", "source_frontier_available_at", True),
    ("activation_lag", "activated_at", "candidate_validated_at", False),
    ("online_freshness_age", "request_time", "record_frontier", False),
    ("ttl_age", "request_time", "expires_at", True),
    ("end_to_end_availability_lag", "request_time", "event_time", False),
)
CLOCKS = tuple(dict.fromkeys(c for _, a, b, _ in _LAGS for c in (a, b)))


def lag_snapshot(clocks: DataFrame) -> DataFrame:
    """``clocks`` with eight lags in seconds and ``violations``; lags of violating rows are null."""
    negative = F.lit(False)
    for c in CLOCKS:
        negative = negative | (F.col(c) < 0)
    regressed = F.lit(False)
    for _, a, b, may in _LAGS:
        regressed = regressed if may else regressed | (F.col(a) < F.col(b))
    out = clocks.withColumn("violations", reasons((negative, "NEGATIVE_CLOCK"), (regressed, "CLOCK_REGRESSED")))
    return out.withColumns({name: F.when(F.size("violations") == 0, F.col(a) - F.col(b)) for name, a, b, _ in _LAGS})


def telemetry_violations(events: DataFrame) -> DataFrame:
    """Telemetry (``event, occurred_at, labels, trace, measurements``) with a ``violations`` array."""
    names = lambda xs: F.array(*[F.lit(x) for x in xs])
    bad_text = lambda m: F.exists(F.map_values(m), lambda v: v.isNull() | (v == "") | (F.char_length(v) > 128))
    codes = reasons(
        (~F.coalesce(F.col("event").isin(*TELEMETRY_EVENTS), F.lit(False)) | F.coalesce(F.col("occurred_at") < 0, F.lit(True)), "INVALID_IDENTITY"),
        (F.size(F.array_except(F.map_keys("labels"), names(TELEMETRY_LABELS))) > 0, "FORBIDDEN_LABEL"),
        (F.size(F.array_except(names(TELEMETRY_TRACE), F.map_keys("trace"))) > 0, "INCOMPLETE_TRACE"),
        (bad_text("labels") | bad_text("trace"), "BAD_TEXT"),
        (F.exists(F.map_values("measurements"), lambda v: v.isNull() | ~finite(v)), "NOT_FINITE"),
    )
    return events.withColumn("violations", codes)


def trial_summary(trials: DataFrame) -> DataFrame:
    """Per (case_id, operation): counts, minimum, median, maximum, interquartile range and variation of warm trials.

    ``valid`` needs a cold and five warm trials, all correct and positive. Quartiles are medians of the halves
    without the middle. Equal durations are counted before anything is ranked, so no group is gathered.
    """
    keys = ["case_id", "operation"]
    warm = F.when(F.col("warm"), F.col("duration_ns"))
    sound = F.col("correctness_passed") & (F.col("duration_ns") > 0) & (F.col("trial") >= 0)
    g = trials.groupBy(*keys).agg(
        F.count_if(~F.col("warm")).alias("cold_count"), F.count(warm).alias("warm_count"), F.count_if(~F.coalesce(sound, F.lit(False))).alias("_bad"), F.min(warm).alias("minimum_ns"), F.max(warm).alias("maximum_ns"),
        F.avg(warm).alias("_mean"), F.stddev_pop(warm).alias("_dev"), F.count_distinct("input_digest").alias("input_digests"), F.count_distinct("output_digest").alias("output_digests"),
    )
    counted = trials.where("warm and duration_ns is not null").groupBy(*keys, "duration_ns").agg(F.count("*").alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(*keys).orderBy("duration_ns"))
    ranked = counted.withColumns({"_upto": upto, "_n": F.sum("_c").over(Window.partitionBy(*keys))})
    half = F.floor(F.col("_n") / 2)
    at = lambda rank: F.min(F.when(F.col("_upto") > rank, F.col("duration_ns")))
    # the median of ``size`` values from rank ``first`` on
    median = lambda first, size: (at(first + F.floor((size - 1) / 2)) + at(first + F.floor(size / 2))) / 2
    middle = ranked.groupBy(*keys).agg(median(F.lit(0), F.col("_n")).alias("_median"), F.when(F.max(half) > 0, median(F.col("_n") - half, half) - median(F.lit(0), half)).alias("_spread"))
    return g.join(middle, keys, "left").select(
        *keys, "warm_count", "cold_count", "minimum_ns", F.floor("_median").cast("bigint").alias("median_ns"), "maximum_ns",
        F.floor("_spread").cast("bigint").alias("warm_interquartile_range_ns"), F.when(F.col("_mean") == 0, 0.0).otherwise(F.col("_dev") / F.col("_mean")).alias("coefficient_of_variation"),
        "input_digests", "output_digests", ((F.col("warm_count") >= 5) & (F.col("cold_count") >= 1) & (F.col("_bad") == 0)).alias("valid"),
    )


def pointer_audit(history: DataFrame) -> DataFrame:
    """Pointer moves with ``problems``: version gaps, breaks in the chain, repeated operations."""
    by = Window.partitionBy("feature_set").orderBy("pointer_version", "activated_at", "to_generation")
    first = F.lag("pointer_version").over(by).isNull()
    gap = F.when(first, F.col("pointer_version") != 1).otherwise(F.col("pointer_version") != F.lag("pointer_version").over(by) + 1)
    broken = F.when(first, F.col("from_generation").isNotNull()).otherwise(~F.col("from_generation").eqNullSafe(F.lag("to_generation").over(by)))
    again = F.count("*").over(Window.partitionBy("operation_id")) > 1
    return history.withColumn("problems", reasons((gap, "VERSION_GAP"), (broken, "BROKEN_CHAIN"), (again, "OPERATION_REPEATED")))


def transition_audit(states: DataFrame, moves: tuple[tuple[str, str], ...], start: str) -> DataFrame:
    """Status changes (``generation_id, at, status``) with ``previous`` and ``legal``."""
    by = Window.partitionBy("generation_id").orderBy("at", "status")
    previous = F.coalesce(F.lag("status").over(by), F.lit(start))
    allowed = F.concat_ws(">", "previous", "status").isin(*[f"{a}>{b}" for a, b in moves])
    return states.withColumn("previous", previous).withColumn("legal", allowed)


def capacity_report(records: DataFrame, item_limit: int = 400 * 1024) -> DataFrame:
    """One row: item and partition counts, largest and total item bytes, most records in a partition, headroom."""
    size = F.octet_length(F.to_json(F.struct(*records.columns), {"ignoreNullFields": "false"}))
    per = records.select("partition_key", size.cast("bigint").alias("_size")).groupBy("partition_key").agg(F.count("*").alias("_n"), F.sum("_size").alias("_sum"), F.max("_size").alias("_max"))
    total = per.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("item_count"), F.coalesce(F.max("_max"), F.lit(0)).alias("maximum_item_bytes"), F.coalesce(F.sum("_sum"), F.lit(0)).alias("total_item_bytes"), F.coalesce(F.max("_n"), F.lit(0)).alias("maximum_records_per_partition"), F.count("*").alias("partition_count"))
    return total.withColumn("maximum_item_headroom_bytes", F.lit(item_limit) - F.col("maximum_item_bytes"))


def write_unit_projection(records: DataFrame, owner_bytes: int) -> DataFrame:
    """One row: upper bound of write units: two per started KiB of each record, and the same for each owner check."""
    names = [c for c in records.columns if c != "value"]
    numbers = {c for c, t in records.dtypes if t in ("bigint", "int")}
    shown = F.lit(sum(len(c) for c in names) + len("value"))
    for c in names:
        shown = shown + (F.lit(21) if c in numbers else F.octet_length(F.col(c).cast("string")))
    value = F.when(F.col("value.kind") == "null", 1).when(F.col("value.kind") == "integer", 21).otherwise(F.octet_length("value.decimal"))
    sized = records.select((shown + value).cast("bigint").alias("_size"))
    out = sized.agg(F.count("*").alias("record_count"), F.coalesce(F.sum("_size"), F.lit(0)).alias("item_bytes"), F.coalesce(F.max("_size"), F.lit(0)).alias("maximum_item_bytes"), F.coalesce(F.sum(2 * ceil_div(F.col("_size"), 1024)), F.lit(0)).alias("_writes"))
    checks = F.col("record_count") * 2 * (-(-owner_bytes // 1024))
    return out.select("record_count", "item_bytes", "maximum_item_bytes", (F.col("_writes") + checks).alias("write_units"), checks.cast("bigint").alias("condition_units"))


def partition_skew(df: DataFrame, partition: Column | None = None) -> DataFrame:
    """One row: rows, partitions that hold some, most rows of one, and its share. ``partition``: where a row goes, by
    default the partition it stands in."""
    per = df.groupBy((F.spark_partition_id() if partition is None else partition).alias("_p")).count()
    return per.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("rows"), F.count("*").alias("partitions"), F.coalesce(F.max("count"), F.lit(0)).alias("most_rows"), (F.max("count") / F.sum("count")).alias("maximum_fraction"))


def key_skew(df: DataFrame, key: str, top: int = 20) -> DataFrame:
    """The ``top`` keys with most rows, and their share of all rows."""
    per = df.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("rows"))
    total = per.agg(F.sum("rows").alias("_total"))
    return per.orderBy(F.desc("rows"), "key").limit(top).join(F.broadcast(total)).select("key", "rows", (F.col("rows") / F.col("_total")).alias("fraction"))


def records_per_partition(records: DataFrame) -> DataFrame:
    """``partition_key, records`` of a set of records."""
    return records.select(partition_key().alias("partition_key")).groupBy("partition_key").agg(F.count("*").alias("records"))


def diagnosis(signals: DataFrame) -> DataFrame:
    """Counts of ``signal`` with layer, impact and action; unknown signals have none."""
    table = signals.sparkSession.createDataFrame(list(DIAGNOSES), "signal string, layer string, impact string, action string")
    counted = signals.groupBy("signal").agg(F.count("*").alias("occurrences"))
    return counted.join(F.broadcast(table), "signal", "left")
