"""The registered queries of the library's own operators, over tables derived from ``events``."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.definitions import definition_set, definition_set_digest, definitions_frame, payment_features
from tidemark.functions.values import canonical_decimal, digest_of, finite, row_digest, rows_digest
from tidemark.operators import assurance, features, incremental, kept, online, parity, quality, skew, temporal, tiles, training
from tidemark.plans import job, pipelines, sql
from tidemark.schemas import REVISION_FIELDS, REVISIONS
from tidemark.sources import clustered, derived, generations, layered, tables, workload
from tidemark.sources.shared import shared_folder, stored
from tidemark.streaming import ingest

#: Event cutoff and two knowledge frontiers of the examples.
CUTOFF = 1_706_000_000
FIRST, SECOND = CUTOFF, CUTOFF + 20_000
FEATURES = payment_features()
NAMES = [d.name for d in FEATURES]
FEATURE_SET, OPERATION, SOURCE, MADE_AT = "payments", "op-1", "source-1", SECOND + 600

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _rev(spark, d):
    return derived.revisions(spark, d)


def _dirty(spark, d):
    """Revisions with rows that break rules or contradict others, by event number."""
    r = _rev(spark, d)
    n = F.col("event_id")
    bad = r.where("event_id % 97 = 1 and operation = 'upsert'")
    late = bad.withColumns({"revision_id": F.concat(n.cast("string"), F.lit("-b1")), "knowledge_time": F.col("event_time") - 5})
    risky = bad.withColumns({"revision_id": F.concat(n.cast("string"), F.lit("-b2")), "merchant_risk": F.lit(1.5), "amount_cents": F.lit(-1).cast("bigint")})
    retract = bad.withColumns({"revision_id": F.lit(""), "operation": F.lit("retract")})
    return r.unionByName(late).unionByName(risky).unionByName(retract)


def _contradicting(spark, d):
    r = _rev(spark, d)
    first = r.where("event_id % 89 = 2 and revision_id like '%-r1'")
    reused = first.withColumns({"amount_cents": F.col("amount_cents") + 1})
    clock = first.withColumn("revision_id", F.concat(F.col("event_id").cast("string"), F.lit("-x")))
    moved = r.where("event_id % 83 = 3 and revision_id like '%-r1'").withColumns({"revision_id": F.concat(F.col("event_id").cast("string"), F.lit("-m")), "knowledge_time": F.col("knowledge_time") + 1, "customer_id": F.col("customer_id") + 1})
    return r.unionByName(reused).unionByName(clock).unionByName(moved).unionByName(r.where("event_id % 5 = 0"))


def _generation(spark, d, frontier, name):
    return features.build_generation(_rev(spark, d), derived.spine(spark, d), FEATURES, CUTOFF, frontier, name)


def _records(spark, d, frontier=SECOND, name="g2"):
    return online.online_records(_generation(spark, d, frontier, name), definitions_frame(spark, FEATURES), FEATURE_SET, OPERATION, SOURCE, MADE_AT, checked=False)


def _flat_records(df):
    return df.withColumns({"value_kind": F.col("value.kind"), "value_integer": F.col("value.integer"), "value_decimal": F.col("value.decimal")}).drop("value")


def _stored(spark, d):
    """The records as a faulty store would hold them: some missing, changed, or of customers not planned."""
    r = _records(spark, d)
    c = F.col("customer_id")
    kept = r.where(c % 10 != 3)
    changed = kept.withColumn("expires_at", F.when(c % 10 == 4, F.col("expires_at") + 1).otherwise(F.col("expires_at")))
    told = online.record_digest(changed.drop("record_digest")).withColumn("record_digest", F.when(c % 10 == 5, F.sha2("record_digest", 256)).otherwise(F.col("record_digest")))
    extra = r.where(c % 10 == 6).withColumns({"customer_id": -c - 1})
    extra = online.record_digest(extra.withColumn("partition_key", F.concat(F.lit("ENTITY#"), F.col("customer_id").cast("string"), F.lit("#GEN#"), "generation_id")).drop("record_digest"))
    return told.unionByName(extra.select(*told.columns))


@query
def revision_dedup(spark, d):
    return quality.deduplicated(_contradicting(spark, d))


@query
def revision_violations(spark, d):
    return quality.revision_violations(_dirty(spark, d)).where("size(violations) > 0").select("event_id", "revision_id", "operation", F.array_join("violations", ",").alias("violations"))


@query
def revision_conflicts(spark, d):
    return quality.conflicts(_contradicting(spark, d))


@query
def reject_split(spark, d):
    report = quality.rejection_report(quality.revision_violations(_dirty(spark, d)))
    return report.withColumn("codes", F.array_join("codes", ","))


@query
def strict_decode(spark, d):
    """Revisions as JSON texts, some malformed, decoded again: rows by violation."""
    r = _rev(spark, d)
    text = F.to_json(F.struct(*[F.col(c).cast("string").alias(c) if c.endswith("_id") else F.col(c) for c in REVISION_FIELDS]), {"ignoreNullFields": "false"})
    n = F.col("event_id")
    raw = F.when(n % 101 == 1, F.concat(F.lit("x"), text)).when(n % 101 == 2, F.replace(text, F.lit('{"event_id"'), F.lit('{"more":1,"event_id"'))).when(n % 101 == 3, F.replace(text, F.lit('"operation":"upsert"'), F.lit('"operation":"update"'))).otherwise(text)
    out = quality.decoded_revisions(r.select(raw.alias("raw")))
    return out.groupBy(F.array_join("violations", ",").alias("violations")).agg(F.count("*").alias("rows"))


@query
def legacy_upgrade(spark, d):
    old = derived.base_revisions(spark, d).drop("revision_id", "operation")
    return quality.upgraded(old)


@query
def strict_label_decode(spark, d):
    """Labels as JSON texts, some of them malformed or repeated, decoded again: rows by violation."""
    n = F.col("label_id")
    labels = derived.labels(spark, d)
    labels = labels.unionByName(labels.where("label_id % 103 = 5"))
    text = F.to_json(F.struct(n.cast("string").alias("label_id"), F.col("customer_id").cast("string").alias("customer_id"), "label_time", "prediction_knowledge_time", F.col("value").cast("bigint").alias("value")))
    raw = F.when(n % 101 == 1, F.concat(F.lit("x"), text)).when(n % 101 == 2, F.replace(text, F.lit('{"label_id"'), F.lit('{"more":1,"label_id"'))).when(n % 101 == 3, F.regexp_replace(text, ',"value":[0-9]+', ""))
    raw = raw.when(n % 101 == 4, F.regexp_replace(text, '"value":([0-9]+)', '"value":"$1"')).when(n % 101 == 5, F.regexp_replace(text, '"label_id":"([0-9]+)"', '"label_id":$1')).when(n % 101 == 6, F.replace(text, F.lit('{"label_id"'), F.lit('{"value":1,"label_id"')))
    out = quality.decoded_labels(labels.select(raw.otherwise(text).alias("raw")))
    return out.groupBy(F.array_join("violations", ",").alias("violations")).agg(F.count("*").alias("rows"))


@query
def label_checks(spark, d):
    labels = derived.labels(spark, d).withColumn("prediction_knowledge_time", F.when(F.col("label_id") % 50 == 0, F.col("label_time") + 1).otherwise(F.col("prediction_knowledge_time")))
    both = labels.unionByName(labels.where("label_id % 40 = 0"))
    marked = quality.label_violations(both).groupBy(F.array_join("violations", ",").alias("code")).agg(F.count("*").alias("rows"))
    return marked.unionByName(quality.duplicate_labels(both).agg(F.count("*").alias("rows")).select(F.lit("DUPLICATE_LABEL").alias("code"), "rows"))


@query
def latest_known_state(spark, d):
    return temporal.latest_known(_rev(spark, d), SECOND)


@query
def standing_events(spark, d):
    return temporal.standing(_rev(spark, d), CUTOFF, SECOND)


@query
def validity_intervals(spark, d):
    return temporal.validity_intervals(_rev(spark, d)).select("event_id", "revision_id", "known_from", "known_to")


def _one_feature(spark, d, name):
    chosen = [x for x in FEATURES if x.name == name]
    return features.wide_features(_rev(spark, d), derived.spine(spark, d), chosen, CUTOFF, SECOND).select("customer_id", F.col(name).alias("value"))


for _name, _feature in (("feature_txn_count_24h", 0), ("feature_success_spend_30d", 1), ("feature_failed_ratio_7d", 2), ("feature_hours_since_success", 3), ("feature_max_risk_7d", 4)):
    QUERIES[_name] = partial(_one_feature, name=NAMES[_feature])


@query
def generation_long(spark, d):
    return _generation(spark, d, SECOND, "g2")


@query
def generation_spine_defaults(spark, d):
    """Customers of the ``customer`` table, most without events."""
    spine = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("customer_id"))
    return features.wide_features(_rev(spark, d), spine, FEATURES, CUTOFF, SECOND)


@query
def expected_projection(spark, d):
    """The independent formulation of a generation."""
    return pipelines.expected_values(_rev(spark, d), derived.spine(spark, d), FEATURES, CUTOFF, SECOND, "g2")


@query
def pit_training_dataset(spark, d):
    return training.point_in_time_dataset(derived.labels(spark, d), _rev(spark, d), FEATURES, SECOND)


@query
def pit_training_tiled(spark, d):
    """The same training set from stored tiles of a day, and raw rows at the windows' edges."""
    intervals = temporal.validity_intervals(_rev(spark, d))
    kept_tiles = stored(tiles.build_tiles(intervals, FEATURES), "tiles")
    return tiles.tiled_dataset(derived.labels(spark, d), _rev(spark, d), FEATURES, SECOND, tiles=kept_tiles)


@query
def rolling_features(spark, d):
    """Features of every customer at twelve weekly frontiers, known as of then, from tiles."""
    weeks = spark.range(12).select((F.lit(CUTOFF) - 604_800 * F.col("id")).alias("label_time"))
    asked = derived.spine(spark, d).crossJoin(F.broadcast(weeks))  # twelve rows
    asked = asked.select(F.concat_ws("@", F.col("customer_id").cast("string"), F.col("label_time").cast("string")).alias("label_id"), "customer_id", "label_time", F.col("label_time").alias("prediction_knowledge_time"))
    return tiles.tiled_dataset(asked, _rev(spark, d), FEATURES, SECOND).select("customer_id", "label_time", *NAMES)


@query
def pit_training_dealt(spark, d):
    """The same training set, had one customer four fifths of all labels and events: its heavy stretches are dealt out."""
    hot = lambda df, key: df.withColumn("customer_id", F.when(F.col(key) % 5 < 4, 0).otherwise(F.col("customer_id")))
    return skew.dealt_dataset(hot(derived.labels(spark, d), "label_id"), hot(_rev(spark, d), "event_id"), FEATURES, SECOND, pairs=20_000)


def _functions(spark, d):
    sql.register_functions(spark, _rev(spark, d), derived.spine(spark, d), derived.labels(spark, d), FEATURES)


@query
def sql_training_set(spark, d):
    """A training set in pure SQL, by a table function."""
    _functions(spark, d)
    return spark.sql(f"select * from training_set({SECOND}) where label_id % 2 = 0")


@query
def sql_features_at(spark, d):
    """Features at two frontiers in pure SQL: which customers' counts later knowledge changed."""
    _functions(spark, d)
    return spark.sql(f"select a.customer_id, a.{NAMES[0]} as before, b.{NAMES[0]} as after, b.{NAMES[2]} as ratio from features_at({CUTOFF}, {FIRST}) a join features_at({CUTOFF}, {SECOND}) b on a.customer_id = b.customer_id")


@query
def sql_state_at(spark, d):
    """States at two times in pure SQL, by operation."""
    _functions(spark, d)
    return spark.sql(f"select 'first' as at, operation, count(*) as events, sum(amount_cents) as cents from state_at({FIRST}) group by operation union all select 'second', operation, count(*), sum(amount_cents) from state_at({SECOND}) group by operation")


@query
def pit_label_cutoffs(spark, d):
    return training.label_cutoffs(derived.labels(spark, d), CUTOFF)


@query
def pit_leakage_report(spark, d):
    return training.leakage_report(derived.labels(spark, d), _rev(spark, d), FEATURES, 2_000_000_000)


@query
def state_diff(spark, d):
    return temporal.state_diff(_rev(spark, d), FIRST, SECOND).select("event_id", F.col("prior.revision_id").alias("prior"), F.col("current.revision_id").alias("current"))


def _pairs(spark, d):
    return incremental.affected_pairs(_rev(spark, d), FEATURES, CUTOFF, FIRST, SECOND)


@query
def affected_pairs(spark, d):
    return _pairs(spark, d)


@query
def affected_mode(spark, d):
    return incremental.scope_summary(_rev(spark, d), _pairs(spark, d), FEATURES, SECOND)


def _refreshed(spark, d):
    """A refresh of a stored generation."""
    root = shared_folder(spark, "generations")
    generations.write_once(_generation(spark, d, FIRST, "g1"), root, "g1", event_cutoff=str(CUTOFF), knowledge_cutoff=str(FIRST))
    before = generations.stored_rows(spark, root, "g1")
    return incremental.refreshed_generation(before, _rev(spark, d), derived.spine(spark, d), FEATURES, CUTOFF, FIRST, SECOND, "g2", manifest=generations.manifest_of(spark, root, "g1"))


@query
def scope_reasons(spark, d):
    """Why pairs are in the scope of a refresh."""
    return incremental.scope_reasons(_rev(spark, d), incremental.scope_summary(_rev(spark, d), _pairs(spark, d), FEATURES, SECOND), FIRST, SECOND)


@query
def predecessor_checks(spark, d):
    """A generation with lost, doubled, moved and foreign rows against its customers and definitions."""
    c, name = F.col("customer_id") % 10, F.col("feature_name")
    g = _generation(spark, d, FIRST, "g1").where(~((c == 3) & (name == NAMES[0])))
    g = g.withColumn("event_time", F.col("event_time") + F.when(c == 5, 1).otherwise(0))
    odd = g.where((c == 4) & (name == NAMES[1])).unionByName(g.where(c == 6).withColumn("customer_id", -F.col("customer_id") - 1))
    return incremental.predecessor_problems(g.unionByName(odd), derived.spine(spark, d), FEATURES, CUTOFF, FIRST)


@query
def spine_checks(spark, d):
    """The customers of single events as a build's customers: repeated, some empty."""
    who = F.when(F.col("event_id") % 500 == 0, "").otherwise(F.col("user_id").cast("string"))
    return quality.spine_violations(derived.events(spark, d).select(who.alias("customer_id")))


@query
def incremental_generation(spark, d):
    return _refreshed(spark, d)[0]


@query
def kept_refresh(spark, d):
    """A refresh from the state of events that was kept at the first frontier."""
    base = shared_folder(spark, "kept")
    kept.keep_state(_rev(spark, d), FIRST, f"{base}/state")
    _generation(spark, d, FIRST, "g1").write.parquet(f"{base}/g1")
    delta = _rev(spark, d).where((F.col("knowledge_time") > FIRST) & (F.col("knowledge_time") <= SECOND))
    return kept.refreshed_from_state(spark.read.parquet(f"{base}/g1"), f"{base}/state", delta, derived.spine(spark, d), FEATURES, CUTOFF, SECOND, "g2")


@query
def layered_refresh(spark, d):
    """The same refresh, stored as a layer of the touched customers over the generation before, read through both."""
    base, at = shared_folder(spark, "layered"), (FIRST + SECOND) // 2
    r, spine = _rev(spark, d), derived.spine(spark, d)
    kept.keep_state(r, FIRST, f"{base}/state")
    pipelines.full_rebuild(r, spine, FEATURES, CUTOFF, FIRST, "g0", f"{base}/generations")
    for old, new, low, high in (("g0", "g1", FIRST, at), ("g1", "g2", at, SECOND)):
        delta = r.where((F.col("knowledge_time") > low) & (F.col("knowledge_time") <= high))
        pipelines.layered_refresh(f"{base}/generations", old, f"{base}/state", delta, spine, FEATURES, CUTOFF, low, high, new)
    return layered.layered_checked(spark, f"{base}/generations", "g2")


@query
def kept_layers(spark, d):
    """The kept state after two deltas, one of them behind the frontier, read through its layers."""
    root = shared_folder(spark, "kept-layers")
    r = _rev(spark, d)
    late = (F.col("event_id") % 17 == 0) & (F.col("knowledge_time") <= FIRST)
    kept.keep_state(r.where(~late), FIRST, root)
    kept.advance(spark, root, r.where((F.col("knowledge_time") > FIRST) & (F.col("knowledge_time") <= SECOND)), SECOND)
    kept.advance(spark, root, r.where(late), SECOND + 1)
    return kept.kept_state(spark, root)


@query
def incremental_work_summary(spark, d):
    return _refreshed(spark, d)[1]


@query
def changed_within_scope(spark, d):
    """One row: values that really changed between the frontiers, and whether all were in scope."""
    before, after = _generation(spark, d, FIRST, "g"), _generation(spark, d, SECOND, "g")
    changed = parity.value_parity(before.drop("knowledge_time"), after.drop("knowledge_time"))
    return parity.key_sets(_pairs(spark, d), changed)


@query
def snapshot_stats(spark, d):
    return generations.source_snapshot(_rev(spark, d))


@query
def label_snapshot(spark, d):
    return generations.label_snapshot(derived.labels(spark, d))


@query
def definition_conflicts(spark, d):
    """Definitions claimed by events: every event type claims names with digests, some of them shared."""
    e = derived.events(spark, d)
    claims = e.select(F.concat(F.col("event_type"), F.lit(":v1")).alias("identity"), F.sha2(F.when(F.col("event_id") % 500 == 1, F.concat("event_type", F.lit("!"))).when(F.col("event_type").isin("click", "view"), "same").otherwise(F.col("event_type")), 256).alias("definition_digest"))
    return quality.definition_conflicts(claims)


@query
def revision_rows_digest(spark, d):
    return rows_digest(_rev(spark, d))


@query
def canonical_numbers(spark, d):
    """Numbers of ordinary, very large and very small size as plain decimals."""
    x = F.col("value") * F.col("k") / 7
    rows = derived.events(spark, d).select("event_id", "value", "k").repartition(4 * spark.sparkContext.defaultParallelism, "event_id")  # few splits, much work a row
    return rows.select("event_id", canonical_decimal(x).alias("canonical"), canonical_decimal(x * 1e12).alias("large"), canonical_decimal(x / -1e35).alias("tiny"), finite(x).alias("finite"))


@query
def upsert_classification(spark, d):
    r = _records(spark, d, FIRST, "g").select("partition_key", "sort_key", F.col("value").alias("v"), "customer_id")
    told = r.withColumn("digest", F.sha2(F.concat_ws("|", F.col("v.kind"), F.col("v.integer").cast("string"), F.col("v.decimal")), 256))
    n = _records(spark, d, SECOND, "g").select("partition_key", "sort_key", F.col("value").alias("v"), "customer_id")
    new = n.withColumn("digest", F.sha2(F.concat_ws("|", F.col("v.kind"), F.col("v.integer").cast("string"), F.col("v.decimal")), 256))
    return online.upsert_outcomes(told.where("customer_id % 4 <> 0"), new, ["partition_key", "sort_key"], "digest")


@query
def missing_records(spark, d):
    return online.missing_records(_records(spark, d), _stored(spark, d)).select("customer_id", "feature_name", "record_digest")


@query
def latest_per_key(spark, d):
    e = derived.events(spark, d).select(F.col("user_id").alias("customer_id"), F.col("event_type").alias("feature_name"), F.col("t").alias("event_time"), (F.col("t") + F.col("event_id") % 50).alias("knowledge_time"), "event_id", "value")
    return temporal.latest_per_key(e, "customer_id", "feature_name")


@query
def online_records(spark, d):
    return _flat_records(_records(spark, d))


@query
def online_plan_summary(spark, d):
    return online.plan_summary(_records(spark, d))


@query
def parity_diff(spark, d):
    """Generations of two frontiers, as if one were the other's online copy; a tenth of the customers missing."""
    actual = _generation(spark, d, SECOND, "g").where("customer_id % 10 <> 3").drop("knowledge_time")
    return parity.value_parity(_generation(spark, d, FIRST, "g").where("customer_id % 10 <> 4").drop("knowledge_time"), actual)


@query
def comparator_report(spark, d):
    out = parity.compared_records(_records(spark, d), _stored(spark, d), request_time=CUTOFF + 700_000, maximum_age=690_000)
    flags = out.select("customer_id", "feature_name", "missing", "extra", F.array_join("semantic_fields", ",").alias("semantic_fields"), "envelope_differs", "ineligible")
    return flags.where("missing or extra or semantic_fields <> '' or envelope_differs or ineligible is not null")


@query
def parity_summary(spark, d):
    out = parity.parity_summary(_records(spark, d), _stored(spark, d), request_time=CUTOFF + 700_000, maximum_age=690_000)
    return out.withColumn("reasons", F.array_join("reasons", ","))


def _strata(spark, d):
    return derived.spine(spark, d).where("customer_id % 3 <> 0").select("customer_id", F.concat(F.lit("s"), (F.col("customer_id") % 3).cast("string")).alias("stratum"))


@query
def stratified_sample(spark, d):
    return parity.stratified_sample(_generation(spark, d, SECOND, "g"), _strata(spark, d), 73, 12)


@query
def sampled_parity(spark, d):
    sample = parity.stratified_sample(_generation(spark, d, SECOND, "g"), _strata(spark, d), 73, 12)
    out = parity.parity_summary(_records(spark, d), _stored(spark, d), sample=sample)
    return out.select("compared_count", "missing_count", "extra_count", "semantic_mismatch_count", "envelope_mismatch_count", F.array_join("reasons", ",").alias("reasons"), "passed")


@query
def reconcile_report(spark, d):
    return online.reconciliation(_records(spark, d), _stored(spark, d))


def _requests(spark, d):
    e = derived.events(spark, d)
    names = F.array(*[F.struct(F.lit(x.name).alias("n"), F.lit(x.digest).alias("x")) for x in FEATURES])
    f = F.element_at(names, (F.col("event_id") % 5 + 1).cast("int"))
    who = F.when(F.col("event_id") % 41 == 0, -F.col("user_id")).when(F.col("event_id") % 43 == 0, -F.col("user_id") - 1).otherwise(F.col("user_id"))
    return e.select(
        F.col("event_id").alias("request_id"), F.lit(FEATURE_SET).alias("feature_set"), F.when(F.col("event_id") % 31 == 0, "g9").otherwise("g2").alias("generation_id"), who.alias("customer_id"), f["n"].alias("feature_name"),
        F.when(F.col("event_id") % 37 == 0, F.sha2(f["x"], 256)).otherwise(f["x"]).alias("definition_digest"), (F.lit(CUTOFF) + (F.col("event_id") * 997) % 3_000_000).alias("request_time"), F.when(F.col("event_id") % 2 == 0, F.lit(1_000_000).cast("bigint")).alias("maximum_freshness_age"),
    )


@query
def serving_outcomes(spark, d):
    states = spark.sql("select 'payments' feature_set, stack(3, 'g1', 'RETIRED', 'g2', 'ACTIVE', 'g9', 'WRITING') as (generation_id, state)")
    out = online.serving_outcomes(_requests(spark, d), states, _stored(spark, d))
    return out.select("request_id", "customer_id", "feature_name", "status", "value")


@query
def serving_from_buckets(spark, d):
    """The same lookups against records in a bucketed table: only the requests are shuffled."""
    path = shared_folder(spark, "bucketed")
    keys = ["generation_id", "customer_id", "feature_name"]
    held = clustered.write_bucketed(_stored(spark, d), f"tidemark_{path.rpartition('-')[2]}", path, keys, 16)
    states = spark.sql("select 'payments' feature_set, stack(3, 'g1', 'RETIRED', 'g2', 'ACTIVE', 'g9', 'WRITING') as (generation_id, state)")
    return online.serving_outcomes(_requests(spark, d), states, held).select("request_id", "customer_id", "feature_name", "status", "value")


@query
def clustered_page(spark, d):
    """A page from the files of key ranges that hold it."""
    path = shared_folder(spark, "clustered")
    clustered.write_clustered(_generation(spark, d, SECOND, "g2"), path, ["customer_id", "feature_name"], 8)
    return clustered.clustered_page(spark, path, ["customer_id", "feature_name"], 50, (40, NAMES[2])).select("customer_id", "feature_name", "value_long", "value_double")


def _history(spark, d):
    """A pointer history for each customer, made of its purchases; some entries skip a version, break a chain or repeat an operation."""
    from pyspark.sql import Window

    e = derived.events(spark, d).where("event_type = 'purchase'")
    by = Window.partitionBy("user_id").orderBy("t", "event_id")
    n = F.row_number().over(by)
    return e.select(
        F.concat(F.lit("set-"), F.col("user_id").cast("string")).alias("feature_set"), (n + F.when(F.col("event_id") % 61 == 0, 1).otherwise(0)).cast("bigint").alias("pointer_version"),
        F.when(F.col("event_id") % 67 == 0, "g-lost").otherwise(F.lag(F.concat(F.lit("g-"), F.col("event_id").cast("string"))).over(by)).alias("from_generation"),
        F.concat(F.lit("g-"), F.col("event_id").cast("string")).alias("to_generation"), F.concat(F.lit("op-"), F.when(F.col("event_id") % 71 == 0, 0).otherwise(F.col("event_id")).cast("string")).alias("operation_id"), F.col("t").alias("activated_at"),
    )


@query
def pointer_history_audit(spark, d):
    return assurance.pointer_audit(_history(spark, d)).where("size(problems) > 0").select("feature_set", "pointer_version", "to_generation", F.array_join("problems", ",").alias("problems"))


@query
def active_generations(spark, d):
    return online.active_generations(_history(spark, d))


@query
def pinned_serving_history(spark, d):
    """Which generation each view's request would have been pinned to."""
    views = derived.events(spark, d).where("event_type = 'view'").select(F.col("event_id").alias("request_id"), F.concat(F.lit("set-"), F.col("user_id").cast("string")).alias("feature_set"), F.col("t").alias("request_time"))
    return online.pinned_at(views, _history(spark, d)).select("request_id", "feature_set", "request_time", "generation_id")


@query
def transition_audit(spark, d):
    """Status changes made of events: a state by event type for every customer, in time order."""
    e = derived.events(spark, d)
    state = F.element_at(F.array(*[F.lit(x) for x in ("BUILDING", "VALIDATING", "READY", "ACTIVE", "RETIRED")]), (F.col("event_id") % 5 + 1).cast("int"))
    states = e.select(F.col("user_id").alias("generation_id"), (F.col("t") * 1000 + F.col("event_id") % 1000).alias("at"), state.alias("status"))
    return assurance.transition_audit(states, assurance.OFFLINE_MOVES, "CREATED").groupBy("previous", "status", "legal").agg(F.count("*").alias("moves"))


@query
def keyset_page(spark, d):
    return online.keyset_page(_generation(spark, d, SECOND, "g"), 50, (40, NAMES[2])).select("customer_id", "feature_name", "value_long", "value_double")


@query
def keyset_traversal(spark, d):
    return online.page_numbers(_generation(spark, d, SECOND, "g"), 7).select("customer_id", "feature_name", "page")


def _gates(spark, d):
    """A candidate for each customer; how its events divide decides the facts."""
    per = derived.events(spark, d).groupBy("user_id").agg(F.count("*").alias("n"), F.sum("event_id").alias("s"))
    facts = [((F.col("s") % (i + 5)) != 0).alias(name) for i, (name, _) in enumerate(assurance.GATES)]
    return per.select(F.lit(FEATURE_SET).alias("feature_set"), F.concat(F.lit("g-"), F.col("user_id").cast("string")).alias("generation_id"), F.concat(F.lit("op-"), F.col("n").cast("string")).alias("operation_id"), *facts)


@query
def gate_decisions(spark, d):
    return assurance.gate_decisions(_gates(spark, d)).select("generation_id", "operation_id", "status", F.array_join("reasons", ",").alias("reasons"))


@query
def publish_verdicts(spark, d):
    found = parity.parity_summary(_records(spark, d), _records(spark, d))
    return assurance.publish_verdict(found, _gates(spark, d)).select("generation_id", "verdict", F.array_join("reasons", ",").alias("reasons"))


@query
def diagnosis_rollup(spark, d):
    decided = assurance.gate_decisions(_gates(spark, d))
    signals = decided.select(F.explode("reasons").alias("signal"))
    states = spark.sql("select 'payments' feature_set, 'g2' generation_id, 'ACTIVE' state")
    served = online.serving_outcomes(_requests(spark, d), states, _stored(spark, d)).where("status <> 'FOUND'").select(F.col("status").alias("signal"))
    return assurance.diagnosis(signals.union(served))


@query
def lag_snapshot(spark, d):
    e = derived.events(spark, d)
    n, t = F.col("event_id"), F.col("t")
    clocks = e.select(
        "event_id", t.alias("event_time"), (t + n % 7200 - F.when(n % 53 == 0, 7300).otherwise(0)).alias("knowledge_time"), (t + 8000).alias("source_frontier_available_at"), (t + 8100).alias("build_started"), (t + 8100 + n % 900).alias("build_completed"),
        (t + 9100).alias("materialization_started"), (t + 9100 + n % 60).alias("materialization_completed"), (t + 9300).alias("candidate_validated_at"), (t + 9400 - F.when(n % 59 == 0, 200).otherwise(0)).alias("activated_at"),
        (t + 20000 + n % 5000).alias("request_time"), (F.when(n % 47 == 0, -1).otherwise(t + 7200)).alias("record_frontier"), (t + 22000).alias("expires_at"),
    )
    return assurance.lag_snapshot(clocks).drop(*assurance.CLOCKS, "build_started", "materialization_started").withColumn("violations", F.array_join("violations", ","))


def _telemetry(spark, d):
    e = derived.events(spark, d)
    n = F.col("event_id")
    pick = lambda xs, i: F.element_at(F.array(*[F.lit(x) for x in xs]), (i % len(xs) + 1).cast("int"))
    labels = F.map_from_arrays(F.array(F.when(n % 23 == 0, "customer_id").otherwise("phase"), F.lit("status")), F.array(F.when(n % 29 == 0, "").otherwise(F.col("event_type")), F.lit("ok")))
    trace = F.map_from_arrays(F.array(F.lit("definition_set_digest"), F.lit("generation_id"), F.lit("operation_id"), F.when(n % 31 == 0, "frontier").otherwise("source_frontier_digest")), F.array(F.lit("d"), F.lit("g"), n.cast("string"), F.lit("f")))
    return e.select(
        F.when(n % 19 == 0, "unknown.event").otherwise(pick(assurance.TELEMETRY_EVENTS, n)).alias("event"), F.when(n % 37 == 0, -1).otherwise(F.col("t")).cast("bigint").alias("occurred_at"), labels.alias("labels"), trace.alias("trace"),
        F.create_map(F.lit("value"), F.when(n % 41 == 0, F.lit(float("nan"))).otherwise(F.col("value"))).alias("measurements"),
    )


@query
def telemetry_validation(spark, d):
    out = assurance.telemetry_violations(_telemetry(spark, d))
    return out.groupBy("event", F.array_join("violations", ",").alias("violations")).agg(F.count("*").alias("events"))


@query
def trial_summary(spark, d):
    """Benchmark trials made of events: a case for each customer, an operation for each event type."""
    e = derived.events(spark, d)
    n = F.col("event_id")
    trials = e.select(
        F.concat(F.lit("case-"), (F.col("user_id") % 40).cast("string")).alias("case_id"), F.col("event_type").alias("operation"), (n % 6).alias("trial"), (n % 6 != 0).alias("warm"), (F.round(F.col("value") * 1000).cast("bigint") + 1).alias("duration_ns"),
        F.lit("i").alias("input_digest"), (n % 2).cast("string").alias("output_digest"), (n % 397 != 0).alias("correctness_passed"),
    )
    return assurance.trial_summary(trials)


@query
def capacity_report(spark, d):
    keys = _records(spark, d).select("partition_key", "sort_key", "feature_set", "generation_id", "customer_id", "feature_name", "expires_at", "record_digest")
    return assurance.capacity_report(keys)


@query
def write_unit_projection(spark, d):
    return assurance.write_unit_projection(_records(spark, d), 300)


@query
def partition_key_skew(spark, d):
    return assurance.records_per_partition(_generation(spark, d, SECOND, "g2"))


@query
def hot_customers(spark, d):
    return assurance.key_skew(_rev(spark, d), "customer_id", 10)


@query
def partition_skew(spark, d):
    """Rows of partitions, if customers were dealt to sixteen of them by number."""
    return assurance.partition_skew(_rev(spark, d), F.pmod("customer_id", F.lit(16)))


@query
def injected_corrections(spark, d):
    """The feed with a second revision of a quarter of its events."""
    return workload.with_corrections(_rev(spark, d), 25)


@query
def json_revision_scan(spark, d):
    """Revisions stored as JSON lines and read with their fixed schema."""
    path = shared_folder(spark, "revisions-json")
    _rev(spark, d).withColumns({"event_id": F.col("event_id").cast("string"), "customer_id": F.col("customer_id").cast("string")}).write.option("ignoreNullFields", "false").json(path)
    return tables.in_order(tables.read_revisions(spark, path, "json", REVISIONS))


@query
def generation_scan(spark, d):
    """Two generations in one partitioned table, of which one is read."""
    path = shared_folder(spark, "values")
    for frontier, name in ((FIRST, "g1"), (SECOND, "g2")):
        tables.write_values(_generation(spark, d, frontier, name), path)
    return generations.read_generation(spark, path, "g1").select("customer_id", "feature_name", "value_long", "value_double", "generation_id")


@query
def generation_round_trip(spark, d):
    """A generation stored, stored again, and read back through its checks."""
    values, root = _generation(spark, d, SECOND, "g2"), shared_folder(spark, "generations")
    outcomes = [generations.write_once(values, root, "g2") for _ in range(2)]
    back = generations.read_checked(spark, root, "g2")
    return rows_digest(back).withColumns({"first": F.lit(outcomes[0]), "second": F.lit(outcomes[1])})


@query
def digest_tree(spark, d):
    """Rows of a stored generation by its digests, and how many buckets differ after one customer's rows were lost."""
    root = shared_folder(spark, "generations")
    values = _generation(spark, d, SECOND, "g2")
    generations.write_once(values, root, "g2")
    path = f"{root}/g2/rows"
    lost = stored(spark.read.parquet(path).where("customer_id <> 7"), "lost")
    lost.write.mode("overwrite").partitionBy("_bucket").parquet(path)
    wrong = generations.damaged_buckets(spark, root, "g2")
    return spark.read.parquet(f"{root}/g2/digests").agg(F.sum("row_count").alias("rows"), F.count_if(F.col("bucket").isin(wrong)).alias("damaged"))


@query
def build_job(spark, d):
    """A generation built by the job from files of revisions and customers, read back through its checks."""
    base = shared_folder(spark, "job")
    text = lambda c: F.col(c).cast("string").alias(c)
    _rev(spark, d).select(*[text(c) if c.endswith("_id") else F.col(c) for c in REVISION_FIELDS]).write.parquet(f"{base}/revisions")
    derived.spine(spark, d).select(text("customer_id")).write.parquet(f"{base}/spine")
    told = {"revisions": f"{base}/revisions", "spine": f"{base}/spine", "root": f"{base}/out", "generation": "g2", "event-cutoff": CUTOFF, "knowledge-cutoff": SECOND}
    job.main([str(x) for k, v in told.items() for x in (f"--{k}", v)])
    return generations.read_checked(spark, f"{base}/out", "g2").select("customer_id", "feature_name", "value_long", "value_double", "generation_id")


@query
def definition_usage(spark, d):
    """A generation's rows by the definitions of the set that they name, with the set's digest: its type contract holds if no row has the other type."""
    names = definition_set(spark, FEATURES).select("definition_digest", "identity", "value_type", "place", "definition_set_digest")
    rows = _generation(spark, d, SECOND, "g2").join(F.broadcast(names), "definition_digest", "left")
    other = F.when(F.col("value_type") == "integer", F.col("value_double")).otherwise(F.col("value_long").cast("double"))
    return rows.groupBy("identity", "place", "definition_set_digest").agg(F.count("*").alias("rows"), F.count(other).alias("of_other_type"))


@query
def dataset_binding(spark, d):
    """A training set's manifest: its rows' digest bound to those of its sources."""
    rows = training.point_in_time_dataset(derived.labels(spark, d), _rev(spark, d), FEATURES, SECOND)
    source, labels = rows_digest(_rev(spark, d)).first().rows_digest, rows_digest(derived.labels(spark, d)).first().rows_digest
    code = rows_digest(definitions_frame(spark, FEATURES)).first().rows_digest
    return training.dataset_manifest(rows, source, labels, definition_set_digest(FEATURES), code).select("row_count", "source_digest", "label_digest", "definition_set_digest")


@query
def missing_links(spark, d):
    """Customers' manifests whose source names no stored artifact."""
    per = _rev(spark, d).groupBy("customer_id").agg(F.sha2(F.max("revision_id"), 256).alias("source_digest"))
    stored = per.where("customer_id % 6 <> 0").select(F.col("source_digest").alias("rows_digest"))
    return generations.missing_links(per, stored, "source_digest").select("customer_id", "source_digest")


def _slices(spark, d):
    """Revisions of four successive spans of knowledge time, the last with replays and contradictions."""
    r = _rev(spark, d)
    low, high = r.agg(F.min("knowledge_time"), F.max("knowledge_time")).first()
    step = (high - low) // 4 + 1
    parts = [r.where((F.col("knowledge_time") >= low + i * step) & (F.col("knowledge_time") < low + (i + 1) * step)) for i in range(4)]
    first = r.where("revision_id like '%-r1'")
    return [*parts[:3], parts[3].unionByName(first.where("event_id % 50 = 0")).unionByName(first.where("event_id % 60 = 1").withColumn("amount_cents", F.col("amount_cents") + 7))]


@query
def stream_ingest_revisions(spark, d):
    base = shared_folder(spark, "stream-ingest")
    ingest.in_turn(_slices(spark, d), f"{base}/in", lambda stream: ingest.ingest(stream, f"{base}/out", f"{base}/checkpoint"))
    kept, refused = spark.read.parquet(f"{base}/out/accepted"), spark.read.parquet(f"{base}/out/quarantine")
    return kept.groupBy(F.lit("appended").alias("outcome")).agg(F.count("*").alias("rows")).union(refused.groupBy("outcome").agg(F.count("*").alias("rows")))


@query
def stream_telemetry(spark, d):
    base = shared_folder(spark, "stream-telemetry")
    events = _telemetry(spark, d)
    events.write.parquet(f"{base}/in")
    for q in ingest.telemetry(spark.readStream.schema(events.schema).parquet(f"{base}/in"), f"{base}/out", f"{base}/checkpoint"):
        q.awaitTermination()
    good, bad = spark.read.parquet(f"{base}/out/valid"), spark.read.parquet(f"{base}/out/quarantine")
    return good.agg(F.count("*").alias("events")).select(F.lit("valid").alias("sink"), "events").union(bad.agg(F.count("*").alias("events")).select(F.lit("quarantine"), "events"))


@query
def stream_arrival_lag(spark, d):
    base = shared_folder(spark, "stream-lag")
    source = F.concat(F.lit("feed-"), (F.col("customer_id") % 3).cast("string"))

    def keep(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={batch_id}")

    def watch(stream):
        lags = ingest.arrival_lag(stream.withColumn("source", source), source="source")
        return lags.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()

    ingest.in_turn(_slices(spark, d), f"{base}/in", watch)
    out = spark.read.parquet(f"{base}/out")
    return out.join(F.broadcast(out.agg(F.max("batch").alias("batch"))), "batch").drop("batch")


@query
def stream_incremental_generation(spark, d):
    base = shared_folder(spark, "stream-generation")
    ingest.in_turn(_slices(spark, d), f"{base}/in", lambda stream: ingest.continuous_generation(stream, derived.spine(spark, d), FEATURES, CUTOFF, f"{base}/out", f"{base}/checkpoint"))
    out = spark.read.parquet(f"{base}/out/values")
    return out.join(F.broadcast(out.agg(F.max("batch").alias("batch"))), "batch").drop("batch", "generation_id")


def _told(spark, d, frontier):
    r = _records(spark, d, frontier, "g")
    return r.select("partition_key", "sort_key", "customer_id", F.sha2(F.concat_ws("|", "value.kind", F.col("value.integer").cast("string"), "value.decimal"), 256).alias("digest"))


@query
def stream_upserts(spark, d):
    """Records of two frontiers as a stream of idempotent writes: rows stored, and rows that contradict them."""
    base = shared_folder(spark, "stream-upserts")
    parts = [_told(spark, d, FIRST).where("customer_id % 4 <> 0"), _told(spark, d, SECOND)]
    ingest.in_turn(parts, f"{base}/in", lambda stream: ingest.upsert(stream, ["partition_key", "sort_key"], "digest", f"{base}/out", f"{base}/checkpoint"))
    return spark.read.parquet(f"{base}/out/stored").select(F.lit("stored").alias("sink")).union(spark.read.parquet(f"{base}/out/conflicts").select(F.lit("conflicts"))).groupBy("sink").agg(F.count("*").alias("rows"))


@query
def resumed_write(spark, d):
    """A write of records that was interrupted, resumed and reconciled."""
    base, planned = shared_folder(spark, "resumed"), _records(spark, d)
    planned.where("customer_id % 3 = 0").write.parquet(f"{base}/stored/batch=0")
    ingest.resume(planned, base, 1)
    return online.reconciliation(planned, spark.read.parquet(f"{base}/stored").drop("batch"))


@query
def candidate_receipts(spark, d):
    """Six candidates by customer number: one has a changed value, one another count in its manifest, one a lost source."""
    n = F.col("customer_id") % 6
    rows = _generation(spark, d, SECOND, "g2").select(F.concat(F.lit("g"), n.cast("string")).alias("generation_id"), "customer_id", "feature_name", "value_long", "value_double")
    candidate = rows.withColumn("value_long", F.when((n == 1) & (F.col("feature_name") == NAMES[0]), F.col("value_long") + 1).otherwise(F.col("value_long")))
    made = candidate.select("generation_id", row_digest(candidate.drop("generation_id")).alias("row_hash")).groupBy("generation_id").agg(*digest_of())
    source = F.sha2(F.col("generation_id"), 256)
    manifests = made.select("generation_id", (F.col("row_count") + F.when(F.col("generation_id") == "g2", 1).otherwise(0)).alias("candidate_count"), F.col("rows_digest").alias("candidate_digest"), source.alias("source_digest"))
    artifacts = made.select(F.when(F.col("generation_id") == "g3", "labels").otherwise("source").alias("kind"), source.alias("rows_digest"))
    return generations.candidate_receipt(manifests, candidate, rows, artifacts, {"source_digest": "source"}).drop("actual_digest", "expected_digest", "receipt_digest")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: a point-in-time training set of all purchases."""
    return pit_training_dataset(spark, sf_dir)
