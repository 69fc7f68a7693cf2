"""Golden values, boundaries, order invariance and properties of the bitemporal operators."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.definitions import FeatureDefinition, check_definitions, payment_features
from tidemark.operators import features, incremental, quality, temporal, training
from tidemark.operators.parity import value_parity
from tidemark.schemas import LABELS, REVISIONS
from tidemark.sources.workload import synthetic_revisions, with_corrections

GOLDEN = [
    ("lower", "lower-r1", "c-1", 100, 100, "upsert", 999, "succeeded", 0.1),
    ("p-1", "p-1-r1", "c-1", 120, 125, "upsert", 100, "succeeded", 0.2),
    ("p-1", "p-1-r2", "c-1", 120, 190, "upsert", 150, "succeeded", 0.3),
    ("p-2", "p-2-r1", "c-1", 140, 145, "upsert", 50, "failed", 0.7),
    ("upper", "upper-r1", "c-1", 200, 200, "upsert", 80, "succeeded", 0.5),
    ("p-3", "p-3-r1", "c-1", 160, 170, "upsert", 30, "succeeded", 0.9),
    ("p-3", "p-3-r2", "c-1", 160, 210, "retract", None, None, None),
]
SHORT = [
    FeatureDefinition("count_100s", 1, "integer", 200, "transaction_count", 100, "", 0),
    FeatureDefinition("spend_100s", 1, "integer", 200, "successful_spend_cents", 100, "", 0),
    FeatureDefinition("failed_ratio_100s", 1, "float", 200, "failed_payment_ratio", 100, "", 0.0),
    FeatureDefinition("hours_since_success_100s", 1, "float", 200, "hours_since_success", 100, "", None),
    FeatureDefinition("max_risk_100s", 1, "float", 200, "max_merchant_risk", 100, "", None),
]
EXPECTED = {180: (3, 130, 1 / 3, 0.011111111111111112, 0.9), 205: (4, 260, 0.25, 0.0, 0.9), 220: (3, 230, 1 / 3, 0.0, 0.7)}
SELECTED = {180: {"lower-r1", "p-1-r1", "p-2-r1", "p-3-r1"}, 205: {"lower-r1", "p-1-r2", "p-2-r1", "p-3-r1", "upper-r1"}, 220: {"lower-r1", "p-1-r2", "p-2-r1", "upper-r1"}}
LIFE = [
    ("boundary", "boundary-r1", "c-1", 113600, 113600, "upsert", 999, "succeeded", 0.1),
    ("p-1", "p-1-r1", "c-1", 120000, 120005, "upsert", 100, "succeeded", 0.2),
    ("p-1", "p-1-r2", "c-1", 120000, 199990, "upsert", 150, "succeeded", 0.3),
    ("p-2", "p-2-r1", "c-1", 140000, 140005, "upsert", 50, "failed", 0.7),
    ("p-3", "p-3-r1", "c-1", 160000, 160005, "upsert", 30, "succeeded", 0.9),
    ("p-3", "p-3-r2", "c-1", 160000, 200010, "retract", None, None, None),
    ("upper", "upper-r1", "c-1", 200000, 200000, "upsert", 80, "succeeded", 0.5),
    ("c2-p1", "c2-p1-r1", "c-2", 150000, 150000, "upsert", 40, "succeeded", 0.4),
]


@pytest.fixture(scope="module")
def golden(spark):
    return spark.createDataFrame(GOLDEN, REVISIONS)


@pytest.fixture(scope="module")
def life(spark):
    return spark.createDataFrame(LIFE, REVISIONS), spark.createDataFrame([("c-1",), ("c-2",), ("c-empty",)], "customer_id string")


def wide(spark, rows, frontier, definitions=SHORT, cutoff=200):
    spine = spark.createDataFrame([("c-1",)], "customer_id string")
    return tuple(features.wide_features(rows, spine, definitions, cutoff, frontier).first())[1:]


@pytest.mark.parametrize("frontier", EXPECTED)
def test_golden_values(spark, golden, frontier):
    assert {r.revision_id for r in temporal.standing(golden, 200, frontier).collect()} == SELECTED[frontier]
    intervals = temporal.validity_intervals(golden).where(temporal.valid_at(F.lit(frontier)) & (F.col("operation") == "upsert") & (F.col("event_time") <= 200))
    assert {r.revision_id for r in intervals.collect()} == SELECTED[frontier]
    assert wide(spark, golden, frontier) == EXPECTED[frontier]


def test_training_set_and_leaky_control(spark, golden):
    labels = spark.createDataFrame([("l", "c-1", 200, 180, 1), ("m", "c-none", 200, 180, 0)], LABELS)
    right = {r.label_id: r for r in training.point_in_time_dataset(labels, golden, SHORT, 10_000).collect()}
    assert tuple(right["l"][n.name] for n in SHORT) == EXPECTED[180]
    assert tuple(right["m"][n.name] for n in SHORT) == (0, 0, 0.0, None, None)
    wrong = training.leaky_dataset(labels, golden, SHORT, 10_000).where("label_id = 'l'").first()
    assert (right["l"].spend_100s, wrong.spend_100s) == (130, 230)
    cut = training.label_cutoffs(labels, 150).first()
    assert (cut.requested_cutoff, cut.effective_cutoff, cut.truncated) == (180, 150, True)


def test_order_and_partitioning_change_nothing(spark, golden):
    rng = random.Random(1)
    for parts in (1, 3, 7):
        rows = GOLDEN[:]
        rng.shuffle(rows)
        assert wide(spark, spark.createDataFrame(rows, REVISIONS).repartition(parts), 205) == EXPECTED[205]


def test_defaults_and_precision(spark):
    big = spark.createDataFrame([("e", "e-r1", "c-1", 150, 150, "upsert", 9007199254740993, "succeeded", 0.5)], REVISIONS)
    assert wide(spark, big, 200)[1] == 9007199254740993
    failed = spark.createDataFrame([("e", "e-r1", "c-1", 150, 150, "upsert", 5, "failed", 0.5)], REVISIONS)
    spend = [FeatureDefinition("spend", 1, "integer", 9, "successful_spend_cents", 100, "", 777), FeatureDefinition("n", 1, "integer", 9, "transaction_count", 100, "", 5)]
    assert wide(spark, failed, 200, spend) == (777, 1)
    risk = [FeatureDefinition("risk", 1, "float", 9, "max_merchant_risk", None, "", 0.25), FeatureDefinition("n", 1, "integer", 9, "transaction_count", 100, "", 5)]
    assert wide(spark, failed.limit(0), 200, risk) == (0.25, 0)


def test_window_boundaries(spark):
    for t, inside in ((99, 0), (100, 0), (101, 1), (200, 1), (201, 0)):
        rows = spark.createDataFrame([("e", "r", "c-1", t, t, "upsert", 1, "succeeded", 0.0)], REVISIONS)
        assert wide(spark, rows, 1000)[0] == inside
        labels = spark.createDataFrame([("l", "c-1", 200, 200, 1)], LABELS)
        assert training.point_in_time_dataset(labels, rows.withColumn("knowledge_time", F.least("knowledge_time", F.lit(200))), SHORT, 1000).first().count_100s == inside


def test_incremental_equals_full(spark, life):
    revisions, spine = life
    definitions = payment_features()
    build = lambda k, g: features.build_generation(revisions, spine, definitions, 200000, k, g)
    pairs = incremental.affected_pairs(revisions, definitions, 200000, 180000, 200020)
    assert {(r.customer_id, r.feature_name) for r in pairs.collect()} == {("c-1", d.name) for d in definitions}
    out, work = incremental.refreshed_generation(build(180000, "g1"), revisions, spine, definitions, 200000, 180000, 200020, "g2")
    assert value_parity(build(200020, "g2"), out).count() == 0 and out.count() == 15
    summary = work.first()
    assert (summary.affected_pairs, summary.recomputed_rows, summary.preserved_rows, summary["mode"]) == (5, 5, 10, "incremental")
    full = incremental.scope_summary(revisions, pairs, definitions, 200020, 0.4).first()
    assert full["mode"] == "full"
    with pytest.raises(ValueError, match="predecessor"):
        incremental.refreshed_generation(build(180000, "g1").where("customer_id <> 'c-2'"), revisions, spine, definitions, 200000, 180000, 200020, "g2")
    counts = [features.wide_features(revisions, spine, definitions, 200000, k).where("customer_id = 'c-1'").first().transaction_count_24h for k in (180000, 200005, 200020)]
    assert counts == [3, 4, 3]


def test_moved_event_affects_both_windows(spark):
    rows = [("e", "r1", "c-1", 150, 150, "upsert", 1, "succeeded", 0.0), ("e", "r2", "c-1", 50, 170, "upsert", 1, "succeeded", 0.0), ("f", "r1f", "c-2", 50, 150, "upsert", 1, "succeeded", 0.0), ("f", "r2f", "c-2", 150, 170, "upsert", 1, "succeeded", 0.0)]
    pairs = incremental.affected_pairs(spark.createDataFrame(rows, REVISIONS), SHORT[:1], 200, 160, 180)
    assert {r.customer_id for r in pairs.collect()} == {"c-1", "c-2"}


@settings(max_examples=8, deadline=None, derandomize=True, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 300), st.integers(0, 100), st.booleans(), st.booleans()), min_size=1, max_size=25), st.integers(0, 300))
def test_later_knowledge_never_changes_the_past(spark, drawn, frontier):
    rows, clocks = [], set()
    for i, (event, t, delay, retract, ok) in enumerate(drawn):
        if (event, t + delay) not in clocks:
            clocks.add((event, t + delay))
            payload = (None, None, None) if retract else (i, "succeeded" if ok else "failed", 0.5)
            rows.append((f"e{event}", f"r{i}", f"c-{event % 2}", t, t + delay, "retract" if retract else "upsert", *payload))
    spine = spark.createDataFrame([("c-0",), ("c-1",)], "customer_id string")
    whole = spark.createDataFrame(rows, REVISIONS)
    past = spark.createDataFrame([r for r in rows if r[4] <= frontier], REVISIONS)
    get = lambda df: sorted(map(tuple, features.wide_features(df, spine, SHORT, 250, frontier).collect()))
    assert get(whole) == get(past)


def test_violations_and_conflicts(spark):
    rows = [
        ("a", "a1", "c", 10, 5, "upsert", 1, "succeeded", 0.1),
        ("b", "b1", "c", 1, 5, "retract", 1, None, None),
        ("c", "c1", "c", 1, 5, "delete", 1, "succeeded", 0.1),
        ("d", "d1", "c", 1, 5, "upsert", 1, "succeeded", 1.5),
        ("e", "", "c", 1, 5, "upsert", None, "odd", None),
        ("f", "f1", "c", 1, 5, "upsert", 1, "succeeded", float("nan")),
    ]
    out = {r.event_id: r.violations for r in quality.revision_violations(spark.createDataFrame(rows, REVISIONS)).collect()}
    assert out == {"a": ["KNOWN_BEFORE_EVENT"], "b": ["RETRACT_WITH_PAYLOAD"], "c": ["UNKNOWN_OPERATION"], "d": ["BAD_RISK"], "e": ["EMPTY_REVISION_ID", "BAD_AMOUNT", "UNKNOWN_STATUS", "BAD_RISK"], "f": ["BAD_RISK"]}
    good = ("x", "x1", "c", 1, 5, "upsert", 1, "succeeded", 0.1)
    for other, kind in (((*good[:6], 2, *good[7:]), "REVISION_REUSED"), (("x", "x2", *good[2:]), "SAME_CLOCK"), (("x", "x3", "other", 1, 6, *good[5:]), "CUSTOMER_CHANGED")):
        both = spark.createDataFrame([good, good, other], REVISIONS)
        assert kind in {r.conflict for r in quality.conflicts(both).collect()}
        with pytest.raises(ValueError, match=kind):
            quality.assert_clean(both)
    quality.assert_clean(spark.createDataFrame([good, good], REVISIONS))


def test_strict_decoding(spark):
    good = '{"event_id":"e","revision_id":"r","customer_id":"c","event_time":1,"knowledge_time":2,"operation":"upsert","amount_cents":3,"status":"failed","merchant_risk":0.5}'
    raws = [good, "{", good.replace('"status"', '"extra":1,"status"'), good.replace('"amount_cents":3', '"amount_cents":"x"'), good.replace('"event_time":1,', "")]
    out = [r.violations for r in quality.decoded_revisions(spark.createDataFrame([(r,) for r in raws], "raw string")).collect()]
    assert out == [[], ["MALFORMED"], ["UNKNOWN_FIELD"], ["WRONG_TYPE"], ["MISSING_FIELD"]]
    old = spark.createDataFrame([("e", "c", 1, 2, 3, "failed", 0.5)], "event_id string, customer_id string, event_time bigint, knowledge_time bigint, amount_cents bigint, status string, merchant_risk double")
    assert quality.upgraded(old).first().revision_id == "e@2"


def test_definitions_are_checked():
    d = payment_features()
    check_definitions(d)
    for bad in ([], [d[0], d[0]], [FeatureDefinition("x", 1, "float", 1, "transaction_count", 1, "")], [FeatureDefinition("x", 1, "integer", 1, "nothing", 1, "")], [FeatureDefinition("x", 0, "integer", 1, "transaction_count", 1, "")]):
        with pytest.raises(ValueError):
            check_definitions(bad)


def test_synthetic_feed_is_the_same_on_any_partitioning(spark):
    a = synthetic_revisions(spark, "skewed", 3, 10, 500)
    b = synthetic_revisions(spark, "skewed", 3, 10, 500).repartition(5)
    assert a.exceptAll(b).count() == 0 and a.where("customer_id = 'c-0'").count() > 350
    assert with_corrections(a, 100).count() == 1000
    quality.assert_clean(with_corrections(a, 25))


def test_no_cartesian_product(spark, golden):
    labels = spark.createDataFrame([("l", "c-1", 200, 180, 1)], LABELS)
    for df in (training.point_in_time_dataset(labels, golden, SHORT, 10_000), features.build_generation(golden, labels.select("customer_id"), SHORT, 200, 205, "g")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_training_set_of_one_hot_customer(spark):
    rng = random.Random(23)
    rows = [(f"e{i}", f"e{i}-r", "hot" if i % 20 else f"c{i}", t := rng.randrange(0, 3000), t + rng.randrange(0, 300), "upsert", i, "succeeded", 0.5) for i in range(1500)]
    labels = [(f"l{i}", "hot" if i % 9 else "c40", t := rng.randrange(-50, 3200), t - rng.randrange(0, 50), 1) for i in range(120)]
    out = {r.label_id: r for r in training.point_in_time_dataset(spark.createDataFrame(labels, LABELS), spark.createDataFrame(rows, REVISIONS), SHORT, 10_000).collect()}
    for label, customer, at, known, _ in labels:
        seen = [r for r in rows if r[2] == customer and at - 100 < r[3] <= at and r[4] <= known]
        assert (out[label].count_100s, out[label].spend_100s) == (len(seen), sum(r[6] for r in seen))


def test_refresh_looks_at_moved_events_only(spark, life):
    moved = temporal.moved_events(life[0], 180000, 200020)
    assert {r.event_id for r in moved.collect()} == {"p-1", "p-3", "upper"}
    assert temporal.state_diff(life[0], 180000, 200020, moved.where("event_id = 'upper'")).count() == 1
