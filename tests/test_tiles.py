"""Time tiles, digest trees, observed manifests, skew plans, clustered pages, bucketed records, SQL functions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.definitions import FeatureDefinition, payment_features, register
from tidemark.functions.values import rows_digest
from tidemark.operators import skew, temporal, tiles, timelines, training
from tidemark.operators.features import build_generation, wide_features
from tidemark.operators.temporal import validity_intervals
from tidemark.plans import sql
from tidemark.schemas import LABELS, REVISIONS
from tidemark.sources import clustered, generations
from tidemark.sources.workload import synthetic_revisions, with_corrections
from tidemark.streaming import ingest

DEFS = payment_features()
START = 1_700_000_000
DAY = 86_400


@pytest.fixture(scope="module")
def feed(spark):
    rows = with_corrections(synthetic_revisions(spark, "skewed", 5, 20, 2500), 40, later=90_000)
    out = rows.persist()
    yield out
    out.unpersist()


@pytest.fixture(scope="module")
def labels(spark):
    rng = random.Random(7)
    rows = []
    for i in range(120):
        t = START + rng.randrange(5 * DAY, 45 * DAY) if i % 10 else START // DAY * DAY + 20 * DAY - i % 3 // 2
        rows.append((f"l{i}", f"c-{rng.choice([0, 0, rng.randrange(20)])}", t, rng.choice([t, t - 50_000, t - 200_000]), i % 2))
    return spark.createDataFrame(rows, LABELS)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("width", [DAY, 7_000])
def test_tiles_equal_the_exact_training_set(spark, feed, labels, width):
    want = rows_of(training.point_in_time_dataset(labels, feed, DEFS, START + 40 * DAY))
    assert rows_of(tiles.tiled_dataset(labels, feed, DEFS, START + 40 * DAY, width)) == want


def test_tiles_join_few_rows(spark, feed):
    """A label of a customer with thousands of events meets some tiles and the events of a few days."""
    label = spark.createDataFrame([("l", "c-0", START + 39 * DAY, START + 60 * DAY, 1)], LABELS)
    events = feed.where(F.col("customer_id") == "c-0").count()
    met = tiles.build_tiles(validity_intervals(feed), DEFS).where("customer_id = 'c-0'").count()
    assert met <= 42 and events > 2000
    out = tiles.tiled_dataset(label, feed, DEFS, START + 90 * DAY)
    assert rows_of(out) == rows_of(training.point_in_time_dataset(label, feed, DEFS, START + 90 * DAY))


def test_tiles_need_parts_and_windows(spark, feed, labels):
    with pytest.raises(ValueError, match="bounded"):
        tiles.tiled_dataset(labels, feed, [FeatureDefinition("n", 1, "integer", 5, "transaction_count", None, "")], START)


def test_a_manifest_is_observed_while_writing(spark, feed, tmp_path):
    """The rows are computed once: each runs through a counter that the session keeps."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(x):
        seen.add(1)
        return x

    few = feed.select("event_id", "customer_id", "amount_cents", "merchant_risk").limit(300).persist()
    few.count()
    rows = few.withColumn("event_id", counted("event_id"))
    assert generations.write_once(rows, str(tmp_path), "g", kind="rows") == "written"
    assert seen.value == 300
    manifest = generations.manifest_of(spark, str(tmp_path), "g")
    whole = rows_digest(few).first()
    assert (manifest["row_count"], manifest["rows_digest"]) == (whole.row_count, whole.rows_digest)
    assert generations.write_once(few, str(tmp_path), "g", kind="rows") == "replayed"
    few.unpersist()


def test_a_digest_tree_names_what_differs(spark, feed, tmp_path):
    root, spine = str(tmp_path), feed.select("customer_id").distinct()
    values = build_generation(feed, spine, DEFS, START + 30 * DAY, START + 31 * DAY, "g")
    generations.write_once(values, root, "g")
    assert generations.damaged_buckets(spark, root, "g") == [] and rows_of(generations.read_checked(spark, root, "g")) == rows_of(values)
    bucket = values.where("customer_id = 'c-3'").select(F.pmod(F.xxhash64("customer_id"), F.lit(generations.BUCKETS))).first()[0]
    others = [b for b in range(generations.BUCKETS) if b != bucket]
    changed = spark.read.parquet(f"{root}/g/rows").withColumn("value_long", F.when(F.col("customer_id") == "c-3", -1).otherwise(F.col("value_long")))
    changed.write.partitionBy("_bucket").parquet(f"{root}/copy")
    changed = spark.read.parquet(f"{root}/copy")
    changed.write.mode("overwrite").partitionBy("_bucket").parquet(f"{root}/g/rows")
    assert generations.damaged_buckets(spark, root, "g") == [bucket] == generations.damaged_buckets(spark, root, "g", [bucket])
    assert generations.damaged_buckets(spark, root, "g", others) == []
    few = generations.stored_rows(spark, root, "g", [bucket])
    few.collect()
    assert "PartitionFilters: [isnotnull(_bucket" in few._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(generations.Damaged, match=str(bucket)):
        generations.read_checked(spark, root, "g")
    assert generations.write_once(spark.createDataFrame([], REVISIONS), root, "empty", kind="rows") == "written"
    assert generations.read_checked(spark, root, "empty").count() == 0


def test_heavy_stretches_are_dealt_evenly(spark):
    """Four fifths of labels and events on one customer: every task gets about as many pairs as the next."""
    feed = synthetic_revisions(spark, "skewed", 9, 40, 4000).persist()
    rng = random.Random(3)
    rows = [(f"l{i}", "c-0" if i % 5 else f"c-{rng.randrange(40)}", START + rng.randrange(10 * DAY, 40 * DAY), None, 0) for i in range(600)]
    labels = spark.createDataFrame(rows, LABELS)
    want = rows_of(training.point_in_time_dataset(labels, feed, DEFS, START + 60 * DAY))
    assert rows_of(skew.dealt_dataset(labels, feed, DEFS, START + 60 * DAY, pairs=500)) == want
    cut = training.label_cutoffs(labels, START + 60 * DAY).select("label_id", "customer_id", "label_time", "effective_cutoff")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        events = validity_intervals(feed).where("operation = 'upsert'")
        dealt = lambda pairs: sorted(r.n for r in skew.dealt_join(cut, events, DEFS, pairs).groupBy("customer_id", "_at", "_l", "_e").agg(F.count("*").alias("n")).groupBy(F.pmod(F.hash("customer_id", "_at", "_l", "_e"), F.lit(8))).agg(F.sum("n").alias("n")).collect())
        even, as_it_was = dealt(500), dealt(1 << 40)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        feed.unpersist()
    assert sum(even) == sum(as_it_was) and max(even) < 2 * even[len(even) // 2]


def test_a_page_reads_the_files_that_hold_it(spark, tmp_path):
    rows = spark.range(4000).select((F.col("id") % 1000).alias("k"), F.concat(F.lit("f"), (F.col("id") / 1000).cast("int").cast("string")).alias("f"), "id")
    clustered.write_clustered(rows, str(tmp_path), ["k", "f"], 20)
    everything = [tuple(r) for r in rows.orderBy("k", "f").collect()]
    cursor, read = None, []
    for page in range(3):
        assert len(clustered.page_files(spark, str(tmp_path), ["k", "f"], 300, cursor)) <= 4
        got = [tuple(r) for r in clustered.clustered_page(spark, str(tmp_path), ["k", "f"], 300, cursor).collect()]
        assert got == everything[300 * page : 300 * page + 301]
        read += got[:300]
        cursor = read[-1][:2]
    last = everything[-5][:2]
    assert [tuple(r) for r in clustered.clustered_page(spark, str(tmp_path), ["k", "f"], 300, last).collect()] == everything[-4:]
    assert len(clustered.page_files(spark, str(tmp_path), ["k", "f"], 300, last)) == 1
    assert clustered.clustered_page(spark, str(tmp_path), ["k", "f"], 300, everything[-1][:2]).count() == 0


def test_bucketed_records_are_not_shuffled(spark, tmp_path):
    keys = ["generation_id", "customer_id", "feature_name"]
    rows = spark.range(500).select(F.lit("g2").alias("generation_id"), (F.col("id") % 100).alias("customer_id"), F.concat(F.lit("f"), (F.col("id") / 100).cast("int").cast("string")).alias("feature_name"), "id")
    table = clustered.write_bucketed(rows, "tidemark_test_records", str(tmp_path / "b"), keys, 8)
    asked = spark.range(50).select(F.when(F.col("id") % 7 == 0, "g1").otherwise("g2").alias("generation_id"), F.col("id").alias("customer_id"), F.concat(F.lit("f"), (F.col("id") % 5).cast("string")).alias("feature_name"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = asked.join(table.groupBy(*keys).agg(F.max("id").alias("id")), keys, "left")
        assert sorted(r.id for r in out.collect() if r.id is not None) == sorted(i + i % 5 * 100 for i in range(50) if i % 7)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("hashpartitioning") == plan[: plan.index("Initial Plan")].count("hashpartitioning") * 2 == 2  # the requests' only
        assert "Bucketed: true" in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.sql("drop table tidemark_test_records")
    again = clustered.open_bucketed(spark, "tidemark_test_records", str(tmp_path / "b"), "generation_id string, customer_id bigint, feature_name string, id bigint", keys, 8)
    assert again.count() == 500
    spark.sql("drop table tidemark_test_records")


def test_sql_functions_equal_the_operators(spark, feed, labels):
    spine = feed.select("customer_id").distinct()
    sql.register_functions(spark, feed, spine, labels, DEFS, prefix="t_")
    at, frontier = START + 20 * DAY, START + 21 * DAY
    assert rows_of(spark.sql(f"select * from t_state_at({frontier})")) == rows_of(temporal.latest_known(feed, frontier))
    assert rows_of(spark.sql(f"select * from t_standing_at({at}, {frontier})")) == rows_of(temporal.standing(feed, at, frontier))
    assert rows_of(spark.sql(f"select * from t_features_at({at}, {frontier})")) == rows_of(wide_features(feed, spine, DEFS, at, frontier))
    mine = training.point_in_time_dataset(labels, feed, DEFS, frontier).drop("requested_cutoff", "dataset_as_of", "truncated")
    got = spark.sql(f"select * from t_training_set({frontier})")
    assert rows_of(got) == rows_of(mine.select(*got.columns))
    plan = spark.sql(f"select * from t_state_at({frontier}) where customer_id = 'c-1'")._jdf.queryExecution().optimizedPlan().toString()
    assert str(frontier) in plan
    register("t_no_sql", "integer", lambda inside, anchor: F.count_if(inside))
    with pytest.raises(ValueError, match="without SQL"):
        sql.register_functions(spark, feed, spine, labels, [FeatureDefinition("n", 1, "integer", 5, "t_no_sql", 5, "")])
    with pytest.raises(ValueError, match="parts"):
        tiles.build_tiles(validity_intervals(feed), [FeatureDefinition("n", 1, "integer", 5, "t_no_sql", 5, "")])


def test_lag_percentiles_stand_within_their_rank_error(spark, tmp_path):
    """Exact below the accuracy, and within it beyond: here the accuracy is lowered so that sketches compress."""
    rows = synthetic_revisions(spark, "balanced", 4, 10, 6000).withColumn("source", F.when(F.col("customer_id") < "c-5", "a").otherwise("b"))
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    lags = {r: [x.lag for x in rows.where(F.col("source") == r).select((F.col("knowledge_time") - F.col("event_time")).alias("lag")).orderBy("lag").collect()] for r in "ab"}
    for accuracy in (ingest.LAG_ACCURACY, 50):
        ingest.LAG_ACCURACY, before = accuracy, ingest.LAG_ACCURACY
        try:
            query = ingest.arrival_lag(stream, width="10000 days", source="source").writeStream.outputMode("complete").format("memory").queryName(f"lags_{accuracy}").trigger(availableNow=True).start()
        finally:
            ingest.LAG_ACCURACY = before
        query.awaitTermination()
        for r in spark.table(f"lags_{accuracy}").collect():
            mine = lags[r.source]
            for p, got in ((0.5, r.p50_lag), (0.95, r.p95_lag), (0.99, r.p99_lag)):
                ranks = [i + 1 for i, x in enumerate(mine) if x == got]
                assert ranks and min(abs(i - p * len(mine)) for i in ranks) <= len(mine) / accuracy + 1


def test_lag_percentiles_are_exact(spark, tmp_path):
    """As ``quantile_disc`` has them, and with more revisions of a window than a sketch keeps."""
    n = F.col("id")
    rows = spark.range(25_000).select((F.lit(START) + n * 7_919 % 800_000).alias("knowledge_time"), (F.lit(START) + n * 7_919 % 800_000 - n * n % 700_001).alias("event_time"))
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    ingest.arrival_lag(stream, width="10000 days").writeStream.outputMode("complete").format("memory").queryName("exact_lags").trigger(availableNow=True).start().awaitTermination()
    mine = sorted(i * i % 700_001 for i in range(25_000))
    [got] = spark.table("exact_lags").collect()
    assert (got.p50_lag, got.p95_lag, got.p99_lag) == tuple(mine[-(-p * 25_000 // 100) - 1] for p in (50, 95, 99))


def test_timelines_answer_what_a_scan_answers():
    rng = np.random.default_rng(3)
    for m in (1, 2, 3, 37, 300):
        when, start = rng.integers(0, 60, m), rng.integers(0, 90, m)
        end, low, asked = start + rng.integers(1, 60, m), rng.integers(-5, 60, 400), rng.integers(-5, 150, 400)
        high, v, w = low + rng.integers(0, 40, 400), rng.integers(-9, 9, m), rng.random(m)
        total, most = timelines.answered(when, start, end, [(v, "add"), (w, "maximum")], low, high, asked)
        inside = (when > low[:, None]) & (when <= high[:, None]) & (start <= asked[:, None]) & (asked[:, None] < end)
        assert (total == (inside * v).sum(axis=1)).all() and (most == np.where(inside, w, -np.inf).max(axis=1)).all()


def test_timelines_equal_the_exact_training_set(spark, feed, labels):
    """With chunks of 40 rows and questions dealt to several copies of a group, and a label before all events."""
    odd = spark.createDataFrame([("early", "c-0", 5, 5, 1), ("late", "c-0", START + 200 * DAY, None, 1)], LABELS)
    labels = labels.where("customer_id = 'c-0'").unionByName(odd)
    cut = training.label_cutoffs(labels, START + 40 * DAY)
    events = validity_intervals(feed).where("operation = 'upsert'")
    want = {r.label_id: r for r in training.point_in_time_dataset(labels, feed, DEFS, START + 40 * DAY).collect()}
    got = timelines.timeline_features(cut, events, DEFS, chunk=40, questions=30).collect()
    assert len(got) == len({r.label_id for r in got}) > 20
    told = {r.label_id: r for r in got}
    for label, w in want.items():
        for d in DEFS:
            mine = told[label][d.name] if label in told else None
            assert (d.default if mine is None else mine) == w[d.name]


def test_heavy_customers_make_no_pairs(spark):
    """Thirty thousand labels and as many events of one customer: some 450 million pairs, of which none is made."""
    n = F.col("id")
    t = F.lit(START) + n * 60
    events = spark.range(30_000).select(n.cast("string").alias("event_id"), n.cast("string").alias("revision_id"), F.lit("c").alias("customer_id"), t.alias("event_time"), t.alias("knowledge_time"), F.lit("upsert").alias("operation"), n.alias("amount_cents"), F.lit("succeeded").alias("status"), (n % 100 / 100).alias("merchant_risk"))
    labels = spark.range(30_000).select(n.cast("string").alias("label_id"), F.lit("c").alias("customer_id"), t.alias("label_time"), t.alias("prediction_knowledge_time"), F.lit(1).cast("bigint").alias("value"))
    out = skew.dealt_dataset(labels, events, DEFS, START + 90 * DAY)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "label_parts" not in plan
    got = out.agg(F.sum(DEFS[0].name).alias("n"), F.sum(DEFS[1].name).alias("spent")).first()
    assert got.n == sum(min(i + 1, 1440) for i in range(30_000)) and got.spent == sum(i * (i + 1) // 2 for i in range(30_000))
