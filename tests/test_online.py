"""Records, reconciliation, serving, parity, generations, assurance and streams."""

import dataclasses
import json
import math
import random
import struct
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidemark.definitions import definition_set, definition_set_digest, definitions_frame, payment_features
from tidemark.functions.values import canonical_decimal, rows_digest
from tidemark.operators import assurance, features, incremental, online, parity, quality
from tidemark.plans import pipelines
from tidemark.schemas import REVISIONS
from tidemark.sources import generations
from tidemark.streaming import ingest
from tests.test_temporal import LIFE

DEFS = payment_features()


@pytest.fixture(scope="module")
def values(spark):
    revisions, spine = spark.createDataFrame(LIFE, REVISIONS), spark.createDataFrame([("c-1",), ("c-2",), ("c-empty",)], "customer_id string")
    return features.build_generation(revisions, spine, DEFS, 200000, 200005, "g1"), revisions, spine


@pytest.fixture(scope="module")
def records(spark, values):
    return online.online_records(values[0], definitions_frame(spark, DEFS), "payments", "op", "s", 200100).cache()


def test_canonical_decimals(spark):
    rng = random.Random(3)
    xs = [0.0, -0.0, 1.0, 0.1, 1 / 3600, 1e-5, 100.0, -2.5, 1e8, 2.5e9, 1e15, 1e22, 1.5e300, -1e-31, 5e-324, 12345678901234567.0, -2.331857357446618e17]
    xs += [x for x in (struct.unpack("d", rng.randbytes(8))[0] for _ in range(3000)) if math.isfinite(x)] + [rng.random() * 10 ** rng.randrange(-6, 18) for _ in range(3000)]
    got = [r.d for r in spark.createDataFrame([(x,) for x in [*xs, float("nan"), float("inf"), None]], "x double").select(canonical_decimal(F.col("x")).alias("d")).collect()]

    def plain(x):
        text = format(Decimal(repr(x)), "f")
        return "0" if x == 0 else text.rstrip("0").rstrip(".") if "." in text else text

    assert got == [*map(plain, xs), None, None, None]


def test_digests_of_large_and_tiny_numbers_differ(spark):
    digests = [rows_digest(spark.createDataFrame([(x,)], "x double")).first().rows_digest for x in (1e8, 2.5e9, 1e-31, 1e-32, 0.0)]
    assert len(set(digests)) == 5


def test_digest_needs_no_order_but_sees_repeats(spark):
    rows = spark.range(100).select("id", (F.col("id") / 7).alias("x"))
    one = rows_digest(rows).first()
    assert one == rows_digest(rows.repartition(9).orderBy(F.desc("id"))).first()
    assert one.rows_digest != rows_digest(rows.union(rows.limit(1))).first().rows_digest


def test_one_wrong_value_is_one_semantic_mismatch(spark, values, records):
    changed = values[0].withColumn("value_long", F.when((F.col("customer_id") == "c-1") & (F.col("feature_name") == DEFS[0].name), 99).otherwise(F.col("value_long")))
    other = online.online_records(changed, definitions_frame(spark, DEFS), "payments", "op", "s", 200100)
    out = parity.parity_summary(records, other).first()
    assert (out.semantic_mismatch_count, out.envelope_mismatch_count, out.passed) == (1, 15, False)
    assert parity.parity_summary(records, records).first().passed
    gone = parity.parity_summary(records, records.where("customer_id <> 'c-2'")).first()
    assert gone.missing_count == 5 and gone.reasons == ["MISSING_RECORD", "AGGREGATE_MISMATCH"]


def test_reconciliation_and_resume(spark, records, tmp_path):
    half = records.where("customer_id = 'c-1'")
    out = online.reconciliation(records, half).first()
    assert (out.missing, out.extra, out.passed) == (10, 0, False)
    forged = half.withColumn("expires_at", F.col("expires_at") + 1).unionByName(records.where("customer_id <> 'c-1'"))
    assert online.reconciliation(records, forged).first().corrupt == 5
    half.write.parquet(f"{tmp_path}/stored/batch=0")
    ingest.resume(records, str(tmp_path), 1)
    stored = spark.read.parquet(f"{tmp_path}/stored").drop("batch")
    assert stored.count() == 15 and online.reconciliation(records, stored).first().passed


def test_reconciliation_counts_repeated_rows_once(spark, records):
    out = online.reconciliation(records, records.unionByName(records.where("customer_id = 'c-1'"))).first()
    assert (out.planned_count, out.stored_count, out.missing, out.extra, out.differing, out.corrupt, out.passed) == (15, 20, 0, 5, 0, 0, False)


def test_pinning_follows_a_long_history(spark):
    moves = [("a", i + 1, f"g{i}", 10 * i) for i in range(200)] + [("b", 1, "h", 500), ("b", 2, "i", 500)]
    history = spark.createDataFrame(moves, "feature_set string, pointer_version bigint, to_generation string, activated_at bigint")
    asked = spark.createDataFrame([(i, "a", 7 * i) for i in range(300)] + [(900, "b", 499), (901, "b", 500), (902, "b", 9000), (903, "c", 5)], "request_id int, feature_set string, request_time bigint")
    got = {r.request_id: r.generation_id for r in online.pinned_at(asked, history, width=64).collect()}
    assert got == {i: f"g{min(199, 7 * i // 10)}" for i in range(300)} | {900: None, 901: "i", 902: "i", 903: None}


def test_serving_precedence(spark, records):
    d = DEFS[0]
    base = ("payments", "g1", "c-1", d.name, d.digest)
    asked = [
        (1, *base, 200005, 100, "FOUND", 4.0), (2, "payments", "g0", *base[2:], 200005, 100, "GENERATION_UNAVAILABLE", None), (3, "payments", "g1", "nobody", d.name, d.digest, 200005, 100, "ABSENT", None),
        (4, *base[:4], "other", 200005, 100, "DEFINITION_MISMATCH", None), (5, *base, 200000 + d.ttl_seconds, None, "EXPIRED", None), (6, *base, 200000 + d.ttl_seconds - 1, None, "FOUND", 4.0),
        (7, *base, 200105, 100, "FOUND", 4.0), (8, *base, 200106, 100, "STALE", None), (9, "payments", "g1", "c-2", d.name, d.digest, 200005, 100, "CORRUPT_RECORD", None), (10, "payments", "g1", "c-1", DEFS[3].name, DEFS[3].digest, 200005, None, "FOUND", 0.0),
    ]
    requests = spark.createDataFrame([a[:8] for a in asked], "request_id int, feature_set string, generation_id string, customer_id string, feature_name string, definition_digest string, request_time bigint, maximum_freshness_age bigint")
    stored = records.withColumn("record_digest", F.when(F.col("customer_id") == "c-2", "forged").otherwise(F.col("record_digest")))
    states = spark.createDataFrame([("payments", "g1", "ACTIVE"), ("payments", "g0", "WRITING")], "feature_set string, generation_id string, state string")
    got = {r.request_id: (r.status, r.value) for r in online.serving_outcomes(requests, states, stored).collect()}
    assert got == {a[0]: a[8:] for a in asked}


def test_values_that_cannot_be_records(spark, values):
    frame = definitions_frame(spark, DEFS)
    for bad in (values[0].union(values[0]), values[0].limit(0), values[0].withColumn("definition_digest", F.lit("x")), values[0].withColumn("generation_id", F.col("customer_id"))):
        with pytest.raises(ValueError, match="online records"):
            online.online_records(bad, frame, "p", "o", "s", 1)


def test_generations_are_written_once(spark, values, tmp_path):
    root = str(tmp_path)
    assert pipelines.full_rebuild(values[1], values[2], DEFS, 200000, 200005, "g1", root) == "written"
    assert pipelines.full_rebuild(values[1], values[2], DEFS, 200000, 200005, "g1", root) == "replayed"
    with pytest.raises(generations.Conflict):
        pipelines.full_rebuild(values[1], values[2], DEFS, 200000, 200020, "g1", root)
    assert generations.read_checked(spark, root, "g1").count() == 15
    values[0].limit(1).write.mode("append").parquet(f"{root}/g1/rows")
    with pytest.raises(generations.Damaged):
        generations.read_checked(spark, root, "g1")
    with pytest.raises(generations.Damaged):
        generations.read_checked(spark, root, "g2")


def test_builds_refuse_unsound_envelopes(spark, values, tmp_path):
    for spine, match in (([("c-1",), ("c-1",)], "1 repeated"), ([("",)], "1 empty"), ([(None,)], "1 empty")):
        with pytest.raises(ValueError, match=match):
            pipelines.full_rebuild(values[1], spark.createDataFrame(spine, "customer_id string"), DEFS, 200000, 200005, "g1", str(tmp_path))
    with pytest.raises(ValueError, match="negative"):
        pipelines.full_rebuild(values[1], values[2], DEFS, -1, 200005, "g1", str(tmp_path))
    with pytest.raises(ValueError, match="unknown computation"):
        pipelines.full_rebuild(values[1], values[2], [dataclasses.replace(DEFS[0], computation="no")], 200000, 200005, "g1", str(tmp_path))
    with pytest.raises(ValueError, match="gives integer"):
        pipelines.full_rebuild(values[1], values[2], [dataclasses.replace(DEFS[0], value_type="float")], 200000, 200005, "g1", str(tmp_path))


def test_refresh_of_a_stored_generation(spark, values, tmp_path):
    root = str(tmp_path)
    pipelines.full_rebuild(values[1], values[2], DEFS, 200000, 180000, "g0", root)
    # the threshold is out of the way, as most pairs change
    assert pipelines.stored_refresh(root, "g0", values[1], values[2], DEFS, 200000, 180000, 200005, "g1", 1.0) == "written"
    assert parity.value_parity(values[0], generations.read_checked(spark, root, "g1")).count() == 0
    with pytest.raises(ValueError, match="knowledge_cutoff"):
        pipelines.stored_refresh(root, "g0", values[1], values[2], DEFS, 200000, 179999, 200005, "g2")
    values[0].limit(1).write.mode("append").parquet(f"{root}/g0/rows")
    with pytest.raises(ValueError, match="manifest: row_count, rows_digest"):
        pipelines.stored_refresh(root, "g0", values[1], values[2], DEFS, 200000, 180000, 200005, "g3")


def test_scope_reasons(spark, values):
    pairs = incremental.affected_pairs(values[1], DEFS, 200000, 180000, 200020)
    reasons = lambda fraction: sorted(r.reason for r in incremental.scope_reasons(values[1], incremental.scope_summary(values[1], pairs, DEFS, 200020, fraction), 180000, 200020).collect())
    changed = ["revision-change:p-1", "revision-change:p-3", "revision-change:upper"]
    assert reasons(0.75) == changed and reasons(0.1) == ["affected-scope-threshold", *changed]


def test_definition_sets(spark, tmp_path):
    assert definition_set_digest(DEFS) == definition_set_digest(DEFS[::-1]) != definition_set_digest(DEFS[1:])
    with pytest.raises(ValueError, match="repeat"):
        definition_set_digest([DEFS[0], DEFS[0]])
    rows = definition_set(spark, DEFS)
    assert [r.identity for r in rows.orderBy("place").collect()] == sorted(d.identity for d in DEFS)
    assert [generations.write_once(rows, str(tmp_path), "set", kind="definition-set") for _ in range(2)] == ["written", "replayed"]


def test_build_as_a_job(spark, values, tmp_path):
    from tidemark.plans import job

    values[1].write.json(f"{tmp_path}/revisions")
    values[2].write.parquet(f"{tmp_path}/spine")
    arguments = ["--revisions", f"{tmp_path}/revisions", "--spine", f"{tmp_path}/spine", "--root", f"{tmp_path}/root", "--generation", "g1", "--event-cutoff", "200000", "--knowledge-cutoff", "200005", "--format", "json"]
    assert [job.main(arguments) for _ in range(2)] == ["written", "replayed"]
    assert parity.value_parity(values[0], generations.read_checked(spark, f"{tmp_path}/root", "g1")).count() == 0


def test_publish_check_and_gates(spark, values):
    facts = {name: True for name, _ in assurance.GATES}
    rows = [("payments", "g1", "op", *facts.values())] + [("payments", f"x-{n}", "op", *({**facts, n: False}).values()) for n in facts]
    gates = spark.createDataFrame(rows, "feature_set string, generation_id string, operation_id string, " + ", ".join(f"{n} boolean" for n in facts))
    got = {r.generation_id: (r.status, r.reasons) for r in assurance.gate_decisions(gates).collect()}
    assert got["g1"] == ("ELIGIBLE", []) and all(got[f"x-{n}"] == ("REJECTED", [code]) for n, code in assurance.GATES)
    found, decided = pipelines.publish_check(values[0], values[1], values[2], DEFS, 200000, 200005, "payments", gates.where("generation_id = 'g1'"), 200100)
    assert found.first().passed and decided.first().verdict == "ELIGIBLE"


def test_trials(spark):
    rows = [("c", "op", i, i > 0, ns, "i", "o", True) for i, ns in enumerate([900, 10, 30, 20, 50, 40])] + [("d", "op", 1, True, 5, "i", "o", True)]
    out = {r.case_id: r for r in assurance.trial_summary(spark.createDataFrame(rows, "case_id string, operation string, trial int, warm boolean, duration_ns bigint, input_digest string, output_digest string, correctness_passed boolean")).collect()}
    assert (out["c"].median_ns, out["c"].warm_interquartile_range_ns, out["c"].valid) == (30, 30, True) and not out["d"].valid


def test_pages_and_samples(spark, values):
    ids = values[0].withColumn("customer_id", F.when(F.col("customer_id") == "c-1", 1).when(F.col("customer_id") == "c-2", 2).otherwise(30).cast("bigint"))
    pages = online.page_numbers(ids, 4).orderBy("customer_id", "feature_name").collect()
    assert [r.page for r in pages] == [i // 4 for i in range(15)]
    # string keys, most of them equal
    hot = spark.range(3000).select(F.when(F.col("id") % 10 > 0, "hot").otherwise(F.col("id").cast("string")).alias("customer_id"), F.col("id").cast("string").alias("feature_name"))
    numbered = online.page_numbers(hot.repartition(7), 100).orderBy("customer_id", "feature_name").collect()
    assert [r.page for r in numbered] == [i // 100 for i in range(3000)]
    first = online.keyset_page(ids, 4).collect()
    after = online.keyset_page(ids, 4, (first[3].customer_id, first[3].feature_name)).collect()
    assert len(first) == 5 and after[0] == first[4]
    strata = spark.createDataFrame([(1, "a")], "customer_id bigint, stratum string")
    sample = parity.stratified_sample(ids, strata, 7, 3)
    assert sample.groupBy("stratum").count().collect() and sample.count() == 6 and sample.exceptAll(parity.stratified_sample(ids.repartition(5), strata, 7, 3)).count() == 0


def test_ingestion_is_replay_safe(spark, tmp_path):
    good = [r for r in LIFE if r[3] < 150000]
    batches = [good, [*good[:2], ("p-2", "p-2-r9", "c-1", 140000, 140005, "upsert", 1, "failed", 0.1), ("new", "new-r1", "c-9", 5, 1, "upsert", 1, "failed", 0.1)], [r for r in LIFE if r[3] >= 150000]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, REVISIONS).coalesce(1).write.parquet(f"{tmp_path}/in/b={i}")
    stream = spark.readStream.schema(REVISIONS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    ingest.ingest(stream, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    kept = spark.read.parquet(f"{tmp_path}/out/accepted").drop("batch")
    assert sorted(r.revision_id for r in kept.collect()) == sorted(r[1] for r in LIFE)
    refused = {r.revision_id: r.outcome for r in spark.read.parquet(f"{tmp_path}/out/quarantine").collect()}
    assert refused == {"p-2-r9": "conflict", "new-r1": "invalid"}
    again = ingest.classified(spark.createDataFrame(batches[0], REVISIONS), kept)
    assert {r.outcome for r in again.collect()} == {"replayed"}


def test_streamed_upserts(spark, tmp_path):
    rows = [(1, "a"), (2, "b")], [(1, "a"), (2, "c"), (3, "d"), (4, "e"), (4, "f")]
    for i, part in enumerate(rows):
        spark.createDataFrame(part, "k bigint, digest string").coalesce(1).write.parquet(f"{tmp_path}/in/b={i}")
    stream = spark.readStream.schema("k bigint, digest string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    ingest.upsert(stream, ["k"], "digest", f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    read = lambda n: sorted((r.k, r.digest) for r in spark.read.parquet(f"{tmp_path}/out/{n}").collect())
    assert read("stored") == [(1, "a"), (2, "b"), (3, "d")] and read("conflicts") == [(2, "c"), (4, "e"), (4, "f")]


def test_strict_labels(spark):
    good = {"label_id": "a", "customer_id": "c", "label_time": 5, "prediction_knowledge_time": None, "value": 1}
    texts = {
        "{}": "MISSING_FIELD", "x": "MALFORMED", "[1]": "MALFORMED", json.dumps(good | {"label_id": "b", "more": 1}): "UNKNOWN_FIELD", json.dumps(good | {"label_id": 5}): "WRONG_TYPE", json.dumps(good | {"label_id": "d", "value": "1"}): "WRONG_TYPE",
        json.dumps(good | {"label_id": "e", "label_time": 5.5}): "WRONG_TYPE", json.dumps(good)[:-1] + ', "value": 2}': "MALFORMED", json.dumps(good): "", json.dumps(good | {"label_id": ""}): "EMPTY_LABEL_ID", json.dumps(good | {"label_id": "f", "prediction_knowledge_time": 6}): "CUTOFF_AFTER_LABEL",
    }
    raw = spark.createDataFrame([(t,) for t in [*texts, json.dumps(good | {"label_id": "g"}), json.dumps(good | {"label_id": "g", "value": 0})]], "raw string")
    got = {r.raw: ",".join(r.violations) for r in quality.decoded_labels(raw).collect()}
    assert {t: got[t] for t in texts} == texts
    assert [v for t, v in got.items() if '"g"' in t] == ["DUPLICATE_LABEL"] * 2
    assert quality.decoded_labels(raw.where(F.col("raw") == json.dumps(good))).first().prediction_knowledge_time == 5


def test_continuous_refresh_keeps_what_it_refuses(spark, tmp_path):
    spine = spark.createDataFrame([("c-1",), ("c-2",)], "customer_id string")
    batches = [[r for r in LIFE if r[4] <= 180000], [*[r for r in LIFE if r[4] > 180000], ("p-2", "p-2-r9", "c-1", 140000, 140005, "upsert", 1, "failed", 0.1), ("new", "new-r1", "c-9", 5, 1, "upsert", 1, "failed", 0.1)]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, REVISIONS).coalesce(1).write.parquet(f"{tmp_path}/in/b={i}")
    stream = spark.readStream.schema(REVISIONS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    ingest.continuous_generation(stream, spine, DEFS, 200000, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    assert {r.revision_id: r.outcome for r in spark.read.parquet(f"{tmp_path}/out/quarantine").collect()} == {"p-2-r9": "conflict", "new-r1": "invalid"}
    last = spark.read.parquet(f"{tmp_path}/out/values").where("batch = 1").drop("batch", "generation_id")
    want = features.build_generation(spark.createDataFrame(LIFE, REVISIONS), spine, DEFS, 200000, 200010, "x").drop("generation_id")
    assert parity.value_parity(want, last).count() == 0


def test_numbers_are_written_by_many_tasks(spark):
    """A file of one split is dealt out before the work on its rows."""
    from tidemark.plans.queries import QUERIES

    assert QUERIES["canonical_numbers"](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism
