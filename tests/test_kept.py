"""Kept state, bucketed indexes: refreshes and streams that read what changed only."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.definitions import payment_features
from tidemark.operators import kept
from tidemark.operators.features import build_generation
from tidemark.operators.temporal import latest_known
from tidemark.schemas import REVISIONS
from tidemark.sources.shared import listed
from tidemark.sources.workload import synthetic_revisions, with_corrections
from tidemark.streaming import ingest
from tidemark.streaming.keyed import KeyIndex

DEFS = payment_features()
START = 1_700_000_000
CUTOFF = START + 20 * 86_400


@pytest.fixture(scope="module")
def history(spark):
    rows = with_corrections(synthetic_revisions(spark, "balanced", 3, 60, 1500), 30, later=400_000)
    late = rows.where("event_id like '%7' and revision_id like '%-r1'").withColumns({"revision_id": F.concat("revision_id", F.lit("-x")), "knowledge_time": F.col("knowledge_time") + 900_000, "operation": F.lit("retract"), "amount_cents": F.lit(None).cast("bigint"), "status": F.lit(None).cast("string"), "merchant_risk": F.lit(None).cast("double")})
    moved = rows.where("event_id like '%3' and revision_id like '%-r1'").withColumns({"revision_id": F.concat("revision_id", F.lit("-m")), "knowledge_time": F.col("knowledge_time") + 700_000, "event_time": F.col("event_time") - 500_000})
    out = rows.unionByName(late).unionByName(moved).persist()
    yield out, out.select("customer_id").distinct()
    out.unpersist()


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_refreshes_from_kept_state_equal_builds(spark, history, tmp_path):
    revisions, spine = history
    root, frontiers = str(tmp_path / "state"), [CUTOFF, CUTOFF + 50_000, CUTOFF + 60_000, CUTOFF + 900_000]
    kept.keep_state(revisions, frontiers[0], root)
    last = build_generation(revisions, spine, DEFS, CUTOFF, frontiers[0], "g0")
    for i, (base, target) in enumerate(zip(frontiers, frontiers[1:], strict=False)):
        delta = revisions.where((F.col("knowledge_time") > base) & (F.col("knowledge_time") <= target))
        last = kept.refreshed_from_state(last, root, delta, spine, DEFS, CUTOFF, target, f"g{i + 1}")
        assert rows_of(last) == rows_of(build_generation(revisions, spine, DEFS, CUTOFF, target, f"g{i + 1}"))
        assert rows_of(kept.kept_state(spark, root, target)) == rows_of(latest_known(revisions, target).select(*kept.REVISION_FIELDS))
    assert kept.merge_layers(spark, root, share=0.0) and len(kept.layers(spark, root)) == 1
    kept.forget(spark, root)
    assert listed(spark, root) == [f"whole={frontiers[-1]}"]
    assert rows_of(kept.kept_state(spark, root)) == rows_of(latest_known(revisions, frontiers[-1]).select(*kept.REVISION_FIELDS))


def test_late_knowledge_and_repeated_advances(spark, history, tmp_path):
    """Revisions that arrive behind the frontier count if they are the latest of their event; a delta taken twice changes nothing."""
    revisions, spine = history
    root = str(tmp_path / "state")
    known = revisions.where(F.col("knowledge_time") <= CUTOFF)
    late = known.where("pmod(xxhash64(revision_id), 5) = 0")
    kept.keep_state(known.join(late, "revision_id", "left_anti"), CUTOFF, root)
    for _ in range(2):
        changed = kept.advance(spark, root, late, CUTOFF + 1)
        assert changed.count() == changed.select("event_id").distinct().count()
        assert rows_of(kept.kept_state(spark, root)) == rows_of(latest_known(known, CUTOFF).select(*kept.REVISION_FIELDS))
    nothing = kept.advance(spark, root, late.limit(0), CUTOFF + 2)
    assert nothing.count() == 0 and rows_of(kept.kept_state(spark, root)) == rows_of(latest_known(known, CUTOFF).select(*kept.REVISION_FIELDS))
    empty = str(tmp_path / "empty")
    kept.keep_state(late.limit(0), CUTOFF, empty)
    assert kept.kept_state(spark, empty).count() == 0 and kept.advance(spark, empty, late, CUTOFF + 1).count() > 0
    with pytest.raises(ValueError, match="no state"):
        kept.advance(spark, str(tmp_path / "none"), late, 5)


def test_a_refresh_reads_the_buckets_of_touched_customers(spark, history, tmp_path):
    revisions, _ = history
    root = str(tmp_path / "state")
    kept.keep_state(revisions, CUTOFF, root)
    delta = revisions.where(F.col("knowledge_time") > CUTOFF).limit(2)
    buckets = {r[0] for r in delta.select(kept.bucket_of()).collect()}
    files = kept.kept_state(spark, root, CUTOFF, sorted(buckets)).inputFiles()
    whole = kept.kept_state(spark, root, CUTOFF)
    assert len(buckets) <= 2 and len(whole.inputFiles()) > len(buckets)
    plan = kept.kept_state(spark, root, CUTOFF, sorted(buckets))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [_bucket" in plan and files


def test_a_batch_reads_at_most_its_keys_buckets(spark, tmp_path):
    index = KeyIndex(str(tmp_path / "index"), "digest string")
    told = lambda keys: spark.createDataFrame([(str(k), f"d{k}") for k in keys], "_key string, digest string")
    for batch in range(2):
        rows = told(range(batch * 500, batch * 500 + 500))
        index.add(rows, batch, index.numbers(rows))
    few = told([3, 700, 99_999])
    numbers = index.numbers(few)
    paths = index.paths(spark, numbers)
    assert len(paths) <= 3
    read = index._read(spark, paths, 9)
    assert {f.split("_bucket=")[1].split("/")[0] for f in read.inputFiles()} <= {str(n) for n in numbers}
    assert rows_of(index.met(few, 9, numbers)) == [("3", "d3"), ("700", "d700")]
    assert rows_of(index.met(few, 1, numbers)) == [("3", "d3")]  # what later batches stored isn't there for an earlier one


def test_indexes_merge_and_widen(spark, tmp_path):
    rng = random.Random(1)
    for name, options in (("merged", {"batches": 2}), ("dealt", {"bucket_bytes": 1})):
        index = KeyIndex(str(tmp_path / name), "digest string", width=2, **options)
        seen = set()
        for batch in range(4):
            keys = [str(rng.randrange(40)) for _ in range(12)]
            rows = spark.createDataFrame([(k, k) for k in keys], "_key string, digest string")
            numbers = index.numbers(rows)
            assert {r[0] for r in index.met(rows, batch, numbers).collect()} == seen & set(keys)
            for _ in range(2):  # a batch that is run again
                index.add(rows, batch, index.numbers(rows))
            seen |= set(keys)
        whole = spark.createDataFrame([(str(k),) for k in range(40)], "_key string")
        assert {r[0] for r in index.met(whole, 9, index.numbers(whole)).collect()} == seen
        assert index.current(spark) == 2 if "batches" in options else index.current(spark) > 2


def test_an_unreadable_target_is_an_error(spark, tmp_path):
    (tmp_path / "accepted" / "batch=0").mkdir(parents=True)
    (tmp_path / "accepted" / "batch=0" / "part-0.parquet").write_bytes(b"no parquet")
    schema = spark.createDataFrame([], REVISIONS).schema
    with pytest.raises(Exception, match="(?i)parquet|footer|read"):
        ingest.read_before(spark, str(tmp_path / "accepted"), schema, 5).count()
    assert ingest.read_before(spark, str(tmp_path / "none"), schema, 5).count() == 0


def test_parts_are_streamed_in_turn(spark, tmp_path):
    """A part is one batch, though several tasks write it, and none of a later one's rows is in it."""
    parts, seen = [spark.range(i * 100, i * 100 + 100, numPartitions=4) for i in range(3)], []
    keep = lambda batch, number: seen.append((number, sorted(r.id for r in batch.collect())))
    start = lambda stream: stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
    ingest.in_turn(parts, f"{tmp_path}/in", start)
    assert seen == [(i, list(range(i * 100, i * 100 + 100))) for i in range(3)]
    assert all(len(list((tmp_path / "in" / f"part={i}").glob("*.parquet"))) == 4 for i in range(3))


def test_the_first_batch_decides_the_width(spark, tmp_path):
    index = KeyIndex(str(tmp_path / "index"), "digest string", width=2, bucket_entries=10)
    rows = spark.range(300).selectExpr("cast(id as string) as _key", "'d' as digest")
    for _ in range(2):  # again, as after a failure
        index.add(rows, 0, index.numbers(rows))
        assert index.current(spark) == 32
    assert index.met(rows, 0, index.numbers(rows)).count() == 0 and index.met(rows, 1, index.numbers(rows)).count() == 300
