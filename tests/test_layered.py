"""Generations in layers: equal to builds, bound to what they rest on, checked along the chain."""

import os

import pytest
from pyspark.sql import functions as F

from tidemark.definitions import payment_features
from tidemark.operators import kept
from tidemark.operators.features import build_generation
from tidemark.plans import pipelines
from tidemark.sources import generations, layered
from tidemark.sources.workload import synthetic_revisions, with_corrections

DEFS = payment_features()
START = 1_700_000_000
CUTOFF = START + 20 * 86_400
FRONTIERS = [CUTOFF, CUTOFF + 50_000, CUTOFF + 400_000]


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def layers(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("layers")
    root, state = str(base / "generations"), str(base / "state")
    revisions = with_corrections(synthetic_revisions(spark, "balanced", 5, 40, 300), 30, later=400_000).persist()
    spine = revisions.select("customer_id").distinct()
    kept.keep_state(revisions, FRONTIERS[0], state)
    pipelines.full_rebuild(revisions, spine, DEFS, CUTOFF, FRONTIERS[0], "g0", root)
    for i, (low, high) in enumerate(zip(FRONTIERS, FRONTIERS[1:], strict=False)):
        delta = revisions.where((F.col("knowledge_time") > low) & (F.col("knowledge_time") <= high))
        for told in ("written", "replayed"):  # a refresh that is run again changes nothing
            assert pipelines.layered_refresh(root, f"g{i}", state, delta, spine, DEFS, CUTOFF, low, high, f"g{i + 1}") == told
    yield root, revisions, spine
    revisions.unpersist()


def test_layers_equal_builds(spark, layers):
    root, revisions, spine = layers
    for i, frontier in enumerate(FRONTIERS):
        built = build_generation(revisions, spine, DEFS, CUTOFF, frontier, f"g{i}")
        assert rows_of(layered.layered_checked(spark, root, f"g{i}").select(*built.columns)) == rows_of(built)
    whole = generations.manifest_of(spark, root, "g0")["row_count"]
    assert generations.manifest_of(spark, root, "g1")["row_count"] < whole  # untouched customers aren't written again


def test_some_buckets_are_read_alone(spark, layers):
    root, _, _ = layers
    some = layered.layered_rows(spark, root, "g2", [3])
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [") >= 5 and "PartitionFilters: []" not in plan
    every = [r for b in (range(8), range(8, 16)) for r in rows_of(layered.layered_rows(spark, root, "g2", b))]
    assert sorted(every, key=str) == rows_of(layered.layered_rows(spark, root, "g2"))


def test_chains_become_one_table(spark, layers):
    root, _, _ = layers
    assert layered.flattened(spark, root, "g0", "flat") is None
    assert layered.flattened(spark, root, "g2", "flat", share=1e9) is None
    assert layered.flattened(spark, root, "g2", "flat", share=0.0) == "written"
    assert rows_of(generations.read_checked(spark, root, "flat")) == rows_of(layered.layered_rows(spark, root, "g2"))
    assert len(layered.chain(spark, root, "flat")) == 1


def test_customers_whose_rows_went(spark, tmp_path):
    """A touched customer without rows has none; a customer that is new has its own; an empty layer hides nothing."""
    root = str(tmp_path)
    table = lambda *keys: spark.createDataFrame([(k, v, "x") for k, v in keys], "customer_id string, v int, generation_id string")
    generations.write_once(table(("a", 1), ("b", 2), ("c", 3)), root, "t0")
    touched = spark.createDataFrame([("a",), ("b",), ("d",), ("d",)], "customer_id string")
    layered.write_layer(table(("b", 7), ("d", 9)), root, "t1", "t0", {"generation_id": "t1"}, touched)
    assert rows_of(layered.layered_checked(spark, root, "t1")) == [("b", 7, "t1"), ("c", 3, "t1"), ("d", 9, "t1")]
    layered.write_layer(table(("a", 1)).limit(0), root, "t2", "t1", {"generation_id": "t2"})
    assert [r.v for r in layered.layered_checked(spark, root, "t2").orderBy("customer_id").collect()] == [7, 3, 9]
    with pytest.raises(ValueError, match="columns"):
        layered.write_layer(table(("a", 1)).drop("v"), root, "t3", "t2", {})
    with pytest.raises(ValueError, match="no columns"):
        layered.write_layer(table(("a", 1)), root, "t3", "t2", {"w": 1})
    with pytest.raises(generations.Damaged, match="no manifest"):
        layered.write_layer(table(("a", 1)), root, "t3", "t9", {})


def test_damage_below_a_layer_is_found(spark, tmp_path):
    root = str(tmp_path)
    table = lambda *keys: spark.createDataFrame(list(keys), "customer_id string, v int")
    generations.write_once(table(("a", 1), ("b", 2), ("c", 3)), root, "t0")
    layered.write_layer(table(("b", 7)), root, "t1", "t0", {})
    assert layered.damaged_layers(spark, root, "t1") == []
    bucket = table(("c", 3)).select(F.pmod(F.xxhash64("customer_id"), F.lit(generations.BUCKETS))).first()[0]
    table(("c", 4)).coalesce(1).write.mode("overwrite").parquet(os.path.join(root, "t0", "rows", f"_bucket={bucket}"))
    assert layered.damaged_layers(spark, root, "t1") == [("t0", bucket)]
    with pytest.raises(generations.Damaged, match=f"t0 bucket {bucket}"):
        layered.layered_checked(spark, root, "t1")
    other = generations.manifest_of(spark, root, "t0") | {"row_count": 4}
    spark.createDataFrame([other]).coalesce(1).write.mode("overwrite").parquet(os.path.join(root, "t0", "manifest"))
    with pytest.raises(generations.Damaged, match="made from"):
        layered.chain(spark, root, "t1")
    with pytest.raises(ValueError, match="knowledge_cutoff"):
        pipelines.layered_refresh(root, "t1", root, spark.createDataFrame([], "customer_id string"), table(("a", 1)), DEFS, CUTOFF, 1, 2, "t2")
