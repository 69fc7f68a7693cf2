"""Immutable tables of rows with manifests: written once, replayed or refused, checked when read.

Rows are written first and the manifest last, so a manifest marks a complete table. All paths go through Spark's
writers and readers and so work on any store Spark can reach.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tidemark.functions.values import digest_of, digest_of_sums, lanes_of, row_digest, rows_digest
from tidemark.sources.shared import exists, listed


class Conflict(RuntimeError):
    """An existing table has other contents under the same id."""


class Damaged(RuntimeError):
    """A table's rows don't agree with its manifest."""


def _manifest(spark: SparkSession, root: str, table_id: str) -> dict | None:
    path = f"{root}/{table_id}/manifest"
    return spark.read.parquet(path).first().asDict() if exists(spark, f"{path}/_SUCCESS") else None


#: Buckets of a table's digest tree.
BUCKETS = 16


def _bucketed(rows: DataFrame, columns: list[str], cluster_by: str | None) -> DataFrame:
    """``rows`` with ``_hash`` and ``_bucket``: by the clustering column where there is one, else by the row itself."""
    hashed = rows.withColumn("_hash", row_digest(rows, columns))
    key = F.col(cluster_by).cast("string") if cluster_by in rows.columns else F.col("_hash")
    return hashed.withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int"))


def _observed(rows: DataFrame) -> tuple[Observation, DataFrame]:
    """``rows`` that tell count and lane sums of every bucket as they are written."""
    seen, lanes = Observation(), [f"_lane{i}" for i in range(4)]
    told = rows.withColumns(dict(zip(lanes, lanes_of("_hash"), strict=True)))
    sums = []
    for b in range(BUCKETS):
        mine = F.col("_bucket") == b
        sums += [F.count_if(mine).alias(f"n{b}"), *[F.sum(F.when(mine, F.col(x))).alias(f"s{b}_{i}") for i, x in enumerate(lanes)]]
    return seen, told.observe(seen, *sums).drop(*lanes, "_hash")


def write_once(rows: DataFrame, root: str, table_id: str, kind: str = "generation", cluster_by: str | None = "customer_id", **bound: str) -> str:
    """``written`` or ``replayed``; raises ``Conflict`` if the id holds other rows. ``bound``: digests to bind.

    Rows are laid out by ``_bucket``, and count and digest of each bucket are observed while they are written, above the
    last shuffle, so that no second scan is made and no task that is run again counts twice. The buckets' digests are a
    table of their own, whose digest the manifest binds: ``damaged_buckets`` says which of them differs.
    """
    spark = rows.sparkSession
    if not table_id or "/" in table_id or table_id.startswith("."):
        raise ValueError(f"{table_id!r} can't name a table")
    old = _manifest(spark, root, table_id)
    columns = sorted(rows.columns)
    if old is not None:
        new = rows_digest(rows, columns).first()
        same = (old["row_count"], old["rows_digest"], old["columns"]) == (new.row_count, new.rows_digest, ",".join(columns))
        if same and all(old.get(k) == v for k, v in bound.items()):
            return "replayed"
        raise Conflict(f"{kind} {table_id} exists with other contents")
    out = _bucketed(rows, columns, cluster_by).hint("rebalance", F.col("_bucket"))
    seen, out = _observed(out.sortWithinPartitions("_bucket", cluster_by) if cluster_by in rows.columns else out)
    out.write.mode("overwrite").partitionBy("_bucket").parquet(f"{root}/{table_id}/rows")  # rows without a manifest are an interrupted write
    told = seen.get
    sums = [[int(told[f"s{b}_{i}"] or 0) for i in range(4)] for b in range(BUCKETS)]
    leaves = [(b, told[f"n{b}"], digest_of_sums(told[f"n{b}"], sums[b])) for b in range(BUCKETS)]
    count, whole = sum(n for _, n, _ in leaves), [sum(x) for x in zip(*sums, strict=True)]
    spark.createDataFrame(leaves, _LEAVES).coalesce(1).write.mode("overwrite").parquet(f"{root}/{table_id}/digests")
    manifest = {"row_count": count, "rows_digest": digest_of_sums(count, whole), "tree_digest": _tree(leaves), "cluster_by": cluster_by if cluster_by in rows.columns else "", "kind": kind, "table_id": table_id, "columns": ",".join(columns), "schema": rows.schema.json()} | bound
    spark.range(1).select(*[F.lit(v).alias(k) for k, v in manifest.items()]).withColumn("row_count", F.lit(count).cast("bigint")).coalesce(1).write.mode("errorifexists").parquet(f"{root}/{table_id}/manifest")
    return "written"


_LEAVES = "bucket int, row_count bigint, rows_digest string"


def _tree(leaves: Sequence[tuple[int, int, str]]) -> str:
    return hashlib.sha256("\n".join(f"{b}:{n}:{d}" for b, n, d in sorted(leaves)).encode()).hexdigest()


def _rows(spark: SparkSession, root: str, table_id: str) -> DataFrame:
    """A complete table's rows with ``_bucket``, in the types of its manifest."""
    fields = StructType.fromJson(json.loads(manifest_of(spark, root, table_id)["schema"])).fields
    return spark.read.schema(StructType([*fields, StructField("_bucket", IntegerType())])).parquet(f"{root}/{table_id}/rows")


def stored_rows(spark: SparkSession, root: str, table_id: str, buckets: Sequence[int] | None = None) -> DataFrame:
    """A stored table's rows, unchecked; of some buckets only those are read."""
    rows = _rows(spark, root, table_id)
    return (rows if buckets is None else rows.where(F.col("_bucket").isin(list(buckets)))).drop("_bucket")


def damaged_buckets(spark: SparkSession, root: str, table_id: str, buckets: Sequence[int] | None = None) -> list[int]:
    """Those of the buckets (of all, if none are named) whose rows aren't the ones that were written; others aren't read.

    Rows that stand in another bucket than their own damage both; -1 stands for files that lie in no bucket. The digests
    themselves must be those of the manifest.
    """
    manifest = manifest_of(spark, root, table_id)
    leaves = {r.bucket: (r.row_count, r.rows_digest) for r in spark.read.schema(_LEAVES).parquet(f"{root}/{table_id}/digests").collect()}  # BUCKETS rows
    if _tree([(b, *x) for b, x in leaves.items()]) != manifest["tree_digest"]:
        raise Damaged(f"the digests of {table_id} aren't those of its manifest")
    wanted = sorted(leaves) if buckets is None else sorted(buckets)
    rows = _rows(spark, root, table_id).where(F.col("_bucket").isin(wanted))
    own = _bucketed(rows.withColumnRenamed("_bucket", "_stored"), manifest["columns"].split(","), manifest["cluster_by"] or None)
    count, digest = digest_of("_hash")
    told = own.groupBy("_stored").agg(count, digest, F.count_if(F.col("_stored") != F.col("_bucket")).alias("strange")).collect()
    found = {r._stored: (r.row_count, r.rows_digest) for r in told if not r.strange}
    empty = (0, digest_of_sums(0, [0] * 4))
    strange = {r._stored for r in told if r.strange}
    stray = [n for n in listed(spark, f"{root}/{table_id}/rows") if not n.startswith(("_bucket=", "_SUCCESS", "."))]
    return [-1] * bool(stray) + [b for b in wanted if b in strange or found.get(b, empty) != leaves[b]]


def manifest_of(spark: SparkSession, root: str, table_id: str) -> dict:
    """The manifest of a complete table; raises where there is none."""
    manifest = _manifest(spark, root, table_id)
    if manifest is None:
        raise Damaged(f"{table_id} has no manifest")
    return manifest


def read_checked(spark: SparkSession, root: str, table_id: str) -> DataFrame:
    """The rows of a complete table whose count and digest are those of its manifest."""
    if wrong := damaged_buckets(spark, root, table_id):
        raise Damaged(f"{table_id} doesn't agree with its manifest in buckets {', '.join(map(str, wrong))}")
    return stored_rows(spark, root, table_id)


def read_generation(spark: SparkSession, values: str, generation_id: str) -> DataFrame:
    """One generation of a table partitioned by ``generation_id``: other partitions aren't read."""
    return spark.read.parquet(values).where(F.col("generation_id") == generation_id)


def source_snapshot(revisions: DataFrame) -> DataFrame:
    """One row: counts, both clocks' ranges, and the digest of a revision table."""
    stats = revisions.agg(
        F.count("*").alias("revisions"), F.count_distinct("event_id").alias("events"), F.min("event_time").alias("minimum_event_time"), F.max("event_time").alias("maximum_event_time"),
        F.min("knowledge_time").alias("minimum_knowledge_time"), F.max("knowledge_time").alias("maximum_knowledge_time"),
    )
    return stats.join(F.broadcast(rows_digest(revisions).select("rows_digest")))


def label_snapshot(labels: DataFrame) -> DataFrame:
    """One row: counts, the ranges of label times and cutoffs, and the digest of a label table."""
    stats = labels.agg(
        F.count("*").alias("labels"), F.min("label_time").alias("minimum_label_time"), F.max("label_time").alias("maximum_label_time"),
        F.min("prediction_knowledge_time").alias("minimum_cutoff"), F.max("prediction_knowledge_time").alias("maximum_cutoff"),
    )
    return stats.join(F.broadcast(rows_digest(labels).select("rows_digest")))


def missing_links(manifests: DataFrame, artifacts: DataFrame, link: str) -> DataFrame:
    """Manifests whose digest in column ``link`` names no artifact (``rows_digest``)."""
    return manifests.join(artifacts.select(F.col("rows_digest").alias(link)), link, "left_anti")


def candidate_receipt(manifests: DataFrame, candidate: DataFrame, expected: DataFrame, artifacts: DataFrame, links: dict[str, str]) -> DataFrame:
    """One row for each manifest (``generation_id, candidate_count, candidate_digest`` and digest columns): a receipt.

    ``candidate`` and ``expected`` rows carry ``generation_id``. ``links``: column of a manifest to the kind of artifact
    (``kind, rows_digest``) that it must name. A candidate matches if its rows are the expected ones and those its
    manifest counted, and all links hold; it is then READY, else FAILED.
    """

    def told(rows: DataFrame, name: str) -> DataFrame:
        columns = [c for c in rows.columns if c != "generation_id"]
        count, whole = digest_of("_hash")
        return rows.select("generation_id", row_digest(rows, columns).alias("_hash")).groupBy("generation_id").agg(count.alias(f"{name}_count"), whole.alias(f"{name}_digest"))

    out = manifests.join(told(candidate, "actual"), "generation_id", "left").join(told(expected, "expected"), "generation_id", "left")
    valid = F.lit(True)
    for i, (column, kind) in enumerate(links.items()):
        held = artifacts.where(F.col("kind") == kind).select(F.col("rows_digest").alias(column), F.lit(True).alias(f"_held{i}")).distinct()
        out = out.join(held, column, "left")
        valid = valid & F.coalesce(f"_held{i}", F.lit(False))
    zero = lambda c: F.coalesce(c, F.lit(0))
    counted = (zero("actual_count") == F.col("candidate_count")) & F.col("actual_digest").eqNullSafe(F.col("candidate_digest"))
    same = (zero("actual_count") == zero("expected_count")) & F.col("actual_digest").eqNullSafe(F.col("expected_digest"))
    out = out.select("generation_id", zero("actual_count").alias("actual_count"), zero("expected_count").alias("expected_count"), "actual_digest", "expected_digest", valid.alias("artifact_links_valid"), counted.alias("candidate_matches_manifest"), (valid & counted & same).alias("matched"))
    out = out.withColumn("next_status", F.when(F.col("matched"), "READY").otherwise("FAILED"))
    return out.withColumn("receipt_digest", row_digest(out))
