"""Layouts for lookups: files of key ranges with their bounds, and tables bucketed by their keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def write_clustered(rows: DataFrame, path: str, keys: Sequence[str], files: int) -> None:
    """Rows in ``files`` files of successive key ranges, sorted, and a table of each file's bounds and count."""
    rows.repartitionByRange(files, *keys).sortWithinPartitions(*keys).write.mode("overwrite").parquet(f"{path}/rows")
    placed = rows.sparkSession.read.schema(rows.schema).parquet(f"{path}/rows").select(F.struct(*keys).alias("_k"), F.col("_metadata.file_path").alias("file"))
    placed.groupBy("file").agg(F.min("_k").alias("low"), F.max("_k").alias("high"), F.count("*").alias("n")).coalesce(1).write.mode("overwrite").parquet(f"{path}/bounds")


def _after(keys: Sequence[str], cursor: Sequence) -> Column:
    """Whether a key stands after the cursor, as comparisons that reach the files' statistics."""
    out, same = F.lit(False), F.lit(True)
    for k, v in zip(keys, cursor, strict=True):
        out, same = out | (same & (F.col(k) > F.lit(v))), same & (F.col(k) == F.lit(v))
    return (F.col(keys[0]) >= F.lit(cursor[0])) & out


def page_files(spark: SparkSession, path: str, keys: Sequence[str], size: int, cursor: Sequence | None = None) -> list[str]:
    """The files that hold the page after a cursor: the first that reaches beyond it, and as many more as the page needs."""
    bounds = spark.read.parquet(f"{path}/bounds")
    if cursor is not None:
        bounds = bounds.select("low", "file", "n", F.struct(*[F.col(f"high.{k}").alias(k) for k in keys]).alias("high")).select("*", "high.*").where(_after(keys, cursor))
    order = Window.orderBy("low").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    # the first file may hold next to nothing of the page, so it isn't counted on
    held = bounds.withColumn("_before", F.coalesce(F.sum("n").over(order), F.lit(0)) - F.coalesce(F.first("n").over(order), F.lit(0)))
    return [r.file for r in held.where(F.col("_before") < size + 1).orderBy("low").select("file").limit(size + 3).collect()]


def clustered_page(spark: SparkSession, path: str, keys: Sequence[str], size: int, cursor: Sequence | None = None) -> DataFrame:
    """``size`` rows after a cursor, and one more if there is a next page, from the files that hold them."""
    files = page_files(spark, path, keys, size, cursor)
    rows = spark.read.parquet(*files) if files else spark.read.parquet(f"{path}/rows").limit(0)
    return (rows if cursor is None else rows.where(_after(keys, cursor))).orderBy(*keys).limit(size + 1)


def write_bucketed(rows: DataFrame, table: str, path: str, keys: Sequence[str], buckets: int) -> DataFrame:
    """Rows as a table of the session's catalog, bucketed and sorted by ``keys``: joins and groupings by them don't shuffle it."""
    rows.write.mode("overwrite").format("parquet").bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(table)
    return rows.sparkSession.table(table)


def open_bucketed(spark: SparkSession, table: str, path: str, schema: str, keys: Sequence[str], buckets: int) -> DataFrame:
    """The table of ``write_bucketed`` in another session: its files as they lie."""
    by = ", ".join(keys)
    spark.sql(f"create table if not exists {table} ({schema}) using parquet clustered by ({by}) sorted by ({by}) into {buckets} buckets location '{path}'")
    return spark.table(table)
