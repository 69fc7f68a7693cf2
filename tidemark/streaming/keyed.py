"""An index of stored keys in hash buckets, so that a batch finds what it meets without a scan of the history.

Entries lie below ``root/width=W/_bucket=B/_batch=N``. A batch reads the buckets that its keys fall into, whatever else is
stored, and adds entries under its own number, so a batch that is run again replaces its own. The first batch decides how
many buckets there are, so that no task writes more than some of them whatever its size. A bucket of many batches
is merged, and when buckets grow beyond a size all entries are dealt to four times as many: so a bucket's size, and with
it the time of a batch, doesn't grow with the history.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.shared import exists, listed, mark, remove, size_of

_COLUMNS = "_key string, {}, _bucket int, _batch bigint"


@dataclass(frozen=True)
class KeyIndex:
    """``payload``: the columns that an entry has besides its key, as DDL."""

    root: str
    payload: str
    width: int = 16  # buckets at first
    bucket_bytes: int = 64 << 20
    bucket_entries: int = 400_000  # of the first batch
    batches: int = 16  # of a bucket before it is merged

    def current(self, spark: SparkSession) -> int:
        """The number of buckets: the largest whose table is complete."""
        widths = [int(n.removeprefix("width=")) for n in listed(spark, self.root) if n.startswith("width=")]
        return max([w for w in widths if exists(spark, f"{self.root}/width={w}/_complete")], default=self.width)

    def bucket(self, width: int) -> Column:
        return F.pmod(F.xxhash64("_key"), F.lit(width)).cast("int")

    def numbers(self, keys: DataFrame) -> list[int]:
        """The buckets that ``_key``s fall into: no more than there are keys, or buckets."""
        return [r[0] for r in keys.select(self.bucket(self.current(keys.sparkSession)).alias("b")).distinct().collect()]

    def paths(self, spark: SparkSession, numbers: list[int]) -> list[str]:
        """Those of the buckets that hold entries."""
        whole = f"{self.root}/width={self.current(spark)}"
        there = set(listed(spark, whole))
        return [f"{whole}/_bucket={b}" for b in sorted(numbers) if f"_bucket={b}" in there]

    def _read(self, spark: SparkSession, paths: list[str], before: int) -> DataFrame:
        schema = _COLUMNS.format(self.payload)
        if not paths:
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).option("basePath", paths[0].rpartition("/")[0]).parquet(*paths).where(F.col("_batch") < before)

    def met(self, keys: DataFrame, batch_id: int, numbers: list[int]) -> DataFrame:
        """Entries of earlier batches that have one of the ``_key``s, which fall into the buckets ``numbers``."""
        found = self._read(keys.sparkSession, self.paths(keys.sparkSession, numbers), batch_id)
        return found.join(keys.select("_key").distinct(), "_key", "left_semi").drop("_bucket", "_batch").distinct()

    def _write(self, entries: DataFrame, width: int, batch_id: int) -> None:
        names = [f.split()[0] for f in self.payload.split(", ")]
        rows = entries.select("_key", *names, self.bucket(width).alias("_bucket"), F.lit(batch_id).cast("bigint").alias("_batch"))
        rows.repartition("_bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket", "_batch").parquet(f"{self.root}/width={width}")

    def add(self, entries: DataFrame, batch_id: int, numbers: list[int]) -> None:
        """Store a batch's entries (``_key`` and the payload) in buckets ``numbers``; then merge or deal anew what has grown."""
        spark, width = entries.sparkSession, self.current(entries.sparkSession)
        if not listed(spark, f"{self.root}/width={width}"):  # the first batch says how many buckets there are
            n = entries.count()
            while n > width * self.bucket_entries:
                width *= 4
            self._write(entries, width, batch_id)
            mark(spark, f"{self.root}/width={width}/_complete")
            return
        self._write(entries, width, batch_id)
        touched = self.paths(spark, numbers)
        if any(size_of(spark, p) > self.bucket_bytes for p in touched):
            self._deal(spark, width, batch_id)
        elif crowded := [p for p in touched if len(listed(spark, p)) > self.batches]:
            self._merge(spark, width, crowded, batch_id)

    def _merge(self, spark: SparkSession, width: int, paths: list[str], batch_id: int) -> None:
        """Each bucket's older entries under one negative number. Entries that stand twice meanwhile count once."""
        old = {p: [n for n in listed(spark, p) if n.startswith("_batch=") and int(n.removeprefix("_batch=")) < batch_id] for p in paths}
        self._write(self._read(spark, paths, batch_id).distinct(), width, -batch_id)
        for p, names in old.items():
            for n in names:
                if n != f"_batch={-batch_id}":
                    remove(spark, f"{p}/{n}")

    def _deal(self, spark: SparkSession, width: int, batch_id: int) -> None:
        """All entries in four times as many buckets. What is older is merged, the last batch keeps its number."""
        whole = f"{self.root}/width={width}"
        paths = [f"{whole}/{n}" for n in listed(spark, whole) if n.startswith("_bucket=")]
        rows = self._read(spark, paths, batch_id + 1)
        wider, last = 4 * width, F.col("_batch") == batch_id
        remove(spark, f"{self.root}/width={wider}")
        self._write(rows.where(~last).distinct(), wider, -batch_id)
        self._write(rows.where(last).distinct(), wider, batch_id)
        mark(spark, f"{self.root}/width={wider}/_complete")
        remove(spark, whole)
