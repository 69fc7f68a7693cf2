"""What the operators of this subpackage share: word splitting, shared-folder tables, checked broadcasts."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows and bytes up to which a derived table may be broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32 << 20

#: The word pattern of the corpus operators: runs of anything but ASCII white space.
SPACES = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share: ``spark.checkpoint.dir``. A local session without one gets a new one."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="spark-tidemark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage is cut and any executor can read it again."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def removed(df: DataFrame) -> None:
    """Remove a table that ``written`` made and nothing that is still to run reads."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
    path = jvm.org.apache.hadoop.fs.Path(df.written_path)
    path.getFileSystem(conf).delete(path, True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows of at most ``size`` bytes, else as it is: Spark then shuffles, and splits skewed keys."""
    told = F.octet_length(F.to_json(F.struct(*[F.base64(c) if t == "binary" else F.col(c) for c, t in df.dtypes])))
    n, held = df.limit(rows + 1).select(told.alias("n")).agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    return F.broadcast(df) if n <= rows and held <= size else df


def crc_mod(column: str, n: int) -> Column:
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased; words are the runs without ASCII white space."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


class Memo(dict):
    """A bounded memory of a function's values, in two generations of ``most``: what isn't used while one fills is let go."""

    def __init__(self, make, most: int = 200_000):
        super().__init__()
        self.make, self.most, self.older = make, most, {}

    def __missing__(self, key):
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        value = self[key] = self.older[key] if key in self.older else self.make(key)
        return value


class Recent:
    """A memory of two generations for keys that are looked up in bulk."""

    def __init__(self, most: int):
        self.most, self.now, self.older = most, {}, {}

    def turn(self) -> None:
        if len(self.now) > self.most:
            self.older, self.now = self.now, {}

    def missing(self, keys: set) -> set:
        """Those of the keys that have no value; values of the older generation are carried over."""
        keys = keys - self.now.keys()
        kept = keys & self.older.keys()
        self.now.update((k, self.older[k]) for k in kept)
        return keys - kept


#: Kept between the tasks of one Python worker.
_word_hash = Memo(xxhash.xxh3_64_intdigest, 50_000)

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(words: list[bytes], size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``size``-word shingles; a shorter text is one shingle, no words give none."""
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_word_hash.__getitem__, words), np.uint64, n)
    size, total = min(size, n), np.uint64(size)
    out = np.zeros(n - size + 1, np.uint64)
    for i in range(size):
        out = mix(out * _ODD[i % 5] + h[i : n - size + 1 + i] + total)
    return np.unique(out)


@contextmanager
def without_gc() -> Iterator[None]:
    """No cyclic garbage collection meanwhile: walking large memories that hold no cycles takes long."""
    gc.disable()
    try:
        yield
    finally:
        gc.enable()
        gc.collect()
        pa.default_memory_pool().release_unused()


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Arrow batches in parts, so that a worker holds few texts as Python objects at once."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def ngram_buckets(data: np.ndarray, n: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hash buckets of the byte ``n``-grams of one text that hold white space at their ends only.

    ``data``: the text's UTF-8 bytes with white space turned into single spaces.
    """
    size = len(data) - n + 1
    if size <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint32)
    h = np.full(size, n, np.uint32)
    for i in range(n):
        h *= np.uint32(0x01000193)
        h ^= data[i : i + size]
    h *= np.uint32(0x9E3779B1)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA77)
    h >>= np.uint32(32 - bits)
    inner = np.zeros(size, bool)
    space = data == 32
    for i in range(1, n - 1):
        inner |= space[i : i + size]
    at = np.flatnonzero(~inner)
    return at, h[at]


def smallest_hashes(ids: DataFrame, group: str, counts: DataFrame, rows: int) -> DataFrame:
    """Distinct ``doc_id, group``: in each group the ``rows`` ids with the smallest hashes, a sample that doesn't depend on partitioning.

    ``counts``: ``group, n``, about how many ids each group has. Hashes are uniform, so those under twice the share
    that is wanted hold the sample: only they, each once, are sorted, and no group's ids meet in one task.
    """
    h = F.xxhash64("doc_id", F.lit(73))
    low = ids.select("doc_id", group).join(counts, group).where(h / 2.0**64 + 0.5 <= (2 * rows + 100) / F.col("n")).select("doc_id", group).distinct()
    rank = F.row_number().over(Window.partitionBy(group).orderBy(h, "doc_id"))
    return low.withColumn("_r", rank).where(F.col("_r") <= rows).select("doc_id", group)


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted batches with ``_range``, the partition's number, and ``_at``, a row's number from 0 among its key's in the partition."""
    part, last, held = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        if not (n := batch.num_rows):
            continue
        key = batch.column("_key")
        changed = np.ones(n, bool)
        changed[1:] = pc.not_equal(key.slice(1), key.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        changed[0] = key[0].as_py() != last
        first = np.maximum.accumulate(np.where(changed, np.arange(n), -1))
        at = np.arange(n) - first
        at[first < 0] += held - 1  # those continue the key of the batch before
        last, held = key[n - 1].as_py(), int(at[-1]) + 1
        columns = [*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(at)]
        yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "_range", "_at"])


def ranked(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df``, stored, with ``rank`` (from 0) of each row among those of its ``_key`` (a string, never null) by ``order``.

    Rows are dealt by ranges of key, order and row, so a key with most rows spreads over many tasks, rows that repeat
    too. A table of the ranges' last keys, a row for each partition, then shifts the numbers of keys that began before.
    """
    by = ["_key", *order, "_row"]
    dealt = df.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by).drop("_row")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema)
    placed = written(dealt.mapInArrow(_placed, f"{fields}, _range int, _at bigint"), name)
    ends = placed.groupBy("_range").agg(F.min("_key").alias("_first"), F.max(F.struct("_key", "_at")).alias("_end"))
    held = F.sum(F.col("_end._at") + 1).over(Window.partitionBy("_end._key").orderBy("_range"))
    order_of = Window.orderBy("_range")  # a row for each partition
    begun = F.when(F.lag("_end._key").over(order_of) == F.col("_first"), F.lag("_held").over(order_of)).otherwise(0)
    shift = ends.withColumn("_held", held).select("_range", "_first", begun.alias("_begun"))
    rank = F.col("_at") + F.when(F.col("_key") == F.col("_first"), F.col("_begun")).otherwise(0)
    return placed.join(F.broadcast(shift), "_range").withColumn("rank", rank).drop("_range", "_at", "_first", "_begun")
