"""The folder that the driver and all executors share, for what outlives a job."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path below ``spark.checkpoint.dir``. A local session without one gets a new one."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="spark-tidemark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return f"{path.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: made once, read by every later step."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _at(spark: SparkSession, path: str) -> tuple:
    """The store that holds a path, and the path, as Hadoop knows them."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), where


def exists(spark: SparkSession, path: str) -> bool:
    store, where = _at(spark, path)
    return store.exists(where)


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if there is no folder."""
    store, where = _at(spark, path)
    return sorted(s.getPath().getName() for s in store.listStatus(where)) if store.exists(where) else []


def size_of(spark: SparkSession, path: str) -> int:
    """Bytes below a path."""
    store, where = _at(spark, path)
    return store.getContentSummary(where).getLength()


def remove(spark: SparkSession, path: str) -> None:
    """Remove a file or folder that nothing still to run reads, if it is there."""
    store, where = _at(spark, path)
    store.delete(where, True)


def mark(spark: SparkSession, path: str) -> None:
    """An empty file, as a sign that what lies beside it is complete."""
    store, where = _at(spark, path)
    store.create(where, True).close()
