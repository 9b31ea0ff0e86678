"""Intermediate tables in the folder that driver and executors share.

Lineage is cut by writing Parquet under ``spark.checkpoint.dir``, or under the folder given
to ``SparkContext.setCheckpointDir``. Where neither is set a temporary folder stands in if
the master is local (tests, one machine); on a cluster that is an error, as executors would
write to disks of their own. Tables go with clear(), or when the driver's JVM ends.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[str] = []
_own: str | None = None


def folder(spark: SparkSession) -> str:
    global _own
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared
    context = spark.sparkContext._jsc.sc()
    if context.getCheckpointDir().isDefined():
        return context.getCheckpointDir().get()
    if not context.isLocal():
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _own is None:
        _own = "file://" + tempfile.mkdtemp(prefix="riskloom-")
    return _own


def _store(spark: SparkSession, name: str):
    """The path as the JVM's, and the file system it is on."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def keep(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """As save, but clear() leaves the table until forget_later() names its path."""
    spark = df.sparkSession
    name = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(name)
    path, store = _store(spark, name)
    store.deleteOnExit(path)
    return spark.read.schema(schema).parquet(name), name


def forget_later(*paths: str) -> None:
    _made.extend(paths)


def save(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back."""
    df, path = keep(df, name)
    _made.append(path)
    return df


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of queries that have ended; it does so when the driver's garbage goes."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def clear(spark: SparkSession) -> None:
    """Delete the tables saved so far; only once every result built on them is written."""
    while _made:
        path, store = _store(spark, _made.pop())
        store.delete(path, True)
