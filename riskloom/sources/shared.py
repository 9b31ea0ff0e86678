"""Files on the store that Spark's writers use: a folder that driver and executors share, and single files by path or URI."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

from ..errors import ConfigurationError

_own: str | None = None


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir; only a local master may go without that setting."""
    global _own
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext._jsc.sc().isLocal():
            raise ConfigurationError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        _own = _own or "file://" + tempfile.mkdtemp(prefix="riskloom-")
        folder = _own
    path = f"{folder}/{uuid.uuid4().hex}-{name}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


@contextmanager
def shuffles_given_back(spark: SparkSession) -> Iterator[None]:
    """Within, the shuffle files of a query go as it ends, not with the driver's garbage; no table may be evaluated twice."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _store(path: str):
    """The path as the JVM's, and the file system it is on; a path without scheme is on Spark's default one."""
    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(str(path))
    store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return at, store.getRawFileSystem() if store.getUri().getScheme() == "file" else store  # no checksum files beside plain ones


def put_file(local: str, path: str) -> str:
    """Moves a file of the driver's disk to a path on the store."""
    at, store = _store(path)
    here = SparkSession.getActiveSession().sparkContext._jvm.org.apache.hadoop.fs.Path(f"file://{local}")
    store.copyFromLocalFile(True, True, here, at)
    return path


def put_bytes(data: bytes, path: str) -> str:
    with tempfile.NamedTemporaryFile(delete=False) as f:
        f.write(data)
    return put_file(f.name, path)


def get_bytes(path: str) -> bytes | None:
    """A file's content; None where there is none."""
    at, store = _store(path)
    if not store.exists(at):
        return None
    with tempfile.TemporaryDirectory() as folder:
        here = SparkSession.getActiveSession().sparkContext._jvm.org.apache.hadoop.fs.Path(f"file://{folder}/it")
        store.copyToLocalFile(False, at, here, True)
        with open(f"{folder}/it", "rb") as f:
            return f.read()


def names_in(folder: str) -> list[str]:
    at, store = _store(folder)
    return sorted(s.getPath().getName() for s in store.listStatus(at)) if store.exists(at) else []
