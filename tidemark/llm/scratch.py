"""Intermediate tables in the folder that the cluster shares (spark.checkpoint.dir).

A written table cuts lineage and survives lost executors: its files are in shared storage, so a
retried task reads them again instead of recomputing its parents. Results are lazy, so tables stay until
release() is told that nothing reads them; the file system deletes the rest when the driver ends.
"""

from __future__ import annotations

import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

_own = threading.local()


def _written() -> list[str]:
    """Tables of this thread: two pipelines in one driver know nothing of each other's."""
    if not hasattr(_own, "tables"):
        _own.tables = []
    return _own.tables


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; a temporary one is set only in local mode, where the session names none."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df once as Parquet in the shared folder and return a DataFrame over those files."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at, files = _path(spark, path)
    files.deleteOnExit(at)
    _written().append(path)
    return spark.read.schema(df.schema).parquet(path)


def mark() -> int:
    """How many tables of materialise() this thread has."""
    return len(_written())


def release(spark: SparkSession, since: int = 0, until: int | None = None) -> None:
    """Delete the tables written between two marks; call it when no pending result reads them."""
    for name in _written()[since:until]:
        at, files = _path(spark, name)
        files.delete(at, True)
        files.cancelDeleteOnExit(at)
        _written().remove(name)


def input_bytes(df: DataFrame, spark: SparkSession) -> int:
    """Size of the files a plain table scan reads; 0 where the plan does not tell."""
    try:
        return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().toString())
    except Exception:  # noqa: BLE001 - statistics are advisory only
        return 0


def parts_for(spark: SparkSession, nbytes: int, target: int = 32 << 20) -> int:
    """Number of partitions that keeps each near `target` bytes, never under the session's own count."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-nbytes // target))
