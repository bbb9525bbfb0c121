"""Sinks (SNK1-SNK5): Spark's commit protocol replaces temporary files and renames."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster shares (spark.checkpoint.dir); local mode may do without one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/tidemark-{name}-{uuid.uuid4().hex}"


def holds_table(spark: SparkSession, path: str) -> bool:
    """Whether a path exists and holds a file or a partition."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(hadoop) and any(x.getPath().getName().startswith("part-") or x.isDirectory() for x in fs.listStatus(hadoop))


def table_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    """The Parquet table at a path; None while the path does not exist or holds no file."""
    return spark.read.option("mergeSchema", True).parquet(path) if holds_table(spark, path) else None


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), sort_by: Sequence[str] = ()) -> None:
    """Overwrite as Parquet, sorted inside files so that time filters skip row groups (SNK1, SNK5)."""
    if sort_by:
        df = df.sortWithinPartitions(*partition_by, *sort_by)
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    """Join condition under which NULL keys are equal."""
    on = F.lit(True)
    for k in keys:
        on = on & left[k].eqNullSafe(right[k])
    return on


def append_rows(df: DataFrame, path: str, keys: Sequence[str], time: str, order: Sequence[str] = ()) -> int:
    """Append the rows that are newer than all before them, per key; returns how many were refused (SNK3).

    Rows come in the given order (by time where none is given, then by their other columns). A row is refused
    if its time is NULL or not after every earlier row of its key, in the table or in this batch. A NULL key is
    a key like any other. New columns are allowed: readers merge schemas.
    """
    old = table_or_none(df.sparkSession, path)
    by = Window.partitionBy(*keys).orderBy(*(order or [time]), F.xxhash64(*df.columns)).rowsBetween(Window.unboundedPreceding, -1)
    marked = df.withColumn("_before", F.max(time).over(by))
    if old is not None:
        last = old.groupBy(*keys).agg(F.max(time).alias("_last"))
        marked = marked.join(last, same_keys(marked, last, keys), "left").select(marked["*"], "_last")
        marked = marked.withColumn("_before", F.greatest("_before", "_last")).drop("_last")
    marked = marked.withColumn("_new", F.col(time).isNotNull() & F.coalesce(F.col(time) > F.col("_before"), F.lit(True)))
    late = marked.filter(~F.col("_new")).count()
    marked.filter("_new").select(*df.columns).write.mode("append").parquet(path)
    return late


def append_checked(df: DataFrame, path: str) -> None:
    """Append only if columns and types agree with the table (SNK4)."""
    old = df.sparkSession.read.parquet(path).schema
    have, want = {f.name: f.dataType for f in df.schema}, {f.name: f.dataType for f in old}
    if have != want:
        raise ValueError(f"schema differs: {sorted(set(have.items()) ^ set(want.items()), key=str)}")
    df.select(*old.names).write.mode("append").parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    """A small report as one JSON lines file (SNK2)."""
    df.coalesce(1).write.mode("overwrite").json(path)


def contract_hash(df: DataFrame, order: Sequence[str]) -> str:
    """sha256 over the rows' JSON in order-free form: the sum of row hashes, then hashed."""
    row = F.xxhash64(F.to_json(F.struct(*sorted(df.columns))))
    n, s, x = df.agg(F.count("*"), F.sum(row.cast("decimal(38,0)")), F.bit_xor(row)).first()
    return df.sparkSession.range(1).select(F.sha2(F.lit(f"{sorted(df.dtypes)}|{n}|{s}|{x}"), 256)).first()[0]
