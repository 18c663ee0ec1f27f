"""The folder that the driver and all executors see, and tables that live there as long as the application."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; where it is unset, a local one, on a local master only."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + os.path.join(tempfile.gettempdir(), "copse-tables")
    return root.rstrip("/")


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def temporary(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is there when the application ends is deleted."""
    path = f"{shared_root(spark)}/{spark.sparkContext.applicationId}-{name}-{uuid.uuid4().hex}"
    fs, p = _path(spark, path)
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: lineage ends there, and a lost executor costs nothing."""
    path = temporary(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(table: DataFrame, name: str, *keys: Column) -> DataFrame:
    """table with its rows' places, from 1, in the order of keys.

    The table is sorted by ranges and stored; a row's place is its place in its part and the rows of the parts before.
    No task sees more than its part, and only one number a part is added up and broadcast.
    """
    at, part, n, before = (f"_{name}_{x}" for x in ("at", "part", "n", "before"))
    placed = stored(table.orderBy(*keys).withColumn(at, F.monotonically_increasing_id()), "numbered")
    in_part, which = F.col(at).bitwiseAND(F.lit((1 << 33) - 1)), F.shiftright(F.col(at), 33)
    sizes = placed.groupBy(which.alias(part)).agg(F.count("*").alias(n))
    earlier = F.sum(n).over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select(part, F.coalesce(earlier, F.lit(0)).alias(before))
    return placed.join(F.broadcast(offsets), which == F.col(part)).withColumn(name, in_part + F.col(before) + 1).drop(at, part, before)


def state(spark: SparkSession, path: str) -> tuple:
    """Names, sizes and times of what lies in a folder."""
    fs, p = _path(spark, path)
    return tuple(sorted((s.getPath().getName(), fs.getContentSummary(s.getPath()).getLength(), s.getModificationTime()) for s in fs.listStatus(p)))
