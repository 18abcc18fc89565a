"""Intermediate tables in the folder that the driver and every executor share, and checked broadcasts."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Folders of local sessions that name none, by application.
_LOCAL: dict[str, str] = {}

#: Most bytes that a broadcast table may hold; beyond it the join shuffles.
BROADCAST_BYTES = 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and every executor can reach.

    It is the cluster's ``spark.checkpoint.dir``; only a local session without one (tests) gets a
    temporary folder. A cluster without one is an error: its executors could not read such a folder.
    """
    base, own = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.applicationId
    if base or own in _LOCAL:
        return base or _LOCAL[own]
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _LOCAL.setdefault(own, tempfile.mkdtemp(prefix="zscape-"))


def _hadoop(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there goes when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    at, fs = _hadoop(spark, path)
    fs.mkdirs(at)  # only what exists can be marked
    fs.deleteOnExit(at)
    return path


def ensured(spark: SparkSession, path: str) -> str:
    """``path``, made if it isn't there, as a URI that other readers than Spark's understand too."""
    at, fs = _hadoop(spark, path)
    fs.mkdirs(at)
    return re.sub("^file:/+", "file:///", fs.makeQualified(at).toString())


def discard(spark: SparkSession, path: str) -> None:
    """Deletes what ``scratch`` named, once no plan reads it any more."""
    at, fs = _hadoop(spark, path)
    fs.delete(at, True)


def stored(df: DataFrame, path: str) -> DataFrame:
    """``df`` written as Parquet at ``path`` and read again (columns stay prunable)."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` stored in the shared folder: later plans start there, so a lost executor costs a stage."""
    return stored(df, scratch(df.sparkSession, name))


def broadcast_if_small(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """``df`` with a broadcast hint if ``rows`` (counted before) fit; else Spark shuffles both sides."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def checked(df: DataFrame, row_bytes: int = 64) -> DataFrame:
    """``df`` with a broadcast hint if it is small; it is counted no further than the limit."""
    most = BROADCAST_BYTES // row_bytes
    return broadcast_if_small(df, df.limit(most + 1).count(), row_bytes)


def placed(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``rows`` sorted by ``order`` over range partitions and written: ``pid``, and the place ``pos`` within it."""
    at = F.monotonically_increasing_id()
    out = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", at), name)
    return out.withColumns({"pid": F.shiftright("_at", 33), "pos": F.col("_at").bitwiseAND((1 << 33) - 1)}).drop("_at")


def numbered(rows: DataFrame, order: list[Column], column: str = "rank", kind: str = "int") -> DataFrame:
    """``rows`` with their place from 1 in ``order``, which no task sees whole: only counts meet, one a partition."""
    parts = placed(rows, order, column)
    before = parts.groupBy("pid").agg(F.count("*").alias("n"))
    before = before.select(F.col("pid").alias("_pid"), (F.sum("n").over(Window.orderBy("pid")) - F.col("n")).alias("_before"))
    return parts.join(F.broadcast(before), F.col("pid") == F.col("_pid")).withColumn(column, (F.col("_before") + F.col("pos") + 1).cast(kind)).drop("pid", "_pid", "_before", "pos")
