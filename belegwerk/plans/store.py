"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MARKED: set[str] = set()
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_SCRATCH = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """The folder of this application below spark.checkpoint.dir. Where that is unset, a local
    session takes a folder under /tmp and a cluster one under its warehouse."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known and spark.sparkContext.master.startswith("local"):
        known = os.path.join(tempfile.gettempdir(), "belegwerk-shared")
    base = (known or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")
    return f"{base}/belegwerk/{spark.sparkContext.applicationId}"


def _folder(spark: SparkSession):
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path in the application's folder, which goes when the driver ends."""
    folder = shared_dir(spark)
    if folder not in _MARKED:
        _MARKED.add(folder)
        fs, path = _folder(spark)
        fs.mkdirs(path)
        fs.deleteOnExit(path)
    inside = getattr(_SCRATCH, "folders", [])
    return f"{inside[-1] if inside else folder}/{label}-{uuid.uuid4().hex}"


def _save(df: DataFrame, path: str) -> None:
    """Write ``df``. The shuffle files of the execution go with its end, since what is read from then
    on is the table; else they stay until the driver happens to collect its garbage."""
    spark = df.sparkSession
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, lost executors
    cost nothing, and the reader knows the size."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    _save(df, path)
    return spark.read.schema(df.schema).parquet(path)


def spread(rows: DataFrame) -> DataFrame:
    """A table's rows in parts for all cores: a table of few files would else be few tasks."""
    least = 2 * rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= least else rows.repartition(least)


def least_hashed(rows: DataFrame, n: int, tie: str) -> DataFrame:
    """The ``n`` rows of least ``h``, a 64-bit hash. Rows beyond a bound that half as many again lie
    below by chance leave first, so that no task gets ``n`` rows of every other."""
    total = rows.count()
    share = 1.5 * (n + 100) / max(total, 1)
    near = rows.where(F.col("h") < F.lit(int(-(2**63) + share * 2**64))) if share < 1 else rows
    if share < 1 and near.count() < min(n, total):  # far too many ties of one hash
        near = rows
    return near.orderBy("h", tie).limit(n)


def kept_alone(spark: SparkSession, make: Callable[[], DataFrame], label: str) -> DataFrame:
    """As ``written``, of what ``make`` returns; the intermediate tables that it wrote on the way are
    deleted once the result is saved."""
    path, scratch = fresh_path(spark, label), fresh_path(spark, "scratch")
    folders = _SCRATCH.__dict__.setdefault("folders", [])
    folders.append(scratch)
    try:
        df = make()
        _save(df, path)
    finally:
        folders.pop()
        where = spark._jvm.org.apache.hadoop.fs.Path(scratch)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession) -> None:
    """Delete all intermediate tables of the application, once the results that read them are
    saved. What is not discarded goes with the driver."""
    fs, path = _folder(spark)
    fs.delete(path, True)
    _MARKED.discard(shared_dir(spark))
