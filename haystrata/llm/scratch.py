"""Written intermediate tables in the folder that every executor shares.

A written table cuts lineage (a lost executor re-reads files instead of recomputing the
query) and gives the optimiser a true size, so a join is broadcast only if that size is
under ``spark.sql.autoBroadcastJoinThreshold``. Shuffle files of a write go when it is done,
a table goes when ``free`` says that nothing reads it any more, the rest at exit.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: dict[str, SparkSession] = {}
_tables: dict[str, str] = {}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``. A folder of this machine serves only where all of Spark runs on it."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = os.path.join(tempfile.gettempdir(), "haystrata-scratch")
    return at.rstrip("/")


def materialise(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and return a reader of it."""
    spark = df.sparkSession
    path = folder(spark, name)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._haystrata_path = path
    return out


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted at exit."""
    path = f"{shared_dir(spark)}/haystrata/{name}-{uuid.uuid4().hex}"
    _written[path] = spark
    return path


def bucketed(df: DataFrame, name: str, column: str, buckets: int) -> DataFrame:
    """Write ``df`` as a table bucketed by ``column`` in the shared folder: tables of equal buckets join by it without a shuffle."""
    spark = df.sparkSession
    path = folder(spark, name)
    table = f"haystrata_{path.rsplit('-', 1)[1]}"
    df.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(buckets, column).sortBy(column).saveAsTable(table)
    out = spark.table(table)
    out._haystrata_path, _tables[path] = path, table
    return out


def _delete(path: str) -> None:
    spark = _written.pop(path)
    if path in _tables:
        spark.sql(f"DROP TABLE IF EXISTS {_tables.pop(path)}")
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def free(*tables: DataFrame) -> None:
    """Delete tables of ``materialise`` that no later step and no returned frame reads."""
    for table in tables:
        if table._haystrata_path in _written:
            _delete(table._haystrata_path)


def clean() -> None:
    """Delete what this process has written; runs at exit."""
    for path in list(_written):
        try:
            _delete(path)
        except Exception:  # the JVM is already gone
            return


atexit.register(clean)
