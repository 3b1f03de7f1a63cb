"""Folders that every executor shares, and files put there only if absent."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: dict[str, SparkSession] = {}


def hadoop(spark: SparkSession, path: str):
    """(file system, Hadoop path) of a path."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = hadoop(spark, path)
    return fs.exists(at)


def listed(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """(name, length, modification time) of what a folder holds, in order of name; none if it is missing."""
    fs, at = hadoop(spark, path)
    return sorted((x.getPath().getName(), x.getLen(), x.getModificationTime()) for x in fs.listStatus(at)) if fs.exists(at) else []


def delete(spark: SparkSession, path: str) -> None:
    fs, at = hadoop(spark, path)
    fs.delete(at, True)


def read_text(spark: SparkSession, path: str) -> str:
    """A small file, read by the driver."""
    fs, at = hadoop(spark, path)
    stream = fs.open(at)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def _temporary(spark: SparkSession, path: str, text: str):
    fs, at = hadoop(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(at, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    return fs, at


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a small file unless one is there; false if another writer was first. Readers see all of it or nothing.

    A written temporary file is moved without overwriting, which HDFS and its kind do in one step. A local file system checks before it
    moves, so there a hard link does it, which fails if the name is taken.
    """
    fs, temporary = _temporary(spark, path, text)
    jvm, target = spark._jvm, spark._jvm.org.apache.hadoop.fs.Path(path)
    try:
        if fs.getUri().getScheme() == "file":
            nio = lambda p: jvm.java.nio.file.Paths.get(p.toUri().getPath(), spark.sparkContext._gateway.new_array(jvm.java.lang.String, 0))
            jvm.java.nio.file.Files.createLink(nio(target), nio(temporary))
        else:
            options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
            options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(temporary, target, options)
        return True
    except Exception as e:
        if "AlreadyExists" in str(e):
            return False
        raise
    finally:
        fs.delete(temporary, False)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``. A folder of this machine serves only where all of Spark runs on it."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = os.path.join(tempfile.gettempdir(), "haystrata-scratch")
    return at.rstrip("/")


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted at exit."""
    path = f"{shared_dir(spark)}/haystrata/{name}-{uuid.uuid4().hex}"
    _made[path] = spark
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` evaluated once: written to the shared folder and read from there. Deleted at exit."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _clean() -> None:
    for path, spark in _made.items():
        try:
            delete(spark, path)
        except Exception:  # the JVM is already gone
            return


atexit.register(_clean)
