"""The files of a corpus folder: a digest of all of them, and which of them have changed.

A file's mark is a hash of its name, size and time. Marks are added up, in any order, in ``NODES`` nodes by a
hash of the path, and the digest is a hash of the nodes. Two listings are compared node by node, and
file by file only where nodes differ.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from haystrata.sources import shared

ALLOWED = ("pdf", "txt", "md")
NODES = 256
FILES = "path string, file_name string, length long, modificationTime timestamp"
#: A file's mark is added up in so many numbers of 15 hexadecimal digits.
_PIECES = 4


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def files(spark: SparkSession, path: str) -> DataFrame:
    """path, file_name, length, modificationTime of the usable files; none if the folder is missing. Contents are not read."""
    if not shared.exists(spark, path):
        return spark.createDataFrame([], FILES)
    rows = spark.read.format("binaryFile").load(path).filter(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*ALLOWED))
    return rows.select("path", file_name(F.col("path")).alias("file_name"), "length", "modificationTime")


def marked(listing: DataFrame) -> DataFrame:
    """Adds mark and node."""
    mark = F.sha2(F.concat_ws("|", "file_name", F.col("length").cast("string"), F.unix_micros("modificationTime").cast("string")), 256)
    return listing.withColumn("mark", mark).withColumn("node", F.pmod(F.xxhash64("path"), F.lit(NODES)).cast("int"))


def nodes(marks: DataFrame) -> dict[int, str]:
    """Of each node that has files: the sums of their marks and their number."""
    piece = lambda k: F.sum(F.conv(F.substring("mark", 15 * k + 1, 15), 16, 10).cast("decimal(20,0)")).cast("string")
    rows = marks.groupBy("node").agg(F.concat_ws(" ", *(piece(k) for k in range(_PIECES)), F.count(F.lit(1)).cast("string")).alias("sums"))
    return {r.node: r.sums for r in rows.collect()}  # at most NODES rows


def digest(found: dict[int, str]) -> str:
    return hashlib.sha256("\n".join(f"{k}: {v}" for k, v in sorted(found.items())).encode()).hexdigest()


def changes(before: DataFrame, after: DataFrame, known: dict[int, str], found: dict[int, str]) -> DataFrame:
    """path, kind ('new', 'changed', 'gone') of files that differ; ``before`` and ``after`` are marked listings with these nodes."""
    differ = [k for k in range(NODES) if known.get(k) != found.get(k)]
    pick = lambda x, c: x.filter(F.col("node").isin(differ)).select("path", F.col("mark").alias(c))
    both = pick(before, "was").join(pick(after, "now"), "path", "full")
    kind = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "gone").when(F.col("was") != F.col("now"), "changed")
    return both.select("path", kind.alias("kind")).filter(F.col("kind").isNotNull())
