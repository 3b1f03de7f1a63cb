"""Connected components of a table of links by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haystrata.llm.scratch import free, materialise


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Each node's larger (or no larger) neighbours move to the smallest of its neighbourhood."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else links
    # links hold a > b: without the reverse, a node's neighbours are the smaller ones
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
    moved = both.join(least, both["a"] == least["n"])
    if large:
        out = moved.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("n").alias("a"), F.col("m").alias("b")))
    return out.filter(F.col("a") > F.col("b")).distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """links: long columns a, b. Returns node, component (its smallest node) of every node but the smallest of each, as a written table."""
    at = materialise(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter(F.col("a") > F.col("b")).distinct(), "links")
    mark = None
    while True:
        before, at = at, materialise(_star(_star(at, True), False), "stars")
        free(before)
        now = at.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == mark:
            out = materialise(at.select(F.col("a").alias("node"), F.col("b").alias("component")), "components")
            free(at)
            return out
        mark = tuple(now)
