"""Mixing sources to target weights by systematic sampling (operator 2, DataFrame functions only).

Targets: the total is shared among sources by weight; a source never gets more than
``max_repeat`` times its own size, the excess goes to the others by weight (water filling,
solved in closed form over sources ordered by size/weight).

Draw: within a source, documents lie in order of size class, block and size. Each expects
target/source_size copies; a running sum of expected copies plus one offset per source is
kept, and a document is emitted once for every integer the sum crosses. Order by size makes
the sample stratified, so taken words come near the target. The running sum is two-level:
documents are numbered inside blocks of about sqrt(rows) documents, blocks get prefix sums
of their counts, so that no task holds a source. The offset is a hash of source and seed:
reruns agree.

Null text has size 0. A null source is a source of its own, last in order. Repeated rows are
documents of their own. Documents of size 0 are never taken. Only three columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haystrata.llm.scratch import materialise

WEIGHTS = (5, 2, 1)
SHARE, MAX_REPEAT, SEED = 1.5, 2.0, 7


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text: word starts are counted, none is built."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def _unit(x: Column) -> Column:
    """[0, 1) from a string."""
    return F.conv(F.substring(F.md5(x), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def _size_class(size: Column) -> Column:
    """Rises with size: number of binary digits, then the three digits below the leading one."""
    digits = F.length(F.bin(size))
    # the shift drops all but the leading four digits
    lead = F.expr("shiftright(size, greatest(length(bin(size)) - 4, 0))").bitwiseAND(F.lit(7))
    return F.when(size > 0, digits * 8 + lead).otherwise(F.lit(-1)).cast("int")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MAX_REPEAT) -> DataFrame:
    """sizes: source, source_size, one row each. Adds target."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(rank - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sizes.withColumn("weight", weight).withColumn("rank", rank).withColumn("cap", F.col("source_size") * F.lit(most))
    ranked = ranked.withColumn("ratio", F.col("cap") / F.col("weight"))
    order = Window.orderBy("ratio", "rank")
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (
        ranked.withColumn("total", F.sum("source_size").over(whole) * F.lit(share))
        .withColumn("capped", F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("left_weight", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("total") - F.col("capped")) / F.col("left_weight"))
    )
    # the first source whose cap is not below its level: sources before it are capped, all others share its level
    free = F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "rank", "level"))
    level = level.withColumn("water", F.min(free).over(whole)["level"])
    return level.select("source", "source_size", F.coalesce(F.least(F.col("water") * F.col("weight"), F.col("cap")), F.col("cap")).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MAX_REPEAT, seed: int = SEED) -> DataFrame:
    """One row per document: ``id_col``, source, size, source_size, target, copies, taken (copies times size)."""
    sized = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    sized = sized.withColumn("class", _size_class(F.col("size")))
    sized = materialise(sized.withColumn("u", _unit(F.concat_ws(":", F.lit("block"), F.col("id").cast("string")))), "sized")
    classes = sized.groupBy("source", "class").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words"))
    block_rows = max(256, int(sized.count() ** 0.5))
    classes = materialise(classes.withColumn("blocks", F.ceil(F.col("n") / F.lit(block_rows)).cast("int")), "classes")

    sizes = classes.groupBy("source").agg(F.sum("words").alias("source_size"))
    targets = materialise(source_targets(sizes, weights, share, most), "targets")

    rows = sized.join(classes.select("source", "class", "blocks"), (sized["source"].eqNullSafe(classes["source"])) & (sized["class"] == classes["class"])).select(
        sized["id"], sized["source"], sized["size"], sized["class"], F.floor(F.col("u") * F.col("blocks")).cast("int").alias("block")
    )
    rows = materialise(rows, "blocked")
    blocks = rows.groupBy("source", "class", "block").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("class", "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = blocks.select("source", "class", "block", before.alias("before"))
    offsets = offsets.join(targets, offsets["source"].eqNullSafe(targets["source"])).select(offsets["source"].alias("o_source"), offsets["class"].alias("o_class"), offsets["block"].alias("o_block"), "before", "source_size", "target")

    in_block = F.row_number().over(Window.partitionBy("source", "class", "block").orderBy("size", "id"))
    ranked = rows.withColumn("in_block", in_block)
    joined = ranked.join(offsets, ranked["source"].eqNullSafe(offsets["o_source"]) & (ranked["class"] == offsets["o_class"]) & (ranked["block"] == offsets["o_block"]))
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(most))).otherwise(F.lit(0.0))
    rank, shift = F.col("before") + F.col("in_block"), _unit(F.concat_ws(":", F.lit(f"offset{seed}"), F.coalesce(F.col("source"), F.lit("\x00null"))))
    copies = F.when(F.col("size") > 0, F.floor(rate * rank + shift) - F.floor(rate * (rank - 1) + shift)).otherwise(F.lit(0))
    return joined.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", copies.cast("long").alias("copies")).withColumn("taken", F.col("copies") * F.col("size"))
