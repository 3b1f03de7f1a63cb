"""A stored inverted index for BM25: posting blocks by term, read for the asked terms only.

Chunks are put in order of seq and cut into ranges of up to ``RANGE`` chunks; a block holds a term's postings in one
range (places in the range, frequencies in as few bytes as hold them) with what bounds its scores: the largest frequency and the smallest
length. The lengths of a range's chunks are kept once, with their ids. Blocks are packed where a range is read, so the one shuffle is of packed blocks into folders by a
hash of the term. A frequent term is a block of each range, dealt over several files. The corpus is tokenised once, when
the index is built; ``meta.json`` is written last, and without it there is no index.

A search reads the folders of its terms. Each query's score in a range is at most the sum of its terms' bounds
there. The ranges of the highest bounds are scored first; of the rest only those whose bound is not below the query's
kth score so far (block-max pruning, without loss). Blocks are dealt by range, each once however many queries
ask for its term, and meet there the queries that want the range. Scores are Okapi BM25 with the floor of negative idf, and
ties go to the smaller seq, so results are those of scoring every chunk.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from haystrata.sources import shared

K1, B, EPSILON = 1.5, 0.75, 0.25
TOKEN = "[가-힣]+|[A-Za-z0-9]+"
#: Chunks, and postings, of a range at most; postings of a file; folders at most and at least.
RANGE, RANGE_POSTINGS, FILE_POSTINGS, MOST_BUCKETS, LEAST_BUCKETS = 1024, 1 << 20, 1 << 22, 1024, 16
#: Ranges that a query scores before the bounds decide; distinct asked terms that are broadcast at most (each under 100 bytes).
FIRST_RANGES, MAX_TERMS = 2, 100_000
#: The folder of chunk ids.
CHUNKS = -1
_BLOCK = "term string, range long, n long, words long, max_tf int, min_dl int, places binary, tfs binary, dls binary, chunk_ids array<string>, seqs array<long>"
#: What blocks hold; an index of another layout is none.
LAYOUT = 2
_BLOCK_ARROW = pa.schema([
    ("term", pa.string()), ("range", pa.int64()), ("n", pa.int64()), ("words", pa.int64()), ("max_tf", pa.int32()), ("min_dl", pa.int32()), ("places", pa.binary()), ("tfs", pa.binary()), ("dls", pa.binary()),
    ("chunk_ids", pa.list_(pa.string())), ("seqs", pa.list_(pa.int64())),
])


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def _ranges(size: int, most: int):
    """Chunks in order, with their tokens: for each range of up to ``size`` chunks, or ``most`` postings, one row of chunk ids and one of each term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        ids, seqs, dls, known, own_terms, own_tfs = [], [], [], {}, [], []

        def flush() -> pa.RecordBatch:
            lengths = np.array(dls, np.int32)
            term = np.array(own_terms, np.int64)
            order = np.argsort(term, kind="stable")  # places of a term stay in order
            tf = np.array(own_tfs, np.int32)[order]
            place = np.repeat(np.arange(len(ids)), distinct)[order].astype(np.uint16)
            dl = lengths[place]
            starts = np.searchsorted(term[order], np.arange(len(known)))
            ends = np.r_[starts[1:], len(order)].astype(np.int64)

            def cut(a: np.ndarray, size: int) -> list[bytes]:
                raw = a.tobytes()
                return [raw[x * size : y * size] for x, y in zip(starts.tolist(), ends.tolist(), strict=True)]

            low, high = (np.minimum.reduceat(dl, starts), np.maximum.reduceat(tf, starts)) if len(known) else (dl, tf)
            none = [None] * len(known)
            wide = [cut(tf.astype(kind), kind().itemsize) for kind in (np.uint8, np.uint16, np.int32)]
            tfs = [wide[(m > 0xFF) + (m > 0xFFFF)][k] for k, m in enumerate(high.tolist())]
            columns = [
                [None, *known], [number] * (len(known) + 1), [len(ids), *(ends - starts).tolist()], [int(lengths.sum(dtype=np.int64)), *none], [None, *high.tolist()], [None, *low.tolist()],
                [None, *cut(place, 2)], [None, *tfs], [lengths.tobytes(), *none], [ids, *none], [seqs, *none],
            ]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _BLOCK_ARROW, strict=True)], schema=_BLOCK_ARROW)

        distinct: list[int] = []
        for batch in batches:
            for chunk_id, seq, words in zip(*(batch.column(c).to_pylist() for c in ("chunk_id", "seq", "terms")), strict=True):
                counts = Counter(words)
                own_terms += [known.setdefault(w, len(known)) for w in counts]
                own_tfs += counts.values()
                ids.append(chunk_id)
                seqs.append(seq)
                dls.append(len(words))
                distinct.append(len(counts))
                if len(ids) == size or len(own_terms) >= most:
                    yield flush()
                    number += 1
                    ids, seqs, dls, known, own_terms, own_tfs, distinct = [], [], [], {}, [], [], []
        if ids:
            yield flush()

    return run


@dataclass(frozen=True)
class Postings:
    """An index in a folder: chunks, their mean length, the mean idf of all terms, the number of folders, chunks of a range."""

    spark: SparkSession
    path: str
    n: int
    avgdl: float | None
    mean_idf: float | None
    buckets: int
    size: int

    def blocks(self) -> DataFrame:
        return self.spark.read.schema(f"{_BLOCK}, bucket int").parquet(f"{self.path}/blocks")

    def search(self, queries: DataFrame, pool: int = 10) -> DataFrame:
        """queries: query_id, query. query_id, chunk_id, seq, bm25, rank: the first ``pool`` chunks of a score above 0."""
        asked = queries.select("query_id", F.explode(tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))
        asked = shared.written(asked.withColumn("bucket", bucket(F.col("term"), self.buckets)), "asked")
        wanted = asked.select("bucket", "term").distinct()
        folders = [r.bucket for r in wanted.select("bucket").distinct().collect()]  # at most MOST_BUCKETS numbers
        if wanted.count() <= MAX_TERMS:
            wanted = F.broadcast(wanted)
        own = self.blocks().filter(F.col("bucket").isin(folders)).join(wanted, ["bucket", "term"], "left_semi")
        light = own.select("term", "range", "n", "max_tf", "min_dl")
        weights = shared.written(asked.join(light.groupBy("term").agg(F.sum("n").alias("df")), "term").select("query_id", "term", (F.col("times") * idf(self.n, F.col("df"), self.mean_idf)).alias("weight")), "weights")
        most = F.greatest(F.col("weight"), F.lit(0.0)) * part(F.col("max_tf"), F.col("min_dl"), self.avgdl)
        bounds = light.join(weights, "term").groupBy("query_id", "range").agg(F.sum(most).alias("bound")).filter("bound > 0")
        order = Window.partitionBy("query_id").orderBy(F.col("bound").desc(), "range")
        bounds = shared.written(bounds.withColumn("turn", F.row_number().over(order)), "bounds")
        asks = weights.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("term", "weight"))).alias("asks"))  # a query's own terms
        first = shared.written(self._scored(own, asks, bounds.filter(F.col("turn") <= FIRST_RANGES), pool), "scored")
        kth = first.groupBy("query_id").agg(F.sort_array(F.collect_list("bm25"), asc=False).alias("s")).select("query_id", F.get("s", F.lit(pool - 1)).alias("kth"))  # pool rows of FIRST_RANGES ranges
        rest = bounds.filter(F.col("turn") > FIRST_RANGES).join(kth, "query_id", "left").filter(F.col("kth").isNull() | (F.col("bound") * (1 + 1e-9) + 1e-8 >= F.col("kth")))
        # written: which ranges are left is known, and few, before their blocks are read
        found = first.unionByName(self._scored(own, asks, shared.written(rest.select("query_id", "range"), "rest"), pool))
        best = Window.partitionBy("query_id").orderBy(F.col("bm25").desc(), "range", "place")
        top = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= pool)
        names = self.blocks().filter(F.col("bucket") == CHUNKS).select("range", "chunk_ids", "seqs")
        at = lambda c: F.element_at(c, F.col("place") + 1)
        return top.join(names, "range").select("query_id", at("chunk_ids").alias("chunk_id"), at("seqs").alias("seq"), F.col("exact").alias("bm25"), "rank")

    def _scored(self, own: DataFrame, asks: DataFrame, pairs: DataFrame, pool: int) -> DataFrame:
        """pairs: query_id, range. The best ``pool`` places of each pair: query_id, range, place, bm25 (rounded), exact."""
        kind = asks.schema["query_id"].dataType.simpleString()
        ranges = pairs.select("range").distinct()
        none = lambda c, t: F.lit(None).cast(t).alias(c)
        lengths = self.blocks().filter(F.col("bucket") == CHUNKS)
        held = own.select("range", F.lit(1).alias("kind"), "term", "places", "tfs", none("dls", "binary")).unionByName(lengths.select("range", F.lit(0).alias("kind"), none("term", "string"), none("places", "binary"), none("tfs", "binary"), "dls"))
        held = held.join(ranges, "range", "left_semi").select("*", none("query_id", kind), none("asks", "array<struct<term:string,weight:double>>"))
        wanted = pairs.select("query_id", "range").join(asks, "query_id").select("range", F.lit(2).alias("kind"), none("term", "string"), none("places", "binary"), none("tfs", "binary"), none("dls", "binary"), "query_id", "asks")
        rows = held.unionByName(wanted).repartition("range").sortWithinPartitions("range", "kind")
        return rows.mapInArrow(_score(self.avgdl, pool), f"query_id {kind}, range long, place int, bm25 double, exact double")


def bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def idf(n: int, df: Column, mean: float | None) -> Column:
    """A negative one gives way to a share of the mean."""
    own = F.log(F.lit(float(n)) - df + 0.5) - F.log(df + 0.5)
    return F.when(own < 0, EPSILON * (mean or 0.0)).otherwise(own)


def part(tf: Column, dl: Column, avgdl: float | None) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.lit(avgdl or 1.0)))


def _score(avgdl: float | None, pool: int):
    """A range's lengths, then its blocks, then the queries that want it; a query's parts are summed by place, in order of term."""
    names = ["query_id", "range", "place", "bm25", "exact"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, lengths, blocks = None, None, {}
        for batch in batches:
            ids, kind = batch.column("query_id"), batch.schema.field("query_id").type
            columns = [batch.column(c) for c in ("range", "kind", "term", "places", "tfs", "dls", "asks")]
            for row in range(batch.num_rows):
                number, what, term, places, tfs, dls, asks = (c[row].as_py() for c in columns)
                if number != at:
                    at, lengths, blocks = number, None, {}
                if what == 0:
                    lengths = np.frombuffer(dls, np.int32)
                elif what == 1:
                    place = np.frombuffer(places, np.uint16)
                    tf = np.frombuffer(tfs, {1: np.uint8, 2: np.uint16, 4: np.int32}[len(tfs) // len(place)]).astype(np.float64)
                    blocks[term] = place, tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[place] / avgdl))
                else:
                    sums = np.zeros(len(lengths))
                    for ask in asks:
                        if ask["term"] in blocks:
                            place, part = blocks[ask["term"]]
                            sums[place] += ask["weight"] * part
                    rounded = np.round(sums, 9)
                    found = np.flatnonzero(rounded > 0)
                    found = found[np.lexsort((found, -rounded[found]))][:pool]
                    m = len(found)
                    yield pa.RecordBatch.from_arrays([pa.array([ids[row].as_py()] * m, kind), pa.array([at] * m, pa.int64()), pa.array(found, pa.int32()), pa.array(rounded[found]), pa.array(sums[found])], names)

    return run


def build(chunks: DataFrame, path: str, null_lengths: bool = True) -> Postings:
    """chunks: chunk_id, seq, text. A new index at ``path``; chunks without words count in lengths, and are never found.

    Null texts count as chunks; in the mean length only with ``null_lengths``.
    """
    spark = chunks.sparkSession
    # a number of partitions keeps Spark from joining small ones: tokenising is the work here, not reading
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    ordered = chunks.select("chunk_id", "seq", "text").repartitionByRange(n, "seq").sortWithinPartitions("seq", "chunk_id")
    words = ordered.select(F.col("chunk_id").cast("string").alias("chunk_id"), F.col("seq").cast("long").alias("seq"), tokens(F.col("text")).alias("terms"))
    packed = shared.written(words.mapInArrow(_ranges(RANGE, RANGE_POSTINGS), _BLOCK), "packed")
    of_terms = F.col("term").isNotNull()
    total, n, length = packed.agg(F.sum(F.when(of_terms, F.col("n"))), F.sum(F.when(~of_terms, F.col("n"))), F.sum("words")).first()
    files = -(-(total or 0) // FILE_POSTINGS)
    buckets = min(MOST_BUCKETS, max(LEAST_BUCKETS, files))
    spread = max(1, -(-4 * files // buckets))
    placed = packed.withColumn("bucket", F.when(F.col("term").isNull(), CHUNKS).otherwise(bucket(F.col("term"), buckets))).withColumn("salt", F.pmod(F.xxhash64("range"), F.lit(spread)))
    # a task has about a file: it sorts in memory
    placed = placed.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * files), "bucket", "salt").sortWithinPartitions("bucket", "term", "range").drop("salt")
    placed.write.option("compression", "zstd").partitionBy("bucket").parquet(f"{path}/blocks")
    measured = (n or 0) - (0 if null_lengths else chunks.filter(F.col("text").isNull()).count())
    counted = Postings(spark, path, n or 0, length / measured if measured and length else None, None, buckets, RANGE)
    df = counted.blocks().filter(F.col("bucket") != CHUNKS).groupBy("term").agg(F.sum("n").alias("df"))
    own = F.log(F.lit(float(counted.n)) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    # decimals: most terms have the same idf, and a sum of doubles would round each of them the same way
    known, whole = df.agg(F.count(F.lit(1)), F.sum(own.cast("decimal(18,16)"))).first()
    mean = float(Fraction(whole) / known) if known else None
    meta = {"n": counted.n, "avgdl": counted.avgdl, "mean_idf": mean, "buckets": buckets, "size": RANGE}
    shared.put_if_absent(spark, f"{path}/meta.json", json.dumps(meta | {"layout": LAYOUT}))
    return Postings(spark, path, **meta)


def load(spark: SparkSession, path: str) -> Postings | None:
    """The index at ``path``, or none."""
    if not shared.exists(spark, f"{path}/meta.json"):
        return None
    meta = json.loads(shared.read_text(spark, f"{path}/meta.json"))
    return Postings(spark, path, **meta) if meta.pop("layout", 1) == LAYOUT else None
