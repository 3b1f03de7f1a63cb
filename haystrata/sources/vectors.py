"""Stored vector blocks for exact cosine search.

Vectors are taken to unit length and go to the nearest of the pivots (unit vectors of a bounded sample); a pivot's vectors are
cut into blocks by their distance from it, each with its least and largest distance. For a query of
distance d from the pivot the triangle inequality gives the distance of any vector in a block at least max(d - largest, least - d), hence
its similarity at most 1 - distance^2 / 2. Queries travel in blocks: first to the block groups of the highest bounds, then to
those whose bound is not below the query's kth similarity so far. Products are of whole blocks, and only the best of a block
leave a task, so no row of a query and a chunk does.

Similarities are computed in double precision and compared at twelve digits; ties go to the smaller seq. A vector of zeros
has similarity 0 to everything. Chunks without an embedding, and queries without one, take no part.
"""

from __future__ import annotations

import json
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from haystrata.sources import shared

#: Rows of the sample; vectors that a pivot should have; pivots at most; vectors of a block; blocks of a group, as long as a pivot has no more
#: than so many groups; queries of a block.
SAMPLE, PIVOT_ROWS, MOST_PIVOTS, BLOCK, GROUP, MOST_GROUPS, QUERY_BLOCK = 20_000, 1024, 1024, 2048, 8, 64, 256
#: Groups that a query visits before the bounds decide.
FIRST_GROUPS = 2
DIGITS, SLACK = 12, 1e-9
_BLOCKS = "pivot int, least double, largest double, chunk_ids array<string>, seqs array<long>, vectors binary, groups int"


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Unit vectors, shorter ones filled with zeros; zeros stay zeros."""
    lengths = np.asarray(column.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    out = np.zeros((len(lengths), dim))
    out[np.arange(dim)[None, :] < lengths[:, None]] = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    norm = np.sqrt((out * out).sum(1))[:, None]
    return np.where(norm > 0, out / np.where(norm > 0, norm, 1), 0.0)


def _away(v: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((v * v).sum(1)[:, None] - 2 * v @ pivots.T + (pivots * pivots).sum(1), 0))


@dataclass
class Asked:
    """A block of n queries and the best k of each so far; similarity -2 where nothing is found yet."""

    ids: list
    vectors: np.ndarray
    visited: np.ndarray  # n x groups
    similarity: np.ndarray  # n x k
    seqs: np.ndarray
    names: np.ndarray

    def merged(self, who: np.ndarray, similarity: np.ndarray, seqs: np.ndarray, names: np.ndarray) -> Asked:
        n, k = self.similarity.shape
        known = self.similarity.ravel() > -2
        who = np.r_[np.repeat(np.arange(n), k)[known], who]
        similarity, seqs, names = np.r_[self.similarity.ravel()[known], similarity], np.r_[self.seqs.ravel()[known], seqs], np.r_[self.names.ravel()[known], names]
        kept = _best(who, similarity, seqs, names, k)
        who = who[kept]
        place = np.arange(len(who)) - np.searchsorted(who, who)
        out = replace(self, similarity=np.full((n, k), -2.0), seqs=np.zeros((n, k), np.int64), names=np.full((n, k), "", object))
        out.similarity[who, place], out.seqs[who, place], out.names[who, place] = similarity[kept], seqs[kept], names[kept]
        return out


def _best(who: np.ndarray, similarity: np.ndarray, seqs: np.ndarray, names: np.ndarray, k: int) -> np.ndarray:
    order = np.lexsort((names.astype(str), seqs, -np.round(similarity, DIGITS), who))
    w = who[order]
    return order[np.arange(len(w)) - np.searchsorted(w, w) < k]


@dataclass(frozen=True)
class Vectors:
    """An index in a folder; ``groups``: pivot, least and largest distance of each group of blocks, and whether it holds zeros."""

    spark: SparkSession
    path: str
    dim: int
    pivots: np.ndarray
    groups: np.ndarray

    def blocks(self) -> DataFrame:
        return self.spark.read.schema(_BLOCKS).parquet(f"{self.path}/blocks")

    def _bounds(self, q: np.ndarray) -> np.ndarray:
        """queries x groups: no similarity in the group is above."""
        if not len(self.groups):
            return np.zeros((len(q), 0))
        d = _away(q, self.pivots)[:, self.groups[:, 0].astype(np.int64)]
        apart = np.maximum(np.maximum(d - self.groups[:, 2], self.groups[:, 1] - d) - SLACK, 0)
        out = 1 - apart * apart / 2 + SLACK
        # the identity needs unit vectors: a group with zeros holds similarities of 0, a query of zeros has no others
        out = np.where(self.groups[:, 3] > 0, np.maximum(out, SLACK), out)
        return np.where((q * q).sum(1)[:, None] > 0.5, out, SLACK)

    def _choose(self, a: Asked, visits: int | None) -> np.ndarray:
        bound = self._bounds(a.vectors)
        wanted = ~a.visited & (bound >= a.similarity[:, -1:] - SLACK)
        if visits is not None and visits < wanted.shape[1]:
            rank = np.argsort(np.argsort(-np.where(wanted, bound, -np.inf), axis=1, kind="stable"), axis=1)
            wanted &= rank < visits
        return wanted

    def search(self, queries: DataFrame, pool: int = 10, skipped: list[tuple[int, int]] | None = None) -> DataFrame:
        """queries: query_id, query_embedding. query_id, chunk_id, seq, vector_similarity, rank, vector_distance. ``skipped``: gets (visits left out, all)."""
        kind = queries.schema["query_id"].dataType
        asked = shared.written(queries.filter(F.col("query_embedding").isNotNull()).select("query_id", "query_embedding").mapInArrow(_gathered(self.dim, len(self.groups), pool), "number long, asked binary"), "asked")
        for visits in (FIRST_GROUPS, None):
            sent = asked.mapInArrow(self._visit(visits), "groups int, number long, sent binary")
            # what is sent is larger than the table it is made of, from which Spark would take its size: never broadcast
            found = sent.hint("merge").join(self.blocks().select("groups", "chunk_ids", "seqs", "vectors"), "groups").mapInArrow(_products(self.dim, pool), "number long, found binary")
            none = lambda c: F.lit(None).cast("binary").alias(c)
            both = asked.select("number", "asked", none("found"), F.lit(0).alias("kind")).unionByName(found.select("number", none("asked"), "found", F.lit(1).alias("kind")))
            asked = shared.written(both.repartition("number").sortWithinPartitions("number", "kind").mapInArrow(self._merge(visits), "number long, asked binary"), "asked")
        if skipped is not None:
            skipped.append(tuple(asked.mapInArrow(_left_out, "out long, total long").agg(F.coalesce(F.sum("out"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()))
        return asked.mapInArrow(_rows(to_arrow_type(kind)), f"query_id {kind.simpleString()}, chunk_id string, seq long, vector_similarity double, rank int, vector_distance double")

    def _visit(self, visits: int | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for number, blob in zip(batch.column("number").to_pylist(), batch.column("asked").to_pylist(), strict=True):
                    a: Asked = pickle.loads(blob)
                    wanted = choose(a, visits)
                    for g in np.flatnonzero(wanted.any(0)):
                        own = np.flatnonzero(wanted[:, g])
                        yield pa.RecordBatch.from_arrays([pa.array([g], pa.int32()), pa.array([number], pa.int64()), pa.array([pickle.dumps((own, a.vectors[own], a.similarity[own, -1]))], pa.binary())], ["groups", "number", "sent"])

        choose = replace(self, spark=None)._choose
        return run

    def _merge(self, visits: int | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            number, a, held = None, None, []

            def settled() -> Asked:
                return a.merged(*(np.concatenate(x) for x in zip(*held, strict=True))) if held else a

            row = lambda: pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([pickle.dumps(settled())], pa.binary())], ["number", "asked"])
            for batch in batches:
                for at, blob, found in zip(*(batch.column(c).to_pylist() for c in ("number", "asked", "found")), strict=True):
                    if blob is not None:
                        if a is not None:
                            yield row()
                        number, a, held = at, pickle.loads(blob), []
                        a.visited |= choose(a, visits)
                    else:
                        held.append(pickle.loads(found))
                        if sum(len(x[0]) for x in held) > 1 << 18:
                            a, held = settled(), []
            if a is not None:
                yield row()

        choose = replace(self, spark=None)._choose
        return run


def _gathered(dim: int, groups: int, k: int):
    """Queries of a task in blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, number = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            v = _matrix_of(batch.column("query_embedding"), dim)
            for a in range(0, batch.num_rows, QUERY_BLOCK):
                ids = batch.column("query_id").slice(a, QUERY_BLOCK).to_pylist()
                n = len(ids)
                number += 1
                asked = Asked(ids, v[a : a + n], np.zeros((n, groups), bool), np.full((n, k), -2.0), np.zeros((n, k), np.int64), np.full((n, k), "", object))
                yield pa.RecordBatch.from_arrays([pa.array([first + number], pa.int64()), pa.array([pickle.dumps(asked)], pa.binary())], ["number", "asked"])

    return run


def _matrix_of(column: pa.Array, dim: int) -> np.ndarray:
    """Queries as unit vectors; components beyond the index's do not count in products but in lengths."""
    longest = max([dim, *(n or 0 for n in column.value_lengths().to_pylist())])
    return _matrix(column, longest)[:, :dim]


def _products(dim: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                own, q, kth = pickle.loads(batch.column("sent")[i].as_py())
                v = np.frombuffer(batch.column("vectors")[i].as_py(), np.float64).reshape(-1, dim)
                seqs = np.array(batch.column("seqs")[i].as_py(), np.int64)
                s = np.clip(q @ v.T, -1, 1)
                least = np.round(kth, DIGITS)[:, None] - SLACK
                if s.shape[1] > k:
                    least = np.maximum(least, np.round(np.partition(s, -k, axis=1)[:, -k], DIGITS)[:, None] - SLACK)
                who, at = np.nonzero(s >= least)
                names = np.array(batch.column("chunk_ids")[i].as_py(), object)
                kept = _best(who, s[who, at], seqs[at], names[at], k)
                who, at = who[kept], at[kept]
                found = pickle.dumps((own[who], s[who, at], seqs[at], names[at]))
                yield pa.RecordBatch.from_arrays([batch.column("number").slice(i, 1), pa.array([found], pa.binary())], ["number", "found"])

    return run


def _rows(kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column("asked").to_pylist():
                a: Asked = pickle.loads(blob)
                who, r = np.nonzero(a.similarity > -2)
                s = a.similarity[who, r]
                columns = [pa.array([a.ids[w] for w in who], kind), pa.array(a.names[who, r].tolist(), pa.string()), pa.array(a.seqs[who, r]), pa.array(s), pa.array(r + 1, pa.int32()), pa.array(1 - s)]
                yield pa.RecordBatch.from_arrays(columns, ["query_id", "chunk_id", "seq", "vector_similarity", "rank", "vector_distance"])

    return run


def _left_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen = [pickle.loads(x).visited for x in batch.column("asked").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([int((~x).sum()) for x in seen], pa.int64()), pa.array([x.size for x in seen], pa.int64())], ["out", "total"])


def build(chunks: DataFrame, path: str) -> Vectors:
    """chunks: chunk_id, seq, embedding. A new index at ``path``."""
    spark = chunks.sparkSession
    rows = chunks.filter(F.col("embedding").isNotNull()).select(F.col("chunk_id").cast("string").alias("chunk_id"), F.col("seq").cast("long").alias("seq"), F.col("embedding").alias("vector"))
    n, dim = rows.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    dim = max(dim or 0, 1)
    share = min(1 << 30, int(1.5 * SAMPLE / max(n, 1) * (1 << 30)) + 1)
    chosen = rows.filter(F.pmod(F.xxhash64("chunk_id", "seq"), F.lit(1 << 30)) < share).select("vector").limit(SAMPLE).toArrow()
    sample = np.unique(_matrix(chosen.column("vector").combine_chunks(), dim), axis=0) if len(chosen) else np.zeros((1, dim))
    pivots = _pivots(sample, max(1, min(MOST_PIVOTS, n // PIVOT_ROWS)))

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch.column("vector"), dim)
            away = _away(v, pivots)
            near = away.argmin(1)
            yield pa.RecordBatch.from_arrays([pa.array(near, pa.int32()), pa.array(away[np.arange(len(v)), near]), batch.column("chunk_id"), batch.column("seq"), pa.array([x.tobytes() for x in v], pa.binary())], ["pivot", "away", "chunk_id", "seq", "vector"])

    placed = rows.mapInArrow(assigned, "pivot int, away double, chunk_id string, seq long, vector binary").repartitionByRange("pivot", "away", "seq").sortWithinPartitions("pivot", "away", "seq")
    packed = shared.written(placed.mapInArrow(_packed(BLOCK), "pivot int, least double, largest double, zeros boolean, chunk_ids array<string>, seqs array<long>, vectors binary"), "packed")
    # blocks of near distance share a group: at most MOST_PIVOTS times MOST_GROUPS
    every = packed.select("pivot", "least").withColumn("one", F.lit(1)).groupBy("pivot").agg(F.count("one").alias("n"))
    at = every.join(packed.groupBy("pivot").agg(F.min("least").alias("low"), F.max("largest").alias("high")), "pivot").collect()  # a row a pivot
    groups, of_pivot = [], {}
    for r in at:
        k = min(MOST_GROUPS, -(-r.n // GROUP))
        of_pivot[r.pivot] = (len(groups), k, r.low, max((r.high - r.low) / k, 1e-12))
        groups += [(r.pivot, r.low + j * (r.high - r.low) / k) for j in range(k)]
    known = spark.createDataFrame([(p, *x) for p, x in of_pivot.items()], "pivot int, first int, k int, low double, step double")
    number = F.col("first") + F.least(F.col("k") - 1, F.floor((F.col("least") - F.col("low")) / F.col("step"))).cast("int")
    grouped = packed.join(F.broadcast(known), "pivot").withColumn("groups", number)  # at most MOST_PIVOTS rows
    ends = {r.groups: r for r in grouped.groupBy("groups").agg(F.min("least").alias("least"), F.max("largest").alias("largest"), F.max("zeros").alias("zeros")).collect()}
    table = np.array([(p, ends[g].least, ends[g].largest, float(ends[g].zeros)) if g in ends else (p, 9.0, -9.0, 0.0) for g, (p, _) in enumerate(groups)]).reshape(-1, 4)
    grouped.select(*(c.split()[0] for c in _BLOCKS.split(", "))).repartition("groups").write.option("compression", "zstd").parquet(f"{path}/blocks")
    shared.put_if_absent(spark, f"{path}/meta.json", json.dumps({"dim": dim, "pivots": pivots.tolist(), "groups": table.tolist()}))
    return Vectors(spark, path, dim, pivots, table)


def _pivots(sample: np.ndarray, k: int) -> np.ndarray:
    """Means of the sample's unit vectors after a few rounds of k-means."""
    c = sample[np.random.default_rng(5).permutation(len(sample))[:k]]
    for _ in range(5):
        near = _away(sample, c).argmin(1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, sample)
        n = np.bincount(near, minlength=len(c))[:, None]
        c = np.where(n > 0, sums / np.maximum(n, 1), c)
    return c


def _packed(size: int):
    """Rows in order of pivot and distance into blocks of one pivot and up to ``size`` vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["pivot", "least", "largest", "zeros", "chunk_ids", "seqs", "vectors"]
        kinds = [pa.int32(), pa.float64(), pa.float64(), pa.bool_(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.binary()]

        def made(t: pa.Table) -> pa.RecordBatch:
            away, vectors = t.column("away").to_numpy(), t.column("vector").to_pylist()
            zero = any(not x.strip(b"\0") for x in vectors)
            values = [t.column("pivot")[0].as_py(), float(away.min()), float(away.max()), zero, t.column("chunk_id").to_pylist(), t.column("seq").to_pylist(), b"".join(vectors)]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(values, kinds, strict=True)], names)

        held: list[pa.Table] = []
        for batch in batches:
            table = pa.Table.from_batches([batch])
            pivot = table.column("pivot").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(pivot)) + 1).tolist(), len(table)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if held and held[0].column("pivot")[0].as_py() != pivot[a]:
                    yield made(pa.concat_tables(held))
                    held = []
                if b > a:
                    held.append(table.slice(a, b - a))
                while sum(map(len, held)) >= size:
                    whole = pa.concat_tables(held)
                    yield made(whole.slice(0, size))
                    held = [whole.slice(size)] if len(whole) > size else []
        if held:
            yield made(pa.concat_tables(held))

    return run


def load(spark: SparkSession, path: str) -> Vectors | None:
    """The index at ``path``, or none."""
    if not shared.exists(spark, f"{path}/meta.json"):
        return None
    meta = json.loads(shared.read_text(spark, f"{path}/meta.json"))
    return Vectors(spark, path, meta["dim"], np.array(meta["pivots"]), np.array(meta["groups"]).reshape(-1, 4))
