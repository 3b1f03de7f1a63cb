"""Centroid clustering of integer vectors with Hamerly's bounds (operator 12).

Vectors are packed in blocks, a row for up to ``BLOCK`` vectors, and written once, bucketed by block.
What changes is a second table with the same buckets: for each vector its cluster, one upper bound of
the distance to its own centroid and one lower bound of the distance to the second nearest. Each round
joins both by block without a shuffle of vectors:

* bounds are loosened by the centroids' drift: the upper one by the own centroid's, the lower one by the largest of the others';
* a vector whose upper bound is below its lower bound, or below half the distance from its centroid to the nearest other one, keeps its cluster;
* the rest get their exact own distance, and those still ambiguous a full scan of all centroids in integers.

Bounds are rounded outwards and compared strictly, so ties always end in a full scan and the result is
that of plain k-means to the last bit. Sums for new centroids are kept by block and changed only by the
vectors that move; the driver sees k rows of sums a round.

Kept vectors have exactly ``dim`` components, none null or non-finite; a component x becomes floor(scale * x)
of x as double. Centroids start as the k kept vectors with the smallest sha256 of ``<seed>:<id>``; equal
hashes (repeated ids) in order of their vectors, null ids last; of fewer vectors all are taken. Rows that repeat are vectors
like any other. An empty table gives none. Components beyond 2^26 are refused, as squared distances would
not fit a long. Only the id and vector columns are read, so other columns can have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haystrata.llm.packing import pack, unpack
from haystrata.llm.scratch import bucketed, free

K, ROUNDS, DIM, SCALE, SEED = 8, 10, 64, 1024, "3"
#: Vectors in a block; bytes of packed vectors in a bucket; Spark's own limit of buckets.
BLOCK, BUCKET_BYTES, MAX_BUCKETS = 4096, 64 << 20, 100_000
LARGEST = 1 << 26
_STATE = "block long, cluster binary, upper binary, lower binary, scanned long, sums array<struct<cluster:int,n:long,spent:long,total:array<long>>>"
_STATE_ARROW = pa.schema([
    ("block", pa.int64()), ("cluster", pa.binary()), ("upper", pa.binary()), ("lower", pa.binary()), ("scanned", pa.int64()),
    ("sums", pa.list_(pa.struct([("cluster", pa.int32()), ("n", pa.int64()), ("spent", pa.int64()), ("total", pa.list_(pa.int64()))]))),
])
# outward rounding of float32 bounds, wider than the error of a root, a sum and the conversion
_up = lambda x: (np.asarray(x, np.float64) * (1 + 1e-6)).astype(np.float32)
_down = lambda x: np.maximum(np.asarray(x, np.float64) * (1 - 1e-6), 0).astype(np.float32)


def usable(vector: Column, dim: int) -> Column:
    """Exactly ``dim`` components, none null or non-finite; false for a null vector."""
    fine = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    return F.coalesce((F.size(vector) == dim) & fine, F.lit(False))


def integers(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of x as double."""
    out = np.floor(scale * values.astype(np.float64))
    if len(out) and np.abs(out).max() > LARGEST:
        raise ValueError(f"a component's integer is beyond {LARGEST}")
    return out.astype(np.int64)


def distances(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all vectors to all centroids; products of floats where their sums stay below 2^53."""
    most = max(int(np.abs(v).max(initial=0)), int(np.abs(c).max(initial=0)))
    if v.shape[1] * (2 * most) ** 2 < 1 << 53:
        f, g = v.astype(np.float64), c.astype(np.float64)
        return ((f * f).sum(1)[:, None] - 2 * (f @ g.T) + (g * g).sum(1)).astype(np.int64)
    return np.stack([((v - x) ** 2).sum(1) for x in c], 1)


def _scan(v: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid (ties: the smaller number), its distance, the second distance."""
    d = distances(v, c)
    near, at = d.argmin(1), np.arange(len(v))
    own = d[at, near]
    d[at, near] = np.iinfo(np.int64).max
    return near, own, d.min(1)


def _gaps(c: np.ndarray) -> np.ndarray:
    """Half the distance from each centroid to the nearest other one, rounded down."""
    d = np.sqrt(distances(c, c).astype(np.float64))
    np.fill_diagonal(d, np.inf)
    return _down(np.minimum(d.min(1) / 2, 1e30))


def _sums(v: np.ndarray, cluster: np.ndarray, spent: np.ndarray | None, k: int) -> list[dict]:
    out = []
    for j in np.unique(cluster):
        own = cluster == j
        out.append({"cluster": int(j), "n": int(own.sum()), "spent": int(spent[own].sum()) if spent is not None else 0, "total": v[own].sum(0).tolist()})
    return out


def _moved_sums(sums: list[dict], v: np.ndarray, before: np.ndarray, after: np.ndarray, k: int) -> list[dict]:
    """A block's sums with its moved vectors taken from their old clusters and added to the new ones."""
    n, total = np.zeros(k, np.int64), np.zeros((k, v.shape[1]), np.int64)
    for s in sums:
        n[s["cluster"]], total[s["cluster"]] = s["n"], s["total"]
    moved = np.flatnonzero(before != after)
    np.subtract.at(n, before[moved], 1)
    np.add.at(n, after[moved], 1)
    np.subtract.at(total, before[moved], v[moved])
    np.add.at(total, after[moved], v[moved])
    return [{"cluster": int(j), "n": int(n[j]), "spent": 0, "total": total[j].tolist()} for j in np.flatnonzero(n)]


def _blocks(dim: int, scale: int, id_type: pa.DataType):
    """Rows of id and vector into blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, number = TaskContext.get().partitionId() << 32, 0
        held: list[pa.RecordBatch] = []

        def flush(rows: pa.Table) -> pa.RecordBatch:
            nonlocal number
            v = integers(rows.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False), scale).reshape(-1, dim)
            kind = np.int16 if np.abs(v).max(initial=0) < 1 << 15 else np.int32
            ids = pa.array([rows.column("id").to_pylist()], pa.list_(id_type))
            number += 1
            return pa.RecordBatch.from_arrays([pa.array([first + number], pa.int64()), ids, pa.array([pack(v.astype(kind).ravel())], pa.binary())], ["block", "ids", "vectors"])

        n = 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            while n >= BLOCK:
                rows = pa.Table.from_batches(held)
                yield flush(rows.slice(0, BLOCK))
                held, n = rows.slice(BLOCK).to_batches(), n - BLOCK
        if n:
            yield flush(pa.Table.from_batches(held))

    return run


def _vectors(blob: bytes, dim: int) -> np.ndarray:
    return unpack(blob).astype(np.int64).reshape(-1, dim)


def _first(c: np.ndarray):
    """The first assignment: all vectors are scanned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, blob in zip(batch.column("block").to_pylist(), batch.column("vectors").to_pylist(), strict=True):
                v = _vectors(blob, c.shape[1])
                near, own, second = _scan(v, c)
                yield _state(block, near, _up(np.sqrt(own)), _down(np.sqrt(second)), len(v), _sums(v, near, own, len(c)))

    return run


def _state(block: int, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, scanned: int, sums: list[dict]) -> pa.RecordBatch:
    row = {"block": block, "cluster": pack(cluster.astype(np.uint16)), "upper": pack(upper.astype(np.float32)), "lower": pack(lower.astype(np.float32)), "scanned": scanned, "sums": sums}
    return pa.RecordBatch.from_pylist([row], _STATE_ARROW)


def _next(before: np.ndarray, c: np.ndarray, last: bool):
    """Another assignment, of state made with the centroids ``before``; the last one also sums exact distances."""
    drift = _up(np.sqrt(((c - before) ** 2).sum(1)))
    order = np.argsort(drift)
    rest = np.full(len(c), drift[order[-1]])
    rest[order[-1]] = drift[order[-2]] if len(c) > 1 else 0
    gaps = _gaps(c)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                v = _vectors(row["vectors"], c.shape[1])
                old = unpack(row["cluster"]).astype(np.int64)
                new, upper = old.copy(), _up(unpack(row["upper"]).astype(np.float64) + drift[old])
                lower = _down(unpack(row["lower"]).astype(np.float64) - rest[old])
                bound = np.maximum(lower, gaps[old])
                open_ = np.flatnonzero(~(upper < bound))
                upper[open_] = _up(np.sqrt(((v[open_] - c[old[open_]]) ** 2).sum(1)))
                open_ = open_[~(upper[open_] < bound[open_])]
                if len(open_):
                    new[open_], own, second = _scan(v[open_], c)
                    upper[open_], lower[open_] = _up(np.sqrt(own)), _down(np.sqrt(second))
                sums = _sums(v, new, ((v - c[new]) ** 2).sum(1), len(c)) if last else _moved_sums(row["sums"], v, old, new, len(c))
                yield _state(row["block"], new, upper, lower, len(open_), sums)

    return run


def _totals(state: DataFrame, dim: int) -> dict[int, tuple]:
    """Of each cluster that has vectors: their number, their distances' sum and their sums; at most k rows."""
    one = state.select(F.explode("sums").alias("s")).select("s.*")
    exact = lambda c: F.sum(c.cast("decimal(20,0)"))
    rows = one.groupBy("cluster").agg(F.sum("n"), exact(F.col("spent")), *(exact(F.col("total")[d]) for d in range(dim))).collect()
    return {r[0]: (int(r[1]), int(r[2]), [int(x) for x in r[3:]]) for r in rows}


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: str = SEED, id_col: str = "vec_id", vector_col: str = "embedding", scanned: list[int] | None = None) -> DataFrame:
    """One row per kept vector: ``id_col``, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256. ``scanned`` gets each pass's number of full scans."""
    spark = vectors.sparkSession
    kept = vectors.filter(usable(F.col(vector_col), dim)).select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"))
    id_type = kept.schema["id"].dataType.simpleString()
    out = f"{id_col} {id_type}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    start = kept.select("vector", hashed.alias("h")).orderBy(F.col("h").asc_nulls_last(), "vector").limit(k).collect()
    if not start:
        return spark.createDataFrame([], out)
    c = integers(np.array([r["vector"] for r in start], np.float64), scale)
    n = min(MAX_BUCKETS, max(spark.sparkContext.defaultParallelism, -(-kept.count() * dim * 2 // BUCKET_BYTES)))
    arrow_id = pa.schema([("id", _arrow(kept))]).field(0).type
    blocks = bucketed(kept.mapInArrow(_blocks(dim, scale, arrow_id), f"block long, ids array<{id_type}>, vectors binary").repartition(n, "block"), "vectors", "block", n)
    light = blocks.select("block", "vectors")
    state = bucketed(light.mapInArrow(_first(c), _STATE), "bounds", "block", n)
    for turn in range(1, rounds + 1):
        found, before = _totals(state, dim), c
        c = np.array([[x // found[j][0] for x in found[j][2]] if j in found else before[j].tolist() for j in range(len(before))], np.int64)
        if scanned is not None:
            scanned.append(state.agg(F.sum("scanned")).first()[0])
        after = bucketed(light.join(state, "block").mapInArrow(_next(before, c, turn == rounds), _STATE), "bounds", "block", n)
        free(state)
        state = after
    if scanned is not None:
        scanned.append(state.agg(F.sum("scanned")).first()[0])
    found = _totals(state, dim)
    inertia = sum(f[1] for f in found.values())
    spent = np.array([found[j][1] if j in found else 0 for j in range(len(c))], np.int64)
    names = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in c.tolist()]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                v, own = _vectors(batch.column("vectors")[i].as_py(), dim), unpack(batch.column("cluster")[i].as_py()).astype(np.int64)
                columns = [batch.column("ids").slice(i, 1).flatten(), pa.array(own, pa.int32()), pa.array(((v - c[own]) ** 2).sum(1)), pa.array(spent[own]), pa.array(np.full(len(v), inertia)), pa.array([names[j] for j in own], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, [id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    return blocks.join(state.select("block", "cluster"), "block").mapInArrow(emit, out)


def _arrow(kept: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kept.schema["id"].dataType)
