"""Hard-negative mining over inverted lists with radii (operator 11).

1. Index. Centroids are fitted by k-means on a bounded sample (``SAMPLE`` rows; results do not depend on
   it) and every row goes to its nearest centroid's list. Lists are cut into blocks of up to ``BLOCK`` rows, by
   distance from the centroid, so a list that holds a third of all rows is many blocks. Each list stores its radius.
2. Search. Anchors travel in blocks, with all that is known about them. For an anchor q and a list of
   centroid c and radius r every score lies within q.c +- |q| r (Cauchy-Schwarz). An anchor first visits its lists of
   the highest upper bounds; then all others, but for those outside each of its windows and those whose upper bound is strictly below
   its kth score so far, in each of its windows. A visit is a row of a join by list part; what comes back are the best rows of
   a block, and a sorted stream merges them into the anchor's best k.
3. The same search runs twice: for positives (same label, one window without ends, ``POSITIVES`` best) and for
   negatives (other labels, a window for each positive, ``NEGATIVES`` best of each).

Nothing is approximate: bounds are rounded outwards, scores are exact integers, ties go to the smaller id (null last). No task holds
a list, an anchor's candidates or all anchors; the driver sees the sample, the centroids and a number for each list.

Rows with a null label, a null vector, or a null or non-finite component take no part. Vectors of fewer components
count as if zeros followed. An anchor's own row is no partner of it, but a row that repeats it is. Rows with
a null id are partners, never anchors. An anchor without positives, or a positive without negatives, has no rows. An empty table gives
none. Components so large that 100 times a score might not fit a long are refused. Only the id, label and vector columns
are read, so other columns can have any name.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haystrata.llm.packing import pack, unpack
from haystrata.llm.scratch import bucketed, free, materialise

SCALE, ANCHOR_EVERY, POSITIVES, NEGATIVES = 256, 100, 5, 10
RELABEL_EVERY, LABELS = 7, 10
#: A negative's score is between these hundredths of its positive's.
LOW, HIGH = 30, 90
#: Rows of the sample; rows that a list should have; lists at most; rows of a block; blocks that share a part of the join; anchors of a block.
SAMPLE, LIST_ROWS, MAX_LISTS, BLOCK, PART_BLOCKS, ANCHOR_BLOCK = 20_000, 512, 1024, 2048, 8, 256
#: Lists that an anchor visits before the bounds decide.
FIRST_VISITS = 2
NONE = np.iinfo(np.int64).min
MOST = np.iinfo(np.int64).max
_OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


@dataclass
class Anchors:
    """A block of n anchors in a search of W windows for k rows each. ``score`` is NONE where nothing is found yet."""

    ids: np.ndarray  # n
    labels: np.ndarray  # n
    at: np.ndarray  # n x 2: block and place of its own row
    vectors: np.ndarray  # n x d
    low: np.ndarray  # n x W
    high: np.ndarray  # n x W
    visited: np.ndarray  # n x lists
    score: np.ndarray  # n x W x k, best first
    found: np.ndarray  # n x W x k: ids
    nameless: np.ndarray  # n x W x k: the id is null
    positives: tuple | None = None  # ids, nameless, scores of the first search

    def kth(self) -> np.ndarray:
        return self.score[:, :, -1]

    @classmethod
    def start(cls, ids, labels, at, vectors, low, high, lists: int, k: int, positives=None) -> Anchors:
        shape = (*low.shape, k)
        return cls(ids, labels, at, vectors, low, high, np.zeros((len(ids), lists), bool), np.full(shape, NONE), np.zeros(shape, np.int64), np.zeros(shape, bool), positives)


@dataclass
class Lists:
    """Centroids, radii and the number of parts of each list."""

    centroids: np.ndarray
    radii: np.ndarray
    parts: np.ndarray

    def choose(self, a: Anchors, visits: int | None) -> np.ndarray:
        """anchor x list: which lists to visit now. ``visits``: at most so many, of the highest bounds."""
        q = a.vectors.astype(np.float64)
        middle, length = q @ self.centroids.T, np.sqrt((q * q).sum(1))[:, None]
        reach = length * self.radii[None, :]
        slack = 1e-6 * (1 + np.abs(middle) + reach)
        upper, lower = middle + reach + slack, middle - reach - slack
        wanted = np.zeros(upper.shape, bool)
        for w in range(a.low.shape[1]):
            least = np.maximum(a.low[:, w], a.kth()[:, w]).astype(np.float64)[:, None]
            most = a.high[:, w].astype(np.float64)[:, None]
            wanted |= (a.low[:, w] <= a.high[:, w])[:, None] & (upper >= least) & (lower <= most)
        wanted &= ~a.visited & (self.parts > 0)[None, :]
        if visits is not None and visits < wanted.shape[1]:
            rank = np.argsort(np.argsort(-np.where(wanted, upper, -np.inf), axis=1, kind="stable"), axis=1)
            wanted &= rank < visits
        return wanted


def products(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact inner products q x v; products of floats where their sums stay below 2^53."""
    most = int(np.abs(v).max(initial=0)) * int(np.abs(q).max(initial=0))
    if v.shape[1] * most < 1 << 53:
        return (q.astype(np.float64) @ v.astype(np.float64).T).astype(np.int64)
    return q @ v.T


def _best(group: np.ndarray, score: np.ndarray, nameless: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k entries of each group: higher scores first, then smaller ids, null last."""
    order = np.lexsort((ids, nameless, -score, group))
    g = group[order]
    starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.zeros(0, np.int64)
    rank = np.arange(len(g)) - np.repeat(starts, np.diff(np.r_[starts, len(g)]))
    return order[rank < k]


def taking_part(rows: DataFrame, id_col: str, label_col: str, vector_col: str, relabel_every: int, labels: int) -> DataFrame:
    """id, label, vector of the rows that take part, some with another label."""
    fine = F.forall(vector_col, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    kept = rows.filter(F.col(label_col).isNotNull() & F.col(vector_col).isNotNull() & fine)
    own, label = F.col(id_col).cast("long"), F.col(label_col)
    return kept.select(own.alias("id"), F.when(own % relabel_every == 0, (label + 1) % labels).otherwise(label).cast("long").alias("label"), F.col(vector_col).alias("vector"))


def _matrix(column: pa.Array, dim: int, scale: int) -> np.ndarray:
    """floor(scale * x), shorter vectors filled with zeros."""
    lengths = np.asarray(column.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    values = np.floor(scale * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    most = np.abs(values).max(initial=0)
    if 100.0 * dim * most * most >= 2.0**62:
        raise ValueError("scores of such large components do not fit a long")
    out = np.zeros((len(lengths), dim), np.int64)
    out[np.arange(dim)[None, :] < lengths[:, None]] = values.astype(np.int64)
    return out


def _fit(sample: np.ndarray, k: int) -> np.ndarray:
    """Centroids of the bounded sample after a few rounds of k-means."""
    x = sample.astype(np.float64)
    c = np.unique(x, axis=0)
    c = c[np.random.default_rng(11).permutation(len(c))[:k]]
    for _ in range(5):
        near = ((c * c).sum(1) - 2 * x @ c.T).argmin(1)
        n = np.bincount(near, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def build_index(rows: DataFrame, scale: int) -> tuple[DataFrame, Lists, int]:
    """rows: id, label, vector. (blocks: part, block, ids, labels, vectors; lists; components of a vector)."""
    spark = rows.sparkSession
    n, dim = rows.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    if not n:
        return None, None, 0
    dim = max(dim, 1)
    share = min(1 << 30, int(1.5 * SAMPLE / n * (1 << 30)) + 1)
    chosen = rows.filter(F.pmod(F.xxhash64("id", "vector"), F.lit(1 << 30)) < share).select("vector").limit(SAMPLE).toArrow()
    sample = _matrix(chosen.column("vector").combine_chunks(), dim, scale)
    c = _fit(sample, max(1, min(MAX_LISTS, n // LIST_ROWS))) if len(sample) else np.zeros((1, dim))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch.column("vector"), dim, scale)
            f = v.astype(np.float64)
            near = ((c * c).sum(1) - 2 * f @ c.T).argmin(1)
            away = np.sqrt(((f - c[near]) ** 2).sum(1))
            raw = pa.array([x.tobytes() for x in v.astype(np.int32)], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(near, pa.int32()), pa.array(away), batch.column("id"), batch.column("label"), raw], ["list", "away", "id", "label", "vector"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, number = TaskContext.get().partitionId() << 32, 0
        names = ["list", "block", "radius", "n", "ids", "labels", "vectors"]

        def made(rows: pa.Table) -> pa.RecordBatch:
            nonlocal number
            number += 1
            v = np.frombuffer(b"".join(rows.column("vector").to_pylist()), np.int32)
            kind = np.int16 if np.abs(v).max(initial=0) < 1 << 15 else np.int32
            values = [rows.column("list")[0].as_py(), first + number, float(rows.column("away").to_numpy().max()), len(rows), rows.column("id").to_pylist(), pack(rows.column("label").to_numpy()), pack(v.astype(kind))]
            kinds = [pa.int32(), pa.int64(), pa.float64(), pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(values, kinds, strict=True)], names)

        held: list[pa.Table] = []  # rows of one list
        for batch in batches:
            table = pa.Table.from_batches([batch])
            lists = table.column("list").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(lists)) + 1).tolist(), len(table)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if held and held[0].column("list")[0].as_py() != lists[a]:
                    yield made(pa.concat_tables(held))
                    held = []
                held.append(table.slice(a, b - a))
                while sum(map(len, held)) >= BLOCK:
                    whole = pa.concat_tables(held)
                    yield made(whole.slice(0, BLOCK))
                    held = [whole.slice(BLOCK)] if len(whole) > BLOCK else []
        if held:
            yield made(pa.concat_tables(held))

    dealt = rows.mapInArrow(assign, "list int, away double, id long, label long, vector binary").withColumn("salt", F.xxhash64(F.monotonically_increasing_id()))
    dealt = dealt.repartitionByRange("list", "away", "salt").sortWithinPartitions("list", "away", "salt").drop("salt")
    packed = materialise(dealt.mapInArrow(blocks, "list int, block long, radius double, n int, ids array<long>, labels binary, vectors binary"), "blocks")
    about = packed.groupBy("list").agg(F.max("radius"), F.count(F.lit(1))).collect()
    radii, parts = np.zeros(len(c)), np.zeros(len(c), np.int64)
    for j, radius, count in about:
        radii[j], parts[j] = radius * (1 + 1e-9), -(-count // PART_BLOCKS)
    # a block goes to one of its list's parts
    of_list = F.array(*(F.lit(int(max(1, p))) for p in parts))[F.col("list")]
    part = F.shiftleft(F.col("list").cast("long"), 32) + F.pmod(F.xxhash64("block"), of_list)
    buckets = max(spark.sparkContext.defaultParallelism, min(100_000, int(parts.sum()) // 4))
    index = bucketed(packed.withColumn("part", part).drop("radius", "list").repartition(buckets, "part"), "lists", "part", buckets)
    free(packed)
    return index, Lists(c, radii, parts), dim


def _ids(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids, 0 where null, and which are null."""
    return array.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), array.is_null().to_numpy(zero_copy_only=False)


def _anchors(index: DataFrame, dim: int, every: int, lists: int, k: int) -> DataFrame:
    """block of anchors (number, pickled) of the rows whose id is divisible by ``every``."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, null = _ids(batch.column("ids").slice(i, 1).flatten())
                own = np.flatnonzero(~null & (ids % every == 0))
                if len(own):
                    v = unpack(batch.column("vectors")[i].as_py()).reshape(-1, dim)[own].astype(np.int32)
                    label = unpack(batch.column("labels")[i].as_py())[own]
                    n = len(own)
                    columns = [pa.array([batch.column(c)[i].as_py()] * n, pa.int64()) for c in ("part", "block")]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(own, pa.int64()), pa.array(ids[own]), pa.array(label, pa.int64()), pa.array([x.tobytes() for x in v], pa.binary())], ["part", "block", "place", "id", "label", "vector"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, number, held = TaskContext.get().partitionId() << 32, 0, []

        def made(rows: pa.Table) -> pa.RecordBatch:
            v = np.frombuffer(b"".join(rows.column("vector").to_pylist()), np.int32).reshape(-1, dim).astype(np.int64)
            n = len(v)
            at = np.stack([rows.column("block").to_numpy(), rows.column("place").to_numpy()], 1)
            a = Anchors.start(rows.column("id").to_numpy(), rows.column("label").to_numpy(), at, v, np.full((n, 1), NONE), np.full((n, 1), MOST), lists, k)
            return pa.RecordBatch.from_arrays([pa.array([first + number], pa.int64()), pa.array([pickle.dumps(a)], pa.binary())], ["number", "anchors"])

        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            while sum(map(len, held)) >= ANCHOR_BLOCK:
                whole = pa.concat_tables(held)
                number += 1
                yield made(whole.slice(0, ANCHOR_BLOCK))
                held = [whole.slice(ANCHOR_BLOCK)] if len(whole) > ANCHOR_BLOCK else []
        if held:
            number += 1
            yield made(pa.concat_tables(held))

    # near anchors visit the same lists, so they share a block
    rows = index.select("part", "block", "ids", "labels", "vectors").mapInArrow(find, "part long, block long, place long, id long, label long, vector binary")
    rows = rows.repartitionByRange("part", "block", "place").sortWithinPartitions("part", "block", "place")
    return materialise(rows.mapInArrow(gather, "number long, anchors binary"), "anchors")


def _visit(lists: Lists, visits: int | None):
    """A row for each part of a list that anchors of a block visit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, blob in zip(batch.column("number").to_pylist(), batch.column("anchors").to_pylist(), strict=True):
                a = pickle.loads(blob)
                wanted = lists.choose(a, visits)
                for j in np.flatnonzero(wanted.any(0)):
                    own = np.flatnonzero(wanted[:, j])
                    asked = pickle.dumps((own, a.labels[own], a.at[own], a.vectors[own].astype(np.int32), a.low[own], a.high[own], a.kth()[own]))
                    parts = [(int(j) << 32) + p for p in range(lists.parts[j])]
                    yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int64()), pa.array([number] * len(parts), pa.int64()), pa.array([asked] * len(parts), pa.binary())], ["part", "number", "asked"])

    return run


def _score(dim: int, k: int, same: bool):
    """Rows of (anchors, block): the block's best rows for each anchor and window, none below what the anchor has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                own, labels, at, q, low, high, kth = pickle.loads(batch.column("asked")[i].as_py())
                ids, null = _ids(batch.column("ids").slice(i, 1).flatten())
                v = unpack(batch.column("vectors")[i].as_py()).reshape(-1, dim).astype(np.int64)
                label = unpack(batch.column("labels")[i].as_py())
                s = products(v, q.astype(np.int64))
                fits = (labels[:, None] == label[None, :]) == same
                here = np.flatnonzero(at[:, 0] == batch.column("block")[i].as_py())
                fits[here, at[here, 1]] = False
                parts = []
                for w in range(low.shape[1]):
                    least = np.maximum(low[:, w], kth[:, w])
                    masked = np.where(fits & (s >= least[:, None]) & (s <= high[:, w][:, None]), s, NONE)
                    if masked.shape[1] > k:
                        least = np.maximum(least, np.partition(masked, -k, axis=1)[:, -k])
                    row, column = np.nonzero((masked >= least[:, None]) & (masked > NONE))
                    kept = _best(row, masked[row, column], null[column], ids[column], k)
                    row, column = row[kept], column[kept]
                    parts.append((own[row], np.full(len(row), w), s[row, column], null[column], ids[column]))
                if sum(len(p[0]) for p in parts):
                    found = pickle.dumps(tuple(np.concatenate(x) for x in zip(*parts, strict=True)))
                    yield pa.RecordBatch.from_arrays([batch.column("number").slice(i, 1), pa.array([found], pa.binary())], ["number", "found"])

    return run


def _merge(lists: Lists, visits: int | None):
    """Anchors of a block, then what was found for them, block after block: the anchors with their best."""

    def merged(a: Anchors, found: list[tuple]) -> Anchors:
        n, windows, k = a.score.shape
        anchor, window, score, null, ids = (np.concatenate(x) for x in zip(*found, strict=True))
        known = a.score.ravel() > NONE
        group = np.r_[np.repeat(np.arange(n * windows), k)[known], anchor * windows + window]
        score, null, ids = np.r_[a.score.ravel()[known], score], np.r_[a.nameless.ravel()[known], null], np.r_[a.found.ravel()[known], ids]
        kept = _best(group, score, null, ids, k)
        group = group[kept]
        place = np.arange(len(group)) - np.searchsorted(group, group)
        out = replace(a, score=np.full(a.score.shape, NONE), found=np.zeros_like(a.found), nameless=np.zeros_like(a.nameless))
        at = (group // windows, group % windows, place)
        out.score[at], out.found[at], out.nameless[at] = score[kept], ids[kept], null[kept]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, a, held = None, None, []
        row = lambda: pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([pickle.dumps(merged(a, held) if held else a)], pa.binary())], ["number", "anchors"])
        for batch in batches:
            for at, anchors, found in zip(*(batch.column(c).to_pylist() for c in ("number", "anchors", "found")), strict=True):
                if anchors is not None:
                    if a is not None:
                        yield row()
                    number, a, held = at, pickle.loads(anchors), []
                    a.visited |= lists.choose(a, visits)
                else:
                    held.append(pickle.loads(found))
                    if sum(len(x[0]) for x in held) > 1 << 18:
                        a, held = merged(a, held), []
        if a is not None:
            yield row()

    return run


def search(index: DataFrame, lists: Lists, dim: int, anchors: DataFrame, k: int, same: bool) -> DataFrame:
    """The anchors with their k best rows in each window; of the same label, or of others."""
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    for visits in (FIRST_VISITS, None):
        asked = anchors.mapInArrow(_visit(lists, visits), "part long, number long, asked binary")
        # what anchors ask is far larger than their table, from which Spark would take its size: never broadcast
        found = asked.hint("merge").join(index, "part").select("number", "asked", "block", "ids", "labels", "vectors").mapInArrow(_score(dim, k, same), "number long, found binary")
        both = anchors.select("number", "anchors", none("binary", "found"), F.lit(0).alias("kind")).unionByName(found.select("number", none("binary", "anchors"), "found", F.lit(1).alias("kind")))
        dealt = both.repartition("number").sortWithinPartitions("number", "kind").drop("kind")
        after = materialise(dealt.mapInArrow(_merge(lists, visits), "number long, anchors binary"), "anchors")
        free(anchors)
        anchors = after
    return anchors


def _windows(low: int, high: int, k: int):
    """Anchors with their positives, ready to search for negatives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for blob in batch.column("anchors").to_pylist():
                a: Anchors = pickle.loads(blob)
                p, there = a.score[:, 0, :], a.score[:, 0, :] > NONE
                p0 = np.where(there, p, 0)
                least, most = np.where(there, -(-low * p0 // 100), 1), np.where(there, high * p0 // 100, 0)
                out.append(pickle.dumps(Anchors.start(a.ids, a.labels, a.at, a.vectors, least, most, a.visited.shape[1], k, (a.found[:, 0, :], a.nameless[:, 0, :], p))))
            yield pa.RecordBatch.from_arrays([batch.column("number"), pa.array(out, pa.binary())], ["number", "anchors"])

    return run


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for blob in batch.column("anchors").to_pylist():
            a: Anchors = pickle.loads(blob)
            n, w, r = np.nonzero(a.score > NONE)
            ids, null, scores = a.positives
            columns = [pa.array(a.ids[n]), pa.array(ids[n, w], mask=null[n, w]), pa.array(r + 1, pa.int32()), pa.array(a.found[n, w, r], mask=a.nameless[n, w, r]), pa.array(scores[n, w]), pa.array(a.score[n, w, r])]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _OUT.split(", ")])


def mine(
    rows: DataFrame, anchor_every: int = ANCHOR_EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE, relabel_every: int = RELABEL_EVERY, labels: int = LABELS,
    id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", skipped: list[tuple[int, int]] | None = None,
) -> DataFrame:
    """A row for each anchor, positive and negative: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``skipped`` gets (visits left out, all possible visits) of both searches.
    """
    spark = rows.sparkSession
    index, lists, dim = build_index(taking_part(rows, id_col, label_col, vector_col, relabel_every, labels), scale)
    if index is None:
        return spark.createDataFrame([], _OUT)
    found = search(index, lists, dim, _anchors(index, dim, anchor_every, len(lists.radii), positives), positives, True)
    asked = materialise(found.mapInArrow(_windows(low, high, negatives), "number long, anchors binary"), "anchors")
    mined = search(index, lists, dim, asked, negatives, False)
    if skipped is not None:
        skipped += [_left_out(x) for x in (found, mined)]
    free(found, index)
    return mined.mapInArrow(_rows, _OUT)


def _left_out(anchors: DataFrame) -> tuple[int, int]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = [pickle.loads(x).visited for x in batch.column("anchors").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([int((~x).sum()) for x in seen], pa.int64()), pa.array([x.size for x in seen], pa.int64())], ["out", "all"])

    return tuple(anchors.mapInArrow(run, "out long, all long").agg(F.coalesce(F.sum("out"), F.lit(0)), F.coalesce(F.sum("all"), F.lit(0))).first())
