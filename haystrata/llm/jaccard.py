"""N-gram Jaccard join by set-relation skipping (operator 9).

A document's set: 64-bit hashes of its distinct ``SHINGLE``-word shingles. Tokens have one
global order, rare first: a count sketch of fixed size over all shingles of all documents gives
each token a frequency class, the token's hash decides inside a class (any fixed order is
exact; the sketch only keeps lists short). With Jaccard >= t two sets, the smaller of n tokens,
share ``share(n)`` tokens among the first n - ceil(t n) + share(n) of each. A posting is live if its
list has a set within the size bound, a set if it has as many live postings as its smallest
partner would have to share with it.

Set relations are used at four levels:

* Equal sets are one set: all documents of a set follow its smallest document.
* A list's anchor is its smallest set, and a set's family is the anchor that most of its lists
  have: near copies share it. Families are dealt in blocks, and every pair of blocks is a task,
  so no task holds a family that is large. Parity bitmaps, which bound the symmetric difference of
  two sets from below, first drop the sets that no other set of the family can link with.
* Answers: in a task a set that is like an earlier one takes that as its anchor and keeps only its
  differences from it. The overlap of two sets of one anchor is derived from the anchor's answers:
  bounds from the two overlaps with the anchor decide most pairs, the differences the others.
  A set is compared with sets of other components only.
* Lists that still hold several families and several components are read in order of size and
  position; blocks of a list whose size or position cannot reach t are skipped. Long lists are
  dealt in blocks too, and folded bitmaps travel with their sets, so pairs are judged where the list is read and
  never leave as rows: first only pairs that would make one of the components of a list (fewer than its sets)
  are verified; then, with the components that this leaves, every set that a set of another component may link
  with is marked once, and each list's marked sets are compared on their tokens.

Components are the exact connected components of all links. Null and empty texts have no shingle
and link with nothing; a shorter text is one shingle. Ids are integers; rows of one id are one
node; a row with a null id links with nothing and has a null component. Only the id and text
columns are read. Two different shingles of two compared sets have one hash with a chance of
n**2 / 2**64, so links are exact at any corpus size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haystrata.llm.components import connected_components
from haystrata.llm.packing import pack, unpack
from haystrata.llm.scratch import free, materialise
from haystrata.llm.tokens import SPACE, sequence_hash, slices, windows, words

SHINGLE, PERCENT = 3, 90
SKETCH_BITS, CHUNK_BITS = 20, 4
#: Two linked sets, the smaller of n tokens, share SHARED + n / SHARED_PART tokens (or all that they must) among their prefixes.
SHARED, SHARED_PART = 4, 32
#: A family of T tokens is dealt in about sqrt(T / FAMILY_TOKENS) blocks, a list of L sets in sqrt(L / LIST_SETS).
FAMILY_TOKENS, LIST_SETS = 1 << 15, 1 << 10
#: Bits at most of the bitmap that travels with a set of a list.
LIST_BITS = 1 << 11
_LISTED = ("token", "one", "two", "part", "n", "pos", "rep", "comp", "family")


def share(n, percent: int):
    """Tokens that a set of ``n`` shares in the prefixes with any larger set that it links with."""
    return np.minimum((percent * n + 99) // 100, SHARED + n // SHARED_PART)


def _share_sql(n: str, percent: int) -> str:
    return f"least(({percent} * {n} + 99) div 100, {SHARED} + {n} div {SHARED_PART})"


def shingles(texts: pa.Array, k: int, percent: int = 0) -> list[np.ndarray]:
    """Distinct shingle hashes of each text, ascending."""
    w = words(texts, SPACE, lower=True)
    at, h = windows(w, k)
    doc = np.searchsorted(w.first, at, "right") - 1
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    fresh = np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])] if len(h) else np.zeros(0, bool)
    h, doc = h[fresh], doc[fresh]
    n = len(w.first) - 1
    cuts = np.searchsorted(doc, np.arange(n + 1))
    out = [h[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    sizes = np.diff(w.first)
    for d in np.flatnonzero((sizes > 0) & (sizes < k)):
        out[d] = np.array([sequence_hash(w.hashes[w.first[d] : w.first[d + 1]])], np.uint64)
    return out


def _counts(k: int):
    """A task's sketch of document frequencies, in chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        for piece in slices(batches, "text"):
            own = shingles(piece.column("text"), k)
            if own:
                total += np.bincount((np.concatenate(own) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(total))
        if total.any():
            parts = total.reshape(1 << CHUNK_BITS, -1)
            kind = np.uint32 if total.max() < 2**32 else np.int64
            yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([pack(p.astype(kind)) for p in parts], pa.binary())], ["chunk", "counts"])

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of chunk: one sum of each, as frequency classes in bytes."""
    chunk, total = None, None
    close = lambda: pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([np.ceil(np.log2(total + 1.0)).astype(np.uint8).tobytes()], pa.binary())], ["chunk", "classes"])
    for batch in batches:
        for c, blob in zip(batch.column("chunk").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            if c != chunk and chunk is not None:
                yield close()
                total = None
            chunk, own = c, unpack(blob).astype(np.int64)
            total = own if total is None else total + own
    if chunk is not None:
        yield close()


def frequency_classes(texts: DataFrame, k: int) -> np.ndarray:
    """One byte for each of 2**SKETCH_BITS buckets of tokens."""
    rows = texts.select("text").mapInArrow(_counts(k), "chunk int, counts binary").repartition(F.col("chunk")).sortWithinPartitions("chunk").mapInArrow(_added, "chunk int, classes binary").collect()
    out = np.zeros(1 << SKETCH_BITS, np.uint8)
    size = len(out) >> CHUNK_BITS
    for row in rows:
        out[row["chunk"] * size : (row["chunk"] + 1) * size] = np.frombuffer(row["classes"], np.uint8)
    return out


def bitmap(h: np.ndarray) -> bytes:
    """At least two bits a token: bit h mod size is the parity of the tokens there. Tokens that two sets do
    not share number at least the bits in which their bitmaps differ; halves fold by exclusive or."""
    bits = max(64, 1 << (2 * len(h) - 1).bit_length())
    odd = np.bincount((h & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def digests(h: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums over a set."""
    return int(np.bitwise_xor.reduce(h * np.uint64(0x9E3779B97F4A7C15) ^ (h >> np.uint64(29)))), int(np.sum((h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9), dtype=np.uint64))


def _sets(k: int, percent: int, classes):
    """id, set size, two digests of the set, its prefix in the global order, its bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rare = classes.value
        for piece in slices(batches, "text"):
            own = shingles(piece.column("text"), k)
            marks, prefixes = [digests(h) if len(h) else (0, 0) for h in own], []
            for h in own:
                n = len(h)
                p = n - (percent * n + 99) // 100 + int(share(n, percent))
                order = np.lexsort((h, rare[(h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]))[:p]
                prefixes.append(h[order])
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(p) for p in prefixes])], pa.int32()), pa.array(np.concatenate(prefixes).view(np.int64) if prefixes else np.zeros(0, np.int64)))
            one, two = (pa.array(np.array([m[j] for m in marks], np.uint64).view(np.int64)) for j in (0, 1))
            maps = pa.array([bitmap(h) if len(h) else b"" for h in own], pa.binary())
            yield pa.RecordBatch.from_arrays([piece.column("id"), pa.array([len(h) for h in own], pa.int64()), one, two, lists, maps], ["id", "n", "one", "two", "prefix", "map"])

    return run


def _tokens(k: int):
    """The text becomes its token set; other columns stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "text"):
            own = shingles(piece.column("text"), k)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(p) for p in own])], pa.int32()), pa.array(np.concatenate(own).view(np.int64)))
            names = [c for c in piece.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in names), lists], [*names, "tokens"])

    return run


def _overlaps(percent: int):
    """Links among pairs of token sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column("x"), batch.column("y")
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                a, b = x[i].values.to_numpy().view(np.uint64), y[i].values.to_numpy().view(np.uint64)
                if len(a) > len(b):
                    a, b = b, a
                at = np.searchsorted(b, a)
                at[at == len(b)] = 0
                both = int((b[at] == a).sum()) if len(b) else 0
                keep[i] = both > 0 and 100 * both >= percent * (len(a) + len(b) - both)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(keep)), batch.column("b").filter(pa.array(keep))], ["a", "b"])

    return run


def _overlap(a: np.ndarray, b: np.ndarray) -> int:
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def _live(percent: int):
    """Postings in order of token, size and set: those whose list has a neighbour within the size bound (sizes
    ascend, so the nearest decides), with the list's first set as anchor. The first and last posting of a task
    may have their neighbour in another task and stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, anchor, before = np.zeros((4, 0), np.int64), None, None

        def emit(rows: np.ndarray, behind: np.ndarray | None):
            """Rows whose successor is known (``behind`` is the one after the last)."""
            nonlocal anchor, before
            token, n, pos, rep = rows
            head = np.r_[before is None or before[0] != token[0], token[1:] != token[:-1]]
            start = np.maximum.accumulate(np.where(head, np.arange(len(token)), -1))
            first = np.where(start >= 0, rep[np.maximum(start, 0)], 0 if anchor is None else anchor)
            prior = np.r_[0 if before is None else before[1], n[:-1]]
            keep = ~head & (100 * prior >= percent * n)
            then = np.r_[token[1:], token[-1] if behind is None else behind[0]], np.r_[n[1:], n[-1] if behind is None else behind[1]]
            keep |= (then[0] == token) & (100 * n >= percent * then[1])
            keep[0] |= before is None
            anchor, before = int(first[-1]), (int(token[-1]), int(n[-1]))
            return pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in (token, n, pos, rep, first)], ["token", "n", "pos", "rep", "anchor"])

        for batch in batches:
            held = np.concatenate([held, np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])], axis=1)
            if held.shape[1] > 1:
                yield emit(held[:, :-1], held[:2, -1])
                held = held[:, -1:]
        if held.shape[1]:
            yield emit(held, None)

    return run


def _maps(blobs: pa.ChunkedArray, bits: int) -> np.ndarray:
    """Bitmaps as rows of 64-bit words, folded to ``bits``."""
    out = np.zeros((len(blobs), bits // 64), np.uint64)
    for k, blob in enumerate(blobs):
        own = np.frombuffer(blob.as_buffer(), np.uint64)
        while len(own) > bits // 64:
            own = own[: len(own) // 2] ^ own[len(own) // 2 :]
        out[k] = own
    return out


def _by_size(n: np.ndarray, most: int | None = None) -> list[tuple[int, int, int]]:
    """(first, end, bits) of sets whose bitmaps, folded to ``most`` bits, have one size; ``n`` ascends."""
    bits = np.array([max(64, 1 << (2 * int(x) - 1).bit_length()) for x in n], np.int64)
    bits = bits if most is None else np.minimum(bits, most)
    cuts = np.flatnonzero(np.r_[True, bits[1:] != bits[:-1], True]) if len(n) else np.zeros(1, np.int64)
    return [(int(a), int(b), int(bits[a])) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


class Neighbours:
    """Sets in order of size with their bitmaps: which later sets can link with one of them."""

    def __init__(self, n: np.ndarray, blobs: pa.ChunkedArray, percent: int, most: int | None = None):
        self.n, self.percent, self.classes = n, percent, []
        for a, b, bits in _by_size(n, most):
            # a linked set has at most twice the tokens, so its bitmap folds once at most
            end = int(np.searchsorted(n, 100 * n[b - 1] // percent, "right"))
            self.classes.append((a, b, _maps(blobs[a:end], bits)))

    def after(self, i: int, candidates: np.ndarray) -> np.ndarray:
        """Of ascending later places the ones whose size and bitmap allow a link with set ``i``."""
        first, _, maps = next(c for c in self.classes if c[0] <= i < c[1])
        j = candidates[: np.searchsorted(candidates, np.searchsorted(self.n, 100 * self.n[i] // self.percent, "right"))]
        apart = np.bitwise_count(maps[j - first] ^ maps[i - first]).sum(axis=1, dtype=np.int64)
        return j[(100 + self.percent) * apart <= (100 - self.percent) * (self.n[j] + self.n[i])]


def _ordered(table: pa.Table) -> pa.Table:
    return table.sort_by([("n", "ascending"), ("rep", "ascending")])


def _may_link(percent: int):
    """One pair of a family's blocks: the sets that some other set of it may link with."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table, split = _ordered(table), key[1] != key[2]
        n, part = table.column("n").to_numpy(), table.column("part").to_numpy()
        near, found, places = Neighbours(n, table.column("map"), percent), np.zeros(len(n), bool), np.arange(len(n))
        for i in range(len(n) - 1):
            j = places[i + 1 :]
            if split:
                j = j[part[j] != part[i]]
            if found[i]:
                j = j[~found[j]]
            j = near.after(i, j)
            found[j] = True
            found[i] |= len(j) > 0
        return pa.table({"rep": table.column("rep").filter(pa.array(found))})

    return run


class Answers:
    """Sets by their difference from an earlier, similar set, their anchor, whose answers they start from."""

    def __init__(self, sets: list[np.ndarray], near: Neighbours, percent: int):
        self.sets, self.percent, m = sets, percent, len(sets)
        self.n = np.array([len(s) for s in sets], np.int64)
        self.anchor, self.both = np.arange(m), self.n.copy()
        self.more, self.less = [np.zeros(0, np.uint64)] * m, [np.zeros(0, np.uint64)] * m
        taken = np.zeros(m, bool)
        for a in range(m):
            if taken[a]:
                continue
            open_ = a + 1 + np.flatnonzero(~taken[a + 1 :])
            for x in near.after(a, open_).tolist():
                hit = self._inside(sets[x], sets[a])
                self.anchor[x], self.both[x], taken[x] = a, int(hit.sum()), True
                self.more[x] = sets[x][~hit]
                self.less[x] = sets[a][~self._inside(sets[a], sets[x])]

    @staticmethod
    def _inside(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which tokens of one set another has."""
        at = np.searchsorted(b, a)
        at[at == len(b)] = 0
        return b[at] == a

    def links(self, i: int, j: np.ndarray) -> np.ndarray:
        """1 where the anchor's answers make a link certain, 0 where they leave it open, -1 where they rule it out."""
        one = self.anchor[j] == self.anchor[i]
        least = self.both[i] + self.both[j] - self.n[self.anchor[i]]
        most = np.minimum(self.both[i], self.both[j]) + np.minimum(self.n[i] - self.both[i], self.n[j] - self.both[j])
        need = self.percent * (self.n[i] + self.n[j])
        return np.where(one, np.where((100 + self.percent) * least >= need, 1, np.where((100 + self.percent) * most < need, -1, 0)), 0)

    def overlap(self, i: int, j: int) -> int:
        if self.anchor[i] != self.anchor[j]:
            return int(self._inside(self.sets[i], self.sets[j]).sum())
        a = self.anchor[i]
        gone = len(np.union1d(self.less[i], self.less[j]))
        added = int(self._inside(self.more[i], self.more[j]).sum()) if len(self.more[j]) else 0
        return int(self.n[a]) - gone + added


def _solve(percent: int):
    """One pair of blocks of a family, or of a list's marked sets: the sets that come to a component with a smaller name, and its name."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table, split = _ordered(table), key[1] != key[2]
        ids, n, part = (table.column(c).to_numpy() for c in ("rep", "n", "part"))
        near = Neighbours(n, table.column("map"), percent)
        answers = Answers([x.values.to_numpy().view(np.uint64) for x in table.column("tokens")], near, percent)
        listed = "comp" in table.column_names  # a family has no components yet
        names = table.column("comp").to_numpy() if listed else ids
        family = table.column("family").to_numpy() if listed else np.arange(len(ids))
        comp, places = np.unique(names, return_inverse=True)[1], np.arange(len(ids))
        for i in range(len(ids)):
            j = places[i + 1 :]
            j = j[(comp[j] != comp[i]) & (family[j] != family[i])]
            if split:
                j = j[part[j] != part[i]]
            j = near.after(i, j)
            for x, known in zip(j.tolist(), answers.links(i, j).tolist(), strict=True):
                if known >= 0 and comp[x] != comp[i] and (known or (100 + percent) * answers.overlap(i, x) >= percent * (n[i] + n[x])):
                    comp[comp == comp[x]] = comp[i]
        least = np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(least, comp, names)
        moved = pa.array(least[comp] != names)
        return pa.table({"node": pa.array(ids, pa.int64()).filter(moved), "component": pa.array(least[comp], pa.int64()).filter(moved)})

    return run


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bitmaps (the last column) of at most ``LIST_BITS`` bits."""
    for batch in batches:
        out = []
        for blob in batch.column("map"):
            own = np.frombuffer(blob.as_buffer(), np.uint64)
            while len(own) > LIST_BITS // 64:
                own = own[: len(own) // 2] ^ own[len(own) // 2 :]
            out.append(own.tobytes())
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.binary())], batch.schema.names)


def _cross(percent: int, all_pairs: bool):
    """Postings with folded bitmaps in order of token, blocks, size, position: which sets of different families and components
    size, position and bitmap allow to link. No more rows leave than come in: with ``all_pairs`` the sets of all such
    pairs, each once; else pairs, of which each would join two components that those before it have not joined."""

    def found(rows: np.ndarray, maps: pa.ChunkedArray) -> tuple[np.ndarray, list[tuple[int, int]]]:
        _, one, two, part, n, pos, rep, comp, family = rows
        split, near, marked, joins = one[0] != two[0], None, np.zeros(len(n), bool), []
        comp = np.unique(comp, return_inverse=True)[1]
        # blocks of equal size: whole blocks beyond the size bound are skipped
        blocks = np.r_[np.flatnonzero(np.r_[True, n[1:] != n[:-1]]), len(n)]
        for i in range(len(n)):
            most, spans = 100 * n[i] // percent, []
            j = i + 1
            while j < len(n) and n[j] <= most:
                end = blocks[np.searchsorted(blocks, j, "right")]
                # a pair's first shared tokens are needed, so as many may lie before this one
                need = -(-percent * (n[i] + n[j]) // (100 + percent)) - (int(share(n[i], percent)) - 1)
                if min(n[i] - pos[i], n[j] - pos[j]) >= need:  # else every later position of the block has less room still
                    spans.append(np.arange(j, j + int(np.searchsorted(pos[j:end], n[j] - need, "right"))))
                j = end
            if not spans:
                continue
            other = np.concatenate(spans)
            other = other[(comp[other] != comp[i]) & (family[other] != family[i])]
            if split:
                other = other[part[other] != part[i]]
            if marked[i]:
                other = other[~marked[other]]
            if not len(other):
                continue
            near = near or Neighbours(n, maps, percent, LIST_BITS)
            other = near.after(i, other)
            if all_pairs:
                marked[other] = True
                marked[i] |= len(other) > 0
            else:
                for x in other.tolist():
                    if comp[x] != comp[i]:
                        joins.append((max(rep[i], rep[x]), min(rep[i], rep[x])))
                        comp[comp == comp[x]] = comp[i]
        return rows[:, marked], joins

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, maps = np.zeros((len(_LISTED), 0), np.int64), pa.chunked_array([], pa.binary())

        def emit(block, blobs):
            cuts = np.r_[np.flatnonzero(np.r_[True, (block[:3, 1:] != block[:3, :-1]).any(axis=0)]), block.shape[1]]
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                marked, joins = found(block[:, a:b], blobs.slice(a, b - a))
                out = marked if all_pairs else np.array(joins, np.int64).reshape(-1, 2).T
                if out.shape[1]:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], list(_LISTED) if all_pairs else ["a", "b"])

        for batch in batches:
            rest = np.concatenate([rest, np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in _LISTED])], axis=1)
            maps = pa.chunked_array([*maps.chunks, batch.column("map")], pa.binary())
            if rest.shape[1]:
                cut = int(np.flatnonzero((rest[:3] == rest[:3, -1:]).all(axis=0))[0])  # the last list may go on
                yield from emit(rest[:, :cut], maps.slice(0, cut)) if cut else ()
                rest, maps = rest[:, cut:], maps.slice(cut)
        if rest.shape[1]:
            yield from emit(rest, maps)

    return run


def _close(percent: int):
    """Pairs whose bitmaps allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            sizes = batch.column("n").to_numpy() + batch.column("m").to_numpy()
            for k, (x, y) in enumerate(zip(batch.column("x"), batch.column("y"), strict=True)):
                x, y = (np.frombuffer(b.as_buffer(), np.uint64) for b in (x, y))
                while len(x) != len(y):
                    x, y = sorted((x, y), key=len)
                    y = y[: len(y) // 2] ^ y[len(y) // 2 :]
                keep[k] = (100 + percent) * int(np.bitwise_count(x ^ y).sum(dtype=np.int64)) <= (100 - percent) * sizes[k]
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep)) for c in ("a", "b")], ["a", "b"])

    return run


def _in_blocks(rows: DataFrame, parts: str) -> DataFrame:
    """Rows with a column ``part`` below ``parts`` once for each pair of blocks (one, two) that theirs is of."""
    rows = rows.withColumn("other", F.explode(F.expr(f"sequence(0L, {parts} - 1)")))
    return rows.select("*", F.least("part", "other").alias("one"), F.greatest("part", "other").alias("two")).drop("other")


def _token_sets(texts: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """id, tokens and the other columns of ``wanted`` (rep first) for the texts of those ids."""
    columns = [f for f in wanted.schema.fields if f.name != "rep"]
    own = texts.join(wanted, F.col("id") == F.col("rep")).select("id", "text", *(f.name for f in columns))
    schema = ", ".join(["id long", *(f"{f.name} {f.dataType.simpleString()}" for f in columns), "tokens array<bigint>"])
    return own.mapInArrow(_tokens(k), schema).withColumnRenamed("id", "rep")


def _cross_links(live: DataFrame, labels: DataFrame, keys: DataFrame, reps: DataFrame, texts: DataFrame, k: int, percent: int, all_pairs: bool) -> DataFrame:
    """Verified links (a, b) between sets of different families and components, or (``all_pairs``) from sets to the components that they come to."""
    placed = live.join(labels, live["rep"] == labels["node"], "left").join(keys, live["rep"] == keys["member"], "left")
    placed = materialise(placed.select("token", "n", "pos", "rep", F.coalesce("component", "rep").alias("comp"), F.coalesce("family", F.xxhash64("rep")).alias("family")), "placed")
    lists = placed.groupBy("token").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.min("family").alias("f0"), F.max("family").alias("f1"), F.count(F.lit(1)).alias("sets"))
    lists = lists.filter("c0 < c1 and f0 < f1").select("token", F.ceil(F.sqrt(F.col("sets") / LIST_SETS)).cast("long").alias("parts"))
    maps = reps.select("rep", "n", "map")
    rest = placed.join(lists, "token").join(maps.mapInArrow(_folded, "rep long, n long, map binary"), ["rep", "n"]).withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")))
    rest = _in_blocks(rest, "parts").select(*_LISTED, "map")
    rest = rest.repartition("token", "one", "two").sortWithinPartitions("token", "one", "two", "n", "pos", "rep")
    if all_pairs:
        marked = materialise(rest.mapInArrow(_cross(percent, True), ", ".join(f"{c} long" for c in _LISTED)), "marked")
        free(placed)
        wanted = marked.select("rep", "n").distinct().join(maps, ["rep", "n"])
        sets = materialise(_token_sets(texts, wanted, k).filter(F.size("tokens") == F.col("n")), "marked-sets")
        links = marked.join(sets, ["rep", "n"]).groupBy("token", "one", "two").applyInArrow(_solve(percent), "node long, component long")
        links = materialise(links.select(F.col("node").alias("a"), F.col("component").alias("b")).distinct(), "verified")
        free(marked, sets)
        return links
    found = materialise(rest.mapInArrow(_cross(percent, False), "a long, b long").distinct(), "pairs")
    free(placed)
    x = reps.select(F.col("rep").alias("a"), "n", F.col("map").alias("x"))
    y = reps.select(F.col("rep").alias("b"), F.col("n").alias("m"), F.col("map").alias("y"))
    pairs = materialise(found.join(x, "a").join(y, "b").select("a", "b", "n", "m", "x", "y").mapInArrow(_close(percent), "a long, b long"), "close-pairs")
    free(found)
    ids = pairs.select(F.col("a").alias("rep")).unionByName(pairs.select(F.col("b").alias("rep"))).distinct()
    sets = materialise(_token_sets(texts, ids, k), "pair-sets")
    links = materialise(verified(pairs, sets, percent), "verified")
    free(pairs, sets)
    return links


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of sets (rep, tokens) that link."""
    x = sets.select(F.col("rep").alias("a"), F.col("tokens").alias("x"))
    y = sets.select(F.col("rep").alias("b"), F.col("tokens").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(_overlaps(percent), "a long, b long")


def linked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per document: ``id_col``, n_shingles, component_id (smallest id reachable by links)."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    classes = spark.sparkContext.broadcast(frequency_classes(texts, k))  # 2**SKETCH_BITS bytes
    sets = materialise(texts.mapInArrow(_sets(k, percent, classes), "id long, n long, one long, two long, prefix array<bigint>, map binary"), "sets")
    known = sets.filter(F.col("id").isNotNull() & (F.col("n") > 0))
    reps = materialise(known.groupBy("n", "one", "two").agg(F.min("id").alias("rep"), F.any_value("prefix").alias("prefix"), F.any_value("map").alias("map")), "representatives")
    rows = materialise(sets.select("id", "n", "one", "two"), "rows")
    free(sets)

    postings = reps.select(F.posexplode("prefix").alias("pos", "token"), "n", "rep").select("token", "n", F.col("pos").cast("long").alias("pos"), "rep")
    # dealt by range: a list that many sets have is cut wherever a task is full
    postings = postings.repartitionByRange("token", "n", "rep").sortWithinPartitions("token", "n", "rep").mapInArrow(_live(percent), "token long, n long, pos long, rep long, anchor long")
    postings = materialise(postings, "postings")
    least = F.expr(_share_sql(f"(({percent} * n + 99) div 100)", percent))
    enough = postings.groupBy("rep", "n").agg(F.count(F.lit(1)).alias("lists")).filter(F.col("lists") >= least).select("rep")
    live = materialise(postings.join(enough, "rep", "left_semi"), "live")
    free(postings)

    votes = live.groupBy("rep", "n", "anchor").agg(F.count(F.lit(1)).alias("votes"))
    families = materialise(votes.groupBy("rep", "n").agg(F.max(F.struct("votes", (-F.col("anchor")).alias("mark")))["mark"].alias("anchor")).select("rep", "n", (-F.col("anchor")).alias("family")), "families")
    blocks = F.ceil(F.sqrt(F.col("tokens") / FAMILY_TOKENS)).cast("long")
    large = families.groupBy(F.col("family").alias("large")).agg(F.sum("n").alias("tokens")).filter(F.col("tokens") > FAMILY_TOKENS).select("large", blocks.alias("parts"))
    members = families.join(large, F.col("family") == F.col("large"), "left").select("rep", "n", "family", F.coalesce("parts", F.lit(1).cast("long")).alias("parts"))
    members = materialise(members.withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts"))), "members")
    free(families)
    mapped = members.join(reps.select(F.col("rep").alias("own"), F.col("n").alias("size"), "map"), (F.col("rep") == F.col("own")) & (F.col("n") == F.col("size"))).select("rep", "n", "family", "parts", "part", "map")
    mapped = materialise(mapped, "bitmaps")
    near = materialise(_in_blocks(mapped, "parts").groupBy("family", "one", "two").applyInArrow(_may_link(percent), "rep long").distinct(), "near")
    wanted = materialise(_token_sets(texts, mapped.join(near, "rep", "left_semi"), k), "token-sets")
    own = wanted.filter(F.size("tokens") == F.col("n"))  # of rows that repeat an id, the one that the bitmap is of
    solved = materialise(_in_blocks(own, "parts").groupBy("family", "one", "two").applyInArrow(_solve(percent), "node long, component long").distinct(), "solved")
    keys = materialise(members.select(F.col("rep").alias("member"), "family"), "keys")
    free(mapped, near, wanted, members)

    links = solved.select(F.col("node").alias("a"), F.col("component").alias("b"))
    labels = connected_components(links)
    found = [solved]
    for all_pairs in (False, True):
        more = _cross_links(live, labels, keys, reps, texts, k, percent, all_pairs)
        found.append(more)
        links = links.unionByName(more)
        free(labels)
        labels = connected_components(links)
    free(live, keys, *found)

    classed = reps.select("n", "one", "two", "rep").join(labels, F.col("rep") == F.col("node"), "left").select("n", "one", "two", F.coalesce("component", "rep").alias("component"))
    out = rows.join(classed, ["n", "one", "two"], "left")
    own = F.when(F.col("id").isNotNull() & (F.col("n") > 0), F.col("component")).otherwise(F.col("id"))
    out = materialise(out.select(F.col("id").cast(kind).alias(id_col), F.col("n").alias("n_shingles"), own.alias("component_id")), "linked")
    free(reps, rows, labels)
    return out


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """The documents, all columns: of each component one, with the smallest id.

    An id is no name where it is null or repeated: such rows go by a number made of id and text, below
    all ids, so that rows of one id with different texts are judged each by its own text, and of rows that
    repeat id and text one stays. Other columns may have any name.
    """
    rows = docs.toDF(*(f"c{j}" for j in range(len(docs.columns))))
    own, text = (f"c{docs.columns.index(c)}" for c in (id_col, text_col))
    often = materialise(rows.groupBy(F.col(own).alias("often")).agg(F.count(F.lit(1)).alias("times")).filter((F.col("times") > 1) | F.col("often").isNull()).select("often", F.lit(True).alias("many")), "repeated-ids")
    rows = rows.join(often, F.col(own).eqNullSafe(F.col("often")), "left")
    nameless = F.col("many").isNotNull()
    number = F.xxhash64(F.coalesce(F.col(own).cast("string"), F.lit("null")), F.coalesce(text, F.lit("")), F.col(text).isNull())
    rows = rows.withColumn("node", F.when(nameless, F.least(number, F.lit(-1).cast("long").bitwiseXOR(number))).otherwise(F.col(own).cast("long")))
    found = linked(rows, "node", text, k, percent)
    dropped = materialise(found.filter(F.col("component_id") != F.col("node")).select(F.col("node").alias("gone")).distinct(), "dropped")
    free(found)
    kept = rows.join(dropped, F.col("node") == F.col("gone"), "left_anti")
    same = kept.filter(nameless).dropDuplicates(["node"])
    return kept.filter(~nameless).unionByName(same).drop("often", "many", "node").toDF(*docs.columns)
