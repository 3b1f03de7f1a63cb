"""Substring deduplication with a log-structured fingerprint index (operator 8).

Documents become sorted runs: the fingerprint of every window of ``WINDOW`` words with the run's
smallest document that has it, cut into buckets by the fingerprint's upper bits. Inside a run every
larger document with the window is a duplicate at once, so a window that a third of all documents
share is one entry of each run, and no task gathers its documents. A bucket's index takes all
runs in, compacts them whenever ``FAN`` have gathered, and is merge-joined with every run: an entry
whose fingerprint stands in the index with a smaller document is a duplicate too. Duplicates go
back to their documents, which mark the words under duplicate windows. A fingerprint is a 64-bit
hash, by which runs are ordered and joined, and 32 bits of an independent hash by which every match
is verified.

``SubstringIndex`` keeps the runs of earlier batches in a shared folder: each batch is merged into one
run, and ``FAN`` runs of a level into one of the next, so a new batch is joined with a few compacted
runs without reading old texts. A window of an earlier batch counts as earlier whatever the ids,
unless its smallest document has the same id; so batches in order of id give what one batch gives.

Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. A null or empty text has no words; a text shorter
than the window loses none. Ids are integers; a document with a null id is not indexed and
loses nothing; rows of one id are one document (none is smaller). Windows are judged on the
input. Only the id and text columns are read. Buckets grow in number with the input, so that
one holds about ``BUCKET_WINDOWS`` entries whatever the corpus. A run is cut into at most
``2**STEP_BITS`` of them, lest its rows hold few entries; beyond that, rows are dealt by these coarse
buckets first, merged ``RUN_WINDOWS`` at a time, and cut again.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haystrata.llm.packing import pack, pack_sorted, unpack, unpack_sorted
from haystrata.llm.scratch import free, materialise
from haystrata.llm.tokens import SPACE, Words, mix, second_windows, slices, windows, words

WINDOW, FAN = 13, 8
RUN_WINDOWS, BUCKET_WINDOWS, STEP_BITS = 1 << 20, 1 << 20, 14
_LOW = np.uint64(16)

#: Entries of a run: ascending fingerprints, their second hashes, documents.
Entries = tuple[np.ndarray, np.ndarray, np.ndarray]


def _heads(prints: np.ndarray, seconds: np.ndarray) -> np.ndarray:
    """Which sorted entries are the first of their fingerprint."""
    return np.r_[True, (prints[1:] != prints[:-1]) | (seconds[1:] != seconds[:-1])] if len(prints) else np.zeros(0, bool)


def merged(runs: list[Entries]) -> Entries:
    """One run: each fingerprint with its smallest document."""
    prints, seconds, docs = (np.concatenate(x) for x in zip(*runs, strict=True))
    order = np.lexsort((seconds, prints))
    prints, seconds, docs = prints[order], seconds[order], docs[order]
    starts = np.flatnonzero(_heads(prints, seconds))
    return prints[starts], seconds[starts], np.minimum.reduceat(docs, starts) if len(starts) else docs


class FingerprintIndex:
    """Sorted runs (fingerprint, smallest document) in levels: ``fan`` runs of a level become one of the next."""

    def __init__(self, fan: int = FAN):
        self.fan, self.levels = fan, [[]]

    def add(self, run: Entries) -> None:
        self.levels[0].append(run)
        level = 0
        while len(self.levels[level]) >= self.fan:
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(merged(self.levels[level]))
            self.levels[level] = []
            level += 1

    def compact(self) -> Entries | None:
        """All runs to one."""
        runs = [r for level in self.levels for r in level]
        if len(runs) > 1:
            runs = [merged(runs)]
            self.levels = [[], runs]
        return runs[0] if runs else None

    def smallest(self, prints: np.ndarray, seconds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(known, smallest document) of a run's entries: a merge join, prints first, then the second hash."""
        run = self.compact()
        if run is None or not len(run[0]):
            return np.zeros(len(prints), bool), np.zeros(len(prints), np.int64)
        known, check, docs = run
        at = np.minimum(np.searchsorted(known, prints), len(known) - 1)
        while True:  # two fingerprints of one print lie side by side
            after = np.minimum(at + 1, len(known) - 1)
            step = (known[at] == prints) & (check[at] != seconds) & (after > at) & (known[after] == prints)
            if not step.any():
                break
            at[step] += 1
        return (known[at] == prints) & (check[at] == seconds), docs[at]


def _bucket_bits(docs: DataFrame) -> int:
    """From the bytes of all texts, about six a word."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(6, int(np.ceil(np.log2(max(1, size / 6) / BUCKET_WINDOWS))))


RUNS = "bucket int, keys binary, checks binary, seconds binary, docs binary, ids binary"
_NAMES = [c.split()[0] for c in RUNS.split(", ")]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), *[pa.binary()] * 5]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], _NAMES)


def _encode(bucket: int, prints: np.ndarray, seconds: np.ndarray, docs: np.ndarray, known: np.ndarray) -> tuple:
    """A row of ``RUNS``; ``docs`` are places in the ascending ids ``known``."""
    if len(prints) * 4 < len(known):
        own, docs = np.unique(docs, return_inverse=True)
        known = known[own]
    small = np.uint16 if len(known) <= 1 << 16 else np.uint32
    return bucket, pack_sorted(prints >> _LOW), pack((prints & np.uint64(0xFFFF)).astype(np.uint16)), pack(seconds), pack(docs.astype(small)), pack(np.diff(known, prepend=0))


def _decode(keys: bytes, checks: bytes, seconds: bytes, docs: bytes, ids: bytes) -> Entries:
    return unpack_sorted(keys) << _LOW | unpack(checks).astype(np.uint64), unpack(seconds), np.cumsum(unpack(ids))[unpack(docs)]


def _found(prints: np.ndarray, docs: np.ndarray, bits: int) -> list[tuple[int, bytes, bytes]]:
    """Duplicates in one row for each group of documents: (group, documents, prints)."""
    group = (mix(docs.view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)
    order = np.lexsort((docs, group))
    prints, docs, group = prints[order], docs[order], group[order]
    cuts = np.flatnonzero(np.r_[True, group[1:] != group[:-1], True]) if len(group) else np.zeros(1, np.int64)
    return [(int(group[a]), pack(np.diff(docs[a:b], prepend=0)), pack(prints[a:b])) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _found_batch(prints: list[np.ndarray], docs: list[np.ndarray], bits: int) -> pa.RecordBatch:
    rows = _found(np.concatenate(prints), np.concatenate(docs), bits)
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[k] for r in rows], pa.binary()) for k in (1, 2))], ["part", "docs", "keys"])


def _cut(prints: np.ndarray, seconds: np.ndarray, ids: np.ndarray, bits: int, groups: int) -> pa.RecordBatch:
    """A run of these windows: a row for each bucket, and the duplicates inside the run in a row for each group of documents.

    The latter have the bucket ``-1 - group`` and pass later steps as they are."""
    known, d = np.unique(ids, return_inverse=True)
    both = seconds.astype(np.uint64) << np.uint64(32) | d.astype(np.uint64)
    order = np.lexsort((both, prints))
    p, both = prints[order], both[order]
    c, d = (both >> np.uint64(32)).astype(np.uint32), (both & np.uint64(0xFFFFFFFF)).astype(np.int64)
    head = _heads(p, c)
    later = d > d[head][np.cumsum(head) - 1]
    later[1:] &= head[1:] | (d[1:] != d[:-1])
    out = [(-1 - g, keys, None, None, own, None) for g, own, keys in _found(p[later], known[d[later]], groups)]
    p, c, d = p[head], c[head], d[head]
    bucket = p >> np.uint64(64 - bits)
    cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True]) if len(p) else np.zeros(1, np.int64)
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        out.append(_encode(int(bucket[a]), p[a:b], c[a:b], d[a:b], known))
    return _batch(out)


def _build(window: int, bits: int, groups: int):
    """Texts to the rows of ``_cut``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints, seconds, docs, ids, n = [], [], [], [], 0

        def flush():
            out = _cut(np.concatenate(prints), np.concatenate(seconds), np.concatenate(ids)[np.concatenate(docs)], bits, groups)
            for held in (prints, seconds, docs, ids):
                held.clear()
            return out

        for piece in slices(batches, "text"):
            w = words(piece.column("text"), SPACE)
            at, p = windows(w, window)
            if not len(at):
                continue
            prints.append(p)
            seconds.append(second_windows(w, window, at))
            docs.append(np.searchsorted(w.first, at, "right") - 1 + sum(map(len, ids)))
            ids.append(piece.column("id").to_numpy(zero_copy_only=False).astype(np.int64))
            n += len(at)
            if n >= RUN_WINDOWS:
                yield flush()
                n = 0
        if n:
            yield flush()

    return run


def _recut(bits: int, groups: int):
    """Rows in order of coarse bucket: as many entries of one as a run has are merged and cut into buckets of ``bits``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = None, []

        def flush():
            out = _cut(*(np.concatenate(x) for x in zip(*held, strict=True)), bits, groups)
            held.clear()
            return out

        for b, *blobs in _buckets(batches, _NAMES):
            if held and (b != bucket or sum(len(p) for p, _, _ in held) >= RUN_WINDOWS):
                yield flush()
            bucket = b
            if b < 0:
                yield _batch([(b, *blobs)])
            else:
                held.append(_decode(*blobs))
        if held:
            yield flush()

    return run


def _regroup(bits: int):
    """Rows in order of coarse document group: as many duplicates of one as a run has are dealt to groups of ``bits``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, prints, docs = None, [], []

        def flush():
            out = _found_batch(prints, docs, bits)
            prints.clear()
            docs.clear()
            return out

        for g, d, p in _buckets(batches, ["part", "docs", "keys"]):
            if docs and (g != part or sum(map(len, docs)) >= RUN_WINDOWS):
                yield flush()
            part = g
            prints.append(unpack(p))
            docs.append(np.cumsum(unpack(d)))
        if docs:
            yield flush()

    return run


def _buckets(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple]:
    """Rows of batches as tuples."""
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in names), strict=True)


def _join(groups: int):
    """Rows in order of bucket: all runs enter the bucket's index, then each new one is joined with it.

    Duplicates leave in one row for each group of documents, whatever number of buckets a task has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held, prints, docs = None, [], [], []

        def close():
            old, new = FingerprintIndex(), FingerprintIndex()
            for fresh, entries in held:
                (new if fresh else old).add(entries)
            for fresh, (p, c, d) in held:
                if fresh:
                    known, first = new.smallest(p, c)
                    before, other = old.smallest(p, c)
                    dup = (known & (first < d)) | (before & (other != d))
                    prints.append(p[dup])
                    docs.append(d[dup])
            held.clear()

        def emit():
            out = _found_batch(prints, docs, groups)
            prints.clear()
            docs.clear()
            return out

        for b, fresh, *blobs in _buckets(batches, ["bucket", "new", *_NAMES[1:]]):
            if b != bucket and held:
                close()
            bucket = b
            if b < 0:
                prints.append(unpack(blobs[0]))
                docs.append(np.cumsum(unpack(blobs[3])))
            else:
                held.append((fresh, _decode(*blobs)))
            if sum(map(len, docs)) >= RUN_WINDOWS:
                yield emit()
        if held:
            close()
        if docs:
            yield emit()

    return run


def _compacted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of bucket: the runs of a bucket become one, in rows of ``RUN_WINDOWS`` entries at most."""
    bucket, held = None, FingerprintIndex()

    def close():
        p, c, d = held.compact()
        for a in range(0, len(p), RUN_WINDOWS):
            part = slice(a, a + RUN_WINDOWS)
            known, own = np.unique(d[part], return_inverse=True)
            yield _batch([_encode(bucket, p[part], c[part], own, known)])

    for b, *blobs in _buckets(batches, _NAMES):
        if b != bucket and bucket is not None:
            yield from close()
            held = FingerprintIndex()
        bucket = b
        held.add(_decode(*blobs))
    if bucket is not None:
        yield from close()


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of document group: one row for each document, with the prints of all its duplicate windows."""
    part, prints, docs = None, [], []

    def close():
        p, d = np.concatenate(prints), np.concatenate(docs)
        order = np.argsort(d, kind="stable")
        p, d = p[order], d[order]
        starts = np.flatnonzero(np.r_[True, d[1:] != d[:-1]]) if len(d) else np.zeros(0, np.int64)
        offsets = (np.r_[starts, len(d)] * 8).astype(np.int64)
        blobs = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(p))])
        return pa.RecordBatch.from_arrays([pa.array(d[starts], pa.int64()), blobs.cast(pa.binary())], ["id", "keys"])

    for g, d, p in _buckets(batches, ["part", "docs", "keys"]):
        if g != part and docs:
            yield close()
            prints, docs = [], []
        part = g
        docs.append(np.cumsum(unpack(d)))
        prints.append(unpack(p))
    if docs:
        yield close()


def _covered(w: Words, at: np.ndarray, dup: np.ndarray, window: int) -> np.ndarray:
    edge = np.zeros(len(w) + 1, np.int64)
    np.add.at(edge, at[dup], 1)
    np.add.at(edge, at[dup] + window, -1)
    return np.cumsum(edge)[:-1] > 0


def _kept_texts(w: Words, gone: np.ndarray) -> list[bytes]:
    """Kept words of each document, joined by one space."""
    keep = np.flatnonzero(~gone)
    edge = np.zeros(len(w.buf) + 1, np.int8)
    edge[w.starts[keep]] += 1
    edge[w.ends[keep]] -= 1
    take = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
    first = np.searchsorted(keep, w.first)  # kept words before each document
    last = np.zeros(len(keep), bool)
    full = first[1:] > first[:-1]
    last[first[1:][full] - 1] = True
    space = w.ends[keep[~last]]  # a word that is not its document's last has white space behind it
    buf = w.buf.copy()
    buf[space] = 32
    take[space] = True
    out = buf[take].tobytes()
    sizes = w.ends[keep] - w.starts[keep] + ~last
    at = np.r_[0, np.cumsum(sizes)][first].tolist()
    return [out[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def _finish(window: int, texts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "text"):
            w = words(piece.column("text"), SPACE)
            at, prints = windows(w, window)
            dup = np.zeros(len(at), bool)
            cuts = np.searchsorted(at, w.first)
            for k, found in enumerate(piece.column("keys").to_pylist()):
                if found:
                    dup[cuts[k] : cuts[k + 1]] = np.isin(prints[cuts[k] : cuts[k + 1]], np.frombuffer(found, np.uint64))
            gone = _covered(w, at, dup, window)
            removed = np.add.reduceat(np.r_[gone, False].astype(np.int64), w.first[:-1]) if len(w.first) > 1 else np.zeros(0, np.int64)
            n = np.diff(w.first)
            removed[n == 0] = 0
            kept = _kept_texts(w, gone)
            arrays = [piece.column("id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in kept])]
            names = ["id", "n_words", "n_removed", "kept_sha256"]
            if texts:
                arrays.append(pa.array([t.decode("utf-8") for t in kept], pa.string()))
                names.append("kept_text")
            yield pa.RecordBatch.from_arrays(arrays, names)

    return run


def _rows(docs: DataFrame, id_col: str, text_col: str, window: int, bits: int) -> DataFrame:
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter(F.col("id").isNotNull())
    coarse = min(bits, STEP_BITS)
    rows = texts.mapInArrow(_build(window, coarse, coarse), RUNS)
    return rows if bits == coarse else _by_bucket(rows).mapInArrow(_recut(bits, coarse), RUNS)


def _by_bucket(rows: DataFrame) -> DataFrame:
    return rows.repartition(F.col("bucket")).sortWithinPartitions("bucket")


def build_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, bits: int | None = None) -> DataFrame:
    """The sorted runs of a batch; ``bits`` must agree between batches of one index."""
    bits = _bucket_bits(docs.select(F.col(text_col).alias("text"))) if bits is None else bits
    return _rows(docs, id_col, text_col, window, bits).filter("bucket >= 0")


def _dedup(docs: DataFrame, rows: DataFrame, id_col: str, text_col: str, window: int, history: DataFrame | None, bits: int, texts: bool) -> DataFrame:
    kind = docs.schema[id_col].dataType.simpleString()
    rows = rows.withColumn("new", F.lit(True))
    if history is not None:
        rows = rows.unionByName(history.withColumn("new", F.lit(False)))
    coarse, kinds = min(bits, STEP_BITS), "part int, docs binary, keys binary"
    by_part = lambda x: x.repartition(F.col("part")).sortWithinPartitions("part")
    found = _by_bucket(rows).mapInArrow(_join(coarse), kinds)
    if bits > coarse:
        found = by_part(found).mapInArrow(_regroup(bits), kinds)
    found = by_part(found).mapInArrow(_gather, "id long, keys binary")
    found = materialise(found, "duplicate-windows").select(F.col("id").alias("found_id"), "keys")
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    own = own.join(found, F.col("id").cast("long") == F.col("found_id"), "left").select("id", "text", "keys")
    out = own.mapInArrow(_finish(window, texts), f"id {kind}, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * texts)
    return out.withColumnRenamed("id", id_col)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, history: DataFrame | None = None, bits: int | None = None, texts: bool = False) -> DataFrame:
    """One row per document: ``id_col``, n_words, n_removed, kept_sha256 (and kept_text if ``texts``).

    ``history``: runs of earlier batches from ``build_runs`` with the same ``bits``; their
    windows count as historical, their documents are not read again.
    """
    if bits is None:
        bits = _bucket_bits(docs.select(F.col(text_col).alias("text")))
    return _dedup(docs, _rows(docs, id_col, text_col, window, bits), id_col, text_col, window, history, bits, texts)


class SubstringIndex:
    """Runs of earlier batches under ``path``, a folder that all executors share.

    A table ``<bits>-<level>-<name>`` is one compacted run. It counts once it is written whole; tables that a merge
    replaces go afterwards, and since a merge keeps the smallest document of each fingerprint, a table that outlives
    its merge changes nothing. ``bits`` (buckets) is chosen for the corpus to come, ``BUCKET_WINDOWS`` to a bucket.
    """

    def __init__(self, spark: SparkSession, path: str, bits: int, window: int = WINDOW, fan: int = FAN):
        self.spark, self.path, self.bits, self.window, self.fan = spark, path.rstrip("/"), bits, window, fan

    def _fs(self):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def tables(self) -> list[tuple[int, str]]:
        """(level, path) of the whole runs, lower levels first."""
        at, fs = self._fs()
        out = []
        for status in fs.listStatus(at) if fs.exists(at) else []:
            name = status.getPath().getName()
            bits, level = map(int, name.split("-")[:2])
            if bits != self.bits:
                raise ValueError(f"the index at {self.path} has 2**{bits} buckets, not 2**{self.bits}")
            if fs.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
                out.append((level, f"{self.path}/{name}"))
        return sorted(out)

    def runs(self, paths: list[str] | None = None) -> DataFrame | None:
        """The index as a table of ``RUNS``; None if it is empty."""
        paths = [p for _, p in self.tables()] if paths is None else paths
        return self.spark.read.schema(RUNS).parquet(*paths) if paths else None

    def _write(self, rows: DataFrame, level: int) -> None:
        _by_bucket(rows).mapInArrow(_compacted, RUNS).write.parquet(f"{self.path}/{self.bits}-{level}-{uuid.uuid4().hex}")

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts: bool = False) -> DataFrame:
        """``dedup`` of a batch against all earlier ones; then the batch's run enters and full levels are merged."""
        rows = materialise(_rows(docs, id_col, text_col, self.window, self.bits), "runs")
        out = _dedup(docs, rows, id_col, text_col, self.window, self.runs(), self.bits, texts)
        self._write(rows.filter("bucket >= 0"), 0)
        free(rows)
        level = 0
        while len(full := [p for k, p in self.tables() if k == level]) >= self.fan:
            self._write(self.runs(full), level + 1)
            _, fs = self._fs()
            for path in full:
                fs.delete(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path), True)
            level += 1
        return out
