"""Exact deduplication with counting quotient filters (operator 5).

1. Every partition builds a counting quotient filter over 64-bit fingerprints of its
   normalised texts: a fingerprint's high bits are its quotient, the low bits its
   remainder; runs of remainders lie sorted in quotient order, each with a count.
2. Filters are cut at quotient boundaries into segments; filters of one segment merge
   losslessly by their sorted remainders, counts added. A text with a million copies is
   one entry of each filter, so no task gathers the copies.
3. Fingerprints counted more than once route their texts to byte verification: grouping by
   the text itself, combined in each task before the shuffle.

Null texts count as empty; empty texts equal one another. Rows that repeat a doc_id with an
equal text are one document and get the same decision (``without_copies`` keeps one of them). A
null doc_id sorts below all others.
Only the id and text columns are read, so other columns can have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haystrata.llm.scratch import free, materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fingerprints a merged segment should hold.
SEGMENT = 1 << 17


@dataclass
class CountingQuotientFilter:
    """Sorted runs of remainders; ``occupied`` marks quotients in use, ``runends`` the last slot of each run."""

    q_bits: int
    r_bits: int
    occupied: np.ndarray
    runends: np.ndarray
    remainders: np.ndarray
    counts: np.ndarray

    @classmethod
    def of_sorted(cls, keys: np.ndarray, counts: np.ndarray, q_bits: int, r_bits: int) -> CountingQuotientFilter:
        """keys: distinct, ascending, of q_bits + r_bits bits."""
        quotients = (keys >> np.uint64(r_bits)).astype(np.int64)
        occupied = np.zeros(1 << q_bits, np.uint8)
        occupied[quotients] = 1
        runends = np.ones(len(keys), np.uint8)
        runends[:-1] = quotients[1:] != quotients[:-1]
        return cls(q_bits, r_bits, np.packbits(occupied), np.packbits(runends), keys & np.uint64((1 << r_bits) - 1), counts.astype(np.int64))

    @classmethod
    def of(cls, fingerprints: np.ndarray, q_bits: int, r_bits: int) -> CountingQuotientFilter:
        keys, counts = np.unique(fingerprints, return_counts=True)
        return cls.of_sorted(keys, counts, q_bits, r_bits)

    def __len__(self) -> int:
        return len(self.remainders)

    def keys(self) -> np.ndarray:
        """The fingerprints back from quotients and remainders: the filter loses nothing."""
        used = np.flatnonzero(np.unpackbits(self.occupied)[: 1 << self.q_bits]).astype(np.uint64)
        ends = np.unpackbits(self.runends)[: len(self)]
        run = np.cumsum(ends) - ends
        return (used[run] << np.uint64(self.r_bits)) | self.remainders if len(self) else np.zeros(0, np.uint64)

    def count(self, fingerprint: int) -> int:
        keys = self.keys()
        i = int(np.searchsorted(keys, np.uint64(fingerprint)))
        return int(self.counts[i]) if i < len(keys) and keys[i] == np.uint64(fingerprint) else 0

    @classmethod
    def merge(cls, parts: list[CountingQuotientFilter]) -> CountingQuotientFilter:
        """Entries of all parts in quotient and remainder order; equal remainders of a run add their counts."""
        keys = np.concatenate([p.keys() for p in parts])
        counts = np.concatenate([p.counts for p in parts])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
        sums = np.add.reduceat(counts, starts) if len(keys) else counts
        return cls.of_sorted(keys[starts], sums, parts[0].q_bits, parts[0].r_bits)

    def to_bytes(self) -> bytes:
        head = np.array([self.q_bits, self.r_bits, len(self)], np.int64)
        return b"".join(x.tobytes() for x in (head, self.occupied, self.runends, self.remainders, self.counts.astype(np.int64)))

    @classmethod
    def from_bytes(cls, blob: bytes) -> CountingQuotientFilter:
        q, r, n = np.frombuffer(blob, np.int64, 3).tolist()
        at, out = 24, []
        for size, kind in ((((1 << q) + 7) // 8, np.uint8), ((n + 7) // 8, np.uint8), (n, np.uint64), (n, np.int64)):
            out.append(np.frombuffer(blob, kind, size, at))
            at += size * np.dtype(kind).itemsize
        return cls(q, r, *out)


def repeated_fingerprints(fingerprints: DataFrame, rows: int) -> DataFrame:
    """``fp`` values (one long column ``fp``) counted more than once over all partitions."""
    s_bits = max(4, int(np.ceil(np.log2(max(1, rows) / SEGMENT))) if rows > SEGMENT else 4)
    q_bits, rest = 10, 64 - s_bits

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, parts = [], 0, []

        def flush():
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            cuts = np.searchsorted(keys >> np.uint64(rest), np.arange((1 << s_bits) + 1, dtype=np.uint64))
            inner = keys & np.uint64((1 << rest) - 1)
            for s in range(1 << s_bits):
                a, b = cuts[s], cuts[s + 1]
                if b > a:
                    parts.append((s, CountingQuotientFilter.of_sorted(inner[a:b], counts[a:b], q_bits, rest - q_bits).to_bytes()))
            out = pa.RecordBatch.from_arrays([pa.array([s for s, _ in parts], pa.int32()), pa.array([b for _, b in parts], pa.binary())], ["segment", "cqf"])
            parts.clear()
            held.clear()
            return out

        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            n += batch.num_rows
            if n >= 1 << 22:
                yield flush()
                n = 0
        if n:
            yield flush()

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        segment = key[0].as_py()
        whole = CountingQuotientFilter.merge([CountingQuotientFilter.from_bytes(b.as_py()) for b in table.column("cqf")])
        found = whole.keys()[whole.counts > 1] | (np.uint64(segment) << np.uint64(rest))
        return pa.table({"fp": pa.array(found.view(np.int64))})

    return fingerprints.mapInArrow(build, "segment int, cqf binary").groupBy("segment").applyInArrow(merge, "fp long")


def _grouped(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, list[DataFrame]]:
    """``exact_groups`` and the written tables that it reads."""
    norm = F.translate(F.coalesce(F.col(text_col), F.lit("")), UPPER, LOWER)
    texts = docs.select(F.col(id_col).alias("id"), norm.alias("norm")).withColumn("fp", F.xxhash64("norm"))
    base = materialise(texts.select("id", "fp", F.unhex(F.sha2("norm", 256)).alias("sha")), "fingerprints")
    repeated = materialise(repeated_fingerprints(base.select("fp"), base.count()), "repeated")
    groups = (
        texts.join(repeated, "fp", "left_semi")
        .groupBy("fp", "norm")
        .agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("size"))
        .select("fp", F.unhex(F.sha2("norm", 256)).alias("sha"), "keep_id", "size")
    )
    groups = materialise(groups, "groups")
    free(repeated)
    single = F.col("size").isNull()
    found = base.join(groups, ["fp", "sha"], "left").select(
        F.col("id").alias(id_col),
        F.when(single, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("size", F.lit(1).cast("long")).alias("group_size"),
        F.when(single, True).otherwise(F.col("id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        "fp",
    )
    return found, [base, groups]


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id_col``, keep_id, group_size, kept, text_sha256 of the normalised text."""
    return _grouped(docs, id_col, text_col)[0].drop("fp")


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, all columns: of each group of equal texts exactly one row, with the largest id.

    Of rows that repeat that id with an equal text (or all have none) any one stays. Other columns may have any name.
    """
    rows = docs.toDF(*(f"c{j}" for j in range(len(docs.columns))))
    own, text = (f"c{docs.columns.index(c)}" for c in (id_col, text_col))
    found, tables = _grouped(rows, own, text)
    found = found.filter("group_size > 1").select(F.col(own).alias("row_id"), "fp", "kept")
    # a row is named by id and fingerprint: few bytes, and only rows of one id could be taken for one another
    dropped = materialise(found.filter(~F.col("kept")).select("row_id", "fp").distinct(), "dropped")
    ties = materialise(found.filter("kept").groupBy("row_id", "fp").agg(F.count(F.lit(1)).alias("times")).filter("times > 1").select("row_id", "fp"), "ties")
    free(*tables)
    print_ = F.xxhash64(F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER))
    named = F.col(own).eqNullSafe(F.col("row_id")) & (print_ == F.col("fp"))
    once = rows.join(dropped, named, "left_anti").join(ties, named, "left_anti")
    again = rows.join(ties, named, "left_semi").withColumn("print", print_).dropDuplicates([own, "print"]).drop("print")
    return once.unionByName(again).toDF(*docs.columns)
