"""The audit log as a table of committed segments.

``<path>/segments/<name>`` holds the records of one append as Parquet; ``<path>/commits/<group>/<number>.json`` makes
a segment part of the log. A commit file is put only if its number is free, so of two writers that read the same end
of the chain one wins; the other chains its prepared records anew behind the winner's and tries the next number. Masking and
hashing of inputs happen once an append, whatever is retried. What no commit names was never appended.

A commit also holds the chain's end (number, hash, tool and input of the last record) and, for streams, the last batch
each has appended, so a batch that runs again after a failure appends nothing twice. Times are fixed on the
driver when a call begins.

``verify`` keeps, beside the log, what it found for each range of ``RANGE`` records of each segment together with the
marks (name, length, time) of the segment's files. A later run recomputes hashes only for new segments and for those whose marks have
changed, and joins ranges at their borders. Who can change a file without changing its length or
time is found by ``verify(full=True)`` alone.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import datetime, timedelta, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from haystrata.operators import audit
from haystrata.sources import shared

GROUP, RANGE, ATTEMPTS = 1000, 1 << 20, 100
_RANGES = "segment string, part long, first_id long, first_prev string, last_hash string, broken long, n long"


@dataclass(frozen=True)
class End:
    """The end of the chain as a commit states it."""

    number: int = 0
    segment: str | None = None
    last_id: int = 0
    last_hash: str = audit.GENESIS
    last_tool: str | None = None
    last_input: str | None = None
    batches: dict[str, int] = field(default_factory=dict)


def now() -> str:
    """This moment in Korea, to the second."""
    return datetime.now(timezone(timedelta(hours=9))).isoformat(timespec="seconds")


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records in order of segment, part and id: a row for each part, with its ends and its first record that does not fit."""
    kinds = pa.schema([("segment", pa.string()), ("part", pa.int64()), ("first_id", pa.int64()), ("first_prev", pa.string()), ("last_hash", pa.string()), ("broken", pa.int64()), ("n", pa.int64())])
    at = None
    for batch in batches:
        out = []
        for segment, part, number, prev, own, fine in zip(*(batch.column(c).to_pylist() for c in ("segment", "part", "id", "prev_hash", "record_hash", "fine")), strict=True):
            if at is None or (at["segment"], at["part"]) != (segment, part):
                if at is not None:
                    out.append(at)
                at = {"segment": segment, "part": part, "first_id": number, "first_prev": prev, "last_hash": prev, "broken": None, "n": 0}
            if at["broken"] is None and not (fine and prev == at["last_hash"]):
                at["broken"] = number
            at["last_hash"] = own
            at["n"] += 1
        if out:
            yield pa.RecordBatch.from_pylist(out, kinds)
    if at is not None:
        yield pa.RecordBatch.from_pylist([at], kinds)


class AuditLog:
    """A log at ``path``, which need not exist yet."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _commit_path(self, number: int) -> str:
        return f"{self.path}/commits/{number // GROUP:09d}/{number:012d}.json"

    def end(self) -> End:
        """The newest commit. Numbers are looked up in the newest group only."""
        groups = [g for g, _, _ in shared.listed(self.spark, f"{self.path}/commits")]
        for group in reversed(groups):
            names = [n for n, _, _ in shared.listed(self.spark, f"{self.path}/commits/{group}") if n.endswith(".json")]
            if names:
                return End(**json.loads(shared.read_text(self.spark, f"{self.path}/commits/{group}/{names[-1]}")))
        return End()

    def segments(self) -> list[str]:
        """Segments of all commits, in order."""
        groups = [f"{self.path}/commits/{g}" for g, _, _ in shared.listed(self.spark, f"{self.path}/commits")]
        files = [f"{g}/{n}" for g in groups for n, _, _ in shared.listed(self.spark, g) if n.endswith(".json")]
        if not files:
            return []
        rows = self.spark.read.schema("number long, segment string").json(files)
        return [r.segment for r in rows.orderBy("number").collect()]

    def _read(self, segments: list[str], schema: str = audit.LOG) -> DataFrame:
        if not segments:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/segments/{s}" for s in segments))

    def read(self) -> DataFrame:
        """All committed records."""
        return self._read(self.segments())

    def latest(self) -> DataFrame:
        """The last record, or none."""
        end = self.end()
        return self._read([end.segment] if end.segment else []).filter(F.col("id") == end.last_id)

    def append(self, records: DataFrame, skip_repeats: bool = False, batch: tuple[str, int] | None = None) -> DataFrame:
        """Appends records (as ``audit.prepare`` takes them) in order of seq; returns what was committed, with ``seq``.

        ``skip_repeats``: a record of the check tool whose input is that of the record before it is left out.
        ``batch``: (stream, number); a number that the stream has already appended is not appended again.
        """
        kind = records.schema["seq"].dataType.simpleString()
        nothing = f"{audit.LOG}, seq {kind}"
        if batch is not None and self.end().batches.get(batch[0], -1) >= batch[1]:
            return self.spark.createDataFrame([], nothing)
        staged = f"{self.path}/staged/{uuid.uuid4().hex}"
        rows = audit.bodies(records.withColumn("ts", F.coalesce(F.col("ts").cast("string"), F.lit(now()))))
        try:
            rows.write.parquet(staged)
            ready = self.spark.read.schema(rows.schema).parquet(staged)
            for _ in range(ATTEMPTS):
                end = self.end()
                if batch is not None and end.batches.get(batch[0], -1) >= batch[1]:
                    break
                made = self._attempt(ready, end, skip_repeats, batch, nothing)
                if made is not None:
                    return made
            else:
                raise RuntimeError(f"other writers were first {ATTEMPTS} times")
            return self.spark.createDataFrame([], nothing)
        finally:
            shared.delete(self.spark, staged)

    def _attempt(self, ready: DataFrame, end: End, skip_repeats: bool, batch: tuple[str, int] | None, schema: str) -> DataFrame | None:
        """The committed records, or none if another writer was first."""
        name = f"{end.number + 1:012d}-{uuid.uuid4().hex}"
        at = f"{self.path}/segments/{name}"
        audit.chained(ready, end.last_id, end.last_hash, (end.last_tool, end.last_input) if skip_repeats else None).write.parquet(at)
        made = self.spark.read.schema(schema).parquet(at)
        last = made.agg(F.max(F.struct("id", "record_hash", "tool_name", "input_hash")).alias("r")).first().r
        batches = end.batches | ({batch[0]: batch[1]} if batch is not None else {})
        if last is None and batches == end.batches:
            shared.delete(self.spark, at)
            return self.spark.createDataFrame([], schema)
        new = End(end.number + 1, name, *((last.id, last.record_hash, last.tool_name, last.input_hash) if last else (end.last_id, end.last_hash, end.last_tool, end.last_input)), batches)
        if shared.put_if_absent(self.spark, self._commit_path(new.number), json.dumps(new.__dict__, ensure_ascii=False)):
            return made
        shared.delete(self.spark, at)
        return None

    def _marks(self, segments: list[str]) -> dict[str, str]:
        return {s: " ".join(f"{n}:{size}:{time}" for n, size, time in shared.listed(self.spark, f"{self.path}/segments/{s}") if n.startswith("part-")) for s in segments}

    def _known(self) -> DataFrame | None:
        """What the newest finished verification found."""
        for name, _, _ in reversed(shared.listed(self.spark, f"{self.path}/verified")):
            if shared.exists(self.spark, f"{self.path}/verified/{name}/_SUCCESS"):
                return self.spark.read.schema(f"{_RANGES}, marks string").parquet(f"{self.path}/verified/{name}")
        return None

    def verify(self, full: bool = False) -> dict:
        """valid, broken_at (first id that does not fit), total_records, and hashed: the segments whose hashes were recomputed."""
        segments = self.segments()
        marks = self._marks(segments)
        known = None if full else self._known()
        kept = {}
        if known is not None:
            kept = {r.segment: r.marks for r in known.select("segment", "marks").distinct().collect() if marks.get(r.segment) == r.marks}
        new = [s for s in segments if s not in kept]
        found = self._compared(new)
        if new:
            listed = self.spark.createDataFrame(list(marks.items()), "segment string, marks string")
            found = found.join(listed, "segment", "left").select(*(c.split()[0] for c in _RANGES.split(", ")), "marks")
            if kept:
                found = found.unionByName(known.filter(F.col("segment").isin(list(kept))))
            done = [n for n, _, _ in shared.listed(self.spark, f"{self.path}/verified")]
            at = f"{self.path}/verified/{int(done[-1].split('-')[0]) + 1 if done else 0:012d}-{uuid.uuid4().hex}"
            found.write.parquet(at)
            found = self.spark.read.schema(f"{_RANGES}, marks string").parquet(at)
        elif kept:
            found = known.filter(F.col("segment").isin(list(kept)))
        # one row a range from here
        joined = found.withColumn("prev", F.lag("last_hash", 1, audit.GENESIS).over(Window.orderBy("first_id")))
        broken = F.least("broken", F.when(~F.col("first_prev").eqNullSafe(F.col("prev")), F.col("first_id")))
        out = joined.agg(F.min(broken).alias("broken_at"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
        return {"valid": out.broken_at is None, "broken_at": out.broken_at, "total_records": out.n, "hashed": len(new)}

    def _compared(self, segments: list[str]) -> DataFrame:
        if not segments:
            return self.spark.createDataFrame([], _RANGES)
        name = F.regexp_extract(F.col("_metadata.file_path"), r"/segments/([^/]+)/", 1)
        rows = self._read(segments).select("*", name.alias("segment"), F.floor(F.col("id") / RANGE).alias("part"))
        light = audit.checked(rows).select("segment", "part", "id", "prev_hash", "record_hash", F.coalesce(F.col("record_hash") == F.col("expected"), F.lit(False)).alias("fine"))
        return light.repartition("segment", "part").sortWithinPartitions("segment", "part", "id").mapInArrow(_ranges, _RANGES)
