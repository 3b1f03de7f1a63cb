"""Hash-chained audit log: append, verify, duplicate guard.

A chain is sequential by definition: a batch is put in order and streams through a single writer
that holds one record at a time. Verification recomputes hashes in parallel, compares neighbours
inside ranges of ids, and joins the ranges at their ends.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haystrata.operators.scan import scan

GENESIS = "GENESIS"
CHECK = "check_disclosure_risk"
LOG = "id bigint, timestamp string, tool_name string, input_hash string, result_summary string, requires_human_review int, prev_hash string, record_hash string"
_FIELDS = ("timestamp", "tool_name", "input_hash", "result_summary", "requires_human_review")


def sanitize(field: Column) -> Column:
    return F.replace(field, F.lit("|"), F.lit("/"))


def record_hash(ts: Column, tool: Column, input_hash: Column, summary: Column, flag: Column, prev: Column) -> Column:
    return F.sha2(F.concat(record_text(ts, tool, input_hash, summary, flag), F.lit("|"), prev), 256)


def record_text(ts: Column, tool: Column, input_hash: Column, summary: Column, flag: Column) -> Column:
    """What a record's hash is taken of, but for the hash before it."""
    return F.concat_ws("|", ts, sanitize(tool), input_hash, sanitize(summary), flag.cast("string"))


def kst(ts: Column) -> Column:
    """ISO text of a UTC timestamp at +09:00, to the second."""
    return F.concat(F.date_format(F.from_utc_timestamp(ts, "Asia/Seoul"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+09:00"))


def prepare(records: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """records (and columns to ``keep``): seq, ts (null: now), tool_name, input_text, result_summary, requires_human_review. Hashes the input and drops it; scans and masks the summary."""
    now = kst(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()))
    checked = records.withColumn("result_summary", F.when(F.col("result_summary").isNull(), F.raise_error(F.lit("result_summary must not be null"))).otherwise(F.col("result_summary")))
    hashed = checked.withColumn("input_hash", F.sha2(F.col("input_text"), 256)).drop("input_text").withColumnRenamed("requires_human_review", "asked")
    return scan(hashed, "result_summary").select(
        *keep, "seq", F.coalesce("ts", now).alias("timestamp"), "tool_name", "input_hash", F.col("masked_text").alias("result_summary"), (F.col("asked") | F.col("requires_human_review")).cast("int").alias("requires_human_review")
    )


def _chain(last_id: int, last_hash: str, last_call: tuple[str | None, str | None] | None):
    """Records in order, each with its text: number, hash before it and own hash are added. ``last_call``: tool and input of the
    last record, where the check tool's records that repeat the record before them are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, prev, call = last_id, last_hash, last_call
        for batch in batches:
            if call is not None:
                fresh = []
                for one in zip(batch.column("tool_name").to_pylist(), batch.column("input_hash").to_pylist(), strict=True):
                    repeats = one[0] == CHECK and call[0] is not None and call[0].strip().lower() == CHECK and call[1] == one[1]
                    fresh.append(not repeats)
                    call = call if repeats else one
                batch = batch.filter(pa.array(fresh, pa.bool_()))
            before, own = [], []
            for text in batch.column("body").to_pylist():
                before.append(prev)
                prev = hashlib.sha256(f"{text}|{prev}".encode()).hexdigest()
                own.append(prev)
            ids = pa.array(range(number + 1, number + 1 + len(own)), pa.int64())
            number += len(own)
            yield pa.RecordBatch.from_arrays([ids, *(batch.column(c) for c in _FIELDS), pa.array(before, pa.string()), pa.array(own, pa.string()), batch.column("seq")], [*(c.split()[0] for c in LOG.split(", ")), "seq"])

    return run


def bodies(records: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Prepared records with the text that their hash is taken of."""
    return prepare(records, keep).withColumn("body", record_text(*(F.col(c) for c in _FIELDS)))


def chained(rows: DataFrame, last_id: int = 0, last_hash: str = GENESIS, last_call: tuple[str | None, str | None] | None = None) -> DataFrame:
    """``bodies`` as records behind the chain's last one, in order of seq, with seq."""
    kind = rows.schema["seq"].dataType.simpleString()
    ordered = rows.repartition(1).sortWithinPartitions("seq", *_FIELDS).select(*_FIELDS, "body", "seq")
    return ordered.mapInArrow(_chain(last_id, last_hash, last_call), f"{LOG}, seq {kind}")


def append(records: DataFrame, last_id: int = 0, last_hash: str = GENESIS) -> DataFrame:
    """The batch's records behind the chain's last one, in order of seq."""
    return chained(bodies(records), last_id, last_hash).drop("seq")


def checked(log: DataFrame) -> DataFrame:
    """The log with the hash each record should have."""
    return log.withColumn("expected", record_hash(*(F.col(c) for c in (*_FIELDS, "prev_hash"))))


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A range of records in order: one row with its ends, its first record that does not fit the one before it, its number."""
    first = last = broken = None
    n = 0
    for batch in batches:
        for number, prev, own, fine in zip(*(batch.column(c).to_pylist() for c in ("id", "prev_hash", "record_hash", "fine")), strict=True):
            if first is None:
                first = (number, prev)
                fits = bool(fine)
            else:
                fits = bool(fine) and prev == last
            if not fits and broken is None:
                broken = number
            last = own
            n += 1
    if n:
        yield pa.RecordBatch.from_pylist([{"first_id": first[0], "first_prev": first[1], "last_hash": last, "broken": broken, "n": n}], pa.schema([("first_id", pa.int64()), ("first_prev", pa.string()), ("last_hash", pa.string()), ("broken", pa.int64()), ("n", pa.int64())]))


def verify(log: DataFrame) -> DataFrame:
    """One row: valid, broken_at (first id that does not fit), total_records."""
    light = checked(log).select(F.col("id").cast("long").alias("id"), "prev_hash", "record_hash", F.col("record_hash").eqNullSafe(F.col("expected")).alias("fine"))
    ranges = light.repartitionByRange("id").sortWithinPartitions("id").mapInArrow(_compared, "first_id long, first_prev string, last_hash string, broken long, n long")
    # one row a partition from here
    joined = ranges.withColumn("prev", F.lag("last_hash", 1, GENESIS).over(Window.orderBy("first_id")))
    broken = F.least("broken", F.when(~F.col("first_prev").eqNullSafe(F.col("prev")), F.col("first_id")))
    out = joined.agg(F.min(broken).alias("broken_at"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_records"))
    return out.select(F.col("broken_at").isNull().alias("valid"), "broken_at", "total_records")


def latest(log: DataFrame) -> DataFrame:
    return log.orderBy(F.col("id").desc()).limit(1)


def repeats_latest(log: DataFrame, calls: DataFrame) -> DataFrame:
    """calls: call_id, tool_name, input_text. Adds duplicate: same tool (case, outer blanks apart) and input as the last record."""
    last = latest(log).select(F.lower(F.trim("tool_name")).alias("last_tool"), F.col("input_hash").alias("last_input"))
    # one row: the last record
    same = (F.lower(F.trim("tool_name")) == F.col("last_tool")) & (F.sha2("input_text", 256) == F.col("last_input"))
    return calls.join(F.broadcast(last), F.lit(True), "left").withColumn("duplicate", F.coalesce(same, F.lit(False))).drop("last_tool", "last_input")
