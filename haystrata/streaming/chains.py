"""Many audit chains in one stream: each key has a chain of its own, kept in the stream's state.

The state of a chain is its end: number, hash, tool and input of the last record. A micro-batch's records are masked and hashed in
parallel, then appended to their chains side by side, in order of seq within the batch; a record that comes in a later
batch is appended behind what is there, whatever its seq. The check tool's record that repeats its chain's last record is dropped.
State and output are committed together with the batch, so a restarted stream goes on where it stopped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from haystrata.operators import audit

#: What transformWithState needs of the session.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
CHAINED = f"chain string, {audit.LOG}"


class Chain(StatefulProcessor):
    """Appends a batch's records of one key. Only they are held, without their inputs."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.end = handle.getValueState("end", "id long, record_hash string, tool string, input string")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        number, prev, tool, seen = tuple(self.end.get()) if self.end.exists() else (0, audit.GENESIS, None, None)
        out = []
        for r in sorted(rows, key=lambda r: (r.seq is None, r.seq, r.body)):
            if r.tool_name == audit.CHECK and (tool, seen) == (r.tool_name, r.input_hash):
                continue
            own = hashlib.sha256(f"{r.body}|{prev}".encode()).hexdigest()
            number += 1
            out.append(Row(chain=key[0], id=number, timestamp=r.timestamp, tool_name=r.tool_name, input_hash=r.input_hash, result_summary=r.result_summary, requires_human_review=r.requires_human_review, prev_hash=prev, record_hash=own))
            prev, tool, seen = own, r.tool_name, r.input_hash
        self.end.update((number, prev, tool, seen))
        yield from out

    def close(self) -> None:
        pass


def configure(spark: SparkSession) -> None:
    spark.conf.set(*PROVIDER)


def chained(calls: DataFrame) -> DataFrame:
    """calls (a stream): chain, seq, ts (null: the batch's time), tool_name, input_text, result_summary, requires_human_review. The records, in append mode; a null chain is one chain."""
    rows = audit.bodies(calls, keep=("chain",))
    return rows.groupBy("chain").transformWithState(statefulProcessor=Chain(), outputStructType=CHAINED, outputMode="Append", timeMode="None")
