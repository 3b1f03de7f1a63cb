"""A stream of texts through the scan, and from there into one audit chain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from haystrata.operators.scan import scan
from haystrata.sources.audit_log import AuditLog


def scan_stream(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """Stateless: works on a streaming DataFrame in append mode."""
    return scan(texts, text_col)


def audit_stream(texts: DataFrame, log_path: str, checkpoint: str, id_col: str = "doc_id", text_col: str = "text", ts: str | None = None, name: str = "scan") -> StreamingQuery:
    """Scans each micro-batch and appends its records to the log at ``log_path``, beside whatever other writers it has.

    The log holds the last batch of each stream (``name``), so a batch that is run again after a failure appends nothing twice.
    ``ts``: the time of all records, instead of the time of their batch.
    """

    def write(batch: DataFrame, number: int) -> None:
        calls = scan(batch.withColumn("input_text", F.col(text_col)), text_col).select(F.col(id_col).alias("seq"), F.lit(ts).cast("string").alias("ts"), F.lit("scan_sensitive_info").alias("tool_name"), "input_text", F.col("log_safe_summary").alias("result_summary"), "requires_human_review")
        AuditLog(batch.sparkSession, log_path).append(calls, batch=(name, number))

    return texts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
