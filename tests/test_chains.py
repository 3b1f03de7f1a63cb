"""Audit chains in a stream's state: several chains, a restart, late records, repeats."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from haystrata.operators import audit
from haystrata.streaming import chains

CALLS = "chain string, seq long, ts string, tool_name string, input_text string, result_summary string, requires_human_review boolean"
TS = "2026-01-01T09:00:00+09:00"


@pytest.fixture()
def stream(spark, tmp_path):
    before = spark.conf.get(chains.PROVIDER[0])
    chains.configure(spark)
    calls = lambda rows: spark.createDataFrame([(c, s, TS, t, i, "메일 ab@example.com" if s == 3 else "요약", False) for c, s, t, i in rows], CALLS)
    calls([]).write.parquet(str(tmp_path / "in"))

    def run(*batches):
        for rows in batches:
            calls(rows).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(CALLS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        out = chains.chained(source).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start()
        out.awaitTermination()
        return spark.read.schema(chains.CHAINED).parquet(str(tmp_path / "out"))

    yield run
    spark.conf.set(chains.PROVIDER[0], before)


def test_chains(spark, stream):
    check = audit.CHECK
    stream([("a", 2, "t", "x"), ("b", 1, "t", "x"), ("a", 1, check, "y"), ("b", 2, check, "y"), ("b", 3, check, "y")])
    # a restart; then a late record, a repeat of the chain's last record, and a chain of its own
    log = stream([("a", 0, "late", "z"), ("b", 9, check, "y"), (None, 1, "t", "x")], [("b", 10, "t", "x"), ("b", 11, check, "y"), ("c", 3, "t", "x")])
    got = {c: [(r.id, r.tool_name) for r in log.filter(F.col("chain").eqNullSafe(c)).orderBy("id").collect()] for c in ("a", "b", "c", None)}
    assert got["a"] == [(1, check), (2, "t"), (3, "late")]
    assert got["b"] == [(1, "t"), (2, check), (3, "t"), (4, check)]
    assert got["c"] == [(1, "t")] and got[None] == [(1, "t")]
    for chain, rows in got.items():
        own = log.filter(F.col("chain").eqNullSafe(chain)).drop("chain")
        assert tuple(audit.verify(own).first()) == (True, None, len(rows))
    c = log.filter("chain = 'c'").first()
    assert c.result_summary == "메일 ***@example.com" and c.requires_human_review == 1 and c.timestamp == TS
    # nothing new, nothing appended
    assert stream([]).count() == log.count() == 9
