"""The committed audit log: several writers, repeats, failures, streams, verification."""

from __future__ import annotations

import json
import subprocess
import sys
import threading

import pytest
from pyspark.sql import functions as F

from haystrata.operators import audit
from haystrata.plans import tools
from haystrata.sources import audit_log, shared
from haystrata.sources.audit_log import AuditLog

CALLS = "seq long, ts string, tool_name string, input_text string, result_summary string, requires_human_review boolean"
TS = "2026-01-01T09:00:00+09:00"


def calls(spark, rows, ts=TS):
    return spark.createDataFrame([(k, ts, *r) for k, r in enumerate(rows)], CALLS)


def whole(log):
    return tuple(audit.verify(log.read()).first())


def test_put_if_absent(spark, tmp_path):
    at = f"{tmp_path}/deep/one.json"
    won = []
    threads = [threading.Thread(target=lambda k=k: won.append((shared.put_if_absent(spark, at, str(k) * 50), k))) for k in range(8)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    first = [k for fine, k in won if fine]
    assert len(first) == 1 and shared.read_text(spark, at) == str(first[0]) * 50
    assert [n for n, _, _ in shared.listed(spark, f"{tmp_path}/deep")] == ["one.json"]


def test_appends_and_reads(spark, tmp_path):
    log = AuditLog(spark, str(tmp_path / "log"))
    assert log.read().count() == 0 and log.latest().count() == 0 and log.verify() == {"valid": True, "broken_at": None, "total_records": 0, "hashed": 0}
    made = log.append(calls(spark, [("a", "x", "계좌번호 110-222-333333 노출", False), ("b", "y", "요약", False)], ts=None))
    assert [(r.seq, r.id) for r in made.orderBy("seq").collect()] == [(0, 1), (1, 2)]
    assert log.append(calls(spark, [])).count() == 0 and log.end().number == 1
    more = log.append(calls(spark, [("c", "z", "s", True)]))
    # what an append returns is what the log holds, also when the time is the present one
    have = {tuple(r) for r in log.read().collect()}
    assert have == {tuple(r)[:8] for r in [*made.collect(), *more.collect()]} and len(have) == 3
    assert whole(log) == (True, None, 3) and log.latest().first().id == 3
    assert all(r.timestamp.endswith("+09:00") and len(r.timestamp) == 25 for r in log.read().collect())
    assert not shared.listed(spark, f"{log.path}/staged")
    with pytest.raises(Exception, match="must not be null"):
        log.append(calls(spark, [("a", "x", None, False)]))
    assert log.end().number == 2 and not shared.listed(spark, f"{log.path}/staged")


def test_two_writers_at_once(spark, tmp_path):
    path, errors = str(tmp_path / "log"), []

    def write(name):
        try:
            for k in range(3):
                AuditLog(spark, path).append(calls(spark, [(f"{name}{k}", f"{j}", "s", False) for j in range(5)]))
        except Exception as e:
            errors.append(e)

    threads = [threading.Thread(target=write, args=(n,)) for n in "abc"]
    [t.start() for t in threads]
    [t.join() for t in threads]
    log = AuditLog(spark, path)
    assert not errors and whole(log) == (True, None, 45)
    assert sorted(r.tool_name for r in log.read().collect()) == sorted(f"{n}{k}" for n in "abc" for k in range(3) for _ in range(5))
    assert len(shared.listed(spark, f"{path}/segments")) == 9  # losers' segments are gone


def test_a_lost_race_is_tried_again(spark, tmp_path, monkeypatch):
    """Another process commits between reading the end and committing."""
    path = str(tmp_path / "log")
    AuditLog(spark, path).append(calls(spark, [("a", "x", "s", False)]))
    real, prepared = audit.chained, []

    def slow(rows, last_id, *rest):
        if not prepared:
            prepared.append(last_id)
            monkeypatch.setattr(audit, "chained", real)
            AuditLog(spark, path).append(calls(spark, [("other", "x", "s", False)]))
        return real(rows, last_id, *rest)

    monkeypatch.setattr(audit, "chained", slow)
    AuditLog(spark, path).append(calls(spark, [("mine", "x", "s", False)]))
    assert prepared == [1] and [r.tool_name for r in AuditLog(spark, path).read().orderBy("id").collect()] == ["a", "other", "mine"]
    assert whole(AuditLog(spark, path)) == (True, None, 3)
    monkeypatch.setattr(shared, "put_if_absent", lambda *a: False)
    with pytest.raises(RuntimeError, match="were first"):
        monkeypatch.setattr(audit_log, "ATTEMPTS", 2)
        AuditLog(spark, path).append(calls(spark, [("never", "x", "s", False)]))


def test_writers_in_two_processes(spark, tmp_path):
    path = str(tmp_path / "log")
    code = f"""
import sys
sys.path.insert(0, {str(sys.path[0])!r})
from pyspark.sql import SparkSession
from haystrata.sources.audit_log import AuditLog
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "1").getOrCreate()
for k in range(3):
    AuditLog(spark, {path!r}).append(spark.createDataFrame([(k, None, "there", "x", "s", False)], {CALLS!r}))
"""
    import os

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    other = subprocess.Popen([sys.executable, "-c", code], env=os.environ | {"PYTHONPATH": root}, stderr=subprocess.DEVNULL)
    k = 0
    while other.poll() is None or k < 3:
        AuditLog(spark, path).append(calls(spark, [("here", str(k), "s", False)], ts=None))
        k += 1
    assert other.returncode == 0 and whole(AuditLog(spark, path)) == (True, None, k + 3)


def test_log_tool(spark, tmp_path):
    log = AuditLog(spark, str(tmp_path / "log"))
    rows = [(" Check_Disclosure_Risk", "z", "s", True), ("CHECK_disclosure_risk", "z", "s", False), ("scan", "z", "s", False), ("check_disclosure_risk", "z", "s", False), (None, "z", "s", False), ("a", None, "s", False), ("a", "z", None, False), ("a", "z", "s", None)]
    got = {r.seq: r for r in tools.log_tool(log, calls(spark, rows)).collect()}
    assert [got[k].ok for k in range(8)] == [True] * 4 + [False] * 4
    assert got[1].summary == "" and got[1].skip.skipped and got[1].record is None and got[1].skip.tool_name == "CHECK_disclosure_risk"
    assert [got[k].record.id for k in (0, 2, 3)] == [1, 2, 3] and got[0].summary == tools.CONFIRMATION and got[0].skip is None
    assert [got[k].error for k in (4, 5, 6, 7)] == [tools.NOT_TEXT[1]] * 3 + [tools.NOT_FLAG[1]] and got[7].requires_human_review
    # the last record before a batch counts too
    again = tools.log_tool(log, calls(spark, [("check_disclosure_risk", "z", "s", False), ("check_disclosure_risk", "y", "s", False)])).orderBy("seq").collect()
    assert again[0].skip.skipped and again[1].record.id == 4 and whole(log) == (True, None, 4)
    assert tools.log_tool(log, calls(spark, [])).count() == 0


def test_failed_writes_are_reported(spark, tmp_path):
    (tmp_path / "file").write_text("not a folder")
    log = AuditLog(spark, str(tmp_path / "file"))
    got = tools.log_tool(log, calls(spark, [("a", "z", "s", False), (None, "z", "s", False)])).orderBy("seq").collect()
    assert [(r.ok, r.summary, r.requires_human_review) for r in got] == [(False, tools.LOG_FAILED, True), (False, tools.NOT_TEXT[0], True)] and got[0].error
    nothing = lambda q: spark.createDataFrame([], "query_id long, position int, source string, file_name string, article string, article_title string, chunk_id string, snippet string, score double, vector_distance double, vector_similarity double")
    asked = spark.createDataFrame([(1, "회계 처리", None), (2, " ", " "), (3, "a", "b.txt"), (4, None, "/nowhere.txt")], "query_id long, text string, file_path string")
    got = {r.query_id: r for r in tools.check_calls(asked, nothing, log).collect()}
    assert [got[k].summary for k in (1, 2)] == [tools.LOG_FAILED] * 2 and got[3].error == tools.BOTH_INPUTS[1] and "nowhere" in got[4].error
    assert all(not r.ok and r.requires_human_review for r in got.values())


def test_check_tool_and_log_agree(spark, tmp_path):
    """Also at the present time: the hashes of results are those of the log."""
    from haystrata.sources import files

    log = AuditLog(spark, str(tmp_path / "log"))
    (tmp_path / "long.txt").write_text("회계 처리 " * 40, "utf-8")
    asked = spark.createDataFrame([(1, "회계 처리", None), (2, "", None), (3, None, str(tmp_path / "long.txt")), (4, "x", "y")], "query_id long, text string, file_path string")
    settings = tools.Settings(max_text_chars=50)
    read = files.read_files(spark, str(tmp_path / "long.txt"), settings)
    seen = []

    def search(q):
        seen.extend(q.collect())
        return q.select("query_id", F.lit(1).alias("position"), F.lit("규정").alias("source"), F.lit("규정.txt").alias("file_name"), F.lit("제7조").alias("article"), F.lit("보고").alias("article_title"), F.lit("c").alias("chunk_id"), F.lit("보고한다").alias("snippet"), F.lit(0.1).alias("score"), F.lit(0.1).alias("vector_distance"), F.lit(0.9).alias("vector_similarity"))

    result = tools.check_calls(asked, search, log, read, settings=settings)
    got = {r.query_id: r for r in result.collect()}
    assert {r.query_id: r["query"] for r in seen}[2] == tools.NO_TEXT_QUERY and len(seen) == 3
    have = {r.id: r for r in log.read().collect()}
    assert len(have) == 3 and whole(log) == (True, None, 3)
    for k, r in got.items():
        if k != 4:
            assert (r.audit_log.record_hash, r.audit_log.timestamp) == (have[r.audit_log.id].record_hash, have[r.audit_log.id].timestamp)
            assert r.summary.startswith(have[r.audit_log.id].result_summary) and r.summary.endswith(tools.CONFIRMATION)
    assert got[3].source_file.truncated and got[3].requires_human_review and "절단" in got[3].outputs[-1] and not got[4].ok
    assert {r.query_id: r.audit_log.record_hash for r in result.filter("query_id < 4").collect()} == {k: r.audit_log.record_hash for k, r in got.items() if k < 4}  # one evaluation
    # without an index calls fail, and are logged
    got = tools.check_calls(asked.filter("query_id < 3"), search, log, error="no corpus").orderBy("query_id").collect()
    assert [(r.ok, r.error, r.audit_log.id) for r in got] == [(False, "no corpus", 4), (False, "no corpus", 5)]
    got = tools.search_calls(spark.createDataFrame([(1, "q")], "query_id long, query string"), search, error="no corpus").first()
    assert (got.ok, got.tool, got.summary) == (False, "search_compliance_rule", tools.NOT_READY["search_compliance_rule"])


def test_batches_of_streams(spark, tmp_path):
    log = AuditLog(spark, str(tmp_path / "log"))
    one = calls(spark, [("a", "x", "s", False)])
    for stream, number in (("p", 0), ("q", 0), ("p", 0), ("p", 1), ("p", 0)):
        log.append(one, batch=(stream, number))
    assert whole(log) == (True, None, 3) and log.end().batches == {"p": 1, "q": 0}
    log.append(calls(spark, []), batch=("q", 1))
    assert log.end().batches["q"] == 1 and whole(log) == (True, None, 3)


def test_verification_hashes_what_is_new(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(audit_log, "RANGE", 4)
    log = AuditLog(spark, str(tmp_path / "log"))
    ask = lambda **k: tuple(log.verify(**k).values())
    for k in range(4):
        log.append(calls(spark, [(f"t{k}", str(j), "s", False) for j in range(6)]))
        assert ask() == (True, None, 6 * (k + 1), 1)
    assert ask() == (True, None, 24, 0) and ask(full=True) == (True, None, 24, 4)
    at = [f"{log.path}/segments/{s}" for s in log.segments()]

    def rewrite(k, change):
        change(shared.written(spark.read.parquet(at[k]), "edited")).coalesce(1).write.mode("overwrite").parquet(at[k])

    before = shared.written(spark.read.parquet(at[1]), "before")
    rewrite(1, lambda x: x.withColumn("tool_name", F.when(F.col("id") == 9, "edited").otherwise(F.col("tool_name"))))
    assert ask() == (False, 9, 24, 1) and ask() == (False, 9, 24, 0) and whole(log) == (False, 9, 24)
    before.coalesce(1).write.mode("overwrite").parquet(at[1])
    assert ask() == (True, None, 24, 1)
    rewrite(2, lambda x: x.filter("id != 14"))
    assert ask() == whole(log) + (1,) == (False, 15, 23, 1)
    rewrite(2, lambda x: x.filter("id > 13"))  # the border between two segments
    assert ask()[:3] == whole(log) == (False, 15, 22)
    # a commit taken away, then the newest one: the second leaves no trace, as ever
    shared.delete(spark, f"{log.path}/commits/{0:09d}/{3:012d}.json")
    assert ask()[:3] == whole(log) == (False, 19, 18)
    shared.delete(spark, f"{log.path}/commits/{0:09d}/{4:012d}.json")
    assert ask()[:3] == whole(log) == (True, None, 12)
    assert json.loads(shared.read_text(spark, f"{log.path}/commits/{0:09d}/{1:012d}.json"))["last_id"] == 6
