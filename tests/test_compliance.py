"""Goldens of the document-compliance operators."""

from __future__ import annotations

import json
import random
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from haystrata import ingest, queries
from haystrata.config import Settings
from haystrata.functions import patterns as P
from haystrata.functions.spans import spans, squeeze
from haystrata.operators import audit, chunking, citations, retrieval, signals
from haystrata.operators.scan import finding_rows, scan
from haystrata.plans import tools
from haystrata.sources import files, index
from haystrata.sources.audit_log import AuditLog

# text, masked text, (type, confidence) of each finding
GOLDENS = [
    ("고객 주민등록번호는 900101-1234567 입니다.", "고객 주민등록번호는 900101-1****** 입니다.", [("rrn", "high")]),
    ("문서번호 9001011234567 확인 바랍니다.", "문서번호 900101-1****** 확인 바랍니다.", [("rrn", "low")]),
    ("주민 900101 1234567", "주민 900101-1******", [("rrn", "high")]),
    ("계좌 991301-1234567 로 입금", "계좌 ***4567 로 입금", [("account", "high")]),
    ("계좌번호 900101-1234567 입금", "계좌번호 900101-1****** 입금", [("rrn", "high")]),
    ("계좌 4111-1111-1111-1111 로 입금", "계좌 4111-****-****-1111 로 입금", [("card", "high")]),
    ("안심번호는 0507-1234-5678 입니다.", "안심번호는 0507-****-5678 입니다.", [("phone", "high")]),
    ("메일은 ab@example.com 입니다.", "메일은 ***@example.com 입니다.", [("email", "high")]),
    ("일련번호 1234-5678-9012-3456 확인", None, []),
    ("결제 카드번호: 4571-1234-1234-1234", "결제 카드번호: 4571-****-****-1234", [("card", "low")]),
    ("카드 4111-1111 1111-1111", None, []),
    ("카드 0000 0000 0000 0000", "카드 0000-****-****-0000", [("card", "high")]),
    ("총 발행 주식 수는 3500000000 이다.", None, []),
    ("110-222-333333 " + "가" * 30 + " 입금", None, []),
    ("이 상품은 원금 보장되지 않습니다.", None, []),
    ("이 상품은 원금 보장은 되지 않습니다", "이 상품은 [금지표현]은 되지 않습니다", [("prohibited_claim", "high")]),
    ("공개 전략회의 자료", None, []),
    ("공개 전 자료입니다", "[내부정보키워드] 자료입니다", [("internal_keyword", "high")]),
    ("+82-10-1234-5678", None, []),
    ("010.1234.5678", None, []),
    ("０１０-１２３４-５６７８", None, []),
    ("미공개중요정보 위험 없음", "[내부정보키워드]중요정보 [금지표현]", [("prohibited_claim", "high"), ("internal_keyword", "high")]),
    ("   ", None, []),
]


def test_scan_goldens(spark):
    rows = [(k, t) for k, (t, _, _) in enumerate(GOLDENS)]
    got = {r.doc_id: r for r in scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, (text, masked, found) in enumerate(GOLDENS):
        assert got[k].masked_text == (text if masked is None else masked)
        assert [(f.type, f.confidence) for f in got[k].findings] == found
        assert got[k].requires_human_review == bool(found)


def test_scan_empty_and_cap(spark):
    mails = " ".join(f"{c}{c}{c}user@example.com" for c in "abcdef")
    table = spark.createDataFrame([(1, None), (2, ""), (3, mails), (4, "😀 ab1@x.io")], "doc_id long, text string")
    got = {r.doc_id: r for r in scan(table, settings=Settings(max_findings=3)).collect()}
    assert got[1].masked_text == got[2].masked_text == "" and got[1].log_safe_summary == "scan_sensitive_info: 빈 입력"
    assert (got[3].total_findings, got[3].returned_findings, got[3].truncated_findings) == (6, 3, 3)
    assert "외 1건" in got[3].summary and got[3].counts == {"email": 6} and "fffuser" not in got[3].masked_text
    assert got[4].findings[0].span_start == 2
    assert finding_rows(scan(table)).filter("doc_id = 3").count() == 6
    assert scan(table, settings=Settings(max_findings=0)).filter(F.size("findings") > 0).count() == 0


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(st.sampled_from("0123456789-@. ab가계좌카드😀\xa0"), max_size=40), min_size=60, max_size=60))
def test_spans_match_python(spark, texts):
    table = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id int, text string")
    for pattern in (P.CARD, P.PHONE, P.ACCOUNT):
        got = {r.id: [(s.s, s.e) for s in r.f] for r in table.select("id", spans(F.col("text"), pattern).alias("f")).collect()}
        for k, t in enumerate(texts):
            assert got[k] == [m.span() for m in re.finditer(pattern, t, re.ASCII)]


def test_signals_and_citations(spark):
    one = spark.range(1)
    ask = lambda c: one.select(c.alias("x")).first().x
    assert [s.matched_terms for s in ask(signals.risk_signals(F.lit("이 상품은 수익률 보장 상품입니다.")))] == [["수익률 보장"]]
    assert ask(signals.risk_signals(F.lit("공개 전략회의 자료입니다")))[0].matched_terms == ["공개 전"]
    for answer, article, fine in (("제10조", "제10조의2", False), ("제 10 조", "제10조", True), ("제999조", "제10조", False), (None, "제10조", True)):
        assert ask(citations.verify(F.lit(answer).cast("string"), F.array(F.lit(article)))).citation_verified is fine
    assert ask(citations.snippet(F.lit("가 " * 400))).endswith("…")
    assert ask(citations.clean_answer(F.lit("<think>no</think> a  b"))) == "a b"
    assert ask(signals.asks_review(F.lit("준법감시인 확인"))) is True


def test_fusion(spark):
    v = spark.createDataFrame([(1, c, k + 1, s, 1 - s) for k, (c, s) in enumerate([("a", 0.9), ("b", 0.8), ("c", 0.7)])], "query_id int, chunk_id string, rank int, vector_similarity double, vector_distance double")
    b = spark.createDataFrame([(1, c, k + 1) for k, c in enumerate("bad")], "query_id int, chunk_id string, rank int")
    got = [r for r in retrieval.fuse(v, b, 3).orderBy("position").collect()]
    assert [r.chunk_id for r in got] == ["a", "b", "c"] and got[0].score == pytest.approx(1 / 61 + 1 / 62)
    for sim, passed in ((0.49, True), (0.4899996, True), (0.4899, False), (None, False)):
        hits = spark.createDataFrame([(1, "a", 1, sim, None)], "query_id int, chunk_id string, position int, vector_similarity double, vector_distance double")
        assert retrieval.confidence(hits).first().threshold_passed is passed


def test_bm25_negative_idf(spark):
    import math

    docs = spark.createDataFrame([("a", 0, "x y"), ("b", 1, "x z z"), ("c", 2, "x")], "chunk_id string, seq int, text string")
    got = {r.chunk_id: r.bm25 for r in retrieval.bm25_search(docs, spark.createDataFrame([(1, "x Z")], "query_id int, query string")).collect()}
    idf = {"x": math.log(0.5) - math.log(3.5), "y": math.log(2.5) - math.log(1.5), "z": math.log(2.5) - math.log(1.5)}
    mean = sum(idf.values()) / 3
    part = lambda w, tf, dl: w * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / 2))
    want = {"b": part(0.25 * mean, 1, 3) + part(idf["z"], 2, 3), "a": part(0.25 * mean, 1, 2), "c": part(0.25 * mean, 1, 1)}
    assert got == pytest.approx({k: v for k, v in want.items() if v > 0})


def chunked(spark, name: str, text, limit: int = 900, overlap: int = 120):
    docs = spark.createDataFrame([(name, text, 0)], "file_name string, text string, doc_seq long")
    return chunking.chunk(docs, limit, overlap, name_is_file=False).orderBy("chunk_seq").collect()


def test_only_texts_beyond_ascii_are_sent_to_python(spark, capsys):
    texts = [None, "", "plain", *("\u1112\u1161\u11ab e\u0301 " + str(k) for k in range(150)), "한 é"]
    out = chunking.composed(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, text string").coalesce(1), "text")
    assert [r.text for r in out.orderBy("k").collect()] == ["", "", "plain", *(f"한 é {k}" for k in range(150)), "한 é"]
    out.explain()
    plan = capsys.readouterr().out
    assert "MapInArrow" not in plan and "octet_length" in plan


def test_chunking(spark):
    text = "머리말 제1조(목적) 가.\n제10조(정보 교류) 나.\n제52조의2(차단) 다."
    got = chunked(spark, "KOFIA_기준", text)
    assert [c["article"] for c in got] == ["제1조", "제10조", "제52조의2"] and got[2]["chunk_id"] == "kofia_52_2_0"
    assert got[0]["text"] == "제1조(목적) 가." and got[1]["article_title"] == "정보 교류"
    long = "제99조(긴 조항) " + " ".join(f"{m} 이 항은 길다. 문장이 이어진다." for m in "①②③")
    parts = chunked(spark, "KOFIA", long, 60, 20)
    assert [p["text"][0] for p in parts] == ["제", "②", "③"] and all(len(p["text"]) <= 60 for p in parts)
    sentences = chunked(spark, "K", "제3조(가) " + " ".join(f"문장 {k}." for k in range(40)), 50, 20)
    assert len(sentences) > 4 and all(len(p["text"]) <= 50 for p in sentences) and " ".join(p["text"] for p in sentences).endswith("문장 39.")
    ids = [c["chunk_id"] for c in chunked(spark, "x", "가" * 110 + ". " + "나" * 300, 200, 150)]
    assert 2 <= len(ids) <= 9 and len(set(ids)) == len(ids)
    assert [c["chunk_id"] for c in chunked(spark, "A", "제1조(가) 나 제1조(다) 라")] == ["a_1_0", "a_1_0_1"]
    with pytest.raises(ValueError):
        chunked(spark, "x", "가", 100, 100)
    name = lambda x: spark.range(1).select(chunking.source_name(F.lit(x)).alias("x")).first().x
    assert name("01_KOFIA_표준내부통제기준.txt") == "KOFIA_표준내부통제기준" and name("01.txt") == "01"
    docs = spark.createDataFrame([("a.txt", text, 0), ("b.txt", "no header here", 1), ("c.txt", None, 2), ("d.txt", "", 3)], "file_name string, text string, doc_seq long")
    assert [r.n for r in chunking.chunk(docs).groupBy("file_name").agg(F.count("*").alias("n")).orderBy("file_name").collect()] == [3, 1]
    assert chunking.chunk(docs.limit(0)).count() == 0


def test_windows_cover_the_text(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice(["가", "b", " ", ". ", "\n", "c"]) for _ in range(rng.randrange(0, 900))) for _ in range(40)]
    docs = spark.createDataFrame([(f"t{k}", t, k) for k, t in enumerate(texts)], "file_name string, text string, doc_seq long")
    for limit, overlap in ((100, 20), (60, 59), (50, 0)):
        rows = chunking.composed(docs, "text").select("doc_seq", squeeze(F.col("text")).alias("flat"))
        for r in rows.select("doc_seq", "flat", chunking.window_bounds(F.array("flat"), F.char_length("flat"), limit, overlap).alias("w")).collect():
            n, at = len(r.flat), 0
            for k, w in enumerate(r.w):
                assert w.a == at and w.a < w.b <= min(n, w.a + limit)
                stops = [j + 2 for j in range(w.a + limit // 2 + 1, w.a + limit - 1) if r.flat[j : j + 2] == ". "]
                assert w.b == (n if w.a + limit >= n else stops[-1] if stops else w.a + limit)
                at = w.b - overlap if w.b - overlap > w.a else w.b
                assert (w.b == n) == (k == len(r.w) - 1)
            assert bool(r.w) == bool(n)


def test_index(spark, tmp_path, capsys):
    corpus, path = tmp_path / "corpus", str(tmp_path / "index")
    assert index.corpus_files(spark, str(corpus)).count() == 0
    assert index.ensure_ready(spark, str(corpus), path)[1] == index.NO_CORPUS
    corpus.mkdir()
    (corpus / "02_기준.txt").write_text("제1조(목적) 가를 정한다.\n제2조(범위) 나를 정한다.", "utf-8")
    (corpus / "01_plain.md").write_bytes("조항이 없는 문서입니다.".encode("cp949"))
    assert [r.file_name for r in index.corpus_files(spark, str(corpus)).collect()] == ["01_plain.md", "02_기준.txt"]
    embed = lambda text: F.array(F.length(text).cast("float"), F.lit(1.0).cast("float"))
    ready, error = index.ensure_ready(spark, str(corpus), path, embed)
    assert error is None and ready.count() == 3
    assert index.read_manifest(spark, path) == {"corpus": files.corpus_fingerprint(spark, str(corpus)), "chunks": 3}
    rows = ready.chunks.collect()
    assert {r.category for r in rows} == {None} and {r.source for r in rows} == {"기준", "plain"}
    asked = spark.createDataFrame([(1, "목적을 정한다", [9.0, 1.0])], "query_id int, query string, query_embedding array<float>")
    hits = ready.search(asked).orderBy("position").collect()
    assert hits and hits[0].article in ("제1조", "제2조", "")
    with pytest.raises(RuntimeError, match="인덱스가 없습니다"):
        index.load(spark, str(tmp_path / "nowhere")).search(asked)
    assert index.ensure_ready(spark, str(corpus), path, embed)[0].number == ready.number == 1  # the same corpus is not built again
    (tmp_path / "index" / "versions" / f"{1:012d}.json").write_text("no json")
    assert index.read_manifest(spark, path) is None and index.ensure_ready(spark, str(corpus), path, embed)[0].count() == 3
    with pytest.raises(ValueError):
        index.load_paths(spark, [str(corpus / "x.docx")])
    summary = index.ingest(spark, [str(corpus / "02_기준.txt")], str(tmp_path / "two"))
    assert summary["total_chunks"] == 2 and summary["per_source"] == {"기준": 2}
    assert ingest.main(["load", "--index", str(tmp_path / "three"), str(corpus / "*.txt")], spark) == 0
    assert json.loads(capsys.readouterr().out) == {"total_chunks": 2, "per_source": {"기준": 2}, "files": [f"file:{corpus}/02_기준.txt"]}
    assert ingest.main(["sync", "--index", str(tmp_path / "five"), str(corpus)], spark) == 0
    assert json.loads(capsys.readouterr().out) == {"total_chunks": 3, "files": {"new": 2, "changed": 0, "gone": 0}}
    assert ingest.main(["find", "--index", str(tmp_path / "five"), "가를", "정한다"], spark) == 0
    assert json.loads(capsys.readouterr().out)["matches"][0]["article"] == "제1조"
    assert ingest.main(["load", "--index", str(tmp_path / "four"), str(corpus / "none*.txt")], spark) == 1 and "error" in json.loads(capsys.readouterr().err)
    assert ingest.main(["find", "--index", str(tmp_path / "four"), "x"], spark) == 1 and index.NO_INDEX in capsys.readouterr().err
    assert not (tmp_path / "four").exists()


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("계좌 안내", "utf-8")
    (tmp_path / "b.md").write_bytes("제7조(보고) 보고한다".encode("cp949"))
    (tmp_path / "c.txt").write_text("   ")
    (tmp_path / "d.docx").write_text("x")
    (tmp_path / "e.pdf").write_bytes(b"not a pdf")
    got = {r.file_name: r for r in files.read_files(spark, str(tmp_path), Settings(max_text_chars=4)).collect()}
    assert got["a.txt"].text == "계좌 안" and got["a.txt"].truncated and got["a.txt"].total_chars == 5
    assert got["b.md"].text.startswith("제7조")
    assert all(got[x].error and got[x].text is None for x in ("c.txt", "d.docx", "e.pdf"))
    for x in ("c.txt", "d.docx", "e.pdf"):
        (tmp_path / x).unlink()
    docs = files.rule_documents(spark, str(tmp_path))
    assert [r.file_name for r in docs.orderBy("doc_seq").collect()] == ["a.txt", "b.md"]
    mark = files.corpus_fingerprint(spark, str(tmp_path))
    (tmp_path / "f.txt").write_text("new")
    assert files.corpus_fingerprint(spark, str(tmp_path)) != mark
    choose = lambda a, b: spark.range(1).select(files.choose_input(F.lit(a), F.lit(b)).alias("x")).first().x
    assert (choose("a", " "), choose("a", "b"), choose(" ", "b"), choose("", "")) == ("text", "both", "file", "text")


def records(spark, rows):
    return spark.createDataFrame([(k, "2026-01-01T09:00:00+09:00", t, i, s, f) for k, (t, i, s, f) in enumerate(rows)], "seq long, ts string, tool_name string, input_text string, result_summary string, requires_human_review boolean")


def test_audit(spark):
    log = audit.append(records(spark, [("a|b", "x", "계좌번호 110-222-333333 노출", False), ("t", "y", "요약", False), ("Check_Disclosure_Risk", "z", "s", True)])).cache()
    rows = log.orderBy("id").collect()
    assert rows[0].prev_hash == "GENESIS" and rows[1].prev_hash == rows[0].record_hash
    assert "***3333" in rows[0].result_summary and rows[0].requires_human_review == 1 and rows[1].requires_human_review == 0
    ask = lambda x: tuple(audit.verify(x).first())
    assert ask(log) == (True, None, 3) and ask(log.limit(0)) == (True, None, 0)
    assert ask(log.filter("id != 2")) == (False, 3, 2)
    assert ask(log.withColumn("requires_human_review", F.when(F.col("id") == 3, 0).otherwise(F.col("requires_human_review")))) == (False, 3, 3)
    # a pinned gap: '|' and '/' are one character to the hash
    assert ask(log.withColumn("tool_name", F.replace("tool_name", F.lit("|"), F.lit("/"))))[0]
    with pytest.raises(Exception, match="must not be null"):
        audit.append(records(spark, [("a", "x", None, False)])).collect()


def test_streaming(spark, tmp_path):
    from haystrata.streaming.scan_stream import audit_stream

    (tmp_path / "in").mkdir()
    source = lambda: spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in"))
    for k, text in enumerate(["메일은 ab@example.com 입니다.", "평범한 글"]):
        spark.createDataFrame([(k, text)], "doc_id long, text string").write.mode("append").parquet(str(tmp_path / "in"))
        audit_stream(source(), str(tmp_path / "log"), str(tmp_path / "mark")).awaitTermination()
    log = AuditLog(spark, str(tmp_path / "log")).read()
    assert tuple(audit.verify(log).first()) == (True, None, 2)


def test_file_meta(spark):
    table = spark.createDataFrame([(1, "평범한 글"), (2, "평범한 글")], "doc_id long, text string")
    meta = spark.createDataFrame([(1, "a.txt", ".txt", None, 5, True), (2, "b.txt", ".txt", None, 5, False)], "doc_id long, file_name string, extension string, pages int, total_chars int, truncated boolean")
    got = {r.doc_id: r for r in tools.apply_file_meta(tools.scan_tool(table), meta).collect()}
    assert got[1].requires_human_review and len(got[1].outputs) == 2 and not got[2].requires_human_review


def test_settings(spark):
    spark.conf.set("haystrata.max_findings", "-3")
    spark.conf.set("haystrata.top_k", "7")
    assert (Settings.of(spark).max_findings, Settings.of(spark).top_k) == (100, 7)
    spark.conf.unset("haystrata.max_findings")
    spark.conf.unset("haystrata.top_k")


def test_queries_against_sql(spark):
    import duckdb

    sf, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("nation", "supplier", "events", "customer", "orders", "documents", "embeddings", "benchmark"):
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    assert set(queries.ORACLES) == set(queries.QUERIES)
    for name, sql in queries.ORACLES.items():
        frame = queries.QUERIES[name](spark, sf)
        columns = sorted(frame.columns)
        have = sorted(str([round(v, 6) if isinstance(v, float) else v for v in r]) for r in frame.select(columns).collect())
        want = con.execute(sql)
        order = [d[0] for d in want.description]
        assert sorted(order) == columns, name
        rows = [[r[order.index(c)] for c in columns] for r in want.fetchall()]
        assert have == sorted(str([round(v, 6) if isinstance(v, float) else v for v in r]) for r in rows), name
