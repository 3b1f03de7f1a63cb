"""Registered queries of the document-compliance operators and the same results in DuckDB's SQL.

The test tables hold no Korean text, so texts are built from numeric columns by the same
templates in both dialects; a template's expected result is known in closed form.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haystrata.operators import audit, calibrate, chunking, citations, retrieval, signals
from haystrata.operators import scan as S
from haystrata.plans import tools
from haystrata.sources import corpus, index, postings, shared, vectors
from haystrata.sources.audit_log import AuditLog
from haystrata.sources.files import truncated

# template with {n} for a number, masked text, types found in order
TEMPLATES = [
    ("계좌번호 900101-1234567 입금 {n}", "계좌번호 900101-1****** 입금 {n}", "rrn"),
    ("계좌 4111-1111-1111-1111 로 입금 {n}", "계좌 4111-****-****-1111 로 입금 {n}", "card"),
    ("계좌 991301-1234567 로 입금 {n}", "계좌 ***4567 로 입금 {n}", "account"),
    ("담당자 연락처는 010-1234-5678입니다. {n}", "담당자 연락처는 010-****-5678입니다. {n}", "phone"),
    ("자료는 gildong.hong@example.com으로 회신 {n}", "자료는 gi***@example.com으로 회신 {n}", "email"),
    ("일련번호 1234-5678-9012-3456 확인 {n}", "일련번호 1234-5678-9012-3456 확인 {n}", ""),
    ("결제 카드번호: 4571-1234-1234-1234 {n}", "결제 카드번호: 4571-****-****-1234 {n}", "card"),
    ("이 상품은 원금 보장되고 확정 수익을 제공합니다. {n}", "이 상품은 [금지표현]되고 [금지표현]을 제공합니다. {n}", "prohibited_claim,prohibited_claim"),
    ("이 상품은 원금 보장되지 않습니다. {n}", "이 상품은 원금 보장되지 않습니다. {n}", ""),
    ("이 문서는 대외비이며 발간 전 자료입니다. {n}", "이 문서는 [내부정보키워드]이며 [내부정보키워드] 자료입니다. {n}", "internal_keyword,internal_keyword"),
    ("원금 손실 가능성이 전혀 없었습니다. 구조상 리스크가 없었습니다. {n}", "[금지표현]. 구조상 [금지표현]. {n}", "prohibited_claim,prohibited_claim"),
    ("공개 전략회의 자료 {n}", "공개 전략회의 자료 {n}", ""),
    ("안정적 고수익을 드립니다. {n}", "[금지표현]을 드립니다. {n}", "prohibited_claim"),
    ("이 종목은 무조건 상승합니다. {n}", "이 종목은 [금지표현]합니다. {n}", "prohibited_claim"),
]
SIGNAL_TEXTS = [
    ("실적 발표 전 대외 공유 자료입니다.", "미공개/발표 전 정보:발표 전;실적/재무 전망:실적", "1호,6호"),
    ("미공개 실적, 발표 전 유상증자 자료", "미공개/발표 전 정보:미공개,발표 전;실적/재무 전망:실적;투자·출자/M&A:유상증자;공시/중요 경영사항:증자", "1호,5호,6호"),
    ("이 상품은 수익률 보장 상품입니다.", "투자권유/수익 표현:수익률 보장", ""),
    ("공개 전략회의 자료입니다", "미공개/발표 전 정보:공개 전", ""),
    ("회계 처리와 재무제표를 정리했다", "회계 관련:재무제표,회계", "7호"),
    ("점심 뭐 먹지", "", ""),
]
ANSWERS = [
    ("제 10 조에 따른다", "제10조", "true", "제10조"),
    ("제10조에 따른다", "제10조의2", "false", "제10조"),
    ("제999조와 제10조 그리고 제999조", "제10조", "false", "제999조,제10조"),
    ("근거를 확인했습니다", "제10조", "true", ""),
]


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _pick(number, values: list[str]):
    """values[number % len] as a Spark expression."""
    return F.element_at(F.split(F.lit("\x01".join(values)), "\x01"), (number % len(values) + 1).cast("int"))


def _pick_sql(number: str, values: list[str]) -> str:
    cases = " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(values))
    return f"CASE ({number}) % {len(values)} {cases} END"


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events")
    return e.select("event_id", F.replace(_pick(F.col("event_id"), [t for t, _, _ in TEMPLATES]), F.lit("{n}"), F.concat(F.lit("번호"), (F.col("user_id") % 1000).cast("string"))).alias("text"))


def scan_masked_text(spark, sf_dir):
    return S.scan(_texts(spark, sf_dir)).select("event_id", "masked_text")


def scan_claim_priority(spark, sf_dir):
    types = F.array_join(F.transform("findings", lambda f: f["type"]), ",")
    return S.scan(_texts(spark, sf_dir)).select("event_id", types.alias("types"), F.col("total_findings").cast("long").alias("n"), "requires_human_review")


def scan_counts_by_type(spark, sf_dir):
    rows = S.finding_rows(S.scan(_texts(spark, sf_dir)), "event_id")
    return rows.groupBy("type", "type_code").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("confidence") == "low").alias("n_low"))


def scan_log_safe_summary(spark, sf_dir):
    return S.scan(_texts(spark, sf_dir)).select("event_id", "log_safe_summary")


def scan_email_documents(spark, sf_dir):
    d = _read(spark, sf_dir, "documents").select("doc_id", S.email(F.col("text")).alias("f"))
    return d.filter(F.size("f") > 0).select("doc_id", F.size("f").cast("long").alias("n"), F.array_join(F.transform("f", lambda f: f["mask"]), " ").alias("masks"))


def scan_card_luhn_documents(spark, sf_dir):
    d = _read(spark, sf_dir, "documents").select("doc_id", F.filter(S.card(F.col("text")), lambda f: f["confidence"] == "high").alias("f"))
    return d.filter(F.size("f") > 0).select("doc_id", F.size("f").cast("long").alias("n"), F.array_join(F.transform("f", lambda f: f["mask"]), " ").alias("masks"))


def scan_envelope(spark, sf_dir):
    out = tools.scan_tool(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "ok", "tool", F.col("data.total_findings").cast("long").alias("n"), "requires_human_review", F.coalesce("error", F.lit("")).alias("error"))


PHONE_HEADS = ["010", "02", "0507", "070"]


def scan_phone_events(spark, sf_dir):
    e = _read(spark, sf_dir, "events")
    four = lambda c: F.lpad((F.col(c) % 10000).cast("string"), 4, "0")
    t = e.select("event_id", F.concat(F.lit("담당자 연락처는 "), _pick(F.col("event_id"), PHONE_HEADS), F.lit("-"), four("user_id"), F.lit("-"), four("event_id"), F.lit("입니다.")).alias("text"))
    return t.select("event_id", F.array_join(F.transform(S.phone(F.col("text")), lambda f: F.concat_ws(":", f["mask"], f["s"].cast("string"), f["e"].cast("string"))), " ").alias("found"))


def scan_rrn_confidence(spark, sf_dir):
    e = _read(spark, sf_dir, "events")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    head = F.concat(F.lit("90"), two(F.col("event_id") % 14), two(F.col("user_id") % 33))
    t = e.select("event_id", F.concat(_pick(F.col("event_id"), ["문서 ", "주민번호 ", "문서 "]), head, _pick(F.col("event_id"), ["", "", "-"]), F.lit("1234567 끝")).alias("text"))
    return t.select("event_id", F.array_join(F.transform(S.rrn(F.col("text")), lambda f: F.concat_ws(":", f["mask"], f["confidence"])), " ").alias("found"))


def scan_account_window(spark, sf_dir):
    e = _read(spark, sf_dir, "events")
    t = e.select("event_id", F.concat(F.lit("110-222-"), F.lpad((F.col("event_id") % 1000000).cast("string"), 6, "0"), F.repeat(F.lit("가"), (F.col("event_id") % 30).cast("int")), F.lit("입금")).alias("text"))
    return t.select("event_id", F.array_join(F.transform(S.account(F.col("text")), lambda f: f["mask"]), " ").alias("found"))


def file_truncation(spark, sf_dir):
    d = truncated(_read(spark, sf_dir, "documents").select("doc_id", "text"), 1000)
    return d.select("doc_id", F.col("total_chars").cast("long").alias("total_chars"), "truncated", F.char_length("text").cast("long").alias("kept"), F.sha2("text", 256).alias("sha"))


def _signal_texts(spark, sf_dir):
    e = _read(spark, sf_dir, "events")
    return e.select("event_id", signals.risk_signals(_pick(F.col("event_id"), [t for t, _, _ in SIGNAL_TEXTS])).alias("risk_signals"))


def risk_signals(spark, sf_dir):
    one = lambda s: F.concat(s["type"], F.lit(":"), F.array_join(s["matched_terms"], ","))
    return _signal_texts(spark, sf_dir).select("event_id", F.array_join(F.transform("risk_signals", one), ";").alias("found"))


def risk_criteria(spark, sf_dir):
    met = signals.matched_criteria(_signal_texts(spark, sf_dir), "event_id")
    return met.groupBy("criterion_no", "name").agg(F.count(F.lit(1)).alias("n"))


def _answers(spark, sf_dir):
    e = _read(spark, sf_dir, "events")
    t = e.select("event_id", _pick(F.col("event_id"), [a[0] for a in ANSWERS]).alias("answer"), _pick(F.col("event_id"), [a[1] for a in ANSWERS]).alias("article"))
    return t.withColumn("c", citations.verify(F.col("answer"), F.array("article")))


def citation_guard(spark, sf_dir):
    return _answers(spark, sf_dir).select("event_id", F.col("c.citation_verified").cast("string").alias("verified"), F.array_join("c.cited_articles", ",").alias("cited"), F.coalesce(citations.guarded_answer(F.col("answer"), F.col("c")), F.lit("-")).alias("kept"))


def review_decision(spark, sf_dir):
    rows = _answers(spark, sf_dir)
    texts = _pick(F.col("event_id"), [t for t, _, _ in SIGNAL_TEXTS])
    review = signals.check_review(signals.risk_signals(texts), F.col("c.citation_verified"), citations.guarded_answer(F.col("answer"), F.col("c")), F.col("event_id") % 5 != 0)
    return rows.select("event_id", review.alias("review"))


def snippet_format(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", citations.snippet(F.col("text")).alias("snippet"))


def article_chunks(spark, sf_dir):
    n = _read(spark, sf_dir, "nation")
    text = F.concat(F.lit("머리말 제1조(목적) 이 기준은 "), F.col("n_name"), F.lit("에 적용한다. 제2조의3(정의) 용어는 "), F.col("n_nationkey").cast("string"), F.lit("번이다."))
    docs = n.select(F.concat(F.lit("01_Rule"), F.col("n_nationkey").cast("string"), F.lit("_기준.txt")).alias("file_name"), text.alias("text"), F.col("n_nationkey").cast("long").alias("doc_seq"))
    return chunking.chunk(docs).select("file_name", "source", "article", "article_title", "chunk_id", "text")


def clause_chunks(spark, sf_dir):
    n = _read(spark, sf_dir, "nation")
    long = lambda mark, c: F.concat(F.lit(mark + " "), F.repeat(F.concat(F.col("n_name"), F.lit("은 보고한다. ")), c))
    text = F.concat(F.lit("제7조(보고) "), long("①", F.lit(30)), long("②", F.lit(20)), long("③", F.lit(80)))
    docs = n.select(F.concat(F.col("n_name"), F.lit(".txt")).alias("file_name"), text.alias("text"), F.col("n_nationkey").cast("long").alias("doc_seq"))
    return chunking.chunk(docs, 400, 50).select("file_name", "chunk_id", "chunk_seq", "text")


def _plain(spark, sf_dir):
    d = _read(spark, sf_dir, "documents")
    return chunking.chunk(d.select(F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("file_name"), "text", F.col("doc_id").alias("doc_seq")))


def plain_chunks(spark, sf_dir):
    return _plain(spark, sf_dir).select(F.col("doc_seq").alias("doc_id"), "chunk_id", "chunk_seq", F.char_length("text").cast("long").alias("n_chars"))


def chunk_stats(spark, sf_dir):
    d = _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc_seq"), F.col("source").alias("origin"))
    return _plain(spark, sf_dir).select("doc_seq").join(d, "doc_seq").groupBy("origin").agg(F.count(F.lit(1)).alias("n_chunks"))


_indexes: dict[tuple, object] = {}


def _stored(spark, sf_dir, table: str, chunks: DataFrame, module, **options):
    """The stored index of a table's chunks; built once, and again when a file of the table has changed."""
    at = f"{sf_dir}/{table}.parquet"
    key = (spark.sparkContext.applicationId, module.__name__, at, tuple(chunks.columns), *shared.listed(spark, at))
    if key not in _indexes:
        _indexes[key] = module.build(chunks, shared.folder(spark, table), **options)
    return _indexes[key]


def _vector_index(spark, sf_dir):
    e = _read(spark, sf_dir, "embeddings")
    return _stored(spark, sf_dir, "embeddings", e.select(F.col("vec_id").cast("string").alias("chunk_id"), F.col("vec_id").alias("seq"), "embedding"), vectors)


def _word_index(spark, sf_dir):
    d = _read(spark, sf_dir, "documents")
    return _stored(spark, sf_dir, "documents", d.select(F.col("doc_id").cast("string").alias("chunk_id"), F.col("doc_id").alias("seq"), "text"), postings, null_lengths=False)


def _vectors(spark, sf_dir):
    e = _read(spark, sf_dir, "embeddings")
    asked = e.filter(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_embedding"))
    return _vector_index(spark, sf_dir).search(asked)


def vector_topk(spark, sf_dir):
    return _vectors(spark, sf_dir).select("query_id", "chunk_id", "rank", F.round("vector_similarity", 5).alias("similarity"))


def _lexical(spark, sf_dir):
    asked = _read(spark, sf_dir, "benchmark").filter(F.col("item_id") % 50 == 0).select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return _word_index(spark, sf_dir).search(asked)


def bm25_topk(spark, sf_dir):
    return _lexical(spark, sf_dir).select("query_id", "chunk_id", "rank", F.round("bm25", 5).alias("bm25"))


def rrf_hybrid(spark, sf_dir):
    return retrieval.fuse(_vectors(spark, sf_dir), _lexical(spark, sf_dir)).select("query_id", "chunk_id", "position", F.round("score", 8).alias("score"))


def retrieval_confidence(spark, sf_dir):
    found = retrieval.fuse(_vectors(spark, sf_dir).filter(F.col("chunk_id") != F.col("query_id").cast("string")), _lexical(spark, sf_dir))
    return retrieval.confidence(found).select("query_id", F.round("best_vector_similarity", 5).alias("best"), "threshold_passed")


TS = "2026-01-01T09:00:00+09:00"


def _log(spark) -> AuditLog:
    """A new log in the shared folder."""
    return AuditLog(spark, shared.folder(spark, "audit-log"))


def _supplied(spark, sf_dir):
    """Calls to log, from the suppliers: one in ten names the check tool twice running, one in thirteen lacks its summary or flag."""
    s = _read(spark, sf_dir, "supplier")
    k, twice = F.col("s_suppkey"), F.explode(F.when(F.col("s_suppkey") % 10 == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    rows = s.select("*", twice.alias("again"))
    name = F.when(k % 10 == 3, F.when(F.col("again") == 1, " Check_Disclosure_Risk ").otherwise("check_disclosure_risk")).otherwise(F.concat(F.lit("tool|"), (k % 4).cast("string")))
    summary = F.when(k % 13 != 5, F.when(k % 6 == 0, F.concat(F.lit("메일 ab@example.com "), F.col("s_name"))).otherwise(F.concat(F.lit("요약 "), F.col("s_name"))))
    return rows.select((k * 2 + F.col("again")).alias("seq"), F.lit(TS).alias("ts"), name.alias("tool_name"), F.coalesce("s_name", F.lit("")).alias("input_text"), summary.alias("result_summary"), F.when(k % 13 != 7, k % 3 == 0).alias("requires_human_review"))


def audit_log_calls(spark, sf_dir):
    """The log tool on all calls: what each returned."""
    out = tools.log_tool(_log(spark), _supplied(spark, sf_dir))
    return out.select("seq", "ok", "summary", "requires_human_review", F.coalesce("error", F.lit("")).alias("error"), F.coalesce("record.id", F.lit(-1)).alias("log_id"), F.coalesce("record.record_hash", F.lit("")).alias("record_hash"), F.coalesce("skip.skipped", F.lit(False)).alias("skipped"))


def audit_log_written(spark, sf_dir):
    """The log that two calls of the log tool have written, read back."""
    log, calls = _log(spark), _supplied(spark, sf_dir)
    tools.log_tool(log, calls.filter("seq % 4 < 2"))
    tools.log_tool(log, calls.filter("seq % 4 >= 2"))
    return log.read()


def audit_log_verify(spark, sf_dir):
    """Verification before and after a second append, and after a segment was edited: only new and changed segments are hashed."""
    log, calls = _log(spark), _supplied(spark, sf_dir)
    tools.log_tool(log, calls.filter("seq % 4 < 2"))
    seen = [("first", log.verify())]
    tools.log_tool(log, calls.filter("seq % 4 >= 2"))
    seen += [("second", log.verify()), ("again", log.verify())]
    at = f"{log.path}/segments/{log.segments()[0]}"
    rows = shared.written(spark.read.parquet(at), "edited")
    last = rows.agg(F.max("id")).first()[0]
    rows.withColumn("result_summary", F.when(F.col("id") == last, "edited by hand").otherwise(F.col("result_summary"))).coalesce(1).write.mode("overwrite").parquet(at)
    seen += [("edited", log.verify()), ("whole", log.verify(full=True))]
    return spark.createDataFrame([(case, v["valid"], v["broken_at"] or -1, v["total_records"], v["hashed"]) for case, v in seen], "case string, valid boolean, broken_at long, total_records long, hashed long")


def _records(spark, sf_dir):
    n = _read(spark, sf_dir, "nation")
    return n.select(
        F.col("n_nationkey").alias("seq"), F.lit(TS).alias("ts"), F.concat(F.lit("tool|"), (F.col("n_regionkey")).cast("string")).alias("tool_name"), F.col("n_name").alias("input_text"),
        F.when(F.col("n_nationkey") % 5 == 0, F.lit("담당자 010-1234-5678 확인")).otherwise(F.concat(F.lit("요약 "), F.col("n_name"))).alias("result_summary"), (F.col("n_nationkey") % 3 == 0).alias("requires_human_review"),
    )


def audit_chain_append(spark, sf_dir):
    return audit.append(_records(spark, sf_dir))


def audit_chain_verify(spark, sf_dir):
    log = audit.append(_records(spark, sf_dir))
    edited = log.withColumn("result_summary", F.when(F.col("id") == 7, F.lit("고침")).otherwise(F.col("result_summary")))
    cut = log.filter(F.col("id") != 12)
    out = [audit.verify(x).withColumn("case", F.lit(c)) for c, x in (("whole", log), ("edited", edited), ("cut", cut), ("shorter", log.filter(F.col("id") < 20)))]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3]).select("case", "valid", F.coalesce("broken_at", F.lit(-1)).alias("broken_at"), "total_records")


def audit_duplicate_guard(spark, sf_dir):
    log = audit.append(_records(spark, sf_dir))
    calls = _read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("call_id"), F.concat(F.lit(" TOOL|"), F.col("n_regionkey").cast("string"), F.lit(" ")).alias("tool_name"), F.col("n_name").alias("input_text"))
    return audit.repeats_latest(log, calls).select("call_id", "duplicate")


def _measured(spark, sf_dir):
    return _read(spark, sf_dir, "embeddings").select(_pick(F.col("label"), ["A", "B", "C"]).alias("group"), F.round(F.abs(F.col("embedding")[0]).cast("double") * 3, 6).alias("top1"))


def calibration_stats(spark, sf_dir):
    return calibrate.group_stats(_measured(spark, sf_dir))


def calibration_margin(spark, sf_dir):
    return calibrate.margin(_measured(spark, sf_dir)).select("margin", F.coalesce("midpoint", F.lit(-1.0)).alias("midpoint"))


def threshold_sweep(spark, sf_dir):
    return calibrate.sweep(_measured(spark, sf_dir))


def _tool_matches(spark, sf_dir):
    d, e = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "embeddings")
    chunks = d.join(e, d["doc_id"] == e["vec_id"], "left").select(F.col("doc_id").cast("string").alias("chunk_id"), F.col("doc_id").alias("seq"), "text", "embedding", "source", F.concat("source", F.lit(".txt")).alias("file_name"), F.lit("제10조").alias("article"), F.lit("보고").alias("article_title"))
    b = _read(spark, sf_dir, "benchmark")
    queries = b.join(e, b["item_id"] == e["vec_id"], "left").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"), F.col("embedding").alias("query_embedding"))
    return tools.matches(chunks, queries, words=_word_index(spark, sf_dir)), queries


def search_tool(spark, sf_dir):
    found, queries = _tool_matches(spark, sf_dir)
    return tools.search_tool(queries, found).select("query_id", "ok", "summary", F.coalesce(F.size("matches"), F.lit(0)).cast("long").alias("n_matches"), "threshold_passed", F.size("outputs").cast("long").alias("n_outputs"), "requires_human_review")


def check_tool(spark, sf_dir):
    found, queries = _tool_matches(spark, sf_dir)
    answers = queries.select("query_id", F.concat(F.lit("<think>x</think> "), _pick(F.col("query_id"), [a[0] for a in ANSWERS])).alias("answer"))
    texts = queries.select("query_id", F.concat(F.lit("회계 처리 검토. "), F.col("query")).alias("text"))
    result = tools.check_and_log(texts, found, _log(spark), answers, ts=TS)
    criteria = F.array_join(F.transform("matched_criteria", lambda c: c["criterion_no"]), ",")
    return result.select("query_id", "ok", "summary", criteria.alias("criteria"), "threshold_passed", "requires_human_review", F.size("outputs").cast("long").alias("n_outputs"), F.col("audit_log.id").alias("log_id"), F.col("audit_log.record_hash").alias("record_hash"))


def scan_calls(spark, sf_dir):
    e = _read(spark, sf_dir, "events")
    text, path = _pick(F.col("event_id"), ["평범한 글", "평범한 글", "평범한 글", " "]), _pick(F.col("event_id"), ["", "a.txt", " ", "/nowhere/b.txt"])
    return tools.scan_calls(e.select("event_id", text.alias("text"), path.alias("file_path")), id_col="event_id").select("event_id", "ok", "summary", "requires_human_review", F.coalesce("error", F.lit("")).alias("error"))


def _customers(spark, sf_dir):
    c = _read(spark, sf_dir, "customer")
    key = F.concat(F.lit("k"), F.col("c_custkey").cast("string")).alias("chunk_id")
    none = F.lit(None).cast("string")
    return lambda every, name, seq: c.filter(F.col("c_custkey") % every == 0).select(key, F.concat(F.lit(name), F.col("c_name")).alias("text"), F.lit("customer").alias("source"), none.alias("article"), none.alias("article_title"), none.alias("category"), none.alias("file_name"), F.lit(seq).cast("long").alias("chunk_seq"))


def index_upsert(spark, sf_dir):
    """A written index after an upsert, read back."""
    rows, own = _customers(spark, sf_dir), index.table(spark, shared.folder(spark, "index"))
    own.replace(index.stored(rows(2, "", 0)))
    own.change(index.stored(rows(3, "new ", 1).unionByName(rows(9, "newer ", 2))))
    return index.restored(own.read()).select("chunk_id", "text", "source", "article", F.coalesce("category", F.lit("-")).alias("category"), F.coalesce("file_name", F.lit("-")).alias("file_name"), "chunk_seq")


def index_versions(spark, sf_dir):
    """Chunks of each version of an index: built, upserted, with a source taken out, built anew."""
    rows, own = _customers(spark, sf_dir), index.table(spark, shared.folder(spark, "index"))
    made = [own.replace(index.stored(rows(2, "", 0))), own.change(index.stored(rows(3, "new ", 1))), own.change(index.stored(rows(50, "last ", 2)), F.col("text").endswith("5")), own.replace(index.stored(rows(7, "", 0)))]
    out = [own.read(v).select(F.lit(v.number).cast("long").alias("version"), "chunk_id", "text", F.lit(v.rows).cast("long").alias("stated")) for v in made]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


def corpus_changes(spark, sf_dir):
    """Files that differ between two listings, made of the orders, by digests of their nodes."""
    o = _read(spark, sf_dir, "orders")
    k, path = F.col("o_orderkey"), F.concat(F.lit("/corpus/"), F.col("o_orderkey").cast("string"), F.lit(".txt"))
    listing = o.select("o_orderkey", path.alias("path"), corpus.file_name(path).alias("file_name"), F.col("o_custkey").cast("long").alias("length"), F.col("o_orderdate").cast("timestamp").alias("modificationTime"))
    before = corpus.marked(listing.filter(k % 1000 != 3))
    after = corpus.marked(listing.filter(k % 1000 != 4).withColumn("length", F.when(k % 1000 == 5, F.col("length") + 1).otherwise(F.col("length"))))
    return corpus.changes(before, after, corpus.nodes(before), corpus.nodes(after)).select("path", "kind")


QUERIES = {
    f.__name__: f
    for f in (
        scan_masked_text, scan_claim_priority, scan_counts_by_type, scan_log_safe_summary, scan_email_documents, scan_card_luhn_documents, scan_envelope, scan_phone_events, scan_rrn_confidence, scan_account_window,
        file_truncation, risk_signals, risk_criteria, citation_guard, review_decision, snippet_format, article_chunks, clause_chunks, plain_chunks, chunk_stats, vector_topk, bm25_topk, rrf_hybrid, retrieval_confidence,
        audit_chain_append, audit_chain_verify, audit_duplicate_guard, audit_log_calls, audit_log_written, audit_log_verify, calibration_stats, calibration_margin, threshold_sweep, search_tool, check_tool, scan_calls, index_upsert, index_versions, corpus_changes,
    )
}

# --- the same results in DuckDB's SQL ---
_MASKED = f"replace({_pick_sql('event_id', [m for _, m, _ in TEMPLATES])}, '{{n}}', '번호' || CAST(user_id % 1000 AS VARCHAR))"
_TYPES = _pick_sql("event_id", [t for _, _, t in TEMPLATES])
_DISTINCT_MASKS = ["RRN 900101-1******", "CARD 4111-****-****-1111", "ACCOUNT ***4567", "PHONE 010-****-5678", "EMAIL gi***@example.com", "", "CARD 4571-****-****-1234", "PROHIBITED_CLAIM [금지표현]", "", "INTERNAL_KEYWORD [내부정보키워드]", "PROHIBITED_CLAIM [금지표현]", "", "PROHIBITED_CLAIM [금지표현]", "PROHIBITED_CLAIM [금지표현]"]
_SUMMARIES = [f"scan_sensitive_info: {m}; 사람 검토 필요" if m else "scan_sensitive_info: 탐지된 민감정보/금지문구 없음" for m in _DISTINCT_MASKS]
_EMAILS = r"regexp_extract_all(text, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b')"
_CARDS = r"""
d AS (SELECT doc_id, text, regexp_replace(text, '([^0-9])', chr(1) || '\1' || chr(2), 'g') AS p FROM documents),
c AS (SELECT doc_id, list_transform(regexp_extract_all(p, '(?:^|\x02)([0-9]{16}|[0-9]{4}\x01-\x02[0-9]{4}\x01-\x02[0-9]{4}\x01-\x02[0-9]{4}|[0-9]{4}\x01 \x02[0-9]{4}\x01 \x02[0-9]{4}\x01 \x02[0-9]{4})(?:$|\x01)', 1), lambda x: regexp_replace(x, '[^0-9]', '', 'g')) AS v FROM d),
luhn AS (SELECT doc_id, list_filter(v, lambda x: list_sum(list_transform(range(1, 17), lambda i: CASE WHEN i % 2 = 0 THEN CAST(substr(x, i, 1) AS INT) ELSE CASE WHEN CAST(substr(x, i, 1) AS INT) > 4 THEN CAST(substr(x, i, 1) AS INT) * 2 - 9 ELSE CAST(substr(x, i, 1) AS INT) * 2 END END)) % 10 = 0) AS v FROM c)
"""
_TOP = """
v AS (SELECT q.vec_id AS query_id, CAST(c.vec_id AS VARCHAR) AS chunk_id, c.vec_id AS seq, list_cosine_similarity(CAST(c.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS s FROM embeddings c, embeddings q WHERE q.vec_id % 50 = 0),
vr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, seq) AS rank FROM v QUALIFY rank <= 10)
"""
_BM25 = """
docs AS (SELECT doc_id AS seq, regexp_extract_all(lower(text), '[가-힣]+|[A-Za-z0-9]+') AS terms FROM documents),
stats AS (SELECT count(*) AS n, avg(len(terms)) AS avgdl FROM docs),
post AS (SELECT seq, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT seq, len(terms) AS dl, unnest(terms) AS term FROM docs) GROUP BY seq, term),
idf0 AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM (SELECT term, count(*) AS df FROM post GROUP BY term), stats),
ask AS (SELECT query_id, term, count(*) AS times FROM (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[가-힣]+|[A-Za-z0-9]+')) AS term FROM benchmark WHERE item_id % 50 = 0) GROUP BY query_id, term),
idf AS (SELECT term, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM idf0) ELSE idf END AS idf FROM idf0),
sc AS (SELECT query_id, seq, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS bm25 FROM post JOIN ask USING (term) JOIN idf USING (term), stats GROUP BY query_id, seq),
lr AS (SELECT query_id, CAST(seq AS VARCHAR) AS chunk_id, seq, bm25, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 9) DESC, seq) AS rank FROM sc QUALIFY rank <= 10 AND bm25 > 0)
"""
_FUSED = """
al AS (SELECT query_id, chunk_id, 0 AS list, rank, s FROM {v} UNION ALL SELECT query_id, chunk_id, 1, rank, NULL FROM lr),
fu AS (SELECT query_id, chunk_id, sum(1.0::DOUBLE / (60 + rank)) AS score, min(list * 1000 + rank) AS first, max(s) AS s FROM al GROUP BY query_id, chunk_id),
fp AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first) AS position FROM fu QUALIFY position <= 5)
"""
_CHAIN = """
r AS (SELECT n_nationkey AS seq, '2026-01-01T09:00:00+09:00' AS ts, 'tool|' || CAST(n_regionkey AS VARCHAR) AS tool, sha256(n_name) AS ih, CASE WHEN n_nationkey % 5 = 0 THEN '담당자 010-****-5678 확인' ELSE '요약 ' || n_name END AS s, CASE WHEN n_nationkey % 3 = 0 OR n_nationkey % 5 = 0 THEN 1 ELSE 0 END AS f FROM nation),
o AS (SELECT *, row_number() OVER (ORDER BY seq) AS id FROM r),
ch AS (SELECT CAST(0 AS BIGINT) AS id, '' AS ts, '' AS tool, '' AS ih, '' AS s, 0 AS f, '' AS prev_hash, 'GENESIS' AS record_hash
  UNION ALL SELECT o.id, o.ts, o.tool, o.ih, o.s, o.f, ch.record_hash, sha256(o.ts || '|' || replace(o.tool, '|', '/') || '|' || o.ih || '|' || replace(o.s, '|', '/') || '|' || CAST(o.f AS VARCHAR) || '|' || ch.record_hash) FROM ch JOIN o ON o.id = ch.id + 1)
"""
_MADE = r"""
s0 AS (SELECT *, unnest(CASE WHEN s_suppkey % 10 = 3 THEN [0, 1] ELSE [0] END) AS again FROM supplier),
s1 AS (SELECT s_suppkey * 2 + again AS seq, s_suppkey AS k, again, coalesce(s_name, '') AS input, CASE WHEN s_suppkey % 10 = 3 THEN 'check_disclosure_risk' ELSE 'tool|' || s_suppkey % 4 END AS tool,
  CASE WHEN s_suppkey % 6 = 0 THEN '메일 ***@example.com ' ELSE '요약 ' END || s_name AS summary, CASE WHEN s_suppkey % 3 = 0 OR s_suppkey % 6 = 0 THEN 1 ELSE 0 END AS f, s_suppkey % 13 = 5 OR s_name IS NULL AS no_text, s_suppkey % 13 = 7 AS no_flag FROM s0),
s2 AS (SELECT *, row_number() OVER (ORDER BY {order}) AS id FROM s1 WHERE NOT no_text AND NOT no_flag AND again = 0),
ch AS (SELECT CAST(0 AS BIGINT) AS id, 'GENESIS' AS record_hash, '' AS prev_hash
  UNION ALL SELECT s2.id, sha256('2026-01-01T09:00:00+09:00|' || replace(tool, '|', '/') || '|' || sha256(input) || '|' || replace(summary, '|', '/') || '|' || f || '|' || ch.record_hash), ch.record_hash FROM ch JOIN s2 ON s2.id = ch.id + 1)
"""
_MEASURED = f"m AS (SELECT {_pick_sql('label', ['A', 'B', 'C'])} AS \"group\", round(abs(CAST(embedding[1] AS DOUBLE)) * 3, 6) AS top1 FROM embeddings)"
_FLAT = r"trim(regexp_replace(text, '[\s\x0b\x1c-\x1f\x{85}\pZ]+', ' ', 'g'))"
_STOP = "strpos(reverse(substr(flat, {a} + 1, 900)), ' .')"
_END = f"CASE WHEN {{a}} + 900 >= length(flat) THEN length(flat) WHEN {_STOP} > 0 AND length(substr(flat, {{a}} + 1, 900)) - {_STOP} - 1 > 450 THEN {{a}} + length(substr(flat, {{a}} + 1, 900)) - {_STOP} + 1 ELSE {{a}} + 900 END"
_WINDOWS = f"""
flat AS (SELECT doc_id, source, {_FLAT} AS flat FROM documents),
win AS (SELECT doc_id, 0::BIGINT AS k, 0::BIGINT AS a, ({_END.format(a='0')})::BIGINT AS b FROM flat WHERE length(flat) > 0
  UNION ALL SELECT doc_id, k + 1, na, ({_END.format(a='na')})::BIGINT FROM (SELECT win.doc_id, k, CASE WHEN b - 120 > a THEN b - 120 ELSE b END AS na, flat FROM win JOIN flat USING (doc_id) WHERE b < length(flat))),
part AS (SELECT doc_id, source, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS chunk_seq, length(trim(substr(flat, a + 1, b - a))) AS n_chars FROM win JOIN flat USING (doc_id) WHERE trim(substr(flat, a + 1, b - a)) <> '')
"""
_CLAUSES = """
cl AS (SELECT n_nationkey, n_name, c, head, n, n_name || '은 보고한다.' AS s FROM nation, (VALUES (1, '제7조(보고) ① ', 30), (2, '② ', 20), (3, '③ ', 80)) AS x(c, head, n)),
fill AS (SELECT n_nationkey, c, 1 AS i, head || s AS open, CAST(NULL AS VARCHAR) AS done FROM cl WHERE length(head) + n * (length(s) + 1) - 1 > 400
  UNION ALL SELECT f.n_nationkey, f.c, i + 1, CASE WHEN length(open) + length(s) + 1 <= 400 THEN open || ' ' || s ELSE s END, CASE WHEN length(open) + length(s) + 1 <= 400 THEN NULL ELSE open END AS done FROM fill f JOIN cl ON cl.n_nationkey = f.n_nationkey AND cl.c = f.c WHERE i < n),
made AS (SELECT n_nationkey, c, i, done AS text FROM fill WHERE done IS NOT NULL
  UNION ALL SELECT f.n_nationkey, f.c, i + 1, open FROM fill f JOIN cl ON cl.n_nationkey = f.n_nationkey AND cl.c = f.c WHERE i = n
  UNION ALL SELECT n_nationkey, c, 0, head || rtrim(repeat(s || ' ', n)) FROM cl WHERE length(head) + n * (length(s) + 1) - 1 <= 400)
"""
_TOOL_TOP = """
v AS (SELECT b.item_id AS query_id, CAST(d.doc_id AS VARCHAR) AS chunk_id, d.doc_id AS seq, list_cosine_similarity(CAST(c.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS s FROM benchmark b JOIN embeddings q ON q.vec_id = b.item_id, documents d JOIN embeddings c ON c.vec_id = d.doc_id),
vr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, seq) AS rank FROM v QUALIFY rank <= 10)
"""
_TOOLS = f"{_TOOL_TOP}, {_BM25.replace(' WHERE item_id % 50 = 0', '')}, {_FUSED.format(v='vr')}, hit AS (SELECT query_id, count(*) AS n, coalesce(max(round(s, 6)) >= 0.49, false) AS ok FROM fp GROUP BY query_id), t AS (SELECT item_id AS query_id, text, coalesce(n, 0) AS n, coalesce(ok, false) AS passed FROM benchmark LEFT JOIN hit ON query_id = item_id)"
_ANSWER = _pick_sql("query_id", [a[0] for a in ANSWERS])
_CHECKED = f"""
k AS (SELECT query_id, text, n, passed, row_number() OVER (ORDER BY query_id) AS id, CASE WHEN NOT passed THEN '{signals.NO_EVIDENCE_REVIEW}' WHEN query_id % 4 = 2 THEN '공시/대외공유 관련 위험 신호가 감지되었습니다: 회계 관련. 아래 규정 근거를 참고하되 최종 판단은 준법감시인이 확인해야 합니다.' ELSE {_ANSWER} END AS summary FROM t),
ch AS (SELECT CAST(0 AS BIGINT) AS id, 'GENESIS' AS record_hash UNION ALL SELECT k.id, sha256('2026-01-01T09:00:00+09:00|check_disclosure_risk|' || sha256('회계 처리 검토. ' || text) || '|' || replace(summary, '|', '/') || '|1|' || ch.record_hash) FROM ch JOIN k ON k.id = ch.id + 1)
"""
ORACLES = {
    "scan_masked_text": f"SELECT event_id, {_MASKED} AS masked_text FROM events",
    "scan_claim_priority": f"SELECT event_id, {_TYPES} AS types, CAST(CASE WHEN {_TYPES} = '' THEN 0 ELSE len(string_split({_TYPES}, ',')) END AS BIGINT) AS n, {_TYPES} <> '' AS requires_human_review FROM events",
    "scan_counts_by_type": f"SELECT type, upper(type) AS type_code, count(*) AS n, sum(CASE WHEN type = 'card' AND event_id % {len(TEMPLATES)} = 6 THEN 1 ELSE 0 END)::BIGINT AS n_low FROM (SELECT event_id, unnest(string_split({_TYPES}, ',')) AS type FROM events) WHERE type <> '' GROUP BY type",
    "scan_log_safe_summary": f"SELECT event_id, {_pick_sql('event_id', _SUMMARIES)} AS log_safe_summary FROM events",
    "scan_email_documents": f"SELECT doc_id, len(v)::BIGINT AS n, array_to_string(list_transform(v, lambda x: CASE WHEN length(split_part(x, '@', 1)) <= 2 THEN '' ELSE substr(x, 1, 2) END || '***@' || split_part(x, '@', 2)), ' ') AS masks FROM (SELECT doc_id, {_EMAILS} AS v FROM documents) WHERE len(v) > 0",
    "scan_card_luhn_documents": f"WITH {_CARDS} SELECT doc_id, len(v)::BIGINT AS n, array_to_string(list_transform(v, lambda x: substr(x, 1, 4) || '-****-****-' || substr(x, 13, 4)), ' ') AS masks FROM luhn WHERE len(v) > 0",
    "scan_envelope": f"WITH {_CARDS} SELECT doc_id, true AS ok, 'scan_sensitive_info' AS tool, (len(v) + len({_EMAILS}))::BIGINT AS n, len(v) + len({_EMAILS}) > 0 AS requires_human_review, '' AS error FROM luhn JOIN documents USING (doc_id)",
    "scan_phone_events": f"SELECT event_id, {_pick_sql('event_id', PHONE_HEADS)} || '-****-' || lpad(CAST(event_id % 10000 AS VARCHAR), 4, '0') || ':9:' || CAST(19 + length({_pick_sql('event_id', PHONE_HEADS)}) AS VARCHAR) AS found FROM events",
    "scan_rrn_confidence": "SELECT event_id, CASE WHEN event_id % 14 BETWEEN 1 AND 12 AND user_id % 33 BETWEEN 1 AND 31 THEN '90' || lpad(CAST(event_id % 14 AS VARCHAR), 2, '0') || lpad(CAST(user_id % 33 AS VARCHAR), 2, '0') || '-1******:' || CASE WHEN event_id % 3 = 0 THEN 'low' ELSE 'high' END ELSE '' END AS found FROM events",
    "scan_account_window": "SELECT event_id, CASE WHEN event_id % 30 <= 22 THEN '***' || lpad(CAST(event_id % 10000 AS VARCHAR), 4, '0') ELSE '' END AS found FROM events",
    "file_truncation": "SELECT doc_id, length(text)::BIGINT AS total_chars, length(text) > 1000 AS truncated, least(length(text), 1000)::BIGINT AS kept, sha256(substr(text, 1, 1000)) AS sha FROM documents",
    "risk_signals": f"SELECT event_id, {_pick_sql('event_id', [s for _, s, _ in SIGNAL_TEXTS])} AS found FROM events",
    "risk_criteria": f"SELECT criterion_no, CASE criterion_no WHEN '1호' THEN '재무구조' WHEN '5호' THEN '투자·출자' WHEN '6호' THEN '손익구조' WHEN '7호' THEN '회계처리' END AS name, count(*) AS n FROM (SELECT unnest(string_split({_pick_sql('event_id', [c for _, _, c in SIGNAL_TEXTS])}, ',')) AS criterion_no FROM events) WHERE criterion_no <> '' GROUP BY criterion_no",
    "citation_guard": f"SELECT event_id, {_pick_sql('event_id', [a[2] for a in ANSWERS])} AS verified, {_pick_sql('event_id', [a[3] for a in ANSWERS])} AS cited, CASE WHEN {_pick_sql('event_id', [a[2] for a in ANSWERS])} = 'true' THEN {_pick_sql('event_id', [a[0] for a in ANSWERS])} ELSE '-' END AS kept FROM events",
    "review_decision": f"SELECT event_id, event_id % 5 = 0 OR {_pick_sql('event_id', [s for _, s, _ in SIGNAL_TEXTS])} <> '' OR {_pick_sql('event_id', [a[2] for a in ANSWERS])} = 'false' AS review FROM events",
    "snippet_format": r"SELECT doc_id, CASE WHEN length(t) <= 260 THEN t ELSE rtrim(substr(t, 1, 259)) || '…' END AS snippet FROM (SELECT doc_id, trim(regexp_replace(text, '[\s\x0b\x1c-\x1f\x{85}\pZ]+', ' ', 'g')) AS t FROM documents)",
    "article_chunks": "SELECT '01_Rule' || n_nationkey || '_기준.txt' AS file_name, 'Rule' || n_nationkey || '_기준' AS source, a AS article, b AS article_title, 'rule' || n_nationkey || c AS chunk_id, CASE WHEN a = '제1조' THEN '제1조(목적) 이 기준은 ' || n_name || '에 적용한다.' ELSE '제2조의3(정의) 용어는 ' || n_nationkey || '번이다.' END AS text FROM nation, (VALUES ('제1조', '목적', '_1_0'), ('제2조의3', '정의', '_2_3_0')) AS x(a, b, c)",
    "vector_topk": f"WITH {_TOP} SELECT query_id, chunk_id, rank, round(s, 5) AS similarity FROM vr",
    "bm25_topk": f"WITH {_BM25} SELECT query_id, chunk_id, rank, round(bm25, 5) AS bm25 FROM lr",
    "rrf_hybrid": f"WITH {_TOP}, {_BM25}, {_FUSED.format(v='vr')} SELECT query_id, chunk_id, position, round(score, 8) AS score FROM fp",
    "retrieval_confidence": f"WITH {_TOP}, {_BM25}, vo AS (SELECT * FROM vr WHERE chunk_id <> CAST(query_id AS VARCHAR)), {_FUSED.format(v='vo')} SELECT query_id, round(max(round(s, 6)), 5) AS best, coalesce(max(round(s, 6)) >= 0.49, false) AS threshold_passed FROM fp GROUP BY query_id",
    "audit_chain_append": f"WITH RECURSIVE {_CHAIN} SELECT id, ts AS timestamp, tool AS tool_name, ih AS input_hash, s AS result_summary, f AS requires_human_review, prev_hash, record_hash FROM ch WHERE id > 0",
    "audit_chain_verify": "SELECT * FROM (VALUES ('whole', true, -1::BIGINT, 25::BIGINT), ('edited', false, 7, 25), ('cut', false, 13, 24), ('shorter', true, -1, 19)) AS x(\"case\", valid, broken_at, total_records)",
    "audit_duplicate_guard": "SELECT n_nationkey AS call_id, n_nationkey = (SELECT max(n_nationkey) FROM nation) AS duplicate FROM nation",
    "audit_log_calls": f"WITH RECURSIVE {_MADE.format(order='seq')} SELECT s1.seq, NOT (no_text OR no_flag) AS ok, CASE WHEN no_text THEN '{tools.NOT_TEXT[0]}' WHEN no_flag THEN '{tools.NOT_FLAG[0]}' WHEN s1.again = 1 THEN '' ELSE '{tools.CONFIRMATION}' END AS summary, no_text OR no_flag AS requires_human_review, CASE WHEN no_text THEN '{tools.NOT_TEXT[1]}' WHEN no_flag THEN '{tools.NOT_FLAG[1]}' ELSE '' END AS error, coalesce(x.id, -1) AS log_id, coalesce(record_hash, '') AS record_hash, s1.again = 1 AND NOT no_text AND NOT no_flag AS skipped FROM s1 LEFT JOIN (SELECT seq, id, record_hash FROM s2 JOIN ch USING (id)) x ON x.seq = s1.seq",
    "audit_log_written": f"WITH RECURSIVE {_MADE.format(order='seq % 4 >= 2, seq')} SELECT id, '2026-01-01T09:00:00+09:00' AS timestamp, tool AS tool_name, sha256(input) AS input_hash, summary AS result_summary, f AS requires_human_review, prev_hash, record_hash FROM s2 JOIN ch USING (id)",
    "audit_log_verify": f"WITH {_MADE.format(order='seq').split('ch AS')[0].rstrip().rstrip(',')}, c AS (SELECT count(*) FILTER (seq % 4 < 2) AS a, count(*) AS n FROM s2) SELECT \"case\", \"case\" NOT IN ('edited', 'whole') AS valid, CASE WHEN \"case\" IN ('edited', 'whole') THEN a ELSE -1 END AS broken_at, CASE WHEN \"case\" = 'first' THEN a ELSE n END AS total_records, hashed::BIGINT AS hashed FROM c, (VALUES ('first', 1), ('second', 1), ('again', 0), ('edited', 1), ('whole', 2)) AS x(\"case\", hashed)",
    "calibration_stats": f"WITH {_MEASURED} SELECT \"group\", count(*) AS n, round(min(top1), 6) AS min_top1, round(avg(top1), 6) AS mean_top1, round(max(top1), 6) AS max_top1, count(*) FILTER (top1 >= 0.49) AS n_pass, count(*) FILTER (top1 < 0.49) AS n_cut FROM m GROUP BY \"group\"",
    "calibration_margin": f"WITH {_MEASURED}, e AS (SELECT min(top1) FILTER (\"group\" = 'A') AS a, max(top1) FILTER (\"group\" = 'B') AS b FROM m) SELECT round(a - b, 6) AS margin, coalesce(CASE WHEN a > b THEN round((a + b) / 2, 6) END, -1.0::DOUBLE) AS midpoint FROM e",
    "threshold_sweep": f"WITH {_MEASURED} SELECT \"group\", h::INT AS hundredths, count(*) FILTER (top1 >= h / 100.0::DOUBLE) AS n_pass, count(*) FILTER (top1 < h / 100.0::DOUBLE) AS n_cut, round(avg(CASE WHEN top1 >= h / 100.0::DOUBLE THEN 1.0::DOUBLE ELSE 0 END), 6) AS pass_rate FROM m, (SELECT unnest(range(30, 71, 2)) AS h) GROUP BY \"group\", h",
    "plain_chunks": f"WITH RECURSIVE {_WINDOWS} SELECT doc_id, 'doc' || doc_id || '_plain_' || chunk_seq AS chunk_id, chunk_seq, n_chars::BIGINT AS n_chars FROM part",
    "chunk_stats": f"WITH RECURSIVE {_WINDOWS} SELECT source AS origin, count(*) AS n_chunks FROM part GROUP BY source",
    "clause_chunks": f"WITH RECURSIVE {_CLAUSES} SELECT n_name || '.txt' AS file_name, lower(regexp_extract(n_name, '^[A-Za-z0-9]+')) || '_7_' || j AS chunk_id, j AS chunk_seq, text FROM (SELECT *, row_number() OVER (PARTITION BY n_nationkey ORDER BY c, i) - 1 AS j FROM made) JOIN nation USING (n_nationkey)",
    "search_tool": f"WITH {_TOOLS} SELECT query_id, true AS ok, CASE WHEN passed THEN '로컬 규정 코퍼스에서 관련 근거 ' || n || '건을 찾았습니다.' ELSE '{signals.NO_EVIDENCE}' END AS summary, (CASE WHEN passed THEN n ELSE 0 END)::BIGINT AS n_matches, passed AS threshold_passed, (CASE WHEN passed THEN n ELSE 0 END)::BIGINT AS n_outputs, false AS requires_human_review FROM t",
    "check_tool": f"WITH RECURSIVE {_TOOLS}, {_CHECKED} SELECT query_id, true AS ok, summary || chr(10) || chr(10) || '{tools.CONFIRMATION}' AS summary, '7호' AS criteria, passed AS threshold_passed, true AS requires_human_review, (CASE WHEN passed THEN least(n, 3) ELSE 0 END)::BIGINT AS n_outputs, id AS log_id, record_hash FROM k JOIN ch USING (id)",
    "scan_calls": f"SELECT event_id, event_id % 4 IN (0, 2) AS ok, CASE event_id % 4 WHEN 1 THEN '{tools.BOTH_INPUTS[0]}' WHEN 3 THEN '파일 입력 오류: 파일을 찾을 수 없습니다: /nowhere/b.txt' ELSE '민감정보·금융 금지문구 패턴이 탐지되지 않았습니다.' END AS summary, event_id % 4 IN (1, 3) AS requires_human_review, CASE event_id % 4 WHEN 1 THEN '{tools.BOTH_INPUTS[1]}' WHEN 3 THEN '파일을 찾을 수 없습니다: /nowhere/b.txt' ELSE '' END AS error FROM events",
    "index_upsert": "SELECT 'k' || c_custkey AS chunk_id, CASE WHEN c_custkey % 9 = 0 THEN 'newer ' WHEN c_custkey % 3 = 0 THEN 'new ' ELSE '' END || c_name AS text, 'customer' AS source, '' AS article, '-' AS category, '-' AS file_name, (CASE WHEN c_custkey % 9 = 0 THEN 2 WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END)::BIGINT AS chunk_seq FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0",
    "index_versions": "WITH v1 AS (SELECT c_custkey AS k, c_name AS t FROM customer WHERE c_custkey % 2 = 0), v2 AS (SELECT k, t FROM v1 WHERE k % 3 <> 0 UNION ALL SELECT c_custkey, 'new ' || c_name FROM customer WHERE c_custkey % 3 = 0), v3 AS (SELECT k, t FROM v2 WHERE NOT t LIKE '%5' AND k % 50 <> 0 UNION ALL SELECT c_custkey, 'last ' || c_name FROM customer WHERE c_custkey % 50 = 0), v4 AS (SELECT c_custkey AS k, c_name AS t FROM customer WHERE c_custkey % 7 = 0), al AS (SELECT 1 AS version, * FROM v1 UNION ALL SELECT 2, * FROM v2 UNION ALL SELECT 3, * FROM v3 UNION ALL SELECT 4, * FROM v4) SELECT version::BIGINT AS version, 'k' || k AS chunk_id, t AS text, count(*) OVER (PARTITION BY version) AS stated FROM al",
    "corpus_changes": "SELECT '/corpus/' || o_orderkey || '.txt' AS path, CASE o_orderkey % 1000 WHEN 3 THEN 'new' WHEN 4 THEN 'gone' ELSE 'changed' END AS kind FROM orders WHERE o_orderkey % 1000 IN (3, 4, 5)",
}
