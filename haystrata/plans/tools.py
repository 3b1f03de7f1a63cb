"""The four tools as DataFrame plans; each returns the seven result columns with typed data."""

from __future__ import annotations

from collections.abc import Callable

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haystrata.config import Settings
from haystrata.operators import audit, citations, retrieval, signals
from haystrata.operators.scan import envelope, scan
from haystrata.sources import files, shared
from haystrata.sources.audit_log import AuditLog
from haystrata.sources.postings import Postings
from haystrata.sources.vectors import Vectors

# Messages.
CONFIRMATION = "🔒 확인한 내용이 안전하게 기록되었습니다. 개인정보와 미공개 정보 등 민감한 내용은 노출되지 않도록 보호한 뒤 저장됩니다."


def with_confirmation(summary: Column) -> Column:
    return F.when(F.contains(summary, F.lit(CONFIRMATION)), summary).otherwise(F.concat(summary, F.lit("\n\n" + CONFIRMATION)))


BOTH_INPUTS = ("text와 file_path 중 정확히 하나만 전달하세요.", "invalid_arguments: exactly one of text/file_path required")
NOT_TEXT = ("올바르지 않은 인자 형식입니다. 모든 텍스트 필드는 문자열이어야 합니다.", "invalid_arguments: text fields must be strings")
NOT_FLAG = ("올바르지 않은 인자 형식입니다. 검토 여부는 boolean이어야 합니다.", "invalid_arguments: requires_human_review must be boolean")
NOT_READY = {"check_disclosure_risk": "규정 코퍼스 인덱스를 준비하지 못했습니다. 보수적으로 준법감시 확인이 필요합니다.", "search_compliance_rule": "규정 코퍼스 인덱스를 준비하지 못했습니다."}
LOG_FAILED = "감사 로그 기록에 실패했습니다."
SKIP_REASON = "check_disclosure_risk_auto_logs_audit_record"
NO_TEXT_QUERY = "공시 위험 준법감시 사전확인"

#: What a write that fails raises; errors of the program itself are none of these.
LOG_ERRORS = (PySparkException, Py4JError, OSError, RuntimeError)


def failed(rows: DataFrame, id_col: str, tool: str, summary: Column, error: Column) -> DataFrame:
    """The result columns of calls that failed: no data, no outputs, and always a review."""
    return rows.select(id_col, F.lit(False).alias("ok"), F.lit(tool).alias("tool"), summary.alias("summary"), F.array().cast("array<string>").alias("outputs"), F.lit(True).alias("requires_human_review"), error.alias("error"))


def with_failures(results: DataFrame, failures: DataFrame) -> DataFrame:
    """Results and failed calls together; what a failure does not have is null."""
    return results.unionByName(failures, allowMissingColumns=True)


def not_ready(calls: DataFrame, id_col: str, tool: str, error: str | None) -> DataFrame:
    """All calls of a tool whose index could not be made ready."""
    return failed(calls, id_col, tool, F.lit(NOT_READY[tool]), F.lit(error or "unknown error"))


def resolved(calls: DataFrame, read: DataFrame | None = None, id_col: str = "doc_id", tool: str = "scan_sensitive_info") -> tuple[DataFrame, DataFrame]:
    """calls: ``id_col``, text, file_path; read: ``files.read_files`` of the paths. (``id_col``, text and file columns of usable calls; failed calls).

    Exactly one of text and file counts; a blank file path is none, a null text is empty; a file that has an
    error, or was not read, fails its call.
    """
    rows = calls.select(id_col, "text", "file_path", files.choose_input(F.col("text"), F.col("file_path")).alias("kind"))
    columns = ("file_name", "extension", "pages", "total_chars", "truncated", "error")
    if read is None:
        read = calls.sparkSession.createDataFrame([], f"{files.READ}, total_chars int, truncated boolean")
    # a file system's scheme is no part of the name that a call gives
    plain = lambda c: F.regexp_replace(c, "^[a-z0-9]+:/*", "/")
    own = read.select(plain(F.col("path")).alias("at"), F.col("text").alias("file_text"), *columns)
    rows = rows.join(own, (F.col("kind") == "file") & (plain(F.trim("file_path")) == F.col("at")), "left")
    problem = F.when(F.col("kind") == "file", F.when(F.col("at").isNull(), F.concat(F.lit("파일을 찾을 수 없습니다: "), F.col("file_path"))).otherwise(F.col("error")))
    rows = rows.withColumn("problem", problem)
    both = F.col("kind") == "both"
    bad = rows.filter(both | F.col("problem").isNotNull())
    failures = failed(bad, id_col, tool, F.when(both, BOTH_INPUTS[0]).otherwise(F.concat(F.lit("파일 입력 오류: "), F.col("problem"))), F.when(both, BOTH_INPUTS[1]).otherwise(F.col("problem")))
    good = rows.filter(~both & F.col("problem").isNull())
    text = F.when(F.col("kind") == "file", F.col("file_text")).otherwise(F.coalesce("text", F.lit("")))
    return good.select(id_col, text.alias("text"), "kind", *columns[:-1]), failures


def scan_calls(calls: DataFrame, read: DataFrame | None = None, id_col: str = "doc_id", settings: Settings | None = None) -> DataFrame:
    """The scan tool on calls with a text or a file: results, with file marks, and failures."""
    good, failures = resolved(calls, read, id_col)
    result = scan_tool(good.select(id_col, "text"), id_col, "text", settings)
    result = apply_file_meta(result, good.filter("kind = 'file'"), id_col, (settings or Settings()).max_text_chars)
    return with_failures(result, failures)


def scan_tool(texts: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings | None = None) -> DataFrame:
    return envelope(scan(texts, text_col, settings), id_col)


def apply_file_meta(result: DataFrame, files: DataFrame, id_col: str = "doc_id", limit: int = 100_000) -> DataFrame:
    """Adds source_file; a cut text asks for review and says so in outputs."""
    meta = files.select(id_col, F.struct("file_name", "extension", "pages", "total_chars", "truncated").alias("source_file"))
    warning = F.lit(f"⚠️ 파일 텍스트가 {limit:,}자에서 절단되어 이후 내용은 검사되지 않았습니다. 문서 전체는 준법감시인 확인이 필요합니다.")
    cut = F.coalesce(F.col("source_file.truncated"), F.lit(False))
    joined = result.join(meta, id_col, "left")
    return joined.withColumn("outputs", F.when(cut, F.array_append("outputs", warning)).otherwise(F.col("outputs"))).withColumn("requires_human_review", cut | F.col("requires_human_review"))


def matches(chunks: DataFrame, queries: DataFrame, settings: Settings | None = None, words: Postings | None = None, vectors: Vectors | None = None) -> DataFrame:
    """chunks: chunk_id, seq, text, embedding, source, file_name, article, article_title; queries: query_id, query, query_embedding. Formatted matches in order of position.

    ``words``, ``vectors``: stored indexes of the same chunks; without them they are built for this call.
    """
    s = settings or Settings()
    pool = max(s.top_k, s.pool)
    asked = queries.select("query_id", "query_embedding")
    near = vectors.search(asked, pool) if vectors else retrieval.vector_search(chunks, asked, pool)
    said = queries.select("query_id", "query")
    hits = retrieval.fuse(near, words.search(said, pool) if words else retrieval.bm25_search(chunks, said, pool), s.top_k, s.rrf_k)
    meta = chunks.select("chunk_id", "source", "file_name", "article", "article_title", citations.snippet(F.col("text")).alias("snippet"))
    return hits.join(meta, "chunk_id").select("query_id", "position", "source", "file_name", "article", "article_title", "chunk_id", "snippet", F.round("score", 6).alias("score"), F.round("vector_distance", 6).alias("vector_distance"), F.round("vector_similarity", 6).alias("vector_similarity"))


def _evidence(found: DataFrame, threshold: float) -> DataFrame:
    """One row per query: its matches in order and their confidence."""
    cols = [c for c in found.columns if c not in ("query_id",)]
    per = found.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(*cols))).alias("matches"))  # top_k rows a query
    return per.join(retrieval.confidence(found, threshold), "query_id")


def check_tool(texts: DataFrame, found: DataFrame, answers: DataFrame | None = None, settings: Settings | None = None) -> DataFrame:
    """texts: query_id, text; found: ``matches`` of them; answers: query_id, answer. Result columns per text."""
    s = settings or Settings()
    rows = texts.join(_evidence(found, s.similarity_threshold), "query_id", "left")
    rows = rows.join(answers, "query_id", "left") if answers is not None else rows.withColumn("answer", F.lit(None).cast("string"))
    passed = F.coalesce("threshold_passed", F.lit(False))
    rows = rows.withColumn("answer", F.nullif(citations.clean_answer(F.col("answer")), F.lit("")))
    rows = rows.withColumn("risk_signals", signals.risk_signals(F.coalesce("text", F.lit("")))).withColumn("passed", passed)
    rows = rows.withColumn("matched_criteria", signals.criteria_met(F.col("risk_signals")))
    rows = rows.withColumn("citation", citations.verify(F.when(passed, F.col("answer")), F.coalesce(F.col("matches.article"), F.array().cast("array<string>"))))
    rows = rows.withColumn("kept", citations.guarded_answer(F.when(passed, F.col("answer")), F.col("citation")))
    review = signals.check_review(F.col("risk_signals"), F.col("citation.citation_verified"), F.col("kept"), F.col("passed"))
    summary = F.when(~F.col("passed"), signals.NO_EVIDENCE_REVIEW).otherwise(F.coalesce("kept", signals.fallback_summary(F.col("risk_signals"))))
    outputs = F.transform(F.slice("matches", 1, 3), lambda m: F.concat(m["source"], F.lit(" "), m["article"], F.lit(" "), m["article_title"], F.lit(": "), m["snippet"]))
    none = F.array().cast("array<string>")
    return rows.select("query_id", F.lit(True).alias("ok"), F.lit("check_disclosure_risk").alias("tool"), summary.alias("summary"), "risk_signals", "matched_criteria", F.when(F.col("passed"), F.col("matches")).alias("matches"), F.char_length(F.coalesce("text", F.lit(""))).alias("input_chars"), F.col("kept").alias("answer"), "citation", F.col("passed").alias("threshold_passed"), F.when(F.col("passed"), outputs).otherwise(none).alias("outputs"), review.alias("requires_human_review"), F.lit(None).cast("string").alias("error"))


def logged(result: DataFrame, texts: DataFrame, log: AuditLog, ts: str | None = None) -> DataFrame:
    """Results of the check tool with their automatic records in ``log``: a confirmation and ``audit_log`` as committed.

    Results are evaluated once; records are appended in order of query_id, which must not repeat, with the summary as it was
    before the confirmation. If nothing could be committed every call has failed.
    """
    result = shared.written(result, "checked")
    calls = result.join(texts.select("query_id", F.coalesce("text", F.lit("")).alias("input_text")), "query_id")
    calls = calls.select(F.col("query_id").alias("seq"), F.lit(ts).cast("string").alias("ts"), F.col("tool").alias("tool_name"), "input_text", F.col("summary").alias("result_summary"), "requires_human_review")
    try:
        made = log.append(calls)
    except LOG_ERRORS as e:
        return failed(result, "query_id", "check_disclosure_risk", F.lit(LOG_FAILED), F.lit(str(e)))
    own = made.select(F.col("seq").alias("query_id"), F.struct("id", "timestamp", "record_hash", (F.col("requires_human_review") == 1).alias("logged_requires_human_review"), F.lit(True).alias("auto_logged")).alias("audit_log"))
    return result.join(own, "query_id").withColumn("summary", with_confirmation(F.col("summary")))


def check_and_log(texts: DataFrame, found: DataFrame, log: AuditLog, answers: DataFrame | None = None, ts: str | None = None, settings: Settings | None = None) -> DataFrame:
    """The check tool on texts, with its automatic records in ``log``."""
    return logged(check_tool(texts, found, answers, settings), texts, log, ts)


def check_calls(
    calls: DataFrame, search: Callable[[DataFrame], DataFrame], log: AuditLog, read: DataFrame | None = None, answers: DataFrame | None = None, error: str | None = None, ts: str | None = None, settings: Settings | None = None
) -> DataFrame:
    """The check tool on calls with a text or a file (query_id, text, file_path).

    ``search``: matches of (query_id, query); a blank text asks a fixed question. ``error``: why there is no index; such calls fail, and are
    logged like others. Calls whose input cannot be used fail and are not logged. A cut file asks for review.
    """
    limit = (settings or Settings()).max_text_chars
    good, failures = resolved(calls, read, "query_id", "check_disclosure_risk")
    if error is not None:
        result = not_ready(good, "query_id", "check_disclosure_risk", error)
    else:
        blank = ~F.col("text").rlike(r"[^\s\x1c-\x1f\x85\p{Z}]")
        found = search(good.select("query_id", F.when(blank, NO_TEXT_QUERY).otherwise(F.col("text")).alias("query")))
        result = check_tool(good.select("query_id", "text"), found, answers, settings)
    result = apply_file_meta(result, good.filter("kind = 'file'"), "query_id", limit)
    return with_failures(logged(result, good.select("query_id", "text"), log, ts), failures)


def search_calls(queries: DataFrame, search: Callable[[DataFrame], DataFrame], answers: DataFrame | None = None, error: str | None = None, settings: Settings | None = None) -> DataFrame:
    """The search tool on (query_id, query); all fail if there is no index, for the reason ``error``."""
    if error is not None:
        return not_ready(queries, "query_id", "search_compliance_rule", error)
    return search_tool(queries, search(queries), settings, answers)


def search_tool(queries: DataFrame, found: DataFrame, settings: Settings | None = None, answers: DataFrame | None = None) -> DataFrame:
    """Result columns per query; success never asks for review. answers: query_id, answer."""
    s = settings or Settings()
    rows = queries.select("query_id", "query").join(_evidence(found, s.similarity_threshold), "query_id", "left").withColumn("passed", F.coalesce("threshold_passed", F.lit(False)))
    rows = rows.join(answers, "query_id", "left") if answers is not None else rows.withColumn("answer", F.lit(None).cast("string"))
    answer = F.when(F.col("passed"), F.nullif(citations.clean_answer(F.col("answer")), F.lit("")))
    rows = rows.withColumn("citation", citations.verify(answer, F.coalesce(F.col("matches.article"), F.array().cast("array<string>"))))
    rows = rows.withColumn("kept", citations.guarded_answer(answer, F.col("citation")))
    listed = F.concat(F.lit("로컬 규정 코퍼스에서 관련 근거 "), F.size("matches").cast("string"), F.lit("건을 찾았습니다."))
    summary = F.when(~F.col("passed"), signals.NO_EVIDENCE).otherwise(F.coalesce("kept", listed))
    outputs = F.transform("matches", lambda m: F.concat(m["source"], F.lit(" "), m["article"], F.lit(" "), m["article_title"], F.lit(": "), m["snippet"]))
    none = F.array().cast("array<string>")
    return rows.select("query_id", F.lit(True).alias("ok"), F.lit("search_compliance_rule").alias("tool"), summary.alias("summary"), F.when(F.col("passed"), F.col("matches")).alias("matches"), F.col("kept").alias("answer"), "citation", F.col("passed").alias("threshold_passed"), F.when(F.col("passed"), outputs).otherwise(none).alias("outputs"), F.lit(False).alias("requires_human_review"), F.lit(None).cast("string").alias("error"))


def generated(rows: DataFrame, answerer, settings: Settings | None = None) -> DataFrame:
    """rows: query_id, query and matches in order. query_id, answer of the caller's function of (query, evidence block); none where it is
    switched off. Queries without matches get a fixed sentence."""
    s = settings or Settings()
    if answerer is None or not s.generate_answer:
        return rows.select("query_id", F.lit(None).cast("string").alias("answer"))
    block = citations.evidence_block(F.col("matches"))
    none = F.coalesce(F.size("matches"), F.lit(0)) == 0
    return rows.select("query_id", F.when(none, signals.NO_EVIDENCE).otherwise(answerer(F.col("query"), block)).alias("answer"))


def log_tool(log: AuditLog, calls: DataFrame) -> DataFrame:
    """Result columns per call. calls: seq (must not repeat), ts (null: now), tool_name, input_text, result_summary, requires_human_review.

    A call that lacks a text or the flag fails and leaves no record. Any spelling of the check tool's name is stored in lower case; a
    call that repeats that tool's record just before it is skipped, with no summary. If nothing could be committed every valid call has failed.
    """
    problem = F.when(F.col("tool_name").isNull() | F.col("input_text").isNull() | F.col("result_summary").isNull(), "text").when(F.col("requires_human_review").isNull(), "flag")
    calls = calls.select("seq", "ts", "tool_name", "input_text", "result_summary", "requires_human_review", problem.alias("problem"))
    bad, good = calls.filter(F.col("problem").isNotNull()), calls.filter(F.col("problem").isNull())
    pick = lambda k: F.when(F.col("problem") == "text", NOT_TEXT[k]).otherwise(NOT_FLAG[k])
    failures = failed(bad, "seq", "log_ai_usage", pick(0), pick(1))
    check = F.lower(F.trim("tool_name")) == audit.CHECK
    named = good.withColumn("stored_name", F.when(check, audit.CHECK).otherwise(F.col("tool_name")))
    try:
        made = log.append(named.select("seq", "ts", F.col("stored_name").alias("tool_name"), "input_text", "result_summary", "requires_human_review"), skip_repeats=True)
    except LOG_ERRORS as e:
        return with_failures(failed(good, "seq", "log_ai_usage", F.lit(LOG_FAILED), F.lit(str(e))), failures)
    own = made.select("seq", F.struct("id", "timestamp", "tool_name", "input_hash", "prev_hash", "record_hash", (F.col("requires_human_review") == 1).alias("logged_requires_human_review")).alias("record"))
    rows = good.join(own, "seq", "left")
    skipped = F.col("record").isNull()
    skip = F.when(skipped, F.struct(F.lit(True).alias("skipped"), F.lit(SKIP_REASON).alias("skip_reason"), "tool_name", F.col("requires_human_review").alias("logged_requires_human_review")))
    none = F.array().cast("array<string>")
    result = rows.select("seq", F.lit(True).alias("ok"), F.lit("log_ai_usage").alias("tool"), F.when(skipped, "").otherwise(CONFIRMATION).alias("summary"), "record", skip.alias("skip"), none.alias("outputs"), F.lit(False).alias("requires_human_review"), F.lit(None).cast("string").alias("error"))
    return with_failures(result, failures)
