"""Sensitive-information scan: twelve ordered stages, claims, masks, summaries.

One narrow projection per text: no shuffle and no Python. A candidate that a stage rejects
claims nothing, so a later stage can take the same characters.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haystrata.config import Settings
from haystrata.functions import patterns as P
from haystrata.functions.spans import claim, once, pieces, spans, splice, window

FINDING = "array<struct<s:int,e:int,type:string,label:string,mask:string,confidence:string,reason:string>>"
_digits = lambda v: F.regexp_replace(v, "[^0-9]", "")
_HANGUL = "[가-힣]"


def _finding(c: Column, kind: str, label: str, mask: Column, confidence: Column, reason: Column) -> Column:
    return F.struct(c["s"].alias("s"), c["e"].alias("e"), F.lit(kind).alias("type"), F.lit(label).alias("label"), mask.alias("mask"), confidence.alias("confidence"), reason.alias("reason"))


def _near(found: Column, text: Column, use: Callable[[Column, Column], Column]) -> Column:
    """What ``use`` makes of candidates and the text in pieces, which is cut only where there are candidates."""
    return once(found, lambda f: F.when(F.size(f) > 0, once(pieces(text), lambda blocks: use(f, blocks))).otherwise(use(f, F.array(F.lit("")))))


def rrn(text: Column) -> Column:
    """National ids whose first six digits look like a date."""
    part = lambda c, k: F.regexp_extract(c["v"], P.RRN, k)
    cand = F.filter(spans(text, P.RRN, _numeric(text)), lambda c: F.substring(c["v"], 3, 2).cast("int").between(1, 12) & F.substring(c["v"], 5, 2).cast("int").between(1, 31))

    def one(c: Column, blocks: Column) -> Column:
        low = (F.char_length(c["v"]) == 13) & ~window(blocks, c, P.RRN_WINDOW).rlike(P.RRN_WORDS)
        mask = F.concat(part(c, 1), F.lit("-"), F.substring(part(c, 3), 1, 1), F.lit("******"))
        return _finding(c, "rrn", "주민등록번호/외국인등록번호", mask, F.when(low, "low").otherwise("high"), F.lit("고유식별정보 패턴"))

    return _near(cand, text, lambda found, blocks: F.transform(found, lambda c: one(c, blocks)))


def card(text: Column) -> Column:
    """Card numbers: valid checksum, or a card word nearby."""
    luhn = lambda c: F.call_function("luhn_check", _digits(c["v"]))
    cand = _near(spans(text, P.CARD, _numeric(text)), text, lambda found, blocks: F.filter(found, lambda c: luhn(c) | window(blocks, c, P.CARD_WINDOW).rlike(P.CARD_WORDS)))

    def one(c: Column) -> Column:
        d = _digits(c["v"])
        mask = F.concat(F.substring(d, 1, 4), F.lit("-****-****-"), F.substring(d, -4, 4))
        reason = F.when(luhn(c), "Luhn checksum 유효 카드번호 패턴").otherwise("카드 키워드 주변의 카드형식 숫자(체크섬 불일치) — 사람 확인 필요")
        return _finding(c, "card", "카드번호", mask, F.when(luhn(c), "high").otherwise("low"), reason)

    return F.transform(cand, one)


def phone(text: Column) -> Column:
    def one(c: Column) -> Column:
        d = _digits(c["v"])
        head = F.when(d.startswith("02"), F.lit("02")).when(d.startswith("050"), F.substring(d, 1, 4)).otherwise(F.substring(d, 1, 3))
        return _finding(c, "phone", "전화번호", F.concat(head, F.lit("-****-"), F.substring(d, -4, 4)), F.lit("high"), F.lit("전화번호 패턴"))

    return F.transform(spans(text, P.PHONE, _numeric(text)), one)


def email(text: Column) -> Column:
    def one(c: Column) -> Column:
        local, domain = F.regexp_extract(c["v"], "^([^@]*)@", 1), F.regexp_extract(c["v"], "@(.*)$", 1)
        mask = F.concat(F.when(F.char_length(local) <= 2, "").otherwise(F.substring(local, 1, 2)), F.lit("***@"), domain)
        return _finding(c, "email", "이메일", mask, F.lit("high"), F.lit("이메일 주소 패턴"))

    return F.transform(spans(text, P.EMAIL, F.contains(text, F.lit("@"))), one)


def account(text: Column) -> Column:
    """Ten to sixteen digits with an account word nearby."""
    ok = lambda c, blocks: F.char_length(_digits(c["v"])).between(10, 16) & window(blocks, c, P.ACCOUNT_WINDOW).rlike(P.ACCOUNT_WORDS)
    one = lambda c: _finding(c, "account", "계좌번호", F.concat(F.lit("***"), F.substring(_digits(c["v"]), -4, 4)), F.lit("high"), F.lit("계좌 관련 키워드 주변의 10~16자리 금융계좌 후보"))
    return F.transform(_near(spans(text, P.ACCOUNT, _numeric(text)), text, lambda found, blocks: F.filter(found, lambda c: ok(c, blocks))), one)


def claims(text: Column) -> list[Column]:
    """Six stages of expressions that need review."""

    def stage(code: str, pattern: str, label: str) -> Column:
        reason = F.lit(f"금융상품 광고/고객 안내문 금지·주의 표현 후보: {code}")
        found = spans(text, P.unicode_pattern(pattern), text.rlike(_HANGUL))
        return F.transform(found, lambda c: _finding(c, "prohibited_claim", label, F.lit("[금지표현]"), F.lit("high"), reason))

    return [stage(*x) for x in P.CLAIMS]


def internal(text: Column) -> Column:
    one = lambda c: _finding(c, "internal_keyword", "내부정보/대외비 키워드", F.lit("[내부정보키워드]"), F.lit("high"), F.lit("외부 공유 전 준법감시 확인이 필요한 내부정보 키워드"))
    return F.transform(spans(text, P.unicode_pattern(P.INTERNAL), text.rlike(f"{_HANGUL}|(?iu)confidential")), one)


def _numeric(text: Column) -> Column:
    return text.rlike("[0-9][0-9-]{2}")


def findings(text: Column) -> Column:
    """All findings, in order of stage, then place."""
    found = claim([rrn(text), card(text), phone(text), email(text), account(text), *claims(text), internal(text)], FINDING)
    return F.when(text.isNull() | (text == ""), F.expr(f"cast(array() as {FINDING})")).otherwise(found)


@lru_cache(maxsize=64)
def _findings_of(application: str, column: str) -> Column:
    """``findings`` of a column: the expression is large, and the same for every table."""
    return findings(F.col(column))


def type_code(kind: Column) -> Column:
    return F.upper(kind)


def masked_values(found: Column) -> Column:
    """By type: the first five distinct masks, then how many more."""
    types = F.array_sort(F.array_distinct(F.transform(found, lambda f: f["type"])))

    def text(t: Column) -> Column:
        values = F.array_distinct(F.transform(F.filter(found, lambda f: f["type"] == t), lambda f: f["mask"]))
        more = F.size(values) - 5
        return F.concat(type_code(t), F.lit(" "), F.array_join(F.slice(values, 1, 5), " / "), F.when(more > 0, F.concat(F.lit(" 외 "), more.cast("string"), F.lit("건"))).otherwise(""))

    return F.array_join(F.transform(types, text), ", ")


OUTPUTS = ("findings", "total_findings", "returned_findings", "max_findings", "truncated_findings", "truncated", "counts", "detected_types", "masked_text", "log_safe_summary", "summary", "requires_human_review")


def scan(df: DataFrame, text_col: str = "text", settings: Settings | None = None) -> DataFrame:
    """Adds findings, total_findings, returned_findings, truncated_findings, truncated, counts,
    detected_types, masked_text, log_safe_summary, summary, requires_human_review.

    A null or empty text has no findings and its own summary; white space is a text. A column of the
    input that has an output's name gives way to it; all others stay.
    """
    most = (settings or Settings()).max_findings
    text = F.col(text_col)
    found, values = (next(n for n in (name + "_" * k for k in range(len(df.columns) + 1)) if n not in df.columns) for name in ("all_findings", "values_text"))
    rows = df.withColumn(found, _findings_of(df.sparkSession.sparkContext.applicationId, text_col))
    every, total = F.col(found), F.size(found)
    empty, none = text.isNull() | (text == ""), total == 0
    types = F.transform(every, lambda f: f["type"])
    rows = rows.withColumn(values, masked_values(every))
    cut = F.greatest(total - most, F.lit(0))
    safe = F.concat(F.lit("scan_sensitive_info: "), F.col(values), F.lit("; 사람 검토 필요"), F.when(cut > 0, F.concat(F.lit("; findings 상세 "), cut.cast("string"), F.lit("건 생략"))).otherwise(""))
    human = F.concat(
        F.lit("스캔 결과 "), total.cast("string"), F.lit("건이 탐지되었습니다 ("), F.col(values), F.lit("). 개인정보는 마스킹했으며, 외부 공유 전 사람 검토가 필요합니다."),
        F.when(cut > 0, F.concat(F.lit(" 상세 반환은 "), F.lit(str(most)), F.lit("/"), total.cast("string"), F.lit("건으로 제한했습니다."))).otherwise(""),
    )
    shown = F.transform(
        F.slice(every, 1, most) if most else F.slice(every, 1, 0),
        lambda f: F.struct(f["type"].alias("type"), type_code(f["type"]).alias("type_code"), f["label"].alias("label"), f["mask"].alias("value_masked"), f["s"].alias("span_start"), f["e"].alias("span_end"), f["confidence"].alias("confidence"), F.lit(True).alias("requires_human_review"), f["reason"].alias("reason")),
    )
    return rows.select(
        *(c for c in df.columns if c not in OUTPUTS),
        shown.alias("findings"),
        total.alias("total_findings"),
        F.least(total, F.lit(most)).alias("returned_findings"),
        F.lit(most).alias("max_findings"),
        cut.alias("truncated_findings"),
        (cut > 0).alias("truncated"),
        F.map_from_entries(F.transform(F.array_distinct(types), lambda t: F.struct(t, F.size(F.filter(types, lambda x: x == t))))).alias("counts"),
        F.array_sort(F.array_distinct(F.transform(types, type_code))).alias("detected_types"),
        F.when(empty, "").otherwise(F.when(none, text).otherwise(splice(text, every))).alias("masked_text"),
        F.when(empty, "scan_sensitive_info: 빈 입력").when(none, "scan_sensitive_info: 탐지된 민감정보/금지문구 없음").otherwise(safe).alias("log_safe_summary"),
        F.when(empty, "입력이 비어 있어 탐지할 내용이 없습니다.").when(none, "민감정보·금융 금지문구 패턴이 탐지되지 않았습니다.").otherwise(human).alias("summary"),
        (total > 0).alias("requires_human_review"),
    )


def finding_rows(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per returned finding, with its order."""
    return scanned.select(id_col, F.posexplode("findings").alias("ord", "f")).select(id_col, "ord", "f.*")


def envelope(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The seven result columns of a tool."""
    data = F.struct("findings", "counts", "total_findings", "returned_findings", "max_findings", "truncated", "truncated_findings", "masked_text", "detected_types", "log_safe_summary")
    return scanned.select(id_col, F.lit(True).alias("ok"), F.lit("scan_sensitive_info").alias("tool"), "summary", data.alias("data"), F.array("log_safe_summary").alias("outputs"), "requires_human_review", F.lit(None).cast("string").alias("error"))
