"""Risk signals, criteria and review rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from haystrata.functions import patterns as P


def risk_signals(text: Column) -> Column:
    """array<struct<type, matched_terms>>: per signal up to five distinct terms in code-point order."""
    rows = []
    for label, pattern in P.SIGNALS.items():
        p = P.unicode_pattern(pattern)
        terms = F.slice(F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(p), F.lit(0)))), 1, 5)
        rows.append(F.when(text.rlike(p), F.struct(F.lit(label).alias("type"), terms.alias("matched_terms"))))
    return F.filter(F.array(*rows), lambda r: r.isNotNull())


def criteria_table(spark: SparkSession) -> DataFrame:
    """One row per criterion and signal: criterion_no, name, signal."""
    return spark.createDataFrame([(no, name, s) for no, name, own in P.CRITERIA for s in own], "criterion_no string, name string, signal string")


def matched_criteria(signals: DataFrame, id_col: str) -> DataFrame:
    """signals: ``id_col`` and ``risk_signals``. One row per criterion met, with its signals sorted."""
    one = signals.select(id_col, F.explode("risk_signals.type").alias("signal"))
    known = F.broadcast(criteria_table(signals.sparkSession))  # the fixed criteria
    return one.join(known, "signal").groupBy(id_col, "criterion_no", "name").agg(F.array_sort(F.collect_set("signal")).alias("triggered_signals"))


def criteria_met(signals: Column) -> Column:
    """array<struct<criterion_no, name, triggered_signals>> of one text, in order of the criteria."""
    types = F.transform(signals, lambda s: s["type"])
    rows = []
    for no, name, own in P.CRITERIA:
        if own:
            hit = F.array_sort(F.array_intersect(F.array(*map(F.lit, own)), types))
            rows.append(F.when(F.size(hit) > 0, F.struct(F.lit(no).alias("criterion_no"), F.lit(name).alias("name"), hit.alias("triggered_signals"))))
    return F.filter(F.array(*rows), lambda r: r.isNotNull())


def asks_review(answer: Column) -> Column:
    return F.coalesce(answer.rlike(P.unicode_pattern(P.REVIEW)), F.lit(False))


def check_review(signals: Column, citation_verified: Column, answer: Column, threshold_passed: Column) -> Column:
    """A missed threshold always asks for review."""
    return ~threshold_passed | (F.size(signals) > 0) | ~citation_verified | asks_review(answer)


def fallback_summary(signals: Column) -> Column:
    types = F.array_join(F.transform(signals, lambda s: s["type"]), ", ")
    return F.when(
        F.size(signals) > 0,
        F.concat(F.lit("공시/대외공유 관련 위험 신호가 감지되었습니다: "), types, F.lit(". 아래 규정 근거를 참고하되 최종 판단은 준법감시인이 확인해야 합니다.")),
    ).otherwise("명시적인 위험 키워드는 탐지되지 않았습니다. 검색된 규정 근거를 함께 확인해 보수적으로 판단하세요.")


NO_EVIDENCE = "관련 규정을 찾지 못했습니다."
NO_EVIDENCE_REVIEW = NO_EVIDENCE + " 근거를 찾지 못한 것은 안전하다는 뜻이 아니므로 준법감시인 확인이 필요합니다."
