"""Threshold calibration: group statistics and a sweep of thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def group_stats(measured: DataFrame, threshold: float = 0.49) -> DataFrame:
    """measured: group, top1."""
    return measured.groupBy("group").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.min("top1"), 6).alias("min_top1"),
        F.round(F.avg("top1"), 6).alias("mean_top1"),
        F.round(F.max("top1"), 6).alias("max_top1"),
        F.count_if(F.col("top1") >= threshold).alias("n_pass"),
        F.count_if(F.col("top1") < threshold).alias("n_cut"),
    )


def margin(measured: DataFrame, high: str = "A", low: str = "B") -> DataFrame:
    """Smallest of the group to pass less largest of the group to cut, and the midpoint where they separate."""
    ends = measured.agg(F.min(F.when(F.col("group") == high, F.col("top1"))).alias("a"), F.max(F.when(F.col("group") == low, F.col("top1"))).alias("b"))
    return ends.select(F.round(F.col("a") - F.col("b"), 6).alias("margin"), F.when(F.col("a") > F.col("b"), F.round((F.col("a") + F.col("b")) / 2, 6)).alias("midpoint"))


def sweep(measured: DataFrame, first: int = 30, last: int = 70, step: int = 2) -> DataFrame:
    """Pass and cut rates at thresholds in hundredths; each measurement is counted at all of them in its task."""
    at = F.explode(F.sequence(F.lit(first), F.lit(last), F.lit(step)))
    rows = measured.select("group", "top1", at.alias("hundredths"))
    passed = F.col("top1") >= F.col("hundredths") / 100.0
    return rows.groupBy("group", "hundredths").agg(F.count_if(passed).alias("n_pass"), F.count_if(~passed).alias("n_cut"), F.round(F.avg(passed.cast("double")), 6).alias("pass_rate"))
