"""Settings of the operators: a frozen value, overridable from the Spark session."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Settings:
    max_findings: int = 100
    similarity_threshold: float = 0.49
    top_k: int = 5
    pool: int = 10
    rrf_k: int = 60
    max_chars: int = 900
    overlap: int = 120
    max_file_bytes: int = 20 * 1024 * 1024
    max_text_chars: int = 100_000
    generate_answer: bool = False

    @classmethod
    def of(cls, spark: SparkSession) -> Settings:
        """``haystrata.<name>`` of the session; a value that does not parse, or is negative, keeps the default."""
        out = cls()
        for f in fields(cls):
            raw = spark.conf.get(f"haystrata.{f.name}", None)
            if raw is None:
                continue
            kind = type(getattr(out, f.name))
            try:
                value = raw.lower() not in ("0", "false", "no") if kind is bool else kind(raw)
            except ValueError:
                continue
            if kind is bool or value >= 0:
                out = replace(out, **{f.name: value})
        return out
