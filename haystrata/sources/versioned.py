"""A keyed table in versions: rows in buckets by key, changed by writing the touched buckets anew.

``<path>/data/<write>/bucket=<k>`` holds rows, ``<path>/versions/<number>.json`` names the folder of each bucket. A version file is put
only if its number is free; a writer that comes second reads the new version and does its change again. Data are
written before the version that names them, so whatever breaks in between leaves the version before it as it was. Readers keep
the version they have opened until ``vacuum`` removes it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from haystrata.sources import shared

BUCKETS, ATTEMPTS = 16, 100


def upsert(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """Rows of ``new`` replace rows of equal key; of new rows that repeat a key the last in ``order`` holds. Null keys are no keys and stay."""
    last = F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc_nulls_last()))
    fresh = new.filter(F.col(key).isNotNull()).withColumn("_place", last).filter("_place = 1").drop("_place").unionByName(new.filter(F.col(key).isNull()))
    return old.join(fresh.select(key), key, "left_anti").select(*old.columns).unionByName(fresh.select(*old.columns))


@dataclass(frozen=True)
class Version:
    """``folders``: the write that holds each bucket (none: no rows); ``facts``: what the writer says about the version."""

    number: int = 0
    rows: int = 0
    schema: str | None = None
    folders: dict[str, str] = field(default_factory=dict)
    facts: dict = field(default_factory=dict)


class VersionedTable:
    """A table at ``path``, which need not exist yet. ``buckets`` holds for a table that is new."""

    def __init__(self, spark: SparkSession, path: str, key: str = "chunk_id", order: str = "chunk_seq", buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.key, self.order, self.buckets = spark, path.rstrip("/"), key, order, buckets

    def bucket(self) -> Column:
        return F.coalesce(F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.buckets)), F.lit(0)).cast("int")

    def numbers(self) -> list[int]:
        return [int(n[:-5]) for n, _, _ in shared.listed(self.spark, f"{self.path}/versions") if n.endswith(".json")]

    def version(self, number: int | None = None) -> Version:
        """A version, the newest one by default; one that cannot be read counts as an empty one with its number."""
        numbers = self.numbers()
        if number is None and not numbers:
            return Version()
        at = max(numbers) if number is None else number
        try:
            return Version(**json.loads(shared.read_text(self.spark, f"{self.path}/versions/{at:012d}.json")))
        except (ValueError, TypeError):
            return Version(at)

    def read(self, version: Version | None = None, buckets: set[int] | None = None) -> DataFrame | None:
        """Rows of a version (none if it has no schema: nothing was ever written), of some buckets only if asked."""
        v = version or self.version()
        if v.schema is None:
            return None
        schema = StructType.fromJson(json.loads(v.schema))
        at = [f"{self.path}/data/{w}/bucket={b}" for b, w in sorted(v.folders.items()) if buckets is None or int(b) in buckets]
        return self.spark.read.schema(schema).parquet(*at) if at else self.spark.createDataFrame([], schema)

    def _written(self, rows: DataFrame) -> tuple[str, dict[str, int]]:
        """(name of the write, rows of each bucket)."""
        name = uuid.uuid4().hex
        at = f"{self.path}/data/{name}"
        rows.withColumn("bucket", self.bucket()).repartition("bucket").write.partitionBy("bucket").parquet(at)
        held = {b: n for b, n in self.spark.read.schema("bucket int").parquet(at).groupBy("bucket").count().collect()} if shared.listed(self.spark, at) else {}
        return name, {str(b): n for b, n in held.items()}

    def _commit(self, version: Version) -> bool:
        return shared.put_if_absent(self.spark, f"{self.path}/versions/{version.number:012d}.json", json.dumps(version.__dict__, ensure_ascii=False))

    def replace(self, rows: DataFrame, facts: dict | None = None) -> Version:
        """All rows anew."""
        name, held = self._written(rows)
        for _ in range(ATTEMPTS):
            new = Version(self.version().number + 1, sum(held.values()), rows.schema.json(), {b: name for b in held}, facts or {})
            if self._commit(new):
                return new
        raise RuntimeError(f"other writers were first {ATTEMPTS} times")

    def change(self, new: DataFrame, removed: Column | None = None, facts: Callable[[Version], dict] | None = None) -> Version:
        """Rows for which ``removed`` holds go, then ``new`` rows are put in place of those of equal key. Only touched buckets are read and written."""
        for _ in range(ATTEMPTS):
            old = self.version()
            now = self.read(old)
            if now is None:
                fresh = upsert(new.limit(0), new, self.key, self.order)
                name, held = self._written(fresh)
                made = Version(old.number + 1, sum(held.values()), new.schema.json(), {b: name for b in held}, facts(old) if facts else {})
            else:
                touched = new.select(self.bucket().alias("b"))
                if removed is not None:
                    touched = touched.unionByName(now.filter(removed).select(self.bucket().alias("b")))
                buckets = {r.b for r in touched.distinct().collect()}  # at most self.buckets numbers
                kept = self.read(old, buckets)
                before = kept.count()
                rows = upsert(kept.filter(~F.coalesce(removed, F.lit(False))) if removed is not None else kept, new, self.key, self.order)
                name, held = self._written(rows)
                folders = {b: w for b, w in old.folders.items() if int(b) not in buckets} | {b: name for b in held}
                made = replace(old, number=old.number + 1, rows=old.rows - before + sum(held.values()), folders=folders, facts=facts(old) if facts else old.facts)
            if self._commit(made):
                return made
            shared.delete(self.spark, f"{self.path}/data/{name}")
        raise RuntimeError(f"other writers were first {ATTEMPTS} times")

    def vacuum(self, keep: int = 1) -> int:
        """Removes all versions but the newest ``keep`` and the writes that only they name; returns how many writes went."""
        numbers = sorted(self.numbers())
        held = {w for n in numbers[-keep:] for w in self.version(n).folders.values()}
        for n in numbers[:-keep]:
            shared.delete(self.spark, f"{self.path}/versions/{n:012d}.json")
        gone = [w for w, _, _ in shared.listed(self.spark, f"{self.path}/data") if w not in held]
        for w in gone:
            shared.delete(self.spark, f"{self.path}/data/{w}")
        return len(gone)
