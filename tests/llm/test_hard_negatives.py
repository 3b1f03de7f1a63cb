"""Hard negatives against brute force, and what the bounds skip."""

from __future__ import annotations

import math

import duckdb
import numpy as np
import pytest

from haystrata.llm import hard_negatives as H
from haystrata.llm.queries import ORACLES, QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int, list int, id string, part string"


def plain(rows, every, positives, negatives):
    kept = []
    for i, v, label, *_ in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept.append((i, (label + 1) % 10 if i is not None and i % 7 == 0 else label, [math.floor(256 * float(np.float32(x))) for x in v]))
    out = []
    for n, (i, label, v) in enumerate(kept):
        if i is None or i % every:
            continue
        scored = [(-sum(a * b for a, b in zip(v, w)), j is None, j or 0, other == label) for m, (j, other, w) in enumerate(kept) if m != n]  # noqa: B905
        name = lambda x: None if x[1] else x[2]
        for p in sorted(x[:3] for x in scored if x[3])[:positives]:
            fit = sorted(x[:3] for x in scored if not x[3] and 30 * -p[0] <= 100 * -x[0] <= 90 * -p[0])[:negatives]
            out += [(i, name(p), rank + 1, name(x), -p[0], -x[0]) for rank, x in enumerate(fit)]
    return sorted(out, key=str)


def rows_of(seed, n, dim, spread):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim))
    rows = [(i, [float(x) for x in (centres[i % 6] + rng.normal(size=dim) * spread).astype(np.float32)], int(rng.integers(4))) for i in range(n)]
    rows += [rows[0], rows[10], (10, rows[1][1], 2), (None, rows[2][1], 1), (None, rows[2][1], 1), (5 * n, rows[10][1], rows[10][2])]
    rows += [(2000, None, 1), (2010, [float("nan")] * dim, 1), (2020, [None] * dim, 1), (2030, rows[3][1], None), (2040, [], 1), (2050, [1.0], 1), (-10, rows[4][1], 3), (2060, [float("inf")] * dim, 0)]
    return [(*r, 1, "x", "y") for r in rows]


@pytest.mark.parametrize(("n", "dim", "spread"), [(150, 4, 0.3), (200, 16, 1.0), (90, 2, 0.0)])
def test_equals_plain(spark, monkeypatch, n, dim, spread):
    for name, value in (("BLOCK", 8), ("LIST_ROWS", 12), ("ANCHOR_BLOCK", 4), ("PART_BLOCKS", 2)):
        monkeypatch.setattr(H, name, value)
    rows = rows_of(n, n, dim, spread)
    got = H.mine(spark.createDataFrame(rows, SCHEMA).repartition(3), 10, 3, 4)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = plain(rows, 10, 3, 4)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want and len(want) > 20


def test_bounds_skip_lists(spark, monkeypatch):
    monkeypatch.setattr(H, "LIST_ROWS", 40)
    rows = rows_of(3, 900, 8, 0.05)
    skipped: list[tuple[int, int]] = []
    got = H.mine(spark.createDataFrame(rows, SCHEMA), 10, 5, 10, skipped=skipped).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain(rows, 10, 5, 10)
    assert all(left > 0.3 * total for left, total in skipped), skipped


def test_large_components(spark):
    rows = [(i, [float(2**14 * (i % 3 + 1)), float(2**14 - i)], i % 3, 1, "x", "y") for i in range(60)]
    assert sorted((tuple(r) for r in H.mine(spark.createDataFrame(rows, SCHEMA), 10, 3, 4).collect()), key=str) == plain(rows, 10, 3, 4)
    with pytest.raises(Exception, match="do not fit"):
        H.mine(spark.createDataFrame([(1, [1e30], 1, 1, "x", "y")], SCHEMA)).collect()


def test_empty(spark):
    assert H.mine(spark.createDataFrame([], SCHEMA)).collect() == []
    assert H.mine(spark.createDataFrame([(100, None, 1, 1, "x", "y")], SCHEMA)).collect() == []
    assert H.mine(spark.createDataFrame([(100, [1.0], 1, 1, "x", "y")], SCHEMA)).collect() == []
    assert H.mine(spark.createDataFrame([(1, [1.0], 1, 1, "x", "y"), (2, [1.0], 2, 1, "x", "y")], SCHEMA)).collect() == []


def test_query_equals_sql(spark):
    at = "/root/testdata/sf0.001"
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{at}/embeddings.parquet'")
    want = db.sql(ORACLES["op11_hard_negatives"])
    got = [tuple(r) for r in QUERIES["op11_hard_negatives"](spark, at).select(*want.columns).collect()]
    assert sorted(got) == sorted(want.fetchall()) and got
