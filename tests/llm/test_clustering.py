"""Clustering against plain k-means, bit by bit, and what the bounds save."""

from __future__ import annotations

import hashlib
import math

import duckdb
import numpy as np
import pytest

from haystrata.llm import clustering
from haystrata.llm.queries import ORACLES, QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int, cluster int, distance string, block string"


def plain(rows, k, rounds, dim, scale, seed="3"):
    kept = [(i, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted(((i is None, hashlib.sha256(f"{seed}:{i}".encode()).hexdigest() if i is not None else "", v) for i, v in kept))
    c = [v for *_, v in start[:k]]
    near = lambda v: min(range(len(c)), key=lambda j: (sum((a - b) ** 2 for a, b in zip(v, c[j], strict=True)), j))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v), []).append(v)
        c = [[sum(x) // len(groups[j]) for x in zip(*groups[j], strict=True)] if j in groups else c[j] for j in range(len(c))]
    own = [(i, near(v), v) for i, v in kept]
    spent = {}
    out = []
    for i, j, v in own:
        d = sum((a - b) ** 2 for a, b in zip(v, c[j], strict=True))
        spent[j] = spent.get(j, 0) + d
        out.append((i, j, d))
    return sorted(((i, j, d, spent[j], sum(spent.values()), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, j, d in out), key=str)


def rows_of(seed, n, dim, spread):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, dim))
    rows = [(int(i), [float(x) for x in (centres[i % 5] + rng.normal(size=dim) * spread).astype(np.float32)]) for i in range(n)]
    rows += [(3, rows[3][1]), (3, rows[-1][1]), (None, rows[2][1]), (None, rows[1][1])]  # repeats
    rows += [(900, None), (901, []), (902, [1.0] * (dim - 1)), (903, [1.0] * (dim + 1)), (904, [None] + [1.0] * (dim - 1)), (905, [float("nan")] * dim), (906, [float("inf")] + [0.0] * (dim - 1))]
    return rows


@pytest.mark.parametrize(("n", "dim", "spread", "k", "rounds"), [(120, 4, 0.3, 8, 10), (60, 64, 2.0, 8, 3), (5, 3, 1.0, 8, 4), (200, 2, 0.05, 3, 6), (40, 4, 0.5, 1, 2), (40, 4, 0.5, 4, 0)])
def test_equals_plain(spark, monkeypatch, n, dim, spread, k, rounds):
    monkeypatch.setattr(clustering, "BLOCK", 16)
    rows = rows_of(n, n, dim, spread)
    table = spark.createDataFrame([(*r, 1, 2, "x", "y") for r in rows], SCHEMA).repartition(3)
    got = clustering.cluster(table, k, rounds, dim)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(rows, k, rounds, dim, clustering.SCALE)


def test_ties_and_large_components(spark, monkeypatch):
    monkeypatch.setattr(clustering, "BLOCK", 8)
    rows = [(i, [float(i % 4), float(i // 4 % 4), 0.0]) for i in range(64)]  # a grid: many equal distances
    table = spark.createDataFrame([(*r, 1, 2, "x", "y") for r in rows], SCHEMA)
    assert sorted((tuple(r) for r in clustering.cluster(table, 5, 5, 3, 2).collect()), key=str) == plain(rows, 5, 5, 3, 2)
    rows = [(i, [float(2**25 - i), float(-i), 1.0]) for i in range(30)]
    table = spark.createDataFrame([(*r, 1, 2, "x", "y") for r in rows], SCHEMA)
    assert sorted((tuple(r) for r in clustering.cluster(table, 3, 4, 3, 1).collect()), key=str) == plain(rows, 3, 4, 3, 1)
    with pytest.raises(Exception, match="beyond"):
        clustering.cluster(spark.createDataFrame([(1, [1e30, 0.0, 0.0], 1, 2, "x", "y")], SCHEMA), 1, 1, 3).collect()


def test_bounds_save_scans(spark):
    rows = [r for r in rows_of(1, 2000, 8, 0.05)]
    table = spark.createDataFrame([(*r, 1, 2, "x", "y") for r in rows], SCHEMA)
    scanned: list[int] = []
    clustering.cluster(table, 5, 6, 8, scanned=scanned).collect()
    assert len(scanned) == 7 and scanned[0] == 2004 and sum(scanned[1:]) < 2004


def test_no_shuffle_of_vectors(spark, monkeypatch):
    """Blocks and bounds have the same buckets: their join has no exchange."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = rows_of(2, 300, 4, 0.3)
        out = clustering.cluster(spark.createDataFrame([(*r, 1, 2, "x", "y") for r in rows], SCHEMA), 4, 2, 4)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_empty(spark):
    assert clustering.cluster(spark.createDataFrame([], SCHEMA)).collect() == []
    assert clustering.cluster(spark.createDataFrame([(1, None, 1, 2, "x", "y")], SCHEMA)).collect() == []


def test_query_equals_sql(spark):
    at = "/root/testdata/sf0.001"
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{at}/embeddings.parquet'")
    want = db.sql(ORACLES["op12_clustering"])
    columns = want.columns
    got = [tuple(r) for r in QUERIES["op12_clustering"](spark, at).select(*columns).collect()]
    assert sorted(got) == sorted(want.fetchall())
