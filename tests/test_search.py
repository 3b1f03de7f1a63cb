"""Stored indexes against brute force, what their bounds leave unread, and search over whole tables."""

from __future__ import annotations

import math
import random
import re
from fractions import Fraction

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from haystrata import queries
from haystrata.operators import retrieval
from haystrata.sources import postings, vectors


def test_tools_search_documents_without_embedding(spark, tmp_path):
    tables = {
        "documents": ([(k, f"word{k} common", "s") for k in range(12)], "doc_id long, text string, source string"),
        "embeddings": ([(k, [1.0, float(k)]) for k in range(9)], "vec_id long, embedding array<float>"),
        "benchmark": ([(k, f"word{k}") for k in range(12)], "item_id long, text string"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    found, asked = queries._tool_matches(spark, str(tmp_path))
    assert {r.query_id for r in asked.collect()} == set(range(12))
    hit = {(r.query_id, r.chunk_id): r.vector_similarity for r in found.collect()}
    assert all((k, str(k)) in hit for k in range(12))
    assert hit[(10, "10")] is None and hit[(3, "3")] is not None
    for tool in (queries.search_tool, queries.check_tool):
        assert {r.query_id for r in tool(spark, str(tmp_path)).collect()} == set(range(12))


WORDS = ["the", "of", "규정", "보고", "moon", "x1", "river", "stone", "제7조", "zebra"]
CHUNKS = "chunk_id string, seq long, text string, term string, n int"


def texts_of(seed, n):
    rng = random.Random(seed)
    rows = [(f"c{k}", k * 3 % n, " ".join(rng.choice(WORDS) + (str(rng.randrange(60)) if rng.random() < 0.5 else "") for _ in range(rng.randrange(0, 30))) + " THE" * (k % 3), "t", 1) for k in range(n)]
    return [*rows, ("null", 900, None, "t", 1), ("empty", 901, "", "t", 1), ("blank", 902, " -- ", "t", 1), ("same", 903, rows[4][2], "t", 1), ("long", 904, "moon " * 20_000, "t", 1)]


def plain_bm25(rows, asked, pool):
    tok = lambda t: re.findall(postings.TOKEN, (t or "").lower())
    docs = [(c, s, tok(t)) for c, s, t, *_ in rows]
    n, avg = len(docs), sum(len(t) for *_, t in docs) / len(docs)
    df = {}
    for *_, t in docs:
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    idf = {w: math.log(n - d + 0.5) - math.log(d + 0.5) for w, d in df.items()}
    mean = sum(idf.values()) / len(idf)
    out = set()
    for q, text in asked:
        scored = []
        for c, s, t in docs:
            x = sum((0.25 * mean if idf[w] < 0 else idf[w]) * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / avg)) for w in tok(text) if w in idf)
            if round(x, 9) > 0:
                scored.append((-round(x, 9), s, c))
        out |= {(q, c, s, k + 1, -x) for k, (x, s, c) in enumerate(sorted(scored)[:pool])}
    return out


@pytest.mark.parametrize("size", [8, 1024])
def test_postings_equal_brute_force(spark, tmp_path, monkeypatch, size):
    monkeypatch.setattr(postings, "RANGE", size)
    rows = texts_of(size, 150)
    built = postings.build(spark.createDataFrame(rows, CHUNKS).repartition(3), str(tmp_path / "p"))
    asked = [(1, "the moon"), (2, "moon5 zebra 규정7 보고"), (3, None), (4, "nothing known"), (5, "THE the of of x1"), (6, "river3")]
    index = postings.load(spark, str(tmp_path / "p"))
    assert index == built and index.n == 155 and postings.load(spark, str(tmp_path / "q")) is None
    got = index.search(spark.createDataFrame(asked, "query_id int, query string"), 7)
    assert {(r.query_id, r.chunk_id, r.seq, r.rank, round(r.bm25, 9)) for r in got.collect()} == plain_bm25(rows, asked, 7)


def test_only_asked_folders_and_likely_ranges_are_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "RANGE", 8)
    rows = texts_of(7, 300) + [(f"hit{k}", 2000 + k, "moon rare rare rare", "t", 1) for k in range(12)]
    index = postings.build(spark.createDataFrame(rows, CHUNKS), str(tmp_path / "p"))
    scored, plans = [], []
    real = postings.Postings._scored

    def spy(self, own, weights, pairs, pool):
        scored.append(pairs.count())
        plans.append(own._jdf.queryExecution().executedPlan().toString())
        return real(self, own, weights, pairs, pool)

    monkeypatch.setattr(postings.Postings, "_scored", spy)
    asked = [(1, "moon rare")]
    got = {(r.query_id, r.chunk_id, r.seq, r.rank, round(r.bm25, 9)) for r in index.search(spark.createDataFrame(asked, "query_id int, query string"), 5).collect()}
    assert got == plain_bm25(rows, asked, 5) and scored[0] == 2 and scored[1] == 0  # of some 40 ranges with moon in them
    assert re.search(r"PartitionFilters: \[(?=[^]]*bucket#\d+ (IN|=))", plans[0])


def test_blocks_travel_once_for_all_queries(spark, tmp_path, monkeypatch):
    index = postings.build(spark.createDataFrame(texts_of(5, 60), CHUNKS), str(tmp_path / "p"))
    real, seen = postings.shared.written, []

    def blocks(*_):
        def run(batches):
            for batch in batches:
                n = len(batch) - batch.column("places").null_count
                kinds = {"query_id": batch.schema.field("query_id").type, "range": pa.int64(), "place": pa.int32(), "bm25": pa.float64(), "exact": pa.float64()}
                yield pa.RecordBatch.from_pydict({c: pa.array([0] * n, k) for c, k in kinds.items()})

        return run

    def spy(df, name):
        out = real(df, name)
        seen.extend([out.count()] if name == "scored" else [])
        return out

    monkeypatch.setattr(postings, "_score", blocks)
    monkeypatch.setattr(postings.shared, "written", spy)
    for n in (1, 20):
        index.search(spark.createDataFrame([(k, "moon the") for k in range(n)], "query_id int, query string"))
    assert seen[0] == seen[1] > 0


def test_mean_idf_does_not_gather_rounding(spark, tmp_path):
    rows = [(str(k), k, " ".join(f"w{k}x{j}" for j in range(2500)) + " all", "t", 1) for k in range(40)]
    index = postings.build(spark.createDataFrame(rows, CHUNKS), str(tmp_path / "p"))
    idf = lambda df: Fraction(math.log(40 - df + 0.5) - math.log(df + 0.5))
    exact = float((100_000 * idf(1) + idf(40)) / 100_001)
    assert abs(index.mean_idf - exact) <= 2 * math.ulp(exact)


def test_bm25_topk_equals_its_sql_with_null_texts(spark, tmp_path):
    rows = [(int(c[1:]) if c[1:].isdigit() else s, t) for c, s, t, *_ in texts_of(3, 40)] + [(1000 + k, None) for k in range(9)]
    tables = {"documents": (rows, "doc_id long, text string"), "benchmark": ([(0, "the moon"), (50, "moon5 zebra 보고"), (100, None)], "item_id long, text string")}
    con = duckdb.connect()
    for name, (data, schema) in tables.items():
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    want = con.execute(queries.ORACLES["bm25_topk"]).fetchall()
    assert len(want) == 20 and {tuple(r) for r in queries.bm25_topk(spark, str(tmp_path)).collect()} == set(want)


def test_empty_index(spark, tmp_path):
    index = postings.build(spark.createDataFrame([], CHUNKS), str(tmp_path / "p"))
    assert index.n == 0 and index.search(spark.createDataFrame([(1, "moon")], "query_id int, query string")).collect() == []
    found = vectors.build(spark.createDataFrame([], "chunk_id string, seq long, embedding array<float>"), str(tmp_path / "v"))
    assert found.search(spark.createDataFrame([(1, [1.0])], "query_id int, query_embedding array<float>")).collect() == []
    assert vectors.load(spark, str(tmp_path / "w")) is None


def plain_cosine(rows, asked, pool):
    out = set()
    for q, v in asked:
        scored = []
        for c, s, w in rows:
            if w is None or v is None:
                continue
            a, b = np.zeros(12), np.zeros(12)
            a[: len(v)], b[: len(w)] = np.float32(v), np.float32(w)
            norm = math.sqrt(a @ a) * math.sqrt(b @ b)
            scored.append((-round(min(1.0, max(-1.0, float(a @ b) / norm)) if norm else 0.0, 10), s, c))
        out |= {(q, c, s, k + 1, -x) for k, (x, s, c) in enumerate(sorted(scored)[:pool])}
    return out


def vectors_of(seed, n, spread):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, 8))
    rows = [(f"c{k}", k * 7 % n, [float(x) for x in np.float32(centres[k % 6] + rng.normal(size=8) * spread)]) for k in range(n)]
    return [*rows, ("zero", 900, [0.0] * 8), ("none", 901, None), ("short", 902, [1.0]), ("no", 903, []), ("same", 904, rows[3][2]), ("twice", 905, [2 * x for x in rows[3][2]])]


@pytest.mark.parametrize("spread", [0.05, 1.0])
def test_vectors_equal_brute_force(spark, tmp_path, monkeypatch, spread):
    for name, value in (("BLOCK", 8), ("PIVOT_ROWS", 20), ("GROUP", 2), ("QUERY_BLOCK", 4)):
        monkeypatch.setattr(vectors, name, value)
    rows = vectors_of(1, 260, spread)
    built = vectors.build(spark.createDataFrame(rows, "chunk_id string, seq long, embedding array<float>").repartition(3), str(tmp_path / "v"))
    index = vectors.load(spark, str(tmp_path / "v"))
    assert len(index.groups) > 12 and np.array_equal(built.groups, index.groups)
    asked = [(str(k), rows[k][2]) for k in range(0, 260, 9)] + [("zero", [0.0] * 8), ("none", None), ("short", [3.0]), ("longer", [1.0] * 12)]
    skipped: list[tuple[int, int]] = []
    got = index.search(spark.createDataFrame(asked, "query_id string, query_embedding array<float>"), 4, skipped)
    assert {(r.query_id, r.chunk_id, r.seq, r.rank, round(r.vector_similarity, 10)) for r in got.collect()} == plain_cosine(rows, asked, 4)
    left, total = skipped[0]
    assert total == (len(asked) - 1) * len(index.groups) and (left > 0.5 * total if spread < 1 else left > 0)


def test_search_without_an_index(spark):
    rows = spark.createDataFrame([(str(k), k, [1.0, k / 7]) for k in range(20)] + [("none", 99, None)], "chunk_id string, seq long, embedding array<double>")
    asked = rows.select(F.col("seq").alias("query_id"), F.col("embedding").alias("query_embedding"))
    found = retrieval.vector_search(rows, asked, 3).collect()
    assert len(found) == 60 and all(r.vector_distance == 1 - r.vector_similarity for r in found)
    assert {r.query_id for r in found if r.rank == 1 and r.chunk_id == str(r.query_id)} == set(range(20))


def test_answers_are_made_of_the_evidence(spark):
    from haystrata.config import Settings
    from haystrata.operators import citations, signals
    from haystrata.plans import tools

    match = "array<struct<source:string,file_name:string,article:string,article_title:string,snippet:string>>"
    some = [("규정", "a.txt", "제7조", "보고", "보고한다"), (None, "b.txt", "", None, "가" * 800), ("", None, "제8조", "", None), *[("s", "f", "제9조", "t", "x")] * 4]
    rows = spark.createDataFrame([(1, "무엇을", some), (2, "없다", []), (3, None, None)], f"query_id int, query string, matches {match}")
    block = rows.select(citations.evidence_block(F.col("matches")).alias("b")).first().b.split("\n")
    assert len(block) == 5 and block[0] == "[1] source=규정 article=제7조 보고 snippet=보고한다"
    assert block[1] == "[2] source=b.txt article=- snippet=" + "가" * 700 and block[2] == "[3] source=unknown article=제8조 snippet="
    answer = lambda q, e: F.concat(q, F.lit(": "), F.substring(e, 1, 12))
    got = {r.query_id: r.answer for r in tools.generated(rows, answer, Settings(generate_answer=True)).collect()}
    assert got == {1: "무엇을: [1] source=규", 2: signals.NO_EVIDENCE, 3: signals.NO_EVIDENCE}
    assert {r.answer for r in tools.generated(rows, answer).collect()} == {r.answer for r in tools.generated(rows, None, Settings(generate_answer=True)).collect()} == {None}
