"""Stages of the corpus pipeline, each on its predecessor's result."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from test_operators import ALNUM, LOW, SPACE, make_docs, plain_components

from haystrata.llm import quality
from haystrata.llm.scratch import materialise

SF = "/root/testdata/sf0.001"
#: Names that the operators use inside, as columns of the documents.
CLASHING = "doc_id long, text string, lang string, source string, n_chars long, gone long, gone_id long, score string, spans string, items string, n_words int, fp long, kept boolean, node long, id string, copies string"


def wide(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None, 1, 2, "a", "b", "c", 3, 4, True, 5, "d", "e") for i, t, s in rows], CLASHING).repartition(3)


def named(df) -> list[tuple]:
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    return [(r[0], r[1], r[3]) for r in make_docs(3)]


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    """A folder whose benchmark has passages of the rows, a null text, an empty one and a repeated item."""
    at = str(tmp_path_factory.mktemp("tables"))
    items = [(1, rows[12][1][20:260]), (1, rows[12][1][20:260]), (2, None), (3, ""), (None, "nobody knows this text at all"), (5, "a phrase that is nowhere among all the rows here today")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{at}/labels.parquet")
    return at


def test_the_driver_gets_the_model_and_not_the_sample(spark, monkeypatch):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")

    def here(*_):
        raise AssertionError("trained in the driver")

    monkeypatch.setattr(quality, "train", here)  # tasks import their own
    of_bucket, _ = quality.fit(docs, labels, quality.remainder("doc_id", 5) != 0)
    assert len(of_bucket) == 1 << quality.BITS and of_bucket.any()


def test_quality_stage_judges_each_text(spark, folder):
    import corpus_pipeline as C

    own = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    own += [own[0], own[1], own[1], (None, own[2][1], None), (None, None, None), (901, "", "s"), (902, "word " * 50_000, "s")]
    docs = materialise(wide(spark, own), "wide")
    got = C.quality_stage(spark, docs, folder)
    assert got.columns == docs.columns
    model = quality.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"), quality.remainder("doc_id", 5) != 0)
    good = lambda t: 1 / (1 + np.exp(-quality.logits(model, pa.array([t], pa.string()))[0])) >= quality.THRESHOLD
    assert named(got) == sorted(((i, t) for i, t, _ in own if good(t)), key=str)


def test_exact_stage_against_plain(spark, rows, folder):
    import corpus_pipeline as C

    docs = wide(spark, [*rows, (None, "nobody knows THIS text at all", None), (3, (rows[3][1] or "").upper(), None)])
    got = C.exact_stage(spark, docs, folder)
    assert got.columns == docs.columns
    groups: dict = {}
    for r in docs.collect():
        groups.setdefault((r.text or "").translate(LOW), []).append(-1 if r.doc_id is None else r.doc_id)
    have = {(r.text or "").translate(LOW): -1 if r.doc_id is None else r.doc_id for r in got.collect()}
    assert have == {t: max(ids) for t, ids in groups.items()} and got.count() == len(groups)


def test_near_stage_against_plain(spark, rows, folder):
    import corpus_pipeline as C

    once = {r[1]: r for r in rows if r[0] is not None and (r[1] or "").strip()}
    other = [(None, "nobody knows this text at all", None), (None, None, None), (500, "one id for two quite different texts", "s"), (500, "the other text that has this very id", "s")]
    docs = wide(spark, [*once.values(), *other])
    got = C.near_stage(spark, docs, folder)
    assert got.columns == docs.columns
    component = plain_components([(i, t) for i, t, _ in once.values()], 5, 80)
    assert any(c != i for i, (_, c) in component.items())
    assert named(got) == sorted([(i, t) for i, t, _ in once.values() if component[i][1] == i] + [(i, t) for i, t, _ in other], key=str)


def test_benchmark_stage_against_plain(spark, rows, folder):
    import corpus_pipeline as C

    docs = wide(spark, rows)
    got = C.benchmark_stage(spark, docs, folder)
    assert got.columns == docs.columns
    words = lambda t: ALNUM.findall((t or "").translate(LOW))
    phrases = set()
    for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect():
        w = words(r.text)
        phrases |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9))} if w else set()
    held = lambda t: any(tuple(w[k : k + n]) in phrases for w in [words(t)] for n in {len(p) for p in phrases} for k in range(len(w) - n + 1))
    want = [(i, t) for i, t, _ in rows if not held(t)]
    assert 0 < len(want) < len(rows) and named(got) == sorted(want, key=str)


def test_mixing_stage_emits_whole_copies(spark, rows, folder):
    import corpus_pipeline as C

    own = [(k, t, s) for k, (_, t, s) in enumerate(rows)]
    own.append(own[7])
    got = C.mixing_stage(spark, wide(spark, own), folder).collect()
    size = {i: len(SPACE.findall(t or "")) for i, t, _ in own}
    assert all(1 <= r.copies <= 2 and r.taken == r.copies * size[r.doc_id] > 0 for r in got)
    assert not Counter(r.doc_id for r in got) - Counter(i for i, _, _ in own)
    for source in {s for _, _, s in own}:
        mine = [r for r in got if r.source == source]
        longest = max(size[i] for i, _, s in own if s == source)
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 8 * longest


def test_stages(spark):
    import corpus_pipeline as C

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs.count()
    assert [n for n, _ in C.STAGES] == ["quality_classifier", "exact_dedup", "ngram_jaccard_join", "benchmark_decontamination", "source_mixing"]
    for name, stage in C.STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf), name)
        assert docs.columns == columns
        assert 0 < docs.count() <= before
        before = docs.count()
    mixed = C.STAGES[-1][1](spark, docs, sf)
    assert mixed.filter("copies < 1 or copies > 2").count() == 0
    assert C.run(spark, sf).count() == mixed.count()


def test_stages_take_empty_tables(spark):
    import corpus_pipeline as C

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in C.STAGES:
        docs_out = stage(spark, docs, sf)
        assert docs_out.count() == 0
