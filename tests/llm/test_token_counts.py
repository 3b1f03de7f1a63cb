"""Token counts against the library itself, and what the cache saves."""

from __future__ import annotations

import public_tokenizers as P
import pytest
import tokenizers
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from haystrata.llm import token_counts
from haystrata.llm.queries import QUERIES

TEXTS = [None, "", " ", "one", "one", "One two\r\nthree", "<|endoftext|> inside <|endoftext|>", "é 한국어 😀 ﬁ", "word " * 200_000, "a" * 5_000, "tab\tand\x00nul", "copy of a text"]
SCHEMA = "doc_id long, text string, digest string, n_tokens int, id string"


@pytest.fixture()
def docs(spark):
    rows = [(k, t, "x", 1, "y") for k, t in enumerate(TEXTS)] + [(3, "one", "x", 1, "y"), (3, "another text", None, None, None), (None, "no id", None, None, None), (None, None, None, None, None)]
    return spark.createDataFrame(rows + [(100 + k, "copy of a text", None, None, None) for k in range(50)], SCHEMA).repartition(3)


def plain(rows, count):
    return sorted(((r.doc_id, len((r.text or "").encode()), count(r.text or "")) for r in rows), key=str)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_counts(spark, docs, tmp_path, name):
    path = P.path(name)
    if name.endswith(".json"):
        model = tokenizers.Tokenizer.from_file(path)
        count = lambda t: len(model.encode(t, add_special_tokens=False))
    else:
        piece = SentencePieceProcessor(model_file=path)
        count = lambda t: len(piece.encode(t))
    got = token_counts.count_tokens(docs, path, str(tmp_path / "c"), limit=4)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    rows = got.collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in rows), key=str) == plain(docs.collect(), count)
    assert all(r.over_limit == (r.n_tokens > 4) for r in rows)


def test_only_new_texts_are_encoded(spark, docs, tmp_path, monkeypatch):
    asked = spark.sparkContext.accumulator(0)
    real = token_counts.encoded

    def counted(texts, model):
        asked.add(texts.count())
        return real(texts, model)

    monkeypatch.setattr(token_counts, "encoded", counted)
    path, cache = P.path("byte_bpe_50k.json"), str(tmp_path / "c")
    first = sorted(map(str, token_counts.count_tokens(docs, path, cache).collect()))
    distinct = docs.select(F.coalesce("text", F.lit(""))).distinct().count()
    assert asked.value == distinct
    assert sorted(map(str, token_counts.count_tokens(docs, path, cache).collect())) == first
    assert asked.value == distinct
    more = docs.unionByName(spark.createDataFrame([(900, "a new text", None, None, None), (901, "a new text", None, None, None)], SCHEMA))
    for limit in (token_counts.BROADCAST_BYTES, 0):
        monkeypatch.setattr(token_counts, "BROADCAST_BYTES", limit)
        assert token_counts.count_tokens(more.withColumn("text", F.when(F.col("doc_id") >= 900, F.concat("text", F.lit(str(limit)))).otherwise(F.col("text"))), path, cache).count() == more.count()
    assert asked.value == distinct + 2
    # another tokenizer shares nothing
    token_counts.count_tokens(docs, P.path("word_bpe_49k.json"), cache)
    assert asked.value == 2 * distinct + 2
    version = token_counts.Tokenizer.of(path).version
    before = sorted(map(str, token_counts.stored(spark, cache, version).collect()))
    assert token_counts.compact(spark, cache, version) == 3 and token_counts.compact(spark, cache, version) == 1
    assert sorted(map(str, token_counts.stored(spark, cache, version).collect())) == before


def test_unfinished_runs_do_not_count(spark, docs, tmp_path):
    path, cache = P.path("byte_bpe_50k.json"), str(tmp_path / "c")
    version = token_counts.Tokenizer.of(path).version
    spark.createDataFrame([(bytearray(b"x"), 5)], "digest binary, n_tokens long").write.parquet(f"{cache}/tokenizer={version}/run=lost")
    (tmp_path / "c" / f"tokenizer={version}" / "run=lost" / "_SUCCESS").unlink()
    assert token_counts.stored(spark, cache, version).count() == 0
    # two writers of one digest
    for _ in range(2):
        token_counts._append(spark.createDataFrame([(bytearray(b"x"), 5)], "digest binary, n_tokens long"), cache, version)
    assert token_counts.stored(spark, cache, version).collect()[0].n_tokens == 5 and token_counts.stored(spark, cache, version).count() == 1


def test_empty_table_and_kinds(spark, tmp_path):
    empty = spark.createDataFrame([], SCHEMA)
    assert token_counts.count_tokens(empty, P.path("byte_bpe_50k.json"), str(tmp_path / "c")).collect() == []
    assert token_counts.count_tokens(empty, P.path("byte_bpe_50k.json"), str(tmp_path / "c")).collect() == []
    with pytest.raises(ValueError):
        token_counts.Tokenizer.of("x.tiktoken")


def test_query(spark):
    at = "/root/testdata/sf0.001"
    model = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = plain(spark.read.parquet(f"{at}/documents.parquet").collect(), lambda t: len(model.encode(t, add_special_tokens=False)))
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in QUERIES["op13_token_counts"](spark, at).collect()), key=str) == want
