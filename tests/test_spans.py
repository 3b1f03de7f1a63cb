"""Claims, masks and chunks of texts with many findings against plain versions."""

from __future__ import annotations

import random
import re
import time

from pyspark.sql import functions as F

from haystrata.functions import spans as S
from haystrata.operators import chunking
from haystrata.operators.scan import scan

KIND = "array<struct<s:int,e:int,mask:string>>"


def stages_of(rng, n, top):
    """Stages of candidates that do not overlap within a stage."""
    out = []
    for _ in range(4):
        at, found = 0, []
        for _ in range(rng.randrange(n)):
            s = at + rng.randrange(6)
            e = s + rng.randrange(1, 6)
            if e > top:
                break
            found.append((s, e, f"<{len(found)}>"))
            at = e
        out.append(found)
    return out


def test_claims_and_masks_equal_plain(spark, monkeypatch):
    rng = random.Random(3)
    monkeypatch.setattr(S, "RUN", 8)
    cases = [stages_of(rng, 40, 150) for _ in range(60)] + [[[], [], [], []], [[(0, 3, "x")], [(0, 3, "y")], [(3, 4, "z")], []]]
    texts = ["".join(rng.choice("ab가😀 ") for _ in range(150)) for _ in cases]
    table = spark.createDataFrame([(k, t, *c) for k, (t, c) in enumerate(zip(texts, cases, strict=True))], f"k int, text string, a {KIND}, b {KIND}, c {KIND}, d {KIND}")
    rows = table.withColumn("f", S.claim([F.col(x) for x in "abcd"], KIND)).withColumn("m", S.splice(F.col("text"), F.col("f")))
    for r in rows.collect():
        want = []
        for stage in cases[r.k]:
            want += [c for c in stage if not any(c[0] < a[1] and c[1] > a[0] for a in want)]
        assert [tuple(x) for x in r.f] == want
        masked = texts[r.k]
        for s, e, mask in sorted(want, reverse=True):
            masked = masked[:s] + mask + masked[e:]
        assert r.m == masked


def test_between_pieces(spark):
    text = "".join(random.Random(1).choice("ab가😀é") for _ in range(3 * S.PIECE + 7))
    cuts = [(a, b) for a in (0, 5, S.PIECE - 1, S.PIECE, 2 * S.PIECE + 3, len(text)) for b in (0, 5, S.PIECE - 1, S.PIECE, S.PIECE + 1, 3 * S.PIECE, len(text)) if b >= a]
    table = spark.createDataFrame([(text, a, b) for a, b in cuts], "t string, a int, b int")
    got = table.select("a", "b", S.once(S.pieces(F.col("t")), lambda p: S.between(p, F.col("a"), F.col("b"))).alias("x")).collect()
    assert all(r.x == text[r.a : r.b] for r in got) and len(got) == len(cuts)


def test_running(spark):
    for n in (0, 1, 255, 256, 257, 1000):
        sums = S.running(F.sequence(F.lit(1), F.lit(n)) if n else F.expr("cast(array() as array<int>)"), F.lit(0), lambda s, x: s + x, lambda s, x: s, "int")
        assert spark.range(1).select(sums.alias("x")).first().x == [k * (k + 1) // 2 for k in range(n)]


def test_time_grows_with_the_text(spark):
    one = "메일 ab1@x.io 전화 010-1234-5678 대외비 계좌 110-222-333333 입금 "
    plain = "some words of a text, 가나 and more. Then another one follows here "
    seconds = {}
    for n in (500, 10_000):
        began = time.time()
        table = spark.range(1).select(F.lit(1).alias("doc_id"), F.repeat(F.lit(one), F.lit(n)).alias("text"))
        r = scan(table).select("total_findings", "masked_text", "counts").first()
        assert r.total_findings == 4 * n and set(r.counts.values()) == {n}
        assert r.masked_text == one.replace("ab1@", "ab***@").replace("1234-5678", "****-5678").replace("대외비", "[내부정보키워드]").replace("110-222-333333", "***3333") * n
        docs = table.select(F.lit("a.txt").alias("file_name"), F.repeat(F.lit(plain), F.lit(5 * n)).alias("text"), F.lit(0).cast("long").alias("doc_seq"))
        chunks = [c.text for c in chunking.chunk(docs).orderBy("chunk_seq").collect()]
        assert all(len(c) <= 900 for c in chunks) and chunks[-1].endswith("follows here") and len(chunks) > 300 * n // 900
        seconds[n] = time.time() - began
    assert seconds[10_000] < 20 * max(seconds[500], 3)  # 20 times the text; a quadratic fold takes some 400 times as long


def test_many_sentences_and_repeated_articles(spark):
    text = "제3조(가) " + " ".join(f"문장 {k}." for k in range(3000)) + " 제3조(나) 둘. 제4조(제5조(안) 셋 제3조(다) 넷"
    docs = spark.createDataFrame([("a.txt", text, 0)], "file_name string, text string, doc_seq long")
    got = chunking.chunk(docs, 50, 20).orderBy("chunk_seq").collect()
    packed, line = [], None
    for part in re.split(r"(?<=[.。])\s+", text[: text.index(" 제3조(나)")]):
        if line is not None and len(line) + len(part) + 1 <= 50:
            line += " " + part
        else:
            packed += [line] if line is not None else []
            line = part
    assert [c.text for c in got] == [*packed, line, "제3조(나) 둘.", "제4조(제5조(안) 셋", "제3조(다) 넷"]
    assert [c.chunk_id for c in got[-3:]] == ["a_3_0_1", "a_4_0", "a_3_0_2"]
