"""The forest's expression: it is compiled, and gives what Spark's own model gives; edges of the scan."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from haystrata.llm import secrets

DOCS = "doc_id long, text string, value string, score string, path string, before int"
KEY = "f3a9b1c04d5e6f708192a3b4c5d6e7f8"


@pytest.fixture(scope="module")
def forest(spark):
    return secrets.default_forest(spark)


def test_expression_equals_the_model(spark, forest):
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = secrets.labelled_findings(spark, 300, seed=9)
    own = [c.alias(n) for c, n in zip(secrets.features(*map(F.col, ("value", "before", "sign", "path"))), secrets.FEATURES, strict=True)]
    train = secrets.labelled_findings(spark).select("label", *own)
    assembler = VectorAssembler(inputCols=secrets.FEATURES, outputCol="x")
    model = RandomForestClassifier(labelCol="label", featuresCol="x", numTrees=secrets.TREES, maxDepth=secrets.DEPTH, seed=secrets.SEED, maxBins=64, featureSubsetStrategy="sqrt").fit(assembler.transform(train.coalesce(1)))
    both = model.transform(assembler.transform(rows.select(*own))).withColumn("f", F.struct(*secrets.FEATURES)).select(F.expr(forest).alias("a"), F.col("probability").alias("b")).collect()
    assert len(both) == 450 and all(r.a == pytest.approx(r.b[1], abs=1e-9) for r in both)


def test_scan_is_compiled(spark, forest):
    spark.conf.set("spark.sql.codegen.fallback", "false")
    spark.conf.set("spark.sql.codegen.factoryMode", "CODEGEN_ONLY")
    try:
        docs = spark.createDataFrame([(1, f'token = "{KEY}"', None, None, None, None)], DOCS)
        assert [r.value for r in secrets.scan(docs, forest=forest).collect()] == [KEY]
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")
        spark.conf.unset("spark.sql.codegen.factoryMode")


def test_edges(spark, forest):
    line = f'api_key = "{KEY}"'
    rows = [(1, line, "v", "s", "src/a.py", 1), (1, line, "v", "s", "src/a.py", 1), (2, None, "v", "s", None, 1), (3, "", "v", "s", None, 1), (4, "plain words " * 50_000 + line, "v", "s", None, 1), (None, line, "v", "s", None, 1), (5, f"{line}\n{line}", "v", "s", None, 1)]
    docs = spark.createDataFrame(rows, DOCS)
    for path in (None, "path"):
        got = sorted(((r.doc_id, r.number, r.value, r.first) for r in secrets.scan(docs, path_col=path, forest=forest).collect()), key=str)
        want = [(1, 0, KEY, 11), (1, 0, KEY, 11), (4, 0, KEY, 12 * 50_000 + 11), (5, 0, KEY, 11), (5, 1, KEY, 12 + len(line)), (None, 0, KEY, 11)]
        assert got == sorted(want, key=str)
    assert secrets.scan(docs.limit(0), forest=forest).collect() == []
