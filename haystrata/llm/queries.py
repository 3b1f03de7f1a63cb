"""Registered queries of the operators: thin, whole tables, production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haystrata.llm import clustering, decontaminate, exact_dedup, hard_negatives, html_text, jaccard, licenses, mixing, quality, secrets, substring_dedup, token_counts, toxicity
from haystrata.llm.scratch import folder


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["first"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(_read(spark, sf_dir, "documents"))
    names = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["license"])))
    return found.select(
        "doc_id",
        F.size("matches").cast("long").alias("n_matches"),
        F.array_join(names, ",").alias("licenses"),
        F.round(F.array_max(F.transform("matches", lambda m: m["dice"])), 6).alias("best_dice"),
    )


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_read(spark, sf_dir, "documents"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_read(spark, sf_dir, "pages"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(_read(spark, sf_dir, "documents"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.linked(_read(spark, sf_dir, "documents"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_read(spark, sf_dir, "documents")).withColumn("score", F.round("score", 6))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(_read(spark, sf_dir, "embeddings"))


def op12_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster(_read(spark, sf_dir, "embeddings"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a cache of its own, so that every run encodes all it reads; elsewhere the folder lasts
    return token_counts.count_tokens(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), folder(spark, "token-cache"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_decontamination, op2_mixing, op3_licenses, op4_toxicity, op5_exact_dedup, op6_html_extraction, op7_quality, op8_substring_dedup, op9_jaccard_join, op10_secrets,
        op11_hard_negatives, op12_clustering, op13_token_counts,
    )
}

# --- the same results in DuckDB's SQL; 4, 6, 7, 10 and 13 are trained, parse or encode and have none ---
_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_SPACE = r"[^\x20\x09-\x0D]+"
_UNIT = "(CAST('0x' || substr(md5({x}), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE)"
_LEVELS = "CASE WHEN size = 0 THEN -1 ELSE length(bin(size)) * 8 + ((size >> greatest(length(bin(size)) - 4, 0)) & 7) END"

ORACLES: dict[str, str] = {
    "op1_decontamination": rf"""
WITH b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS i, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '{_ALNUM}') AS w FROM benchmark),
p AS (SELECT DISTINCT i, w[k : k + {decontaminate.WINDOW - 1}] AS ph FROM (SELECT i, w, unnest(range(1, greatest(len(w) - {decontaminate.WINDOW - 1}, 1) + 1)) AS k FROM b WHERE len(w) > 0)),
n AS (SELECT DISTINCT len(ph) AS n FROM p),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '{_ALNUM}') AS w FROM documents),
x AS (SELECT doc_id, n, k, w[k : k + n - 1] AS ph FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, n WHERE len(w) >= n)),
h AS (SELECT doc_id, n, k, i FROM x JOIN p USING (ph)),
c AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(k, k + n)) AS pos FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT i) AS n_items, string_agg(DISTINCT i, ',' ORDER BY i) AS items FROM h GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)""",
    "op2_mixing": rf"""
WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_SPACE}'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM d GROUP BY source),
w AS (SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, source_size * 2.0::DOUBLE AS cap FROM s),
l AS (SELECT *, cap / weight AS ratio, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, coalesce(least((SELECT arg_min(level, struct_pack(ratio := ratio, rank := rank)) FROM l WHERE level <= ratio) * weight, cap), cap) AS target FROM l),
c AS (SELECT *, {_LEVELS} AS class FROM d),
k AS (SELECT source, class, ceil(count(*) / greatest(256, floor(sqrt((SELECT count(*) FROM d))))::DOUBLE)::BIGINT AS blocks FROM c GROUP BY source, class),
b AS (SELECT c.*, floor({_UNIT.format(x="'block:' || CAST(c.doc_id AS VARCHAR)")} * k.blocks) AS block FROM c JOIN k ON c.source IS NOT DISTINCT FROM k.source AND c.class = k.class),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY class, block, size, doc_id) AS rn, {_UNIT.format(x="'offset7:' || coalesce(source, chr(0) || 'null')")} AS u FROM b)
SELECT r.doc_id, r.size, t.source_size, t.target, CASE WHEN r.size = 0 THEN 0 ELSE (floor(least(t.target / t.source_size, 2.0::DOUBLE) * rn + u) - floor(least(t.target / t.source_size, 2.0::DOUBLE) * (rn - 1) + u))::BIGINT * r.size END AS taken
FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source""",
    "op5_exact_dedup": f"""
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), {_AZ}) AS t FROM documents)""",
    "op8_substring_dedup": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_SPACE}') AS w FROM documents),
x AS (SELECT doc_id, k, array_to_string(w[k : k + 12], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS k FROM d WHERE len(w) >= 13)),
m AS (SELECT s, min(doc_id) AS least FROM x GROUP BY s),
g AS (SELECT DISTINCT doc_id, unnest(range(k, k + 13)) AS pos FROM x JOIN m USING (s) WHERE least < doc_id),
p AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS pos, unnest(w) AS word FROM d WHERE len(w) > 0),
q AS (SELECT p.doc_id, count(*)::BIGINT AS n_words, count(g.pos)::BIGINT AS n_removed, string_agg(p.word, ' ' ORDER BY p.pos) FILTER (g.pos IS NULL) AS kept FROM p LEFT JOIN g ON p.doc_id = g.doc_id AND p.pos = g.pos GROUP BY p.doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN q USING (doc_id)""",
    "op9_jaccard_join": rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '{_SPACE}') AS w FROM documents),
x AS (SELECT DISTINCT doc_id, array_to_string(w[k : k + 2], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS k FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM x GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM x a JOIN x b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM o JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * shared >= 90 * (p.n + q.n - shared)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS v, doc_id AS c FROM documents UNION SELECT u.b, r.c FROM r JOIN u ON u.a = r.v WHERE r.c < u.b)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, min(r.c)) AS component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN r ON r.v = d.doc_id GROUP BY d.doc_id, n.n""",
}


def _licenses_sql() -> str:
    templates = ", ".join(f"('{name}', [{', '.join(repr(g) for g in licenses.bigrams(t))}])" for name, t in sorted(licenses.TEMPLATES.items()))
    return rf"""
WITH t(license, g) AS (VALUES {templates}),
d AS (SELECT doc_id, translate(coalesce(text, ''), {_AZ}) AS low FROM documents),
u AS (SELECT doc_id, 0 AS kind, unnest(range(len(string_split(low, chr(10))))) AS k, unnest(string_split(low, chr(10))) AS unit FROM d
  UNION ALL SELECT doc_id, 1, unnest(range(len(regexp_split_to_array(low, '\n[ \t\r]*\n')))), unnest(regexp_split_to_array(low, '\n[ \t\r]*\n')) FROM d WHERE len(regexp_split_to_array(low, '\n[ \t\r]*\n')) > 1
  UNION ALL SELECT doc_id, 2, 0, low FROM d WHERE contains(low, chr(10))),
w AS (SELECT doc_id, kind, k, regexp_extract_all(unit, '[a-z0-9]+') AS w FROM u),
b AS (SELECT doc_id, kind, k, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS own FROM w WHERE len(w) > 1),
s AS (SELECT doc_id, kind, k, license, 2.0::DOUBLE * len(list_intersect(own, g)) / (len(own) + len(g)) AS dice FROM b, t WHERE len(own) <= 1.5 * len(g) + 1),
m AS (SELECT * FROM s WHERE dice >= {licenses.THRESHOLD} QUALIFY row_number() OVER (PARTITION BY doc_id, kind, k ORDER BY dice DESC, license) = 1)
SELECT d.doc_id, count(m.license)::BIGINT AS n_matches, coalesce(string_agg(DISTINCT m.license, ',' ORDER BY m.license), '') AS licenses, round(max(m.dice), 6) AS best_dice FROM d LEFT JOIN m USING (doc_id) GROUP BY d.doc_id"""


def _clustering_sql() -> str:
    c = clustering
    near = "SELECT rid, any_value(v) AS v, arg_min(c, d) AS c, min(d) AS d FROM (SELECT rid, v, c, list_sum(list_transform(range(1, {dim} + 1), lambda i: (v[i] - cv[i]) * (v[i] - cv[i]))) * {k}::HUGEINT + c AS d FROM x, c{r}) GROUP BY rid"
    mean = "SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS cv FROM (SELECT c, i, sum(v[i]) AS s, count(*) AS n FROM (SELECT c, v, unnest(range(1, {dim} + 1)) AS i FROM a{r}) GROUP BY c, i) GROUP BY c"
    steps = []
    for r in range(c.ROUNDS):
        steps.append(f"a{r} AS MATERIALIZED ({near.format(r=r, dim=c.DIM, k=c.K)})")
        steps.append(f"c{r + 1} AS MATERIALIZED (SELECT c, coalesce(m.cv, o.cv) AS cv FROM c{r} o LEFT JOIN ({mean.format(r=r, dim=c.DIM)}) m USING (c))")
    steps.append(f"a{c.ROUNDS} AS MATERIALIZED ({near.format(r=c.ROUNDS, dim=c.DIM, k=c.K)})")
    return f"""
WITH x AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda y: CAST(floor({c.SCALE} * CAST(y AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = {c.DIM} AND len(list_filter(embedding, lambda y: isfinite(y))) = {c.DIM}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v AS cv FROM (SELECT v, sha256('{c.SEED}:' || vec_id) AS h FROM x ORDER BY h NULLS LAST, v LIMIT {c.K})),
{", ".join(steps)},
f AS (SELECT vec_id, c, d // {c.K} AS d FROM a{c.ROUNDS} JOIN x USING (rid))
SELECT vec_id, c::INT AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(cv, ',')) AS centroid_sha256 FROM f JOIN c{c.ROUNDS} USING (c)"""


ORACLES["op3_licenses"] = _licenses_sql()
ORACLES["op11_hard_negatives"] = f"""
WITH r AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % {hard_negatives.RELABEL_EVERY} = 0 THEN (label + 1) % {hard_negatives.LABELS} ELSE label END AS label, list_transform(embedding, lambda y: CAST(floor({hard_negatives.SCALE} * CAST(y AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda y: isfinite(y))) = len(embedding)),
s AS MATERIALIZED (SELECT a.rid AS a, a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, coalesce(list_sum(list_transform(range(1, least(len(a.v), len(b.v)) + 1), lambda i: a.v[i] * b.v[i])), 0)::BIGINT AS score FROM r a JOIN r b ON a.rid <> b.rid WHERE a.vec_id % {hard_negatives.ANCHOR_EVERY} = 0),
p AS (SELECT a, anchor_id, id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY a ORDER BY score DESC, id NULLS LAST) AS k FROM s WHERE same QUALIFY k <= {hard_negatives.POSITIVES})
SELECT p.anchor_id, positive_id, (row_number() OVER (PARTITION BY p.a, k ORDER BY score DESC, id NULLS LAST))::INT AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON p.a = s.a AND NOT same AND {hard_negatives.LOW} * positive_score <= 100 * score AND 100 * score <= {hard_negatives.HIGH} * positive_score QUALIFY rank <= {hard_negatives.NEGATIVES}"""
ORACLES["op12_clustering"] = _clustering_sql()
