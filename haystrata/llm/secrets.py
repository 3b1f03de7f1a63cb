"""Secret scan with a random forest against false positives (operator 10, DataFrame functions only).

Candidates are values assigned to a secret-like name (``password = "value"``, of any length and
characters), tokens of known providers' shapes (also inside a path or URL) and long mixed strings.
Each has features: length, digits, cases, character transitions, share of hex digits, coverage by
runs that look like words (a pattern; no dictionary is at hand), quotes, signs of code, what its
path says and what the words before it say. A random forest,
trained on labelled findings, keeps the true ones.

Labelled findings are made from a stated rule with ``spark.range``: random keys of the usual
alphabets and lengths in secret-like surroundings are true; identifiers of words, version
numbers, dates, repeated characters, placeholders, digests and e-mail-like strings in other
surroundings are false. ``FINDINGS`` bounds them; the corpus is not needed.

Trees are fitted by Spark's own forest and applied as one SQL expression: their nodes are arrays of
constants, a fold of depth steps goes down each, so a scan is a compiled projection without shuffle. Null and empty texts have no findings. Equal rows have
equal findings; findings are in order of place, ties do not occur. A null path is no path.
Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FINDINGS, TREES, DEPTH, SEED = 4000, 15, 8, 3
THRESHOLD = 0.5
# Words that stand before secrets, and in harmless surroundings.
SECRET_WORDS = "(?i)(token|secret|passw(or)?d|pwd|api_?-?key|access_?-?key|auth|credential|bearer|private|apikey|client_?secret)"
HARMLESS_WORDS = "(?i)(example|sample|dummy|placeholder|changeme|checksum|sha1|sha256|md5|digest|commit|uuid|version|test|fixture)"
HARMLESS_PATHS = "(?i)(test|fixture|example|sample|docs?/|readme)"
_SHAPES = "AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}|sk_(live|test)_[A-Za-z0-9]{16,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[0-9A-Za-z_-]{35}|eyJ[A-Za-z0-9_-]{10,}\\.[A-Za-z0-9_.-]{10,}"
PROVIDERS = f"^({_SHAPES})$"
_INSIDE = f"(?<![A-Za-z0-9])(?:{_SHAPES})(?![A-Za-z0-9])"
#: A secret-like name and its sign; what is assigned follows. The guard keeps most places from the longer look back.
_GUARD = "(?<=[=:>][ \\t]{0,4}[\"']?)"
_NAME = "(?i:token|secret|passw(?:or)?d|passphrase|pwd|api_?-?key|access_?-?key|auth(?!or)|credential|bearer|private)[A-Za-z0-9_-]{0,16}[\"'\\]]{0,2}[ \\t]{0,4}(?::=|=>|={1,3}|:)[ \\t]{0,4}"
ASSIGNED = f"{_GUARD}(?:(?<={_NAME}\")[^\"\\n]++(?=\")|(?<={_NAME}')[^'\\n]++(?=')|(?<={_NAME})[^\\s\"',;=:>][^\\s\"',;]*+)"
#: Or else a whole run of at least 16 of these characters with a digit among them, up to a provider's shape inside it.
_RUN = f"(?<![A-Za-z0-9_+/.-])(?=[A-Za-z_+/.-]*[0-9])(?:(?!{_INSIDE})[A-Za-z0-9_+/.-]){{16,}}+"
CANDIDATE = f"{ASSIGNED}|{_INSIDE}|{_RUN}"
#: Characters before a candidate that its features look at.
BEFORE = 32
FEATURES = ["length", "digits", "uppers", "transitions", "hexes", "words", "symbols", "named", "harmless", "path", "provider", "assigned", "quoted", "code"]


def features(value: Column, before: Column, sign: Column, path: Column) -> list[Column]:
    n = F.greatest(F.length(value), F.lit(1)).cast("double")
    share = lambda pattern: F.length(F.regexp_replace(value, pattern, "")).cast("double") / n
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    return [
        F.length(value).cast("double"),
        share("[^0-9]"),
        share("[^A-Z]"),
        F.regexp_count(value, F.lit("(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])|(?<=[a-z])(?=[A-Z])")).cast("double") / n,
        share("[^0-9a-f]"),
        F.length(F.regexp_replace(value, "[a-z]*[aeiou][a-z]{3,}|[A-Z][a-z]{3,}|[a-z]{3,}[aeiou][a-z]*", "")).cast("double") / n,
        share("[A-Za-z0-9]"),
        flag(before.rlike(SECRET_WORDS)),
        flag(before.rlike(HARMLESS_WORDS) | value.rlike(HARMLESS_WORDS)),
        flag(path.rlike(HARMLESS_PATHS)),
        flag(value.rlike(PROVIDERS)),
        flag(sign.rlike("[=:]")),
        flag(sign.rlike("[\"']$")),
        flag(value.rlike("[(\\[{<]|^[$%]|^(?i:none|null|true|false|nil|undefined|string)$")),
    ]


def labelled_findings(spark: SparkSession, rows: int = FINDINGS, seed: int = SEED) -> DataFrame:
    """value, before, sign, path, label: ``rows`` long findings, a third of them true, and half as many assigned values, half of them true."""
    r = lambda k: F.conv(F.substring(F.md5(F.concat_ws("/", F.lit(f"{seed}.{k}"), F.col("id"))), 1, 7), 16, 10).cast("int")
    pick = lambda k, *xs: F.element_at(F.array(*[F.lit(x) if isinstance(x, str) else x for x in xs]), r(k) % len(xs) + 1)
    hexes = F.sha2(F.concat_ws(":", F.lit(f"key{seed}"), F.col("id")), 512)
    base = F.regexp_replace(F.base64(F.unhex(hexes)), "[^A-Za-z0-9]", "x")
    true_value = pick(1, F.substring(hexes, 1, 32), F.substring(hexes, 1, 40), F.substring(hexes, 1, 64), F.substring(base, 1, 24), F.substring(base, 1, 40), F.concat(F.lit("ghp_"), F.substring(base, 1, 36)), F.concat(F.lit("AKIA"), F.upper(F.substring(hexes, 1, 16))), F.concat(F.lit("sk_live_"), F.substring(base, 1, 24)))
    words = ["connection", "handler", "report", "customer", "invoice", "service", "module", "default", "content", "parser"]
    phrase = F.concat_ws("_", pick(2, *words), pick(3, *words), pick(4, *words))
    dotted = F.concat_ws(".", F.lit("com"), pick(2, *words), pick(3, *words), pick(4, *words))
    false_value = pick(5, phrase, dotted, F.concat(F.lit("2024-01-"), F.lpad(r(6) % 28 + 1, 2, "0"), F.lit("T10.20.30")), F.rpad(F.lit("x"), 24, "x"), F.lit("your_api_key_goes_here"), F.lpad(r(7).cast("string"), 16, "1"), F.concat(F.lit("v1.2."), r(8).cast("string"), F.lit("-build.77")), F.concat_ws("-", F.substring(hexes, 1, 8), F.substring(hexes, 9, 4), F.substring(hexes, 13, 4), F.substring(hexes, 17, 4), F.substring(hexes, 21, 12)), F.concat(pick(2, *words), F.lit("/"), pick(3, *words), F.lit("/"), pick(4, *words), F.lit(".txt")))
    label = (F.col("id") % 3 == 0).cast("int")
    digest = F.col("id") % 9 == 1  # a true-looking value in surroundings that say it is none
    before_true, before_false = pick(9, "token", "my api_key", "password", "client_secret", "auth", "set access_key", "the secret"), pick(10, "name", "see", "commit", "sha256", "file", "example", "on", "id", "version", "uuid", "the")
    # a provider's shape needs no name before it
    bare = true_value.rlike(PROVIDERS) & (r(14) % 2 == 0)
    long = spark.range(rows).select(
        F.when((label == 1) | (digest & ~true_value.rlike(PROVIDERS)), true_value).otherwise(false_value).alias("value"),
        F.when((label == 1) & bare, pick(15, "key", "and", "see", "the", "use", "")).when(label == 1, before_true).when(digest, pick(11, "commit", "sha1", "checksum", "digest", "md5 of", "see", "and")).otherwise(before_false).alias("before"),
        F.when(label == 1, pick(12, " = ", "=", ": ", " ")).otherwise(pick(12, " ", " ", ": ", "=")).alias("sign"),
        F.when(label == 1, F.lit("src/app.py")).otherwise(pick(13, "src/app.py", "tests/test_app.py", "docs/readme.md")).alias("path"),
        label.alias("label"),
    )
    # values of any length assigned to secret-like names: passwords and short or unmixed keys; words of prose, code and placeholders are none
    mark, cap = pick(16, "!", "&", "#", "$", "@", "-"), F.initcap(pick(2, *words))
    some = lambda least, spread: F.substring(base, F.lit(1), F.lit(least) + r(17) % spread)
    password = pick(18, F.concat(pick(2, *words), (r(8) % 1000).cast("string"), mark, F.substring(base, 1, 1)), F.concat(cap, mark, (r(8) % 100).cast("string")), F.concat(F.translate(cap, "aeo", "430"), mark, F.substring(base, 2, 1)), some(6, 12), F.substring(hexes, F.lit(1), F.lit(8) + r(17) % 8), F.translate(F.substring(base, 1, 36), "0123456789", "ghijKLMNOP"), F.lower(F.translate(some(10, 22), "0123456789", "bcdfghjklm")))
    no_secret = pick(19, pick(2, *words), F.concat(pick(2, *words), F.lit("s")), F.substring(pick(3, *words), 1, 3), F.initcap(pick(4, *words)), F.concat(pick(2, *words), F.lit("."), pick(3, *words), F.lit("()")), F.concat(F.lit("get_"), pick(2, *words), F.lit("(")), F.lit("None"), F.lit("null"), F.lit("true"), F.concat(F.lit("${"), F.upper(pick(2, *words)), F.lit("}")), F.concat(F.lit("<"), pick(2, *words), F.lit(">")), F.lit("your_password"), F.lit("changeme"), F.lit("example"))
    word = no_secret.rlike("^[A-Za-z]+$") & ~no_secret.isin("None", "null", "true", "changeme", "example")
    name = pick(20, "password", "secret", "token", "api_key", "my pwd", "client_secret", "auth_token", "credential", "passwd")
    short = spark.range(rows // 2).select(
        F.when(F.col("id") % 2 == 0, password).otherwise(no_secret).alias("value"),
        name.alias("before"),
        F.when((F.col("id") % 2 == 1) & word, pick(21, ": ", "=", " = ", ":")).otherwise(pick(21, " = \"", ": \"", "='", ": ", "=", " = ")).alias("sign"),
        pick(22, "src/app.py", "config/app.yml").alias("path"),
        (F.col("id") % 2 == 0).cast("int").alias("label"),
    )
    return long.unionByName(short)


def train_forest(findings: DataFrame, trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> str:
    """A SQL expression over the feature names: the trees' mean probability of a true finding."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = findings.select("label", *[c.alias(n) for c, n in zip(features(*map(F.col, ("value", "before", "sign", "path"))), FEATURES, strict=True)])
    table = VectorAssembler(inputCols=FEATURES, outputCol="x").transform(rows.coalesce(1))
    forest = RandomForestClassifier(labelCol="label", featuresCol="x", numTrees=trees, maxDepth=depth, seed=seed, maxBins=64, featureSubsetStrategy="sqrt").fit(table)

    def nodes(tree) -> list[str]:
        """A tree's nodes, root first: feature, threshold, places of both children (-1: a leaf), share of true findings."""
        out: list[str] = []

        def add(node) -> int:
            at = len(out)
            out.append("")
            if node.numDescendants() == 0:
                a, b = (float(x) for x in node.impurityStats().stats())
                out[at] = f"named_struct('i', 0, 't', 0D, 'l', -1, 'r', -1, 'v', {b / (a + b)!r}D)"
            else:
                split = node.split()
                left, right = add(node.leftChild()), add(node.rightChild())
                out[at] = f"named_struct('i', {split.featureIndex()}, 't', {split.threshold()!r}D, 'l', {left}, 'r', {right}, 'v', 0D)"
            return at

        add(tree._java_obj.rootNode())
        return out

    table = ", ".join(f"array({', '.join(nodes(t))})" for t in forest.trees)
    down = f"aggregate(sequence(1, {depth}), 0, (n, k) -> CASE WHEN t[n].l < 0 THEN n WHEN x[t[n].i] <= t[n].t THEN t[n].l ELSE t[n].r END, n -> t[n].v)"
    values = ", ".join(f"f.{name}" for name in FEATURES)
    return f"transform(array(array({values})), x -> aggregate(array({table}), 0D, (s, t) -> s + {down}) / {float(len(forest.trees))!r}D)[0]"


_trained: dict[tuple, str] = {}


def default_forest(spark: SparkSession) -> str:
    """The forest of the labelled findings, trained once a Spark application."""
    key = (spark.sparkContext.applicationId, FINDINGS, TREES, DEPTH, SEED)
    if key not in _trained:
        _trained[key] = train_forest(labelled_findings(spark))
    return _trained[key]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = None, threshold: float = THRESHOLD, forest: str | None = None) -> DataFrame:
    """One row per finding: ``id_col``, number, value, first (code point, from 0), score; rejected candidates are left out."""
    forest = forest or default_forest(docs.sparkSession)
    path = F.col(path_col).cast("string") if path_col else F.lit(None).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), path.alias("path"))
    rows = rows.filter(F.col("text").rlike(CANDIDATE))  # most texts end here
    hits = F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0))
    pieces = F.split("text", CANDIDATE, -1)
    rows = rows.select("id", "path", hits.alias("hits"), pieces.alias("pieces"), F.transform(pieces, lambda p: F.char_length(p)).alias("gaps"))
    # (length so far, candidates so far) folded once along the text
    start = F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<bigint>)").alias("firsts"))
    firsts = F.aggregate(
        F.zip_with("gaps", F.transform("hits", lambda h: F.char_length(h)), lambda g, h: F.struct(g.alias("gap"), F.coalesce(h, F.lit(0)).alias("hit"))),
        start,
        lambda a, x: F.struct((a["at"] + x["gap"] + x["hit"]).alias("at"), F.concat(a["firsts"], F.array(a["at"] + x["gap"])).alias("firsts")),
        lambda a: a["firsts"],
    )
    # a name that is itself the candidate before still stands before its value
    joined = F.zip_with("pieces", F.concat(F.array(F.lit("")), F.col("hits")), lambda p, h: F.when(p.rlike("^[\"'=:> \\t\\]]*$"), F.concat(h, p)).otherwise(p))
    befores = F.transform(joined, lambda p: F.right(p, F.lit(BEFORE)))
    one = rows.select("id", "path", F.posexplode(F.arrays_zip("hits", befores.alias("befores"), firsts.alias("firsts"))).alias("number", "span"))
    one = one.filter(F.col("span.hits").isNotNull())  # behind the last candidate
    ends = "[\"'=:> \\t\\]]*$"
    sign = F.regexp_extract(F.col("span.befores"), ends, 0)
    one = one.select("id", "path", "number", F.regexp_replace(F.col("span.befores"), ends, "").alias("before"), sign.alias("sign"), F.col("span.hits").alias("value"), F.col("span.firsts").alias("first"))
    assigned = F.col("before").rlike(f"{SECRET_WORDS}[A-Za-z0-9_-]*$") & F.col("sign").rlike("[=:]")
    one = one.filter(F.col("value").rlike("[A-Za-z]") & F.col("value").rlike("[0-9]") | F.col("value").rlike(PROVIDERS) | assigned)
    own = F.struct(*[c.alias(n) for c, n in zip(features(F.col("value"), F.col("before"), F.col("sign"), F.col("path")), FEATURES, strict=True)])
    scored = one.withColumn("f", own).withColumn("score", F.expr(forest)).filter(F.col("score") >= threshold)
    return scored.select(F.col("id").alias(id_col), F.col("number").cast("long").alias("number"), "value", "first", "score")
