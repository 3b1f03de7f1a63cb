"""The chunk index: corpus folders and path lists to chunks, a versioned table with a manifest, search over it.

The index is a ``VersionedTable`` of chunks by chunk_id. Its version states the corpus digest and, in a table of its own,
the marks of the corpus' files; of a corpus that has changed only new and changed files are read and chunked, and
chunks of files that are gone are taken out. Search reads posting and vector blocks stored for the version that was
loaded; they are built at its first search. Embeddings and answers come from functions of the caller: a Column of the text
column (a pandas UDF, or a precomputed column).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from haystrata.config import Settings
from haystrata.operators import chunking
from haystrata.plans import tools
from haystrata.sources import corpus, files, postings, shared, vectors
from haystrata.sources import versioned
from haystrata.sources.versioned import Version, VersionedTable

# Messages.
NO_INDEX = "인덱스가 없습니다. 먼저 build_index(chunks)를 호출하세요."
NO_CORPUS = "검색 가능한 코퍼스 문서가 없습니다."
KEY = "chunk_id"
#: Paths of changed files that are listed to the reader; beyond, the folder is read.
MOST_PATHS = 10_000
#: What reading a corpus or writing an index raises; errors of the program itself are none of these.
ERRORS = (PySparkException, Py4JError, ValueError, OSError)


def corpus_files(spark: SparkSession, path: str) -> DataFrame:
    """path, file_name, length, modificationTime of the usable files in order of name; none if the folder is missing."""
    return corpus.files(spark, path).orderBy("path")


def load_corpus(spark: SparkSession, path: str | list[str], limit: int = 900, overlap: int = 120) -> DataFrame:
    """Chunks of all rule documents of a folder, with the path of their file; a file that cannot be read fails the whole load."""
    return _chunked(files.rule_documents(spark, path), limit, overlap)


def _chunked(docs: DataFrame, limit: int, overlap: int) -> DataFrame:
    return chunking.chunk(docs, limit, overlap).join(docs.select("doc_seq", F.col("path").alias("file_path")), "doc_seq")


def load_paths(spark: SparkSession, paths: list[str], limit: int = 900, overlap: int = 120) -> DataFrame:
    """Chunks of the files named, in the order given; patterns that match nothing, and other kinds of file, are errors."""
    for path in paths:
        if path.rsplit(".", 1)[-1].lower() not in files.ALLOWED:
            raise ValueError(f"지원하지 않는 코퍼스 파일 형식입니다: {path}")
    docs = spark.createDataFrame([], "path string, file_name string, text string, doc_seq long")
    for k, path in enumerate(paths):
        docs = docs.unionByName(files.rule_documents(spark, path).withColumn("doc_seq", F.col("doc_seq") + F.lit(k << 38)))
    return _chunked(docs, limit, overlap)


def embedded(chunks: DataFrame, embed: Callable[[Column], Column] | None) -> DataFrame:
    """With a column ``embedding``: of the caller's function, as it is, or null. A text that gets no vector, or one of another size than the first, is an error."""
    if embed is None:
        return chunks if "embedding" in chunks.columns else chunks.withColumn("embedding", F.lit(None).cast("array<float>"))
    rows = chunks.withColumn("embedding", embed(F.col("text")))
    size = F.coalesce(F.size("embedding"), F.lit(-1))
    bad = F.raise_error(F.concat(F.lit("embedding of "), F.col("chunk_id"), F.lit(" has "), size.cast("string"), F.lit(" components")))
    first = rows.select("embedding").first()
    return rows.withColumn("embedding", F.when(size == (len(first.embedding or []) or 1 if first else 1), F.col("embedding")).otherwise(bad))


def upsert(index: DataFrame, new: DataFrame, key: str = KEY, order: str = "chunk_seq") -> DataFrame:
    """Rows of ``new`` replace rows of equal key; of new rows that repeat a key the last in ``order`` holds. Null keys are no keys and stay."""
    return versioned.upsert(index, new, key, order)


def restored(stored: DataFrame) -> DataFrame:
    """Stored chunks as chunks again: an empty category is none, a missing id is the row's own, missing names are empty."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    own = F.coalesce(F.nullif(F.col("chunk_id"), F.lit("")), F.col("id"))
    rest = [c for c in stored.columns if c not in ("id", "text", "source", "article", "article_title", "chunk_id", "category", "file_name")]
    return stored.select("text", text("source").alias("source"), text("article").alias("article"), text("article_title").alias("article_title"), own.alias("chunk_id"), F.nullif(F.col("category"), F.lit("")).alias("category"), F.nullif(F.col("file_name"), F.lit("")).alias("file_name"), *rest)


def stored(chunks: DataFrame) -> DataFrame:
    """Chunks as they are written: the id beside the fields, an absent field as an empty one."""
    fields = ("source", "article", "article_title", "chunk_id", "category", "file_name")
    rest = [c for c in chunks.columns if c not in (*fields, "text", "id")]
    return chunks.select(F.col("chunk_id").alias("id"), "text", *(F.coalesce(F.col(c), F.lit("")).alias(c) for c in fields), *rest)


def table(spark: SparkSession, path: str) -> VersionedTable:
    return VersionedTable(spark, path, KEY, "chunk_seq")


def build(chunks: DataFrame, path: str, mark: str | None = None, embed: Callable[[Column], Column] | None = None, facts: dict | None = None) -> int:
    """Replaces the index at ``path``; returns its number of chunks. Nothing is written when there are none. Of equal ids the last in order of the files holds."""
    if not chunks.take(1):
        return 0
    rows = stored(embedded(chunks, embed))
    last = upsert(rows.limit(0), rows.withColumn("_order", F.struct("doc_seq", "chunk_seq")), KEY, "_order")
    return table(chunks.sparkSession, path).replace(last, {"corpus": mark, **(facts or {})}).rows


def manifest(corpus: str | None, chunks: int) -> str:
    return json.dumps({"corpus": corpus, "chunks": chunks}, ensure_ascii=False, indent=2)


def read_manifest(spark: SparkSession, path: str) -> dict | None:
    """Corpus digest and number of chunks of an index; none if there is none or its newest version cannot be read."""
    v = table(spark, path).version()
    return {"corpus": v.facts.get("corpus"), "chunks": v.rows} if v.schema is not None else None


@dataclass(frozen=True)
class Index:
    """An index that can be searched, at the version that was loaded; ``chunks`` is None before it is built or loaded."""

    chunks: DataFrame | None = None
    path: str | None = None
    number: int = 0
    _search: dict = field(default_factory=dict)

    def count(self) -> int:
        return 0 if self.chunks is None else self.chunks.count()

    def _stored(self, name: str, module, chunks: DataFrame):
        """Blocks of this version, found in the index's folder or built there."""
        if name not in self._search:
            spark, top = chunks.sparkSession, f"{self.path}/search"
            for folder, _, _ in shared.listed(spark, top):
                if folder.startswith(f"{self.number:012d}-{name}-"):
                    self._search[name] = self._search.get(name) or module.load(spark, f"{top}/{folder}")
            self._search[name] = self._search.get(name) or module.build(chunks, f"{top}/{self.number:012d}-{name}-{uuid.uuid4().hex}")
        return self._search[name]

    def search(self, queries: DataFrame, settings: Settings | None = None) -> DataFrame:
        """queries: query_id, query, query_embedding. Formatted matches; an error without an index."""
        if self.chunks is None:
            raise RuntimeError(NO_INDEX)
        chunks = self.chunks.withColumn("seq", F.col("doc_seq") * F.lit(1 << 20) + F.col("chunk_seq"))
        if self.path is None:
            return tools.matches(chunks, queries, settings)
        return tools.matches(chunks, queries, settings, self._stored("words", postings, chunks), self._stored("vectors", vectors, chunks))


def load(spark: SparkSession, path: str, number: int | None = None) -> Index:
    """The index at a folder, its newest version unless another is named; one without chunks if there is none."""
    own = table(spark, path)
    v = own.version(number)
    rows = own.read(v)
    if rows is None:
        return Index()
    listing = v.facts.get("files")
    if listing is not None:  # the order of files is that of the corpus as it was at this version
        order = spark.read.schema(f"{corpus.FILES}, mark string, node int, doc_seq long").parquet(f"{path}/files/{listing}").select(F.col("path").alias("file_path"), "doc_seq")
        rows = rows.drop("doc_seq").join(order, "file_path")
    return Index(restored(rows.drop("file_path")), path, v.number)


def _listing(spark: SparkSession, path: str, marks: DataFrame) -> str:
    name = uuid.uuid4().hex
    files.ordered(marks, "path").write.parquet(f"{path}/files/{name}")
    return name


def update(spark: SparkSession, folder: str, path: str, embed: Callable[[Column], Column] | None = None, limit: int = 900, overlap: int = 120) -> dict:
    """Brings the index at ``path`` up to a corpus folder; returns the files by kind of change, and chunks.

    An index of another kind, or none, is built from all files. Of chunks of several files that share an id the one written last holds.
    """
    marks = shared.written(corpus.marked(corpus.files(spark, folder)), "marks")
    found, own = corpus.nodes(marks), table(spark, path)
    v, mark = own.version(), corpus.digest(found)
    facts = {"corpus": mark, "nodes": {str(k): x for k, x in found.items()}}
    if v.schema is None or "nodes" not in v.facts or not found:
        if not found:
            return {"new": 0, "changed": 0, "gone": 0, "chunks": 0}
        n = build(load_corpus(spark, folder, limit, overlap), path, mark, embed, facts | {"files": _listing(spark, path, marks)})
        return {"new": marks.count(), "changed": 0, "gone": 0, "chunks": n}
    if v.facts.get("corpus") == mark:
        return {"new": 0, "changed": 0, "gone": 0, "chunks": v.rows}
    before = spark.read.schema(f"{corpus.FILES}, mark string, node int, doc_seq long").parquet(f"{path}/files/{v.facts['files']}")
    known = {int(k): x for k, x in v.facts["nodes"].items()}
    differ = shared.written(corpus.changes(before, marks, known, found), "changes")
    kinds = {r.kind: r["count"] for r in differ.groupBy("kind").count().collect()}
    read = [r.path for r in differ.filter("kind != 'gone'").limit(MOST_PATHS + 1).collect()]
    if len(read) > MOST_PATHS:
        fresh = _chunked(files.rule_documents(spark, folder).join(differ.select("path"), "path", "left_semi"), limit, overlap)
    elif read:
        fresh = load_corpus(spark, read, limit, overlap)
    else:
        fresh = load_paths(spark, [], limit, overlap)
    rows = stored(embedded(fresh, embed if read else None))
    listing = _listing(spark, path, marks)
    now = own.read(v)
    stale = now.join(differ.filter("kind != 'new'").select(F.col("path").alias("file_path")), "file_path", "left_semi").select(F.col("file_path").alias("stale_path")).distinct()
    gone = [r.stale_path for r in stale.limit(MOST_PATHS + 1).collect()]
    if len(gone) > MOST_PATHS:  # most of the corpus is another one
        n = build(load_corpus(spark, folder, limit, overlap), path, mark, embed, facts | {"files": listing})
    else:
        n = own.change(rows.select(*now.columns), F.col("file_path").isin(gone), lambda _: facts | {"files": listing}).rows
    return {"new": 0, "changed": 0, "gone": 0} | kinds | {"chunks": n}


def ensure_ready(spark: SparkSession, folder: str, path: str, embed: Callable[[Column], Column] | None = None) -> tuple[Index, str | None]:
    """The index of a corpus folder, brought up to its files; or why there is none."""
    try:
        if not corpus.files(spark, folder).take(1):
            return Index(), NO_CORPUS
        if not update(spark, folder, path, embed)["chunks"]:
            return Index(), NO_CORPUS
        return load(spark, path), None
    except ERRORS as e:  # the tools report it and ask for review
        return Index(), str(e)


def ingest(spark: SparkSession, paths: list[str], path: str, limit: int = 900, overlap: int = 120, embed: Callable[[Column], Column] | None = None) -> dict:
    """Chunks of the files into the index: total_chunks, per_source, files. No index is written for no chunks."""
    chunks = load_paths(spark, paths, limit, overlap)
    total = build(chunks, path, None, embed)
    found = per_source(load(spark, path).chunks).collect() if total else []
    return {"total_chunks": total, "per_source": {r.source: r.n for r in found}, "files": [str(p) for p in paths]}


def per_source(chunks: DataFrame) -> DataFrame:
    """source, n: chunks of each source."""
    return chunks.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


def open_version(spark: SparkSession, path: str) -> Version:
    """What the newest version states."""
    return table(spark, path).version()
