"""Token counts with a digest cache (operator 13).

1. Every text gets the SHA-256 digest of its normalised content. Normalisation makes a null text an
   empty one and changes nothing else, because any other change could change the count.
2. Distinct digests that the cache has no count for, under this tokenizer's version digest, are the
   misses. The version digest covers the tokenizer file, its kind and the library's version.
3. One text of each miss is encoded and (digest, count) is appended to the cache; then every row takes
   its count from the cache by its digest. A text with a million copies is encoded once.

The cache is a folder ``<cache>/tokenizer=<version>/run=<name>`` of Parquet runs that never change. A
run counts from the moment its ``_SUCCESS`` is there, so a failed or lost writer leaves nothing behind
that is read; two writers may add the same digest, which reading takes once. ``compact`` rewrites runs as one.

Texts: null and empty ones have no tokens (unless the tokenizer says otherwise); whole texts are encoded,
a very long one by itself. Rows that repeat an id, or have none, are rows like any other. Special tokens'
strings inside a text are handled as the library does by default; none is added. Only the id
and text columns are read, so other columns can have any name.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from haystrata.llm.scratch import free, materialise

LIMIT = 1024
#: Bytes of text that one call of the library gets; a longer text has a call of its own.
BATCH_BYTES = 1 << 18
#: Misses are broadcast up to these bytes (a digest counts 64); beyond, texts are dealt by digest.
BROADCAST_BYTES = 8 << 20
#: A tokenizer file goes to all tasks; a larger one is refused.
MAX_FILE_BYTES = 64 << 20
_RUN = "digest binary, n_tokens long"


@dataclass(frozen=True)
class Tokenizer:
    """A tokenizer file: its kind, content and version digest."""

    kind: str
    content: bytes
    version: str

    @classmethod
    def of(cls, path: str) -> Tokenizer:
        """``.json`` is read by tokenizers, ``.model`` by sentencepiece."""
        kind = {".json": "tokenizers", ".model": "sentencepiece"}.get(os.path.splitext(path)[1])
        if kind is None:
            raise ValueError(f"no library for the tokenizer file {path}")
        if os.path.getsize(path) > MAX_FILE_BYTES:
            raise ValueError(f"{path} has more than {MAX_FILE_BYTES} bytes")
        with open(path, "rb") as f:
            content = f.read()
        library = __import__(kind).__version__
        return cls(kind, content, hashlib.sha256(f"{kind} {library} ".encode() + content).hexdigest())

    def counter(self):
        """A function of a list of texts that gives their numbers of tokens."""
        if self.kind == "sentencepiece":
            from sentencepiece import SentencePieceProcessor

            model = SentencePieceProcessor(model_proto=self.content)
            return lambda texts: [len(x) for x in model.encode(texts, num_threads=1, add_bos=False, add_eos=False)]
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for each core
        from tokenizers import Tokenizer as Library

        model = Library.from_buffer(self.content)
        model.no_truncation()
        model.no_padding()
        return lambda texts: [len(x) for x in model.encode_batch_fast(texts, add_special_tokens=False)]


def normalised(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(normalised(text), 256))


def _runs(spark: SparkSession, cache: str, version: str) -> list[str]:
    """Committed runs of a tokenizer."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    top = path(f"{cache}/tokenizer={version}")
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(top):
        return []
    found = [x.getPath() for x in fs.listStatus(top)]
    return sorted(x.toString() for x in found if x.getName().startswith("run=") and fs.exists(path(x, "_SUCCESS")))


def stored(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """digest, n_tokens: every digest once, of all committed runs."""
    runs = _runs(spark, cache, version)
    if not runs:
        return spark.createDataFrame([], _RUN)
    rows = spark.read.schema(_RUN).parquet(*runs)
    return rows if len(runs) == 1 else rows.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def _append(counts: DataFrame, cache: str, version: str) -> str:
    run = f"{cache}/tokenizer={version}/run={uuid.uuid4().hex}"
    counts.write.option("compression", "zstd").parquet(run)
    return run


def compact(spark: SparkSession, cache: str, version: str) -> int:
    """All committed runs as one; returns how many there were. Not while another job reads this cache."""
    runs = _runs(spark, cache, version)
    if len(runs) > 1:
        _append(stored(spark, cache, version), cache, version)
        for run in runs:
            at = spark._jvm.org.apache.hadoop.fs.Path(run)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return len(runs)


def encoded(texts: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """texts: digest, text. digest, n_tokens."""
    shipped = texts.sparkSession.sparkContext.broadcast(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = shipped.value.counter()
        for batch in batches:
            out, held, n = [], [], 0
            for text in batch.column("text"):
                held.append(text.as_py())
                n += len(held[-1])
                if n >= BATCH_BYTES:
                    out += count(held)
                    held, n = [], 0
            if held:
                out += count(held)
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(out, pa.int64())], ["digest", "n_tokens"])

    return texts.mapInArrow(run, _RUN)


def count_tokens(docs: DataFrame, tokenizer: str, cache: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id_col``, n_bytes (UTF-8), n_tokens, over_limit. ``tokenizer``: path of a file; ``cache``: a shared folder."""
    spark, model = docs.sparkSession, Tokenizer.of(tokenizer)
    rows = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("text")).withColumn("digest", digest(F.col("text")))
    marks = materialise(rows.select("id", "digest", F.octet_length("text").cast("long").alias("n_bytes")), "digests")
    known = bool(_runs(spark, cache, model.version))
    texts = rows.select("digest", "text")
    if not known:
        _append(encoded(texts.dropDuplicates(["digest"]), model), cache, model.version)
    else:
        misses = materialise(marks.select("digest").distinct().join(stored(spark, cache, model.version), "digest", "left_anti"), "misses")
        n = misses.count()
        if n * 64 <= BROADCAST_BYTES:
            texts = texts.join(F.broadcast(misses), "digest", "left_semi").dropDuplicates(["digest"])
        else:
            texts = texts.dropDuplicates(["digest"]).join(misses, "digest", "left_semi")
        if n:
            _append(encoded(texts, model), cache, model.version)
        free(misses)
    found = marks.join(stored(spark, cache, model.version), "digest", "left")
    return found.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
