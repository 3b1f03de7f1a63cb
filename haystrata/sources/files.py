"""Text files, rule documents and the chunk index as tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from haystrata.config import Settings
from haystrata.sources import corpus

ALLOWED = corpus.ALLOWED
READ = "path string, file_name string, extension string, text string, pages int, error string"


def _pdf(content: bytes) -> tuple[str, int]:
    from io import BytesIO

    from pypdf import PdfReader  # optional

    reader = PdfReader(BytesIO(content))
    if reader.is_encrypted:
        raise ValueError("암호화된 PDF는 지원하지 않습니다. 암호를 해제한 사본으로 다시 시도하세요.")
    return "\n".join(p.extract_text() or "" for p in reader.pages), len(reader.pages)


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for path, content, problem in zip(*(batch.column(c).to_pylist() for c in ("path", "content", "problem")), strict=True):
            name = path.rsplit("/", 1)[-1]
            ext = "." + name.rsplit(".", 1)[-1].lower() if "." in name else ""
            row = {"path": path, "file_name": name, "extension": ext, "text": None, "pages": None, "error": problem}
            if problem is None:
                try:
                    if ext == ".pdf":
                        row["text"], row["pages"] = _pdf(content)
                    else:
                        try:
                            row["text"] = content.decode("utf-8")
                        except UnicodeDecodeError:
                            row["text"] = content.decode("cp949")
                        row["text"] = row["text"].replace("\r\n", "\n").replace("\r", "\n")
                except ImportError:
                    row["error"] = "PDF를 읽을 라이브러리가 없습니다."
                except ValueError as e:
                    row["error"] = f"파일을 읽는 중 오류가 발생했습니다: {e}" if ext != ".pdf" else str(e)
                if row["text"] is not None and not row["text"].strip():
                    row |= {"text": None, "error": "파일에서 텍스트를 추출하지 못했습니다. 스캔 이미지 PDF 등 텍스트 레이어가 없는 파일은 지원하지 않습니다."}
            out.append(row)
        yield pa.RecordBatch.from_pylist(out, pa.schema([("path", pa.string()), ("file_name", pa.string()), ("extension", pa.string()), ("text", pa.string()), ("pages", pa.int32()), ("error", pa.string())]))


def read_files(spark: SparkSession, path: str | list[str], settings: Settings | None = None) -> DataFrame:
    """A row per file: path, file_name, extension, text (cut at the limit), pages, total_chars, truncated, error. A file that cannot be used has an error and no text."""
    s = settings or Settings()
    rows = spark.read.format("binaryFile").load(path)
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    problem = (
        F.when(~suffix.isin(*ALLOWED), F.concat(F.lit("지원하지 않는 파일 형식입니다("), F.when(suffix == "", "확장자 없음").otherwise(F.concat(F.lit("."), suffix)), F.lit("). 지원: .md, .pdf, .txt")))
        .when(F.col("length") > s.max_file_bytes, F.concat(F.lit("파일이 너무 큽니다("), F.col("length").cast("string"), F.lit(f" bytes, 상한 {s.max_file_bytes}).")))
    )
    kept = rows.select("path", problem.alias("problem"), F.when(problem.isNull(), F.col("content")).alias("content"))
    return truncated(kept.mapInArrow(_decode, READ), s.max_text_chars)


def truncated(files: DataFrame, limit: int) -> DataFrame:
    """Cuts the text at ``limit`` characters and says so."""
    n = F.char_length("text")
    return files.withColumn("total_chars", n).withColumn("truncated", F.coalesce(n > limit, F.lit(False))).withColumn("text", F.substring("text", 1, limit))


def choose_input(text: Column, file_path: Column) -> Column:
    """Which of the two inputs holds: 'text', 'file', or 'both' (not allowed)."""
    has = lambda c: F.coalesce(c.rlike(r"[^\s\x1c-\x1f\x85\p{Z}]"), F.lit(False))
    return F.when(has(text) & has(file_path), "both").when(has(file_path), "file").otherwise("text")


def corpus_fingerprint(spark: SparkSession, path: str) -> str:
    """A digest of names, sizes and times of the usable files under a folder."""
    return corpus.digest(corpus.nodes(corpus.marked(corpus.files(spark, path))))


def rule_documents(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """path, file_name, text, doc_seq ascending in order of name; a file that cannot be read fails the whole load.

    Names are put in order by ranges; texts stay where they are read.
    """
    files = read_files(spark, path, Settings(max_text_chars=2**31 - 1))
    files = files.filter(F.substring("extension", 2, 9).isin(*ALLOWED))
    text = F.when(F.col("error").isNotNull(), F.raise_error(F.concat(F.col("file_name"), F.lit(": "), F.col("error")))).otherwise(F.col("text"))
    names = ordered(spark.read.format("binaryFile").load(path).select(F.col("path").alias("at")), "at")
    return files.join(names, F.col("path") == F.col("at")).select("path", "file_name", text.alias("text"), "doc_seq")


def ordered(paths: DataFrame, column: str) -> DataFrame:
    """Adds doc_seq: numbers that ascend with the file's name, then its path; not without gaps."""
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    rows = paths.withColumn("_name", corpus.file_name(F.col(column))).repartitionByRange("_name", column).sortWithinPartitions("_name", column)
    return rows.withColumn("doc_seq", F.spark_partition_id().cast("long") * F.lit(1 << 24) + inside).drop("_name")
