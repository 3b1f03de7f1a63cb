"""Index commands, each with one JSON line as its answer.

    spark-submit haystrata/ingest.py load  --index FOLDER FILE...   files or patterns, in place of what the index holds
    spark-submit haystrata/ingest.py sync  --index FOLDER CORPUS    a folder: new, changed and deleted files
    spark-submit haystrata/ingest.py find  --index FOLDER QUESTION  best chunks by words
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from haystrata.config import Settings
from haystrata.sources import index, shared


def matching(spark: SparkSession, pattern: str) -> list[str]:
    """What a pattern matches, in order of name; the pattern itself if that is nothing, so that reading it fails."""
    fs, at = shared.hadoop(spark, pattern)
    return sorted(x.getPath().toString() for x in fs.globStatus(at) or []) or [pattern]


def load(spark: SparkSession, args: argparse.Namespace) -> dict:
    paths = [p for pattern in args.what for p in matching(spark, pattern)]
    return index.ingest(spark, paths, args.index, args.limit, args.overlap)


def sync(spark: SparkSession, args: argparse.Namespace) -> dict:
    done = index.update(spark, args.what[0], args.index, None, args.limit, args.overlap)
    return {"total_chunks": done.pop("chunks"), "files": done}


def find(spark: SparkSession, args: argparse.Namespace) -> dict:
    asked = spark.createDataFrame([(0, " ".join(args.what), None)], "query_id int, query string, query_embedding array<float>")
    found = index.load(spark, args.index).search(asked, Settings.of(spark)).orderBy("position").collect()
    return {"matches": [{k: r[k] for k in ("source", "article", "article_title", "chunk_id", "snippet", "score")} for r in found]}


COMMANDS = {f.__name__: f for f in (load, sync, find)}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """0 if the command did something; 1, with ``error`` in the answer or no chunks, if not."""
    words = argparse.ArgumentParser(prog="ingest")
    words.add_argument("command", choices=COMMANDS)
    words.add_argument("--index", required=True, metavar="FOLDER")
    words.add_argument("--limit", type=int, default=Settings.max_chars)
    words.add_argument("--overlap", type=int, default=Settings.overlap)
    words.add_argument("what", nargs="+")
    args = words.parse_args(argv)
    try:
        answer = COMMANDS[args.command](spark or SparkSession.builder.getOrCreate(), args)
    except (*index.ERRORS, RuntimeError) as e:
        answer = {"error": str(e).split("\n", 1)[0]}
    print(json.dumps(answer, ensure_ascii=False), file=sys.stderr if "error" in answer else sys.stdout)
    return int("error" in answer or not answer.get("total_chunks", 1))


if __name__ == "__main__":
    raise SystemExit(main())
