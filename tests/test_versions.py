"""Versions of an index: touched buckets, several writers, crashes, files that change."""

from __future__ import annotations

import threading

import pytest
from pyspark.sql import functions as F

from haystrata.sources import corpus, files, index, shared
from haystrata.sources.versioned import VersionedTable

ROWS = "chunk_id string, text string, chunk_seq long"


def rows(spark, pairs):
    return spark.createDataFrame([(k, t, n) for n, (k, t) in enumerate(pairs)], ROWS)


def held(table, version=None):
    return sorted((r.chunk_id, r.text) for r in table.read(version).collect())


def test_only_touched_buckets_are_written(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"))
    assert table.read() is None and table.version().number == 0
    one = table.replace(rows(spark, [(f"k{k}", "a") for k in range(200)]))
    assert one.rows == 200 and len(one.folders) == 16
    two = table.change(rows(spark, [("k3", "old"), ("k3", "new"), ("k500", "b")]))
    changed = {b for b in two.folders if one.folders.get(b) != two.folders[b]}
    assert two.rows == 201 and len(changed) <= 2 and len({two.folders[b] for b in changed}) == 1
    assert dict(held(table))["k3"] == "new" and dict(held(table, one))["k3"] == "a" and len(held(table, one)) == 200
    three = table.change(rows(spark, []), F.col("chunk_id") == "k7")
    assert three.rows == 200 and "k7" not in dict(held(table)) and sum(two.folders[b] != three.folders.get(b) for b in two.folders) == 1
    pinned = table.read(two)
    assert table.vacuum(keep=2) == 0 and table.version(two.number) == two  # the first write still holds untouched buckets
    assert pinned.count() == 201 and table.numbers() == [2, 3]
    table.replace(rows(spark, [("x", "y")]))
    assert table.vacuum() == 3 and held(table) == [("x", "y")]
    assert table.change(rows(spark, []), F.col("chunk_id") == "x").rows == 0 and held(table) == []
    assert table.change(rows(spark, [(None, "n"), (None, "n"), ("z", None)])).rows == 3


def test_a_crash_leaves_the_version_before(spark, tmp_path, monkeypatch):
    table = VersionedTable(spark, str(tmp_path / "t"))
    table.replace(rows(spark, [("a", "1"), ("b", "2")]))
    for step in ("_written", "_commit"):
        real = getattr(VersionedTable, step)

        def broken(self, *args, real=real, step=step):
            if step == "_written":
                real(self, *args)
            raise OSError("lost")

        monkeypatch.setattr(VersionedTable, step, broken)
        for change in (lambda: table.replace(rows(spark, [("c", "3")])), lambda: table.change(rows(spark, [("a", "9")]))):
            with pytest.raises(OSError, match="lost"):
                change()
        monkeypatch.setattr(VersionedTable, step, real)
        assert held(table) == [("a", "1"), ("b", "2")] and table.numbers() == [1]
    assert table.change(rows(spark, [("a", "9")])).rows == 2 and table.vacuum() > 0 and held(table) == [("a", "9"), ("b", "2")]


def test_writers_at_once(spark, tmp_path):
    table, errors = VersionedTable(spark, str(tmp_path / "t"), buckets=2), []
    table.replace(rows(spark, [("a", "1")]))

    def write(k):
        try:
            VersionedTable(spark, table.path, buckets=2).change(rows(spark, [(f"w{k}", "x")]))
        except Exception as e:
            errors.append(e)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not errors and held(table) == [("a", "1"), *((f"w{k}", "x") for k in range(4))] and table.numbers() == [1, 2, 3, 4, 5]


def test_only_changed_files_are_read(spark, tmp_path, monkeypatch):
    folder, path = tmp_path / "corpus", str(tmp_path / "index")
    folder.mkdir()
    for k in range(12):
        (folder / f"{k:02d}_rule{k}.txt").write_text(f"제{k + 1}조(목적) 규정 {k}을 정한다.", "utf-8")
    read = []
    real = files.read_files
    monkeypatch.setattr(files, "read_files", lambda s, p, *a: read.append(p if isinstance(p, list) else [p]) or real(s, p, *a))
    embed = lambda text: F.array(F.length(text).cast("float"), F.lit(1.0).cast("float"))
    assert index.update(spark, str(folder), path, embed) == {"new": 12, "changed": 0, "gone": 0, "chunks": 12}
    assert read == [[str(folder)]]
    assert index.update(spark, str(folder), path, embed)["new"] == 0 and len(read) == 1
    first = index.load(spark, path)
    (folder / "03_rule3.txt").write_text("제4조(목적) 새 글을 정한다.\n제5조(범위) 둘째.", "utf-8")
    (folder / "07_rule7.txt").unlink()
    (folder / "00_before.txt").write_text("제1조(목적) 앞에 온다.", "utf-8")
    assert index.update(spark, str(folder), path, embed) == {"new": 1, "changed": 1, "gone": 1, "chunks": 13}
    assert sorted(p.rsplit("/", 1)[1] for p in read[1]) == ["00_before.txt", "03_rule3.txt"]
    assert first.count() == 12  # the reader keeps its version
    # the same chunks, in the same order, as a build from nothing
    assert index.update(spark, str(folder), str(tmp_path / "new"), embed)["chunks"] == 13
    order = lambda p: [(r.file_name, r.chunk_id, r.text, r.embedding) for r in index.load(spark, p).chunks.orderBy("doc_seq", "chunk_seq").collect()]
    assert order(path) == order(str(tmp_path / "new")) and order(path)[0][0] == "00_before.txt"
    asked = spark.createDataFrame([(1, "새 글", [9.0, 1.0]), (2, "둘째", None)], "query_id int, query string, query_embedding array<float>")
    find = lambda p: sorted(map(str, index.load(spark, p).search(asked).collect()))
    assert find(path) == find(str(tmp_path / "new"))
    assert len(shared.listed(spark, f"{path}/search")) == 2 and find(path) == find(path) and len(shared.listed(spark, f"{path}/search")) == 2
    for f in folder.iterdir():
        f.unlink()
    assert index.ensure_ready(spark, str(folder), path)[1] == index.NO_CORPUS


def test_digest_and_changes(spark):
    import datetime

    at = datetime.datetime(2026, 1, 1)
    listing = lambda ks, size=5: corpus.marked(spark.createDataFrame([(f"/c/{k}.txt", f"{k}.txt", size, at) for k in ks], corpus.FILES))
    a, b = listing(range(50)), listing(reversed(range(50)))
    assert corpus.digest(corpus.nodes(a)) == corpus.digest(corpus.nodes(b.repartition(7)))
    assert corpus.changes(a, b, corpus.nodes(a), corpus.nodes(b)).count() == 0
    c = listing(range(1, 51)).unionByName(listing([0], 6))
    assert corpus.digest(corpus.nodes(c)) != corpus.digest(corpus.nodes(a))
    assert sorted(map(tuple, corpus.changes(a, c, corpus.nodes(a), corpus.nodes(c)).collect())) == [("/c/0.txt", "changed"), ("/c/50.txt", "new")]
    none = listing([])
    assert corpus.nodes(none) == {} and corpus.changes(none, a, {}, corpus.nodes(a)).count() == 50


def test_embeddings_are_checked(spark):
    chunks = spark.createDataFrame([("a", "x"), ("b", "yy")], "chunk_id string, text string")
    assert index.embedded(chunks, lambda t: F.array(F.lit(1.0))).count() == 2
    for bad in (lambda t: F.array_repeat(F.lit(1.0), F.length(t)), lambda t: F.when(t == "x", F.array(F.lit(1.0)))):
        with pytest.raises(Exception, match="components"):
            index.embedded(chunks, bad).collect()
    assert index.embedded(chunks.limit(0), lambda t: F.array(F.lit(1.0))).collect() == []
