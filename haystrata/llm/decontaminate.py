"""Benchmark decontamination with an FM-index per training shard (operator 1).

Benchmark items become phrases: every run of ``window`` words, or the whole item if it has
fewer. A shard is the next ``SHARD_WORDS`` words of a task's documents. Words outside the
phrases' vocabulary can be in no occurrence, so only runs of vocabulary words of at least the
shortest phrase's length enter the shard's index, with separators between runs: exact, and
small. All phrases are searched backwards at once through wavelet-tree ranks, occurrences are
located by sampled suffix positions, and their spans are merged per document.

The benchmark is read in blocks of about ``BLOCK_WORDS`` words (one item at least). Blocks are broadcast,
``PASS_BLOCKS`` at a time, and the documents stream through one Python stage that hashes words once and
loads one block after the other for each shard; a larger benchmark takes further passes, each over the
written rows of the one before. So neither the corpus nor the benchmark sets what an executor
holds. Nothing is shuffled.

Null or empty texts have no words, hit nothing and, as items, occur nowhere. Repeated rows
give repeated results; items that repeat an id count once. A null item id is written as ''.
Words are compared by 64-bit hashes: a word of the corpus is taken for another one of the benchmark with
a chance of vocabulary / 2**64, and a hit needs a whole phrase of such words.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haystrata.llm.fm_index import FMIndex
from haystrata.llm.scratch import free, materialise
from haystrata.llm.tokens import ALNUM, slices, words

WINDOW = 10
BLOCK_WORDS = 400_000
#: Blocks broadcast at once, of some 100 MB each at most unless an item is longer.
PASS_BLOCKS = 8
SHARD_WORDS = 1 << 21


class PhraseBlock:
    """Distinct phrases of some items and the items that each belongs to."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        found: dict[tuple, set[int]] = {}
        self.item_ids = sorted({i for i, _ in items})
        number = {x: k for k, x in enumerate(self.item_ids)}
        vocabulary: dict[int, int] = {}
        w = words(pa.array([t for _, t in items], pa.large_string()), ALNUM, lower=True)
        for k, (item, _) in enumerate(items):
            own = w.hashes[w.first[k] : w.first[k + 1]].tolist()
            symbols = tuple(vocabulary.setdefault(h, len(vocabulary)) for h in own)
            for at in range(max(1, len(symbols) - window + 1)) if symbols else ():
                found.setdefault(symbols[at : at + window], set()).add(number[item])
        hashes = np.array(list(vocabulary), np.uint64)
        order = np.argsort(hashes)
        self.vocabulary = hashes[order]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        #: Symbols: 0 ends the text, 1 separates, words from 2.
        self.sigma = len(order) + 2
        self.lengths = np.array([len(p) for p in found], np.int64)
        self.phrases = np.zeros((len(found), window), np.int64)
        for k, p in enumerate(found):
            self.phrases[k, : len(p)] = place[list(p)] + 2
        #: Items of phrase p: ``flat[bounds[p]:bounds[p + 1]]``.
        self.flat = np.array(list(chain.from_iterable(map(sorted, found.values()))), np.int64)
        self.bounds = np.cumsum([0, *map(len, found.values())])
        self.shortest = int(self.lengths.min()) if len(found) else 0

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        """2 and up for vocabulary words, 0 for all others."""
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.int64)
        at = np.searchsorted(self.vocabulary, hashes)
        at[at == len(self.vocabulary)] = 0
        return np.where(self.vocabulary[at] == hashes, at + 2, 0)


def phrase_blocks(benchmark: DataFrame, id_col: str, text_col: str, window: int, block_words: int = BLOCK_WORDS) -> Iterator[PhraseBlock]:
    """Streams the items to the driver; holds one block at a time."""
    held, n = [], 0
    rows = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    for row in rows.toLocalIterator():
        held.append((row["i"], row["t"]))
        n += len(row["t"]) // 2 + 1
        if n >= block_words:
            yield PhraseBlock(held, window)
            held, n = [], 0
    if held:
        yield PhraseBlock(held, window)


class Shard:
    """Documents of one index: their vocabulary words in runs, and where each came from."""

    def __init__(self, block: PhraseBlock):
        self.block, self.n_words, self.symbols, self.places, self.docs, self.size = block, [], [], [], [], 0

    def add(self, first: np.ndarray, hashes: np.ndarray) -> None:
        """Documents d with the words ``hashes[first[d]:first[d + 1]]``."""
        self.n_words.append(np.diff(first))
        s = self.block.symbols(hashes)
        inside = s > 0
        if inside.any():
            # runs of vocabulary words, broken at document bounds
            opens, shuts = inside.copy(), inside.copy()
            bounds = np.unique(first[1:-1])
            bounds = bounds[(bounds > 0) & (bounds < len(s))]
            opens[1:] &= ~inside[:-1]
            opens[bounds] = inside[bounds]
            shuts[:-1] &= ~inside[1:]
            shuts[bounds - 1] = inside[bounds - 1]
            a, b = np.flatnonzero(opens), np.flatnonzero(shuts) + 1
            long_ = b - a >= self.block.shortest
            a, b = a[long_], b[long_]
            sizes = b - a + 1  # one separator behind each run
            at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            place = np.repeat(a, sizes) + at
            last = at == np.repeat(sizes - 1, sizes)
            self.symbols.append(np.where(last, 1, s[np.minimum(place, len(s) - 1)]))
            self.places.append(place + self.size)
        self.size += len(s)

    def hits(self) -> tuple[list, dict[int, list[str]]]:
        """Merged (document, first, end) spans, item ids by document."""
        n_words = np.concatenate(self.n_words)
        block, symbols = self.block, np.concatenate(self.symbols) if self.symbols else np.zeros(0, np.int64)
        if not len(symbols) or not len(block.phrases):
            return [], {}
        first = np.r_[0, np.cumsum(n_words)]
        index = FMIndex(symbols, block.sigma)
        lo, hi = index.search(block.phrases, block.lengths)
        n = hi - lo
        phrase = np.repeat(np.arange(len(n)), n)
        rows = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        at = np.concatenate(self.places)[index.locate(rows)]
        edge = np.zeros(self.size + 1, np.int64)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + block.lengths[phrase], -1)
        covered = np.cumsum(edge)[:-1] > 0
        opens, shuts = covered.copy(), covered.copy()
        bounds = np.unique(first[1:-1])
        bounds = bounds[(bounds > 0) & (bounds < self.size)]
        opens[1:] &= ~covered[:-1]
        opens[bounds] = covered[bounds]
        shuts[:-1] &= ~covered[1:]
        shuts[bounds - 1] = covered[bounds - 1]
        a, b = np.flatnonzero(opens), np.flatnonzero(shuts) + 1
        doc = np.searchsorted(first, a, "right") - 1
        spans = list(zip(doc.tolist(), (a - first[doc]).tolist(), (b - first[doc]).tolist(), strict=True))
        pairs = np.unique((np.searchsorted(first, at, "right") - 1) * len(n) + phrase)
        items: dict[int, set[int]] = {}
        for d, p in zip((pairs // len(n)).tolist(), (pairs % len(n)).tolist(), strict=True):
            items.setdefault(d, set()).update(block.flat[block.bounds[p] : block.bounds[p + 1]].tolist())
        return spans, {d: sorted(block.item_ids[i] for i in x) for d, x in items.items()}


def _replaced(table: pa.Table, name: str, values) -> pa.Table:
    """The column's new values in its own field: batches of a task must agree to the names inside lists, so every shard keeps what came in."""
    at = table.schema.get_field_index(name)
    return table.set_column(at, table.schema.field(at), pa.array(values, table.schema.field(at).type))


def _merged(spans: list[tuple[int, int]]) -> list[dict]:
    out: list[dict] = []
    for a, b in sorted(spans):
        if out and a <= out[-1]["end"]:
            out[-1]["end"] = max(b, out[-1]["end"])
        else:
            out.append({"first": a, "end": b})
    return out


def _pass(blocks: list, text: str, drop: bool, shard_words: int):
    """The search of some blocks; other columns are carried along, and the text unless it is to be dropped."""

    def load(block) -> PhraseBlock:
        # a worker keeps the value of a broadcast that it asks for; of many only one at a time may be held
        return block.value if len(blocks) == 1 else block.load_from_path(block._path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, hashed, size = [], [], 0

        def flush():
            by_doc: dict[int, list] = {}
            of_doc: dict[int, set] = {}
            for block in blocks:
                shard = Shard(load(block))
                for first, hashes in hashed:
                    shard.add(first, hashes)
                spans, items = shard.hits()
                for d, a, b in spans:
                    by_doc.setdefault(d, []).append((a, b))
                for d, own in items.items():
                    of_doc.setdefault(d, set()).update(own)
            table = pa.Table.from_batches(held)
            if by_doc:
                spans, items = table.column("spans").to_pylist(), table.column("items").to_pylist()
                for d, found in by_doc.items():
                    spans[d] = _merged([(x["first"], x["end"]) for x in spans[d]] + found)
                    items[d] = sorted({*items[d], *of_doc.get(d, ())})
                table = _replaced(_replaced(table, "spans", spans), "items", items)
            n_words = np.concatenate([np.diff(first) for first, _ in hashed])
            table = _replaced(table, "n_words", n_words)
            return (table.drop_columns([text]) if drop else table).to_batches()

        for piece in slices(batches, text):
            held.append(piece)
            w = words(piece.column(text), ALNUM, lower=True)
            hashed.append((w.first, w.hashes))
            size += len(w)
            if size >= shard_words:
                yield from flush()
                held, hashed, size = [], [], 0
        if held:
            yield from flush()

    return run


def _search(rows: DataFrame, text: str, keep_text: bool, blocks: Iterator[PhraseBlock], window: int, shard_words: int) -> DataFrame:
    """rows: n_words, spans, items and other columns of unambiguous names."""
    spark: SparkSession = rows.sparkSession
    ahead = next(blocks, None) or PhraseBlock([], window)
    before = None
    while True:
        held = [spark.sparkContext.broadcast(b) for b in chain([ahead], islice(blocks, PASS_BLOCKS - 1))]
        ahead = next(blocks, None)
        drop = ahead is None and not keep_text
        rows = rows.mapInArrow(_pass(held, text, drop, shard_words), rows.drop(text).schema if drop else rows.schema)
        if ahead is None:
            return rows
        rows = materialise(rows, "searched")
        for block in held:
            block.unpersist()
        if before is not None:
            free(before)
        before = rows


def _nothing() -> tuple:
    """Before any search: no words, no spans, no items."""
    return (
        F.lit(0).cast("long").alias("n_words"),
        F.expr("cast(array() as array<struct<first:bigint,end:bigint>>)").alias("spans"),
        F.expr("cast(array() as array<string>)").alias("items"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """One row per document: ``id_col``, n_words, spans (word first to end, merged), items (ids, sorted as strings)."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *_nothing())
    found = _search(rows, "text", False, phrase_blocks(benchmark, item_id_col, item_text_col, window, block_words), window, shard_words)
    return found.withColumnRenamed("id", id_col)


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The documents, all columns, without those in which a phrase occurs: each row is judged by its own text,
    so rows that repeat an id, or have none, stay or go by it. Other columns may have any name. Nothing is joined or shuffled."""
    rows = docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))
    rows = rows.select("*", *_nothing())
    found = _search(rows, f"c{docs.columns.index(text_col)}", True, phrase_blocks(benchmark, item_id_col, item_text_col, window, block_words), window, shard_words)
    return found.filter(F.size("spans") == 0).drop("n_words", "spans", "items").toDF(*docs.columns)
