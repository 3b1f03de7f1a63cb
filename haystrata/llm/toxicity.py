"""Toxicity by class-conditional Kneser-Ney models (operator 4).

The models: each class has its own distribution of expressions (words), an order-two Kneser-Ney model
whose history is the class. With c(k, w) documents of class k that hold the word w and N(k) their sum,
p(w | k) = (c(k, w) - D) / N(k) + mass(k) q(w): D is the modified Kneser-Ney discount of the class for
counts 1, 2 and 3 or more, from its counts of counts, mass(k) what the discounts of the class set free,
and q(w) the shared back-off, the number of distinct words that precede w in texts of either class,
discounted likewise. So a rare expression has the probability that both classes share.

The score: the two models' log-likelihoods of a text are compared on the fiftieth of its words (one at
least) that most tell the classes apart towards label 1, and on all of them, both normalised by length;
with the log of the length they are calibrated by logistic regression on labelled texts of remainder 3,
which the counts have not seen (at most ``CALIBRATION_DOCS``, those with the smallest hash of their id).

Counting: a task of labelled texts keeps document counts of both classes by word, and distinct pairs of
neighbouring words, as sorted runs of 64-bit hashes; they are dealt by hash ranges, whose number grows
with the labelled text, and merged into one written table of all words. No word or pair is left out.

Scoring: a word's figures are asked for once for each group of documents (about ``GROUP_BYTES`` of text
by hash of id and text): groups' distinct words are dealt to the table's ranges, the answers to the groups,
where the texts of the group follow them. Nothing of the table is broadcast or collected but its totals.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``, lower-cased. Null and empty texts have no words and
get what the regression gives for none. Repeated rows get equal scores; of repeated labels the largest
counts; a null label is none; a null id is never labelled and not held out. With no labelled row of one
class every score is the share of label 1. Only the id and text columns are read, and other columns may
have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haystrata.llm.packing import pack, pack_sorted, unpack, unpack_sorted
from haystrata.llm.quality import labelled_sample, remainder
from haystrata.llm.scratch import free, materialise
from haystrata.llm.tokens import ALNUM, Words, mix, slices, words

#: Of a text's words the part that the first comparison is made on.
TELLING = 50
#: Bytes of labelled text to a hash range, bytes of text to a group, parts in which texts are dealt to their groups.
RANGE_BYTES, GROUP_BYTES, BATCHES = 1 << 22, 1 << 25, 2
CALIBRATION_DOCS = 6000
THRESHOLD = 0.3
_RUN = 1 << 19
BLOBS = "part int, kind int, owner long, blobs array<binary>"


def _split(texts: pa.Array) -> Words:
    return words(texts, ALNUM, lower=True)


def _cuts(keys: np.ndarray, bits: int) -> Iterator[tuple[int, int, int]]:
    """(range, first, end) of ascending keys."""
    part = (keys >> np.uint64(64 - bits)).astype(np.int64)
    at = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True]) if len(part) else np.zeros(1, np.int64)
    return zip(part[at[:-1]].tolist(), at[:-1].tolist(), at[1:].tolist(), strict=True)


def _batch(rows: list[tuple[int, int, int, list[bytes]]]) -> pa.RecordBatch:
    part, kind, owner, blobs = zip(*rows, strict=True) if rows else ((),) * 4
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(kind, pa.int32()), pa.array(owner, pa.int64()), pa.array(blobs, pa.list_(pa.binary()))], ["part", "kind", "owner", "blobs"])


def _rows(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, Iterator[tuple[int, int, list]]]]:
    """(key, its rows of kind, owner, blobs); rows come in order of the key."""
    rows = ((k, kind, owner, blobs) for batch in batches for k, kind, owner, blobs in zip(*(batch.column(c).to_pylist() for c in (key, "kind", "owner", "blobs")), strict=True))
    for k, own in groupby(rows, key=lambda r: r[0]):
        yield k, ((kind, owner, blobs) for _, kind, owner, blobs in own)


def _distinct(keys: np.ndarray, values: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Ascending distinct keys, with the sums of their values."""
    if values is None:
        return np.unique(keys), None
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[starts], np.add.reduceat(values, starts) if len(starts) else values


def document_words(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(document, word hash) of each document's distinct words."""
    doc = w.doc_of
    order = np.lexsort((w.hashes, doc))
    doc, h = doc[order], w.hashes[order]
    fresh = np.r_[True, (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])] if len(h) else np.zeros(0, bool)
    return doc[fresh], h[fresh]


def pair_keys(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(word hash, hash of the word before it and itself); a document's first word follows nothing."""
    before = np.zeros(len(w), np.uint64)
    before[1:] = w.hashes[:-1]
    heads = w.first[:-1]
    before[heads[heads < len(w)]] = 0
    return w.hashes, mix((before ^ np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9) + w.hashes)


def _counted(bits: int):
    """Sorted runs of labelled texts: words with the documents of each class (kind 0), distinct pairs by word (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, pairs, n = [], [], [], 0

        def flush() -> pa.RecordBatch:
            w, c = _distinct(np.concatenate(keys), np.concatenate(counts))
            out = [(p, 0, 0, [pack_sorted(w[a:b]), pack(c[a:b, 0].astype(np.uint32)), pack(c[a:b, 1].astype(np.uint32))]) for p, a, b in _cuts(w, bits)]
            p, h = (np.concatenate(x) for x in zip(*pairs, strict=True))
            order = np.lexsort((h, p))
            p, h = p[order], h[order]
            fresh = np.r_[True, (p[1:] != p[:-1]) | (h[1:] != h[:-1])]
            p, h = p[fresh], h[fresh]
            out += [(r, 1, 0, [pack_sorted(p[a:b]), pack(h[a:b])]) for r, a, b in _cuts(p, bits)]
            for held in (keys, counts, pairs):
                held.clear()
            return _batch(out)

        for piece in slices(batches, "text"):
            w = _split(piece.column("text"))
            if not len(w):
                continue
            label = piece.column("label").to_numpy(zero_copy_only=False) > 0
            doc, h = document_words(w)
            keys.append(h)
            counts.append(np.stack([~label[doc], label[doc]], axis=1).astype(np.int64))
            pairs.append(pair_keys(w))
            n += len(w)
            if n >= _RUN:
                yield flush()
                n = 0
        if n:
            yield flush()

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each range its words with the counts of both classes and continuations, and the totals that discounts need."""
    for part, rows in _rows(batches, "part"):
        keys, counts, pairs, n, least = [], [], [], 0, 2 * _RUN
        for kind, _, blobs in rows:
            if kind == 0:
                keys.append(unpack_sorted(blobs[0]))
                counts.append(np.stack([unpack(blobs[1]), unpack(blobs[2])], axis=1).astype(np.int64))
            else:
                pairs.append((unpack_sorted(blobs[0]), unpack(blobs[1])))
                n += len(pairs[-1][0])
                if n >= least:
                    pairs = [_distinct_pairs(pairs)]
                    n = len(pairs[0][0])
                    least = max(least, 2 * n)
        w, c = _distinct(np.concatenate(keys), np.concatenate(counts))
        before = np.bincount(np.searchsorted(w, _distinct_pairs(pairs)[0]), minlength=len(w))
        figures = np.stack([c[:, 0], c[:, 1], before], axis=1)
        totals = [len(w), *figures.sum(axis=0).tolist(), *(int((figures[:, j] == m).sum()) for j in range(3) for m in (1, 2, 3, 4)), *(int((figures[:, j] >= 3).sum()) for j in range(3))]
        batch = _batch([(part, 0, -1, [pack_sorted(w), *(pack(figures[:, j].astype(np.uint32)) for j in range(3))])])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([totals], pa.list_(pa.int64()))], [*batch.schema.names, "totals"])


def _distinct_pairs(pairs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    p, h = (np.concatenate(x) for x in zip(*pairs, strict=True))
    order = np.lexsort((h, p))
    p, h = p[order], h[order]
    fresh = np.r_[True, (p[1:] != p[:-1]) | (h[1:] != h[:-1])]
    return p[fresh], h[fresh]


N_TOTALS = 1 + 3 + 12 + 3


class KneserNey:
    """Discounts and masses of both classes and of the shared back-off, from the totals of all ranges."""

    def __init__(self, totals: list[int]):
        self.n_words, self.sums = totals[0], np.array(totals[1:4], float)
        of = np.array(totals[4:16], float).reshape(3, 4)
        many = totals[16:19]
        self.discounts, self.mass = np.zeros((3, 4)), np.zeros(3)
        for j in range(3):
            n1, n2, n3, n4 = of[j]
            y = n1 / (n1 + 2 * n2) if n1 else 0.5
            for c, (a, b) in enumerate(((n1, n2), (n2, n3), (n3, n4)), 1):
                self.discounts[j, c] = np.clip(c - (c + 1) * y * b / a if a else c * y, 0.1 * c, 0.95 * c)
            freed = self.discounts[j, 1] * n1 + self.discounts[j, 2] * n2 + self.discounts[j, 3] * many[j]
            self.mass[j] = freed / self.sums[j] if self.sums[j] else 1.0
        self.ready = bool(self.sums[0] and self.sums[1])

    def kept(self, j: int, counts: np.ndarray) -> np.ndarray:
        return (counts - self.discounts[j][np.minimum(counts, 3).astype(np.int64)]) / self.sums[j]

    def ratios(self, figures: np.ndarray) -> np.ndarray:
        """log p(w | toxic) - log p(w | ordinary) for rows of both classes' counts and continuations; zeros are an unknown word."""
        shared = self.kept(2, figures[:, 2]) + self.mass[2] / (self.n_words + 1)
        ordinary, toxic = (self.kept(k, figures[:, k]) + self.mass[k] * shared for k in (0, 1))
        return np.log(toxic) - np.log(ordinary)


def _asked(bits: int):
    """The distinct words of each group's documents in this task, a row for each range and group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush() -> pa.RecordBatch:
            group, h = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.lexsort((group, h >> np.uint64(64 - bits)))
            group, h = group[order], h[order]
            part = (h >> np.uint64(64 - bits)).astype(np.int64)
            at = np.flatnonzero(np.r_[True, (part[1:] != part[:-1]) | (group[1:] != group[:-1]), True])
            return _batch([(int(part[a]), 1, int(group[a]), [pack_sorted(np.unique(h[a:b]))]) for a, b in zip(at[:-1], at[1:], strict=True)])

        for piece in slices(batches, "text"):
            w = _split(piece.column("text"))
            if not len(w):
                continue
            doc, h = document_words(w)
            held.append((piece.column("owner").to_numpy()[doc], h))
            n += len(h)
            if n >= 4 * _RUN:
                yield flush()
                n = 0
        if n:
            yield flush()

    return run


def _answered(model: KneserNey):
    """Of each range the table's rows (kind 0) first, then the words that groups ask for: their log ratios."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _rows(batches, "part"):
            known, ratio = np.zeros(0, np.uint64), np.zeros(0, np.float32)

            def answer(owner: int, asked: list[np.ndarray], known, ratio) -> pa.RecordBatch:
                h = np.unique(np.concatenate(asked))
                at = np.minimum(np.searchsorted(known, h), max(0, len(known) - 1))
                hit = known[at] == h if len(known) else np.zeros(len(h), bool)
                return _batch([(0, 0, owner, [pack_sorted(h[hit]), pack(ratio[at[hit]])])])

            for (kind, owner), own in groupby(rows, key=lambda r: (r[0], r[1])):
                blobs = [b for _, _, b in own]
                if kind == 0:
                    known = unpack_sorted(blobs[0][0])
                    ratio = model.ratios(np.stack([unpack(b) for b in blobs[0][1:]], axis=1)).astype(np.float32)
                else:
                    yield answer(owner, [unpack_sorted(b[0]) for b in blobs], known, ratio)

    return run


def _features(ratio: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each document: mean log ratio of its most telling words, of all words, log of length."""
    n = np.diff(first)
    doc = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((-ratio, doc))
    take = np.arange(len(ratio)) - first[:-1][doc] < np.maximum(1, n // TELLING)[doc]
    top = np.bincount(doc[take], weights=ratio[order][take], minlength=len(n)) / np.maximum(1, n // TELLING)
    return top, np.bincount(doc, weights=ratio, minlength=len(n)) / np.maximum(n, 1), np.log1p(n)


def _evidence(model: KneserNey):
    """Of each group its answers (kind 0) first, then its texts: the three features of each."""
    unknown = float(model.ratios(np.zeros((1, 3)))[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner, hashes, ratios, held = None, [], [], (np.zeros(0, np.uint64), np.zeros(0))
        for batch in batches:
            kinds, owners = batch.column("kind").to_numpy(), batch.column("owner").to_numpy()
            cuts = np.flatnonzero(np.r_[True, (kinds[1:] != kinds[:-1]) | (owners[1:] != owners[:-1]), True]) if len(kinds) else np.zeros(1, np.int64)
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                rows = batch.slice(a, b - a)
                if owners[a] != owner:
                    owner, hashes, ratios, held = owners[a], [], [], (np.zeros(0, np.uint64), np.zeros(0))
                if kinds[a] == 0:
                    for blobs in rows.column("blobs").to_pylist():
                        hashes.append(unpack_sorted(blobs[0]))
                        ratios.append(unpack(blobs[1]).astype(float))
                    continue
                if hashes:
                    h, r = np.concatenate(hashes), np.concatenate(ratios)
                    order = np.argsort(h)
                    held, hashes = (h[order], r[order]), []
                for piece in slices(iter([rows]), "text"):
                    w = _split(piece.column("text"))
                    h, of = np.unique(w.hashes, return_inverse=True)
                    at = np.minimum(np.searchsorted(held[0], h), max(0, len(held[0]) - 1))
                    hit = held[0][at] == h if len(held[0]) else np.zeros(len(h), bool)
                    ratio = np.full(len(h), unknown)
                    ratio[hit] = held[1][at[hit]]
                    top, mean, length = _features(ratio[of], w.first)
                    yield pa.RecordBatch.from_arrays([piece.column("id"), pa.array(top), pa.array(mean), pa.array(length)], ["id", "top", "mean", "length"])

    return run


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Newton steps; x has a column of ones last."""
    beta = np.zeros(x.shape[1])
    keep = np.full(x.shape[1], ridge)
    keep[-1] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -40, 40)))
        g = x.T @ (p - y) + keep * beta
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(keep + 1e-9)
        step = np.linalg.solve(h, g)
        beta -= step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def fit(learn: DataFrame, bits: int) -> tuple[KneserNey, DataFrame]:
    """learn: text, label. The model and the written table of its words."""
    dealt = lambda rows: rows.repartition(F.col("part")).sortWithinPartitions("part", "kind")
    runs = materialise(learn.mapInArrow(_counted(bits), BLOBS), "toxic-runs")
    table = materialise(dealt(runs).mapInArrow(_merged, BLOBS + ", totals array<bigint>"), "toxic-words")
    free(runs)
    totals = table.agg(*[F.coalesce(F.sum(F.col("totals")[k]), F.lit(0)) for k in range(N_TOTALS)]).first()
    return KneserNey(list(totals)), table


def evidence(texts: DataFrame, model: KneserNey, table: DataFrame, bits: int) -> list[DataFrame]:
    """texts: id, text. Written tables of id and the three features, together one row for each text."""
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(1, -(-size // GROUP_BYTES))
    kind = texts.schema["id"].dataType.simpleString()
    own = texts.withColumn("owner", F.pmod(F.xxhash64("id", "text"), F.lit(groups)))
    asked = own.select("text", "owner").mapInArrow(_asked(bits), BLOBS)
    meet = table.select("part", "kind", "owner", "blobs").unionByName(asked).repartition(F.col("part")).sortWithinPartitions("part", "kind", "owner")
    answers = materialise(meet.mapInArrow(_answered(model), BLOBS), "toxic-answers")
    out = []
    for b in range(BATCHES):
        mine = F.pmod(F.col("owner"), F.lit(BATCHES)) == b
        none = F.lit(None)
        rows = answers.filter(mine).select("owner", F.lit(0).alias("kind"), "blobs", none.cast(kind).alias("id"), none.cast("string").alias("text"))
        rows = rows.unionByName(own.filter(mine).select("owner", F.lit(1).alias("kind"), none.cast("array<binary>").alias("blobs"), "id", "text"))
        rows = rows.repartition(F.col("owner")).sortWithinPartitions("owner", "kind")
        out.append(materialise(rows.mapInArrow(_evidence(model), f"id {kind}, top double, mean double, length double"), "toxic-evidence"))
    free(answers)
    return out


def score(docs: DataFrame, labels: DataFrame, modulus: int = 4, held_out: int = 2, calibrate: int = 3, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = THRESHOLD, most: int = CALIBRATION_DOCS) -> DataFrame:
    """One row per document: ``id_col``, held_out, score of label 1, predicted."""
    rest = remainder("id", modulus)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    counted = (rest != held_out) & (rest != calibrate)
    learn = texts.filter(counted).join(known.filter(counted).hint("shuffle_hash"), "id").select("text", "label")
    learn = materialise(learn, "toxic-texts")
    size = learn.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(4, int(np.ceil(np.log2(max(1, size / RANGE_BYTES)))))
    model, table = fit(learn, bits)
    free(learn)
    if model.ready:
        parts = evidence(texts, model, table, bits)
        free(table)
        found = parts[0]
        for part in parts[1:]:
            found = found.unionByName(part)
        sample = labelled_sample(labels, id_col, label_col, remainder(id_col, modulus) == calibrate, most)
        seen = found.join(F.broadcast(sample), "id").select("label", "top", "mean", "length").toArrow()  # at most CALIBRATION_DOCS ids
        x = np.stack([*(seen.column(c).to_numpy() for c in ("top", "mean", "length")), np.ones(seen.num_rows)], axis=1)
        y = np.clip(seen.column("label").to_numpy(), 0, 1)
        order = np.lexsort(x.T)
        beta = _logistic(x[order], y[order]) if 0 < y.sum() < len(y) else np.r_[1.0, 0, 0, 0]
        z = F.col("top") * float(beta[0]) + F.col("mean") * float(beta[1]) + F.col("length") * float(beta[2]) + float(beta[3])
        found = found.select("id", (1 / (1 + F.exp(-z))).alias("score"))
    else:
        free(table)
        base = known.filter(rest != held_out).agg(F.avg("label")).first()[0] or 0.0
        found = texts.select("id", F.lit(float(base)).alias("score"))
    return found.select(
        F.col("id").alias(id_col),
        F.coalesce(remainder("id", modulus) == held_out, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
