"""Quality classifier over supervised subword embeddings (operator 7).

A document is the average of learned vectors of its hashed words, pairs of neighbouring words and
character n-grams (of code points; a word's first and last n-grams see the white space around it).
A pair's hash is the exclusive or of its words' hashes: order is left out, and a word twice in a
row has one vector whatever the word. A softmax over the average gives the score. Vectors and
output weights are trained together by stochastic gradient descent in numpy, on at most ``TRAIN_DOCS``
labelled documents (those with the smallest hash of their id; whole texts), classes weighted by the
root of their rarity. A task trains: the steps follow one another, and the driver gets the model only. The output is linear in the average, so for scoring
every bucket's vector collapses to one number and a document's logit is the mean of its features'
numbers: one streaming pass, no shuffle.

Null and empty texts have no features and get the bias alone. Repeated rows get equal scores; of
repeated labels the largest counts; null labels are no labels; a null id is never labelled and not
held out. With no labelled row at all every score is 0.5. Only the id and text columns of the
documents are read, and other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from haystrata.llm.tokens import SPACE, raw, slices, words

BITS, DIM, NGRAMS = 17, 8, (3, 4)
TRAIN_DOCS, EPOCHS, RATE, SEED = 4000, 8, 0.4, 11
THRESHOLD = 0.3
_BLANKS = np.array([32, 9, 10, 11, 12, 13], np.uint32)


def remainder(id_col: str, modulus: int) -> Column:
    """crc32(id as text) mod modulus."""
    return F.crc32(F.col(id_col).cast("string")) % modulus


def code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code points, offsets) of a string column; nulls are empty."""
    buf, at = raw(texts)
    points = np.frombuffer(buf.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    before = np.r_[0, np.cumsum((buf & 0xC0) != 0x80)]
    return points, before[at]


def features(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(bucket ids, first id of each document) for words, pairs of words and each n-gram length."""
    w = words(texts, SPACE)
    out = [((w.hashes >> np.uint64(64 - BITS)).astype(np.int32), w.first)]
    if len(w) > 1:
        pair = w.hashes[1:] ^ w.hashes[:-1]
        place = np.flatnonzero(np.bincount(w.first[1:-1], minlength=len(w) + 1)[1 : len(w)] == 0)  # no pair across documents
        out.append(((pair[place] >> np.uint64(64 - BITS)).astype(np.int32), np.searchsorted(place + 1, w.first)))
    points, at = code_points(texts)
    space = np.isin(points, _BLANKS)
    sym = np.where(space, np.uint32(32), points)
    for n in NGRAMS:
        m = len(sym) - n + 1
        if m <= 0:
            out.append((np.zeros(0, np.int32), np.zeros(len(at), np.int64)))
            continue
        h = sym[:m] * np.uint32(0x9E3779B1) + np.uint32(n)
        valid = np.ones(m, bool)
        for k in range(1, n):
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x2C1B3C6D)
            h += sym[k : m + k] * np.uint32(0x85EBCA6B)
            if k < n - 1:
                valid &= ~space[k : m + k]
        crossing = (at[1:-1, None] - np.arange(1, n)).ravel()
        valid[crossing[(crossing >= 0) & (crossing < m)]] = False
        h ^= h >> np.uint32(16)
        h *= np.uint32(0x297A2D39)
        place = np.flatnonzero(valid)
        out.append(((h[place] >> np.uint32(32 - BITS)).astype(np.int32), np.searchsorted(place, at)))
    return out


def train(ids: list[np.ndarray], counts: list[np.ndarray], labels: np.ndarray, dim: int = DIM, epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> tuple[np.ndarray, float]:
    """SGD over documents; returns one logit per bucket and the bias of label 1 against label 0."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (1 << BITS, dim)).astype(np.float32)
    out, bias = np.zeros((dim, 2), np.float32), np.zeros(2, np.float32)
    shares = [(c / max(1, c.sum())).astype(np.float32) for c in counts]
    weight = np.array([len(labels) / max(1, 2 * int((labels == k).sum())) for k in (0, 1)], np.float32) ** np.float32(0.5)
    steps, total = 0, max(1, epochs * len(ids))
    for _ in range(epochs):
        for d in rng.permutation(len(ids)):
            lr = np.float32(rate * (1 - steps / total))
            steps += 1
            own, share = ids[d], shares[d]
            mean = share @ vectors[own]
            z = mean @ out + bias
            z = np.exp(z - z.max())
            g = z / z.sum()
            g[labels[d]] -= 1
            g *= weight[labels[d]]
            back = out @ g
            out -= lr * np.outer(mean, g)
            bias -= lr * np.float32(0.1) * g
            # a document's features are many: the average's gradient goes to each feature whole
            vectors[own] -= (lr * share * len(own))[:, None].clip(0, lr) * back
    return (vectors @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """label, distinct feature ids, their counts."""
    for piece in slices(batches, "text"):
        own = features(piece.column("text"))
        ids, counts = [], []
        for d in range(piece.num_rows):
            i, c = np.unique(np.concatenate([x[a[d] : a[d + 1]] for x, a in own]), return_counts=True)
            ids.append(i)
            counts.append(c.astype(np.int32))
        yield pa.RecordBatch.from_arrays([piece.column("id").cast(pa.string()), piece.column("label"), pa.array(ids, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))], ["id", "label", "ids", "counts"])


def _trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The model of all rows; none without rows."""
    ids, counts, labels = [], [], []
    for batch in batches:
        ids += [x.values.to_numpy() for x in batch.column("ids")]
        counts += [x.values.to_numpy() for x in batch.column("counts")]
        labels.append(np.clip(batch.column("label").to_numpy(), 0, 1))
    if ids:
        of_bucket, bias = train(ids, counts, np.concatenate(labels))
        yield pa.RecordBatch.from_arrays([pa.array([of_bucket.tobytes()], pa.binary()), pa.array([bias])], ["of_bucket", "bias"])


def labelled_sample(labels: DataFrame, id_col: str, label_col: str, keep: Column, most: int) -> DataFrame:
    """At most ``most`` labelled ids (id, label), those with the smallest hash."""
    known = labels.filter(keep & F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    known = known.groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    return known.orderBy(F.xxhash64("id"), "id").limit(most)


def fit(docs: DataFrame, labels: DataFrame, keep: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = TRAIN_DOCS) -> tuple[np.ndarray, float]:
    """keep: condition on the labels' rows that may be learned from."""
    sample = labelled_sample(labels, id_col, label_col, keep, most)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id")  # at most TRAIN_DOCS rows
    counted = texts.mapInArrow(_counted, "id string, label int, ids array<int>, counts array<int>")
    # a bounded sample in one order, whatever the partitions
    made = counted.repartition(1).sortWithinPartitions("id", "ids", "counts").mapInArrow(_trained, "of_bucket binary, bias double").first()
    if made is None:
        return np.zeros(1 << BITS, np.float32), 0.0
    return np.frombuffer(made["of_bucket"], np.float32), made["bias"]


def logits(model: tuple[np.ndarray, float], texts: pa.Array) -> np.ndarray:
    """Each document's logit of label 1."""
    of_bucket, bias = model
    total, n = np.zeros(len(texts)), np.zeros(len(texts))
    for ids, first in features(texts):
        sums = np.zeros(len(ids) + 1)
        np.cumsum(of_bucket[ids], out=sums[1:])
        total += sums[first[1:]] - sums[first[:-1]]
        n += np.diff(first)
    return total / np.maximum(n, 1) + bias


def scorer(spark, model: tuple[np.ndarray, float], text: str = "text", keep_text: bool = False) -> Callable:
    """For mapInArrow: adds a last column, the score; the text goes unless it is to be kept."""
    held = spark.sparkContext.broadcast(model)  # 2**BITS numbers, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, text):
            z = logits(held.value, piece.column(text))
            names = [c for c in piece.schema.names if keep_text or c != text]
            yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in names), pa.array(1 / (1 + np.exp(-np.clip(z, -60, 60))))], [*names, "score"])

    return run


def score(docs: DataFrame, labels: DataFrame, modulus: int = 5, held_out: int = 0, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = THRESHOLD, most: int = TRAIN_DOCS) -> DataFrame:
    """One row per document: ``id_col``, held_out, score of label 1, predicted."""
    model = fit(docs, labels, remainder(id_col, modulus) != held_out, id_col, text_col, label_col, most)
    kind = docs.schema[id_col].dataType.simpleString()
    scored = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(scorer(docs.sparkSession, model), f"id {kind}, score double")
    return scored.select(
        F.col("id").alias(id_col),
        F.coalesce(remainder("id", modulus) == held_out, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, modulus: int = 5, held_out: int = 0, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = THRESHOLD, most: int = TRAIN_DOCS) -> DataFrame:
    """The documents, all columns, whose score reaches the threshold: the choice is by text alone, so repeated
    rows and rows with a null id stay or go by it. Nothing is joined or shuffled."""
    model = fit(docs, labels, remainder(id_col, modulus) != held_out, id_col, text_col, label_col, most)
    rows = docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))
    text = f"c{docs.columns.index(text_col)}"
    scored = rows.mapInArrow(scorer(docs.sparkSession, model, text, True), T.StructType([*rows.schema.fields, T.StructField("score", T.DoubleType())]))
    return scored.filter(F.col("score") >= threshold).drop("score").toDF(*docs.columns)
