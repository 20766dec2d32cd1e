"""Toxicity by multiple-instance learning: only documents are labelled, sentences are scored.

A sentence's score is a logistic function of the summed weights of its words' features
(hashes of its first 3 to 7 bytes, and of the word); a document's score is the
noisy-or of its sentences' scores, 1 - prod(1 - score), and the weights are trained
through it from document labels.  The sentences with the highest scores locate the
offence.

The classifier is fitted on at most `most_rows` labelled rows with at most
`most_bytes` of text, in order of a hash of their ids; every row is scored, whole.
Null text counts as empty.  Rows with a null id are scored, and aren't held out.  With
no labelled row of both kinds every score is the share of toxic rows among the
labelled ones, 0 without any.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WorkTable, Words, gather_runs, offsets_of, slices

BITS = 20
END = np.zeros(256, bool)
END[[ord(c) for c in ".!?\n"]] = True


def word_features(values: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(features end to end, how many each word has): hashes of its first 3 to 7 bytes and of the word."""
    bounds, data = offsets_of(values)
    size = np.diff(bounds)
    n = len(size)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    place = np.arange(len(data)) - np.repeat(bounds[:-1], size)
    powers = np.cumprod(np.full(64, 0x9E3779B97F4A7C15, np.uint64))
    whole = np.add.reduceat((data.astype(np.uint64) + np.uint64(1)) * powers[np.minimum(place, 63)], bounds[:-1])
    out, owner, stem = [whole], [np.arange(n)], np.zeros(n, np.uint64)
    for k in range(1, 8):
        fits = np.flatnonzero(size >= k)
        stem[fits] = stem[fits] * np.uint64(0x100000001B3) + data[bounds[fits] + k - 1]
        if k >= 3:
            out.append(stem[fits] + np.uint64(k << 56))
            owner.append(fits)
    owner = np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return hashed(np.concatenate(out), bits)[order], np.bincount(owner, minlength=n)


def hashed(x: np.ndarray, bits: int) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB) >> np.uint64(64 - bits)).astype(np.int64)


class Bags:
    """Words of a slice of texts by sentence."""

    def __init__(self, text: pa.Array, bits: int = BITS):
        w = Words(text, lower=True)
        self.index, self.doc_at, self.values = w.index, w.doc_at, len(w.values)  # the words' bytes and places aren't kept
        ends = np.concatenate(([0], np.cumsum(END[w.data])))[w.begin]
        doc = np.repeat(np.arange(len(text)), np.diff(w.doc_at))
        new = np.ones(len(w), bool)
        new[1:] = (np.diff(ends) != 0) | (np.diff(doc) != 0)
        self.first = np.flatnonzero(new)  # first word of each sentence
        self.doc = doc[self.first]
        self.docs = len(text)
        features, self.sizes = word_features(w.values, bits)
        self.features = features.astype(np.int32)

    def logits(self, weight: np.ndarray, bias: float) -> np.ndarray:
        """Of each sentence."""
        if not len(self.first):
            return np.zeros(0)
        of_word = np.add.reduceat(weight[self.features], np.cumsum(self.sizes) - self.sizes)
        return np.add.reduceat(of_word[self.index], self.first) + bias

    def support(self, size: int) -> np.ndarray:
        """In how many of the documents each feature occurs, to a few collisions."""
        doc = np.repeat(np.arange(self.docs), np.diff(self.doc_at))
        pairs = np.unique(doc * self.values + self.index)
        index, at = pairs % max(self.values, 1), np.cumsum(self.sizes) - self.sizes
        found = gather_runs(self.features, at[index], self.sizes[index])
        owner = np.repeat(pairs // max(self.values, 1), self.sizes[index])
        return np.bincount(np.unique(owner * size + found) % size, minlength=size).astype(np.int32)

    def back(self, slope: np.ndarray, size: int) -> np.ndarray:
        """Slopes by feature from those by sentence."""
        by_word = np.bincount(self.index, np.repeat(slope, np.diff(np.append(self.first, len(self.index)))), self.values)
        return np.bincount(self.features, np.repeat(by_word, self.sizes), size)


def noisy_or(logits: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    """1 - prod(1 - sigmoid(logit)) by document; 0 without a sentence."""
    return -np.expm1(-np.bincount(doc, np.logaddexp(0, logits), docs))


def sentence_slopes(bag: Bags, label: np.ndarray, weight: np.ndarray, bias: float) -> np.ndarray:
    """Slope of the documents' log loss by each sentence's logit, through the noisy-or."""
    z = bag.logits(weight, bias)
    p = np.clip(noisy_or(z, bag.doc, bag.docs), 1e-9, 1 - 1e-9)
    by_doc = np.where(label > 0, -(1 - p) / p, 1.0)
    return by_doc[bag.doc] * np.exp(-np.logaddexp(0, -z))


def train(text: list[str], toxic: np.ndarray, bits: int = BITS, rounds: int = 50, rate: float = 0.15, decay: float = 1e-6, least: int = 8) -> tuple[np.ndarray, float]:
    """(weights, bias) of least log loss through the noisy-or, by Adam on all rows; weights are 0 or more, as no word can excuse another; features of fewer than `least` documents stay out."""
    y = toxic.astype(float)
    parts = [(Bags(pa.array(text[a : a + 1000], pa.string()), bits), y[a : a + 1000]) for a in range(0, len(text), 1000)]
    support = np.zeros(1 << bits, np.int32)
    for bag, _ in parts:
        support += bag.support(1 << bits)
    known = support >= least
    weight, bias = np.zeros(1 << bits), -6.0
    m1, m2, b1, b2 = np.zeros_like(weight), np.zeros_like(weight), 0.0, 0.0
    for step in range(1, rounds + 1):
        slope, on_bias = decay * weight, 0.0
        for bag, label in parts:
            by_sentence = sentence_slopes(bag, label, weight, bias) / len(y)
            slope = slope + bag.back(by_sentence, len(weight)) * known
            on_bias += by_sentence.sum()
        m1, m2 = 0.9 * m1 + 0.1 * slope, 0.99 * m2 + 0.01 * slope**2
        b1, b2 = 0.9 * b1 + 0.1 * on_bias, 0.99 * b2 + 0.01 * on_bias**2
        scale = rate / (1 - 0.9**step)
        weight = np.maximum(0, weight - scale * m1 / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-6))
        bias -= scale * b1 / (np.sqrt(b2 / (1 - 0.99**step)) + 1e-9)
    return weight.astype(np.float32), float(bias)


def remainder(doc_id: str = "doc_id"):  # noqa: ANN201
    """crc32 of the id as text, modulo 5."""
    return F.crc32(F.col(doc_id).cast("long").cast("string").cast("binary")) % 5


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = 6000, most_bytes: int = 20 << 20, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple:
    """(weights or None, bias or the constant score) from labelled rows outside the held-out fifth."""
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col(label_col).alias("y")).where("id is not null and y is not null")
    known = known.groupBy("id").agg(F.max(F.when(F.col("y") == 1, 1).otherwise(0)).alias("y")).where(remainder("id") != 0)
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    drawn = own.select("id", F.octet_length("text").alias("n")).join(known, "id").orderBy(F.xxhash64("id", F.lit(7)), "id").limit(most_rows)
    drawn = sorted(WorkTable(drawn.withColumn("at", F.xxhash64("id", F.lit(7)))).df.collect(), key=lambda r: (r["at"], r["id"]))  # limited by the executors
    total, chosen = 0, {}
    for r in drawn:
        if total + r["n"] <= most_bytes:
            total, chosen[r["id"]] = total + r["n"], r["y"]
    y = np.array([*chosen.values()])
    if not len(y) or y.min() == y.max():
        return None, float(y.mean()) if len(y) else 0.0
    ids = docs.sparkSession.createDataFrame([*chosen.items()], "id long, y int")  # at most most_rows rows
    rows = own.join(F.broadcast(ids), "id").dropDuplicates(["id"]).repartition(1)  # at most most_bytes of text
    return pickle.loads(rows.select("id", "y", "text").mapInArrow(train_task, "model binary").first()["model"])


def train_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trains on the rows (id, y, text) of the sample within a task, so that the driver's memory stays out of it."""
    rows = sorted(r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    if rows:
        model = train([t for _, _, t in rows], np.array([y for _, y, _ in rows]))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])


def score_rows(batches: Iterator[pa.RecordBatch], weight: np.ndarray | None, bias: float) -> Iterator[pa.RecordBatch]:
    """Adds score, n_sentences and worst (place of the sentence of the highest score) to (doc_id, text)."""
    for batch in slices(batches):
        n = batch.num_rows
        if weight is None:
            score, sentences, worst = np.full(n, bias), np.zeros(n, np.int64), np.full(n, -1)
        else:
            bag = Bags(batch.column(1))
            z = bag.logits(weight, bias)
            score = noisy_or(z, bag.doc, n)
            sentences = np.bincount(bag.doc, minlength=n)
            worst, order = np.full(n, -1), np.lexsort((-z, bag.doc))
            docs, first = np.unique(bag.doc[order], return_index=True)
            worst[docs] = order[first] - np.searchsorted(bag.doc, docs)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.clip(score, 0, 1)), pa.array(sentences), pa.array(worst)], ["key", "score", "n_sentences", "worst"])


def score(docs: DataFrame, model: tuple, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """key (the id), score, n_sentences and worst of every row, in one pass and without a shuffle."""
    weight, bias = model
    rows = docs.select(F.col(id_col).alias("key"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    held = docs.sparkSession.sparkContext.broadcast(weight)  # 2^20 weights, whatever the data
    return rows.mapInArrow(lambda batches: score_rows(batches, held.value, bias), f"key {kind}, score double, n_sentences long, worst long")


def keep_clean(docs: DataFrame, labels: DataFrame, most: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input's rows and columns without those that score `most` or more."""
    model = fit(docs, labels, id_col=id_col, text_col=text_col)
    whole = docs.select(F.struct("*").alias("row"), F.col(text_col).alias("text"))
    return score(whole, model, "row", "text").where(F.col("score") < most).select("key.*")


def op7(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = score(docs, fit(docs, labels))
    held_out = F.coalesce(remainder("key") == 0, F.lit(False))
    return out.select(F.col("key").cast("long").alias("doc_id"), held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_sentences", "worst")
