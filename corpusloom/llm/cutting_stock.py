"""Packing as a cutting-stock problem, solved by column generation on the histogram of piece lengths.

A document is cut into sequences of full capacity, then one piece whose length is a
multiple of `grain`, then what is left (< grain), so that at most capacity / grain +
grain lengths occur, whatever the data's size.  A linear program over patterns (how
many pieces of each length share a sequence) is solved on their histogram alone;
dynamic programming over the capacity prices new patterns.  Its counts are rounded
down, what remains is filled by the same kind of dynamic program, and the pieces of
each length are dealt to the slots of the patterns by rank.

Null text counts as empty and gives the end id alone, one piece of length 1.  Rows
with equal or null ids are packed as rows of their own.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe
from .common import WorkTable, conf_int, offsets_of, slices, texts

CAPACITY, GRAIN = 4096, 64
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def cut_lengths(tokens: int, capacity: int = CAPACITY, grain: int = GRAIN) -> list[int]:
    """Lengths of the pieces of a document in order."""
    full, rest = divmod(tokens, capacity)
    return [capacity] * full + [x for x in (rest - rest % grain, rest % grain) if x]


def cut_pieces(batches: Iterator[pa.RecordBatch], vocabulary: str, end_id: int, capacity: int, grain: int) -> Iterator[pa.RecordBatch]:
    coder = bpe.encoder(vocabulary)
    for batch in slices(batches):
        bounds, data = offsets_of(batch.column(1))
        ids, at = coder.encode(data, bounds)
        out: list[tuple] = []
        for i, doc_id in enumerate(batch.column(0).to_pylist()):
            own = np.append(ids[at[i] : at[i + 1]], np.uint32(end_id)).astype("<u4")
            raw, start = memoryview(own.tobytes()), 0
            for n in cut_lengths(len(own), capacity, grain):
                out.append((doc_id, start, n, zlib.crc32(raw[4 * start : 4 * (start + n)]), len(own)))
                start += n
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])


def best_pattern(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The pattern of most worth within the capacity: unbounded knapsack by dynamic programming."""
    best, taken = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    order = np.argsort(sizes)
    by, value = sizes[order], worth[order]
    fits = np.searchsorted(by, np.arange(capacity + 1), side="right")
    for w in range(1, capacity + 1):
        best[w] = best[w - 1]
        if k := fits[w]:
            gain = best[w - by[:k]] + value[:k]
            j = int(gain.argmax())
            if gain[j] > best[w] + 1e-12:
                best[w], taken[w] = gain[j], order[j]
    pattern, w = np.zeros(len(sizes), np.int64), capacity
    while w > 0:
        if taken[w] < 0:
            w -= 1
        else:
            pattern[taken[w]] += 1
            w -= int(sizes[taken[w]])
    return float(best[capacity]), pattern


def linear_program(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 300, gap: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """(patterns as columns, how often each): revised simplex whose columns are priced by best_pattern, ended once the bound is within `gap`, or after `rounds` columns: what it leaves is filled one pattern at a time."""
    n = len(sizes)
    columns = np.diag(capacity // sizes).astype(float)
    inverse = np.diag(1.0 / np.diag(columns))
    level = (inverse * demand).sum(axis=1)
    for _ in range(rounds):
        value, pattern = best_pattern(sizes, inverse.sum(axis=0), capacity)
        if value <= 1 + 1e-9 or level.sum() * (1 - 1 / value) <= max(gap * level.sum(), 0.5):
            break
        enters = (inverse * pattern).sum(axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(enters > 1e-9, np.maximum(level, 0) / enters, np.inf)
        out = int(ratio.argmin())
        columns[:, out] = pattern
        row = inverse[out] / enters[out]
        inverse = inverse - enters[:, None] * row
        inverse[out] = row
        level = (inverse * demand).sum(axis=1)
    return columns.astype(np.int64), np.maximum(level, 0)


def fullest(sizes: np.ndarray, left: np.ndarray, capacity: int) -> np.ndarray:
    """A pattern of the pieces left that fills most of the capacity; longer pieces come first."""
    reached = np.zeros(capacity + 1, bool)
    reached[0] = True
    steps = []
    for i in np.argsort(-sizes):
        most, lot = min(int(left[i]), capacity // int(sizes[i])), 1
        while most:
            take = min(lot, most)
            most, lot, weight = most - take, lot * 2, take * int(sizes[i])
            new = np.zeros_like(reached)
            new[weight:] = reached[: capacity + 1 - weight]
            new &= ~reached
            reached |= new
            steps.append((i, take, weight, new))
        if reached[capacity]:
            break
    w, pattern = int(np.flatnonzero(reached)[-1]), np.zeros(len(sizes), np.int64)
    for i, take, weight, new in reversed(steps):
        if new[w]:
            pattern[i] += take
            w -= weight
    return pattern


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """[(pattern: pieces by length, how many sequences follow it)], each piece of the histogram in exactly one sequence."""
    out = []
    if histogram.get(capacity):
        out.append(({capacity: 1}, histogram[capacity]))
    sizes = np.array(sorted(x for x, n in histogram.items() if n and x < capacity), np.int64)
    if not len(sizes):
        return out
    left = np.array([histogram[x] for x in sizes.tolist()], np.int64)
    columns, level = linear_program(sizes, left.astype(float), capacity)
    for k in np.argsort(-level):
        pattern = columns[:, k]
        used = pattern > 0
        times = min(int(level[k] + 1e-6), int((left[used] // pattern[used]).min()))
        if times:
            out.append((dict(zip(sizes[used].tolist(), pattern[used].tolist(), strict=True)), times))
            left -= times * pattern
    while left.any():
        pattern = fullest(sizes, left, capacity)
        used = pattern > 0
        times = int((left[used] // pattern[used]).min())
        out.append((dict(zip(sizes[used].tolist(), pattern[used].tolist(), strict=True)), times))
        left -= times * pattern
    return out


def slots(patterns: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, rank after the last, first sequence, pieces of the length in a sequence, their offset in it)."""
    out, rank, sequence = [], {}, 0
    for pattern, times in patterns:
        offset = 0
        for length in sorted(pattern, reverse=True):
            each = pattern[length]
            a = rank.get(length, 0)
            rank[length] = a + each * times
            out.append((length, a, rank[length], sequence, each, offset))
            offset += each * length
        sequence += times
    return out


def pack(docs: DataFrame, vocabulary: str, end_id: int = 2, capacity: int = CAPACITY, grain: int = GRAIN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    pieces = WorkTable(texts(docs, id_col, text_col).mapInArrow(lambda batches: cut_pieces(batches, vocabulary, end_id, capacity, grain), PIECES)).df
    counts = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity / grain + grain rows
    table = slots(plan(counts, capacity))
    places = spark.createDataFrame(table, "slot_length long, low long, high long, first_sequence long, each long, base long")
    lots = max(1, conf_int(spark, "spark.sql.shuffle.partitions", 200))
    ranked = pieces.withColumn("lot", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(lots)))
    ranked = ranked.withColumn("in_lot", F.row_number().over(Window.partitionBy("length", "lot").orderBy("doc_id", "start", "ids_crc32")) - 1)
    sizes = pieces.withColumn("lot", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(lots))).groupBy("length", "lot").agg(F.count("*").alias("n"))
    before = sizes.select(F.col("length").alias("of_length"), F.col("lot").alias("of_lot"), (F.sum("n").over(Window.partitionBy("length").orderBy("lot")) - F.col("n")).alias("before"))
    ranked = ranked.join(before, (F.col("length") == F.col("of_length")) & (F.col("lot") == F.col("of_lot"))).withColumn("rank", F.col("in_lot") + F.col("before"))
    # one row a pattern and length in it: bounded by the lengths, not by the data
    placed = ranked.join(F.broadcast(places), (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    nth = F.col("rank") - F.col("low")
    return placed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("first_sequence") + F.floor(nth / F.col("each"))).cast("long").alias("sequence_id"), (F.col("base") + F.pmod(nth, F.col("each")) * F.col("length")).cast("long").alias("offset")
    )
