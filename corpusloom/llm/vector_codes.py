"""Vector code compression: four codebooks of at most 256 entries, one for each quarter of a vector.

Components become whole numbers (floor(scale * x)), so that all distances and sums are
exact.  Each round broadcasts a kd-tree a codebook (at most 256 entries, whatever the
input); tasks look up the nearest entry of every part by branch and bound and add up the
parts of each entry; Spark sums these over the tasks, and the driver gets one row an
entry.

Defined results: vectors that are null or hold null or non-finite components are dropped;
a component's number stops at +-2^26 (x = +-65,536 at the scale of the query).  With
fewer than 256 vectors codebooks are that much smaller.  Vectors are ordered by id, null
last, then by components.  All vectors should be as long as the first one; one of another
length gets null code and error.  A length that 4 doesn't divide gives the first parts one
component more; an empty vector's parts all meet entry 0.  Null labels count as equal;
repeated ids and rows are rows like others.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.work import WorkTable

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
MOST = 1 << 26
#: Entries in a leaf of a tree.
LEAF = 16
#: A label with more than this share of all rows is broadcast with its sum; there are fewer than its inverse.
HOT = 1 / 500


@dataclass
class Node:
    """Part of a codebook: the box around its entries, and two halves or the entries themselves."""

    low: np.ndarray
    high: np.ndarray
    halves: tuple[Node, Node] | None
    indexes: np.ndarray  # ascending


class KdTree:
    """Nearest entries of one codebook, the lower index on a tie; exact in whole numbers."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries.astype(np.int64)
        self.root = self._grow(np.arange(len(entries)))

    def _grow(self, own: np.ndarray) -> Node:
        points = self.entries[own]
        low, high = points.min(axis=0), points.max(axis=0)
        if len(own) <= LEAF or not points.shape[1] or (low == high).all():
            return Node(low, high, None, own)
        axis = int(np.argmax(high - low))
        by_axis = own[np.argsort(points[:, axis], kind="stable")]
        half = len(own) // 2
        return Node(low, high, (self._grow(np.sort(by_axis[:half])), self._grow(np.sort(by_axis[half:]))), own)

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) for each row of `queries`."""
        queries = queries.astype(np.int64)
        best, found = np.full(len(queries), np.iinfo(np.int64).max), np.full(len(queries), len(self.entries))
        if len(queries):
            self._visit(self.root, queries, np.arange(len(queries)), best, found)
        return found, best

    def _visit(self, node: Node, queries: np.ndarray, rows: np.ndarray, best: np.ndarray, found: np.ndarray) -> None:
        """Looks through a node for the queries in `rows`, none of which it is too far from: for each the nearer half first, the other unless its bound is above the best so far."""
        if node.halves is None:
            own = queries[rows]
            distance = squared(own, self.entries[node.indexes])
            at = distance.argmin(axis=1)  # the first of equals, and indexes ascend
            least, index = distance[np.arange(len(rows)), at], node.indexes[at]
            better = (least < best[rows]) | ((least == best[rows]) & (index < found[rows]))
            best[rows[better]], found[rows[better]] = least[better], index[better]
            return
        own = queries[rows]
        bounds = [bound(half, own) for half in node.halves]
        right_first = bounds[1] < bounds[0]
        for chosen, order in ((~right_first, (0, 1)), (right_first, (1, 0))):
            for k in order:
                near = chosen & (bounds[k] <= best[rows])  # equal bounds stay: a lower index may lie there
                if near.any():
                    self._visit(node.halves[k], queries, rows[near], best, found)


def bound(node: Node, queries: np.ndarray) -> np.ndarray:
    """Squared distance of each query from the node's box."""
    out = np.maximum(np.maximum(node.low - queries, queries - node.high), 0)
    return np.einsum("ij,ij->i", out, out)


def squared(queries: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """All squared distances, exact: in floating point where every sum stays below 2^53."""
    most = max(np.abs(queries).max(initial=0), np.abs(entries).max(initial=0))
    if 4 * int(most) ** 2 * max(1, queries.shape[1]) < 1 << 52:
        a, b = queries.astype(np.float64), entries.astype(np.float64)
        return (np.einsum("ij,ij->i", a, a)[:, None] - 2 * (a @ b.T) + np.einsum("ij,ij->i", b, b)).astype(np.int64)
    return np.stack([((queries - e) ** 2).sum(axis=1) for e in entries], axis=1)


def cuts(length: int) -> list[int]:
    """Where the parts of a vector begin and end."""
    return [0, *np.cumsum([length // PARTS + (k < length % PARTS) for k in range(PARTS)]).tolist()]


def whole_numbers(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = SCALE) -> DataFrame:
    """(vec_id, label, x) of the vectors that count, x as whole numbers."""
    vector = F.col(vector_col).cast("array<double>")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    number = lambda x: F.least(F.greatest(F.floor(x * float(scale)), F.lit(-MOST)), F.lit(MOST)).cast("int")
    return vectors.where(vector.isNotNull() & finite).select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.transform(vector, number).alias("x"))


def matrix(column: pa.Array, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows of the given length, as a matrix; which rows these are)."""
    sizes = np.diff(column.offsets.to_numpy())
    fits = np.flatnonzero(sizes == length)
    flat = column.flatten() if len(fits) == len(sizes) else column.take(pa.array(fits)).flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(fits), length), fits


def sums_of_parts(vectors: DataFrame, trees: list[KdTree], length: int) -> list:
    """A row for each entry that parts were assigned to: (part, entry, n, s0, s1, ...)."""
    at = cuts(length)
    width = max(1, at[1])
    held = vectors.sparkSession.sparkContext.broadcast(trees)
    schema = "part int, entry int, n long, " + ", ".join(f"s{i} long" for i in range(width))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        n, total = np.zeros((PARTS, ENTRIES), np.int64), np.zeros((PARTS, ENTRIES, width), np.int64)
        for batch in batches:
            rows, _ = matrix(batch.column(0), length)
            for p, tree in enumerate(held.value):
                part = rows[:, at[p] : at[p + 1]]
                index, _ = tree.nearest(part)
                n[p] += np.bincount(index, minlength=ENTRIES)
                order = np.argsort(index, kind="stable")
                used, first = np.unique(index[order], return_index=True)
                if len(used) and part.shape[1]:
                    total[p, used, : part.shape[1]] += np.add.reduceat(part[order], first, axis=0)
        part, entry = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(n[part, entry]), *[pa.array(total[part, entry, i]) for i in range(width)]], names=["part", "entry", "n", *[f"s{i}" for i in range(width)]])

    partial = vectors.select("x").mapInArrow(add, schema)
    out = partial.groupBy("part", "entry").agg(*[F.sum(c).alias(c) for c in ("n", *(f"s{i}" for i in range(width)))]).collect()
    held.unpersist()
    return out


def fit(vectors: DataFrame, rounds: int = ROUNDS) -> list[np.ndarray]:
    """The codebooks after some rounds over all vectors (vec_id, x)."""
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(ENTRIES).select("x").collect()
    if not first:
        return []
    length = len(first[0]["x"])
    start = np.array([r["x"] for r in first if len(r["x"]) == length], np.int64).reshape(-1, length)
    at = cuts(length)
    books = [start[:, at[p] : at[p + 1]] for p in range(PARTS)]
    for _ in range(rounds):
        books = [b.copy() for b in books]
        for row in sums_of_parts(vectors, [KdTree(b) for b in books], length):
            book = books[row["part"]]
            book[row["entry"]] = [row[f"s{i}"] // row["n"] for i in range(book.shape[1])]
    return books


def encode(vectors: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """(vec_id, label, code, error) of every vector: an entry's number in two hex digits a part, and its squared distance."""
    length = sum(b.shape[1] for b in books)
    at = cuts(length)
    held = vectors.sparkSession.sparkContext.broadcast([KdTree(b) for b in books])
    kept = vectors.select("vec_id", "label", "x")
    out_schema = kept.drop("x").schema.add("code", "string").add("error", "long")

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digits = np.array([f"{i:02x}" for i in range(ENTRIES)], dtype=object)
        for batch in batches:
            rows, fits = matrix(batch.column(2), length)
            code, error = np.full(batch.num_rows, None, dtype=object), np.zeros(batch.num_rows, np.int64)
            own, far = np.full(len(fits), "", dtype=object), np.zeros(len(fits), np.int64)
            for p, tree in enumerate(held.value):
                index, distance = tree.nearest(rows[:, at[p] : at[p + 1]])
                own, far = own + digits[index], far + distance
            code[fits], error[fits] = own, far
            missing = np.ones(batch.num_rows, bool)
            missing[fits] = False
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(code, pa.string()), pa.array(error, mask=missing)], names=["vec_id", "label", "code", "error"])

    return kept.mapInArrow(assign, out_schema)


def with_label_error(coded: DataFrame) -> DataFrame:
    """Adds label_error, the errors summed over equal labels; labels with many rows meet their sum by broadcast, the others by a shuffle."""
    sums = WorkTable(coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("_n"))).df
    many = F.col("_n") > (sums.agg(F.sum("_n")).first()[0] or 0) * HOT
    hot = sums.where(many).select(F.col("label").alias("_label"), "label_error", F.lit(True).alias("_hot"))
    cold = sums.where(~many).select(F.col("label").alias("_label"), "label_error")
    met = coded.join(F.broadcast(hot), F.col("label").eqNullSafe(F.col("_label")), "left").drop("_label")
    rest = met.where("_hot is null").drop("label_error").join(cold, F.col("label").eqNullSafe(F.col("_label")))
    return met.where("_hot").select(*coded.columns, "label_error").unionByName(rest.select(*coded.columns, "label_error"))


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = SCALE, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, code, error of each vector; the four codebooks)."""
    rows = WorkTable(whole_numbers(vectors, id_col, vector_col, label_col, scale)).df
    books = fit(rows, rounds)
    if not books:
        return rows.select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error")), []
    return WorkTable(encode(rows, books)).df, books


def op13(vectors: DataFrame) -> DataFrame:
    coded, books = compress(vectors)
    numbers = ",".join(str(x) for b in books for x in b.ravel().tolist())
    out = with_label_error(coded)
    return out.select("vec_id", "code", "error", "label_error", F.lit(hashlib.sha256(numbers.encode()).hexdigest()).alias("codebooks_sha256"))
