"""Shared plumbing of the training-data operators: rows, work tables and vectorised word splitting.

Every operator takes only the columns it needs, the whole input row travelling as
one struct, so extra columns never clash with the operator's own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.work import WorkTable, work_dir  # noqa: F401 - for the operators

#: ASCII white space [\x20\x09-\x0D]; words are runs of other bytes.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Stands for a null id in keys; the returned id stays null.
NULL_ID = -(2**63)
#: Bytes of text handled at once by the vectorised passes.
SLICE_BYTES = 4 << 20


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) with null text as empty; duplicate and null ids stay as they are."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(k1, k2, row, doc_id, text): (k1, k2) = (id, text fingerprint) names a row; rows alike in both are interchangeable."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    doc_id = F.col(id_col).cast("long")
    return docs.select(F.coalesce(doc_id, F.lit(NULL_ID)).alias("k1"), F.xxhash64(text).alias("k2"), F.struct("*").alias("row"), doc_id.alias("doc_id"), text.alias("text"))


def with_text(frame: DataFrame, text: str, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """The rows of keyed() with column `text` in place of the old text, and n_chars, if there, brought into line."""
    row = F.col("row").withField(text_col, F.col(text))
    fields = {f.name: f.dataType for f in frame.schema["row"].dataType.fields}
    if length_col in fields:
        row = row.withField(length_col, F.length(F.col(text)).cast(fields[length_col]))
    return frame.select(row.alias("row")).select("row.*")


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts record batches so that one slice holds about `limit` bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        text = batch.column(batch.schema.get_field_index(column))
        sizes = np.diff(offsets_of(text)[0])
        part = np.cumsum(sizes) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a)


def offsets_of(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets from 0, bytes) of a string column without nulls."""
    big = pa.types.is_large_string(text.type) or pa.types.is_large_binary(text.type)
    _, offsets, data = text.buffers()
    if not len(text):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    at = np.frombuffer(offsets, np.int64 if big else np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return at - at[0], raw[at[0] : at[-1]]


class Words:
    """All words of a slice of texts, as indexes into its distinct words.

    index: int32 per word; values: the distinct words (Arrow binary); doc_at: first
    word of each text, with the end appended; begin, end: byte offsets of the words.
    """

    def __init__(self, text: pa.Array, lower: bool = False):
        self.doc_bytes, self.data = offsets_of(text)
        data = LOWER[self.data] if lower else self.data
        solid = ~SPACE[data]
        before = np.empty_like(solid)
        before[1:], before[:1] = solid[:-1], False
        inner = self.doc_bytes[:-1]
        before[inner[inner < len(data)]] = False
        self.begin = np.flatnonzero(solid & ~before)
        after = np.empty_like(solid)
        after[:-1], after[-1:] = solid[1:], False
        ends = self.doc_bytes[1:]
        after[ends[ends > 0] - 1] = False
        self.end = np.flatnonzero(solid & ~after) + 1
        self.doc_at = np.searchsorted(self.begin, self.doc_bytes)
        packed = np.concatenate(([0], np.cumsum(self.end - self.begin)))
        words = pa.Array.from_buffers(pa.large_binary(), len(self.begin), [None, pa.py_buffer(packed.astype(np.int64)), pa.py_buffer(data[solid])])
        coded = words.dictionary_encode()
        self.index = coded.indices.to_numpy(zero_copy_only=False)
        self.values = coded.dictionary

    def __len__(self) -> int:
        return len(self.index)

    def hashes(self) -> np.ndarray:
        """A 64-bit fingerprint of every word."""
        return fingerprints(self.values)[self.index] if len(self) else np.zeros(0, np.uint64)


def fingerprints(values: pa.Array) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(x) for x in values.to_pylist()), np.uint64, len(values))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


#: Multipliers without structure: with those in arithmetic progression, "a b b a" and "b a a b" would collide.
GRAM_ODDS = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def grams(hashes: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
    """Fingerprints of all runs of k words (64 at most): k - 1 fewer than words."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    spread = mix(hashes + np.uint64(seed))
    for j in range(k):
        out += spread[j : j + n] * GRAM_ODDS[j]
    return mix(out)


def gather_runs(store: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The runs store[start:start+length] of all pairs, end to end."""
    total = int(length.sum())
    if not total:
        return np.zeros(0, store.dtype)
    first = np.cumsum(length) - length
    return store[np.repeat(start - first, length) + np.arange(total)]


def conf_int(spark: SparkSession, key: str, default: int) -> int:
    return int(spark.conf.get(key, str(default)))


def binary_rows(frames: dict, schema: pa.Schema) -> pa.RecordBatch:
    """A record batch from arrays, lists or Arrow arrays by column."""
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, type=f.type) for f, x in ((f, frames[f.name]) for f in schema)], schema=schema)
