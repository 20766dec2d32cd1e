"""Line dedup by content-defined chunks of lines.

A line's hash is the first 32 bits of its md5.  A chunk ends after line i if
h[i] + 3 h[i-1] + 9 h[i-2] is divisible by EVERY (lines before the text count as 0),
so chunk ends move with the lines around them.  Of chunks of two or more lines that
are equal byte for byte, in whatever documents, the first by (doc_id, fingerprint of
the text, place) stays and the others go.  Single-line chunks always stay.

Null text counts as empty: one empty line.  Null ids sort first.  Rows alike in id and
text count as one row and fare alike.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WorkTable, keyed, slices, with_text

EVERY = 4
CHUNKS = "k1 long, k2 long, line int, n_lines int, h1 long, h2 long, again boolean, chunk string"


def chunk_ends(lines: list[bytes], every: int = EVERY) -> list[int]:
    """The line after each chunk's last."""
    n = len(lines)
    h = np.zeros(n + 2, np.int64)
    h[2:] = np.frombuffer(b"".join(hashlib.md5(x).digest()[:4] for x in lines), ">u4")
    rolled = h[2:] + 3 * h[1:-1] + 9 * h[:-2]
    ends = (np.flatnonzero(rolled % every == 0) + 1).tolist()
    return ends if ends and ends[-1] == n else [*ends, n]


def emit_chunks(batches: Iterator[pa.RecordBatch], every: int) -> Iterator[pa.RecordBatch]:
    """Chunks of two or more lines; `again` ones repeat a chunk of the same text and come without their text."""
    for batch in slices(batches):
        out: list[tuple] = []
        for k1, k2, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            lines = text.encode().split(b"\n")
            if len(lines) < 2:
                continue
            begin, seen = 0, set()
            for end in chunk_ends(lines, every):
                if end - begin > 1:
                    chunk = b"\n".join(lines[begin:end])
                    h = xxhash.xxh3_128_digest(chunk)
                    h1, h2 = int.from_bytes(h[:8], "big", signed=True), int.from_bytes(h[8:], "big", signed=True)
                    out.append((k1, k2, begin, end - begin, h1, h2, chunk in seen, None if chunk in seen else chunk))
                    seen.add(chunk)
                begin = end
        if out:
            columns = zip(*out, strict=True)
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())
            arrays = [pa.array(x, type=t) for x, t in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays([*arrays[:-1], arrays[-1].cast(pa.string())], ["k1", "k2", "line", "n_lines", "h1", "h2", "again", "chunk"])


def removals(docs: DataFrame, every: int = EVERY) -> DataFrame:
    """(k1, k2, gone: array of (line, n_lines)) of the rows of keyed() that lose chunks."""
    chunks = WorkTable(docs.select("k1", "k2", "text").mapInArrow(lambda batches: emit_chunks(batches, every), CHUNKS)).df
    once = chunks.where(~F.col("again"))
    groups = once.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(F.struct("k1", "k2")).alias("keep"), (F.min("chunk") < F.max("chunk")).alias("differ"))
    repeated = WorkTable(groups.where("n > 1").select("h1", "h2", "keep", "differ")).df
    skinny = chunks.select("k1", "k2", "line", "n_lines", "h1", "h2", "again")
    found = skinny.join(repeated.where(~F.col("differ")), ["h1", "h2"], "left")
    later = F.struct("k1", "k2") > F.col("keep")
    gone = found.where(F.col("again") | later).select("k1", "k2", "line", "n_lines")
    unlike = repeated.where("differ")
    if unlike.limit(1).count():  # chunks that share a hash but not their bytes
        some = once.join(unlike.select("h1", "h2"), ["h1", "h2"], "left_semi")
        by_bytes = some.groupBy("chunk").agg(F.min(F.struct("k1", "k2")).alias("keep"))
        gone = gone.unionByName(some.join(by_bytes, "chunk").where(later).select("k1", "k2", "line", "n_lines"))
    return gone.groupBy("k1", "k2").agg(F.collect_set(F.struct("line", "n_lines")).alias("gone"))


def judged(docs: DataFrame, every: int = EVERY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """keyed() with n_lines, n_removed_chunks, n_removed_lines and kept (the text that stays)."""
    rows = keyed(docs, id_col, text_col)
    out = rows.join(removals(rows, every), ["k1", "k2"], "left").withColumn("lines", F.split("text", "\n", -1))
    inside = lambda i: F.exists("gone", lambda g: (i >= g["line"]) & (i < g["line"] + g["n_lines"]))
    kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.filter("lines", lambda _, i: ~inside(i)), "\n"))
    return out.select(
        "k1", "k2", "row", "doc_id", F.size("lines").cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed_chunks"),
        F.coalesce(F.aggregate("gone", F.lit(0).cast("long"), lambda a, g: a + g["n_lines"]), F.lit(0)).cast("long").alias("n_removed_lines"), kept.alias("kept"),
    )


def dedup_lines(docs: DataFrame, every: int = EVERY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input's rows and columns with repeated chunks cut out of their text; no row goes."""
    return with_text(judged(docs, every, id_col, text_col), "kept", text_col)


def op1(docs: DataFrame) -> DataFrame:
    return judged(docs).select("doc_id", "n_lines", "n_removed_chunks", "n_removed_lines", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
