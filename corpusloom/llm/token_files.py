"""Token-ID files: whole texts as ids, in id order, coded by an adaptive context-mixing range coder.

A written set is a Parquet folder whose part files hold blocks in order: part file
`file` holds the documents of one range of ids, and each of its blocks carries up to
BLOCK_IDS ids (see range_coder) and an index of the runs of documents in it.  Blocks
are reset and checked one by one, so any of them can be read alone.

Null text counts as empty and gives the end id alone.  Rows with equal or null ids
stay rows of their own, nulls first, ties in order of the text's fingerprint.  An
empty table gives an empty set.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bpe, range_coder
from .common import NULL_ID, conf_int, offsets_of, slices, texts, work_dir

BLOCK_IDS = 1 << 19
BLOCKS = "file int, block int, start long, n_ids long, runs binary, payload binary"
RUNS = "file int, ordinal long, doc_id long, part long, doc_start long, n_ids long, crc long"


def encode_blocks(batches: Iterator[pa.RecordBatch], vocabulary: str, end_id: int, block_ids: int, file: int | None = None) -> Iterator[pa.RecordBatch]:
    """Blocks of a partition whose rows come in order."""
    from pyspark import TaskContext

    file = TaskContext.get().partitionId() if file is None else file
    coder = bpe.encoder(vocabulary)
    alphabet = max(coder.vocab, end_id + 1)
    held: list[np.ndarray] = []
    runs: list[tuple[int, int, int, int, int, int]] = []  # ordinal, id, id is known, part, the document's start, ids
    size = block = ordinal = start = 0

    def flush() -> pa.RecordBatch:
        nonlocal held, runs, size, block, start
        row = [[file], [block], [start], [size], [zlib.compress(np.array(runs, "<i8").tobytes())], [range_coder.encode(np.concatenate(held), alphabet)]]
        start, block, held, runs, size = start + size, block + 1, [], [], 0
        return pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["file", "block", "start", "n_ids", "runs", "payload"])

    for batch in slices(batches):
        bounds, data = offsets_of(batch.column(1))
        ids, at = coder.encode(data, bounds)
        for i, doc_id in enumerate(batch.column(0).to_pylist()):
            own = np.append(ids[at[i] : at[i + 1]], np.uint32(end_id))
            doc_start, part = start + size, 0
            while len(own):
                take = own[: block_ids - size]
                held.append(take)
                runs.append((ordinal, NULL_ID if doc_id is None else doc_id, doc_id is not None, part, doc_start, len(take)))
                own, size, part = own[len(take) :], size + len(take), part + 1
                if size == block_ids:
                    yield flush()
            ordinal += 1
    if size:
        yield flush()


def decode_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The runs of documents in blocks: file, ordinal, doc_id, part, doc_start, ids, their number and crc32."""
    for batch in batches:
        for file, packed, payload in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("file", "runs", "payload")), strict=True):
            ids = range_coder.decode(payload)
            runs = np.frombuffer(zlib.decompress(packed), "<i8").reshape(-1, 6)
            sizes = runs[:, 5]
            if sizes.sum() != len(ids):
                raise ValueError("a block's index doesn't fit its ids")
            raw, ends = memoryview(ids.astype("<u4").tobytes()), np.cumsum(sizes) * 4
            crcs = [zlib.crc32(raw[e - 4 * n : e]) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
            known = runs[:, 2] != 0
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(runs), file, np.int32)), pa.array(runs[:, 0]), pa.array(runs[:, 1], mask=~known), pa.array(runs[:, 3]), pa.array(runs[:, 4]), pa.array(sizes), pa.array(crcs, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(ids.astype(np.int32))),
                ],
                ["file", "ordinal", "doc_id", "part", "doc_start", "n_ids", "crc", "ids"],
            )


def write(docs: DataFrame, path: str, vocabulary: str, end_id: int = 1, files: int | None = None, block_ids: int = BLOCK_IDS, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Writes the ids of all texts, each followed by `end_id`, in ascending id order to a set of `files` files at `path`."""
    spark = docs.sparkSession
    files = files or conf_int(spark, "spark.sql.shuffle.partitions", 200)
    rows = texts(docs, id_col, text_col).withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange(files, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    rows.mapInArrow(lambda batches: encode_blocks(batches, vocabulary, end_id, block_ids), BLOCKS).write.option("compression", "none").parquet(path)
    return path


def read(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """Runs of ids of the documents of a set; every block is decoded and checked by itself."""
    blocks = spark.read.schema(BLOCKS).parquet(path).select("file", "runs", "payload")
    if with_ids:
        return blocks.mapInArrow(decode_blocks, RUNS + ", ids array<int>")
    return blocks.mapInArrow(lambda batches: (b.select([*range(7)]) for b in decode_blocks(batches)), RUNS)


def crc32_join(first: int, second: int, size: int) -> int:
    """crc32 of two strings end to end, from theirs and the second one's size: multiplying by x^(8 size) modulo the crc's polynomial."""

    def times(a: int, b: int) -> int:
        out = 0
        while a:
            if a & 0x80000000:
                out ^= b
            a = (a << 1) & 0xFFFFFFFF
            b = (b >> 1) ^ (0xEDB88320 if b & 1 else 0)
        return out

    power, square, n = 0x80000000, 0x00800000, size  # x^0 and x^8, highest power in the lowest bit
    while n:
        if n & 1:
            power = times(power, square)
        square, n = times(square, square), n >> 1
    return times(power, first) ^ second


def joined_crc(parts: pd.Series) -> pd.Series:
    """crc32 of a document from those of its parts in order."""

    def one(items: list) -> int:
        items = sorted((x["part"], x["n_ids"], x["crc"]) for x in items)
        crc = items[0][2]
        for _, n, more in items[1:]:
            crc = crc32_join(crc, more, 4 * n)
        return crc

    return parts.map(one)


def documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of every document of a set, read back from it."""
    ends = spark.read.schema(BLOCKS).parquet(path).groupBy("file").agg(F.sum("n_ids").alias("n"))
    before = ends.select("file", (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("before"))  # a row a file
    docs = read(spark, path, with_ids=False).groupBy("file", "ordinal").agg(
        F.first("doc_id").alias("doc_id"), F.min("doc_start").alias("doc_start"), F.sum("n_ids").alias("n_tokens"), F.collect_list(F.struct("part", "n_ids", "crc")).alias("parts")
    )
    return docs.join(before, "file").select("doc_id", (F.col("doc_start") + F.col("before")).alias("start"), "n_tokens", F.pandas_udf(joined_crc, T.LongType())("parts").alias("ids_crc32"))


def op2(docs: DataFrame, vocabulary: str, end_id: int = 1) -> DataFrame:
    path = work_dir(docs.sparkSession)
    write(docs, path, vocabulary, end_id)
    return documents(docs.sparkSession, path)
