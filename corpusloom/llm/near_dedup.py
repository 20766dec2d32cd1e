"""Near-duplicate documents by circulant MinHash, banding and exact verification.

A document is the set of its distinct runs of `words` words (ASCII lower-cased).  One
permutation spreads the set's members over Z/2^32; a second, shifted circularly by k,
orders them for coordinate k: signature[k] = min(pi(sigma(x) - k step)).  Bands of
`rows` coordinates put documents of similar sets into common buckets: with 32 bands
of 4, a pair at the threshold 0.75 shares none with probability (1 - 0.75^4)^32,
about 5 in a million, and less the more alike it is.

Documents with the same sequence of words, told by its sha256, form a class, and only
classes go on; those that have one set in different orders are linked like others.  In each bucket the
smallest class is first compared with the others; a bucket whose classes are then in
one component is done, so a bucket of copies of one text costs one comparison a class.
The classes of other buckets are cut into parts of about PART, those of the bucket's
largest component apart from the rest; every two parts, but two of that component, meet
in a task of their own, which tests their classes against each other and gives as many
links as join them.  So a bucket of many copies and a few strays costs a test of each
stray with each copy.  Nothing is capped: a link can only be missed by the bands.  Each
link between classes is confirmed on the full sets of the texts themselves.

Null and empty texts have the empty set and link with nothing.  Fewer than `words`
words make one shingle.  Rows with equal or null ids are documents of their own;
component_id is the smallest id of the component, nulls last.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, WorkTable, grams, keyed, mix, slices

WORDS, BANDS, ROWS, PERCENT = 5, 32, 4, 75
STEP = 0x9E3779B1
#: Classes of a part of a bucket, on average; two parts meet in a task.
PART = 256
SIGNED = "k1 long, k2 long, doc_id long, n long, seq binary, bands array<long>"


def shingle_hashes(w: Words, hashes: np.ndarray, i: int, words: int) -> np.ndarray:
    """Sorted distinct fingerprints of the shingles of text i."""
    own = hashes[w.doc_at[i] : w.doc_at[i + 1]]
    return np.unique(grams(own, min(words, len(own)) or 1, seed=3))


def signature(members: np.ndarray, size: int, chunk: int = 4096) -> np.ndarray:
    """Circulant MinHash: `size` coordinates from two permutations of Z/2^32."""
    spread = (mix(members) >> np.uint64(32)).astype(np.uint32)  # sigma, on fingerprints
    shift = (np.arange(size, dtype=np.uint64) * np.uint64(STEP)).astype(np.uint32)[:, None]
    out = np.full(size, 2**32 - 1, np.uint32)
    for a in range(0, len(spread), chunk):
        x = spread[None, a : a + chunk] - shift
        x ^= x >> np.uint32(16)  # pi
        x *= np.uint32(0x7FEB352D)
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x846CA68B)
        np.minimum(out, x.min(axis=1), out=out)
    return out


def sign(batches: Iterator[pa.RecordBatch], words: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    mark = mix(np.arange(1, bands + 1, dtype=np.uint64))
    for batch in slices(batches):
        w = Words(batch.column(3), lower=True)
        hashes = w.hashes()
        n, seq, keys = [], [], []
        for i, text in enumerate(batch.column(3).to_pylist()):
            members = shingle_hashes(w, hashes, i, words)
            n.append(len(members))
            seq.append(hashlib.sha256(b" ".join(text.encode().lower().split())).digest())
            if len(members):
                sig = signature(members, bands * rows).astype(np.uint64).reshape(bands, rows)
                key = mark.copy()
                for r in range(rows):
                    key = mix(key ^ sig[:, r]) * np.uint64(0x9E3779B97F4A7C15)
                keys.append(key.view(np.int64))
            else:
                keys.append(np.zeros(0, np.int64))
        at = np.cumsum([0, *map(len, keys)]).astype(np.int32)
        bands_ = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(keys)))
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n, pa.int64()), pa.array(seq, pa.binary()), bands_], ["k1", "k2", "doc_id", "n", "seq", "bands"])


def exact_set(text: str, words: int) -> set[bytes]:
    own = text.encode().lower().split()
    if len(own) < words:
        return {b" ".join(own)} if own else set()
    return {b" ".join(own[i : i + words]) for i in range(len(own) - words + 1)}


def verify(batches: Iterator[pa.RecordBatch], words: int, percent: int) -> Iterator[pa.RecordBatch]:
    """(a, b) of the pairs (a, b, text_a, text_b), sorted by a, whose full sets are similar enough."""
    last, left = None, set()
    for batch in batches:
        a, b, text_a, text_b = (c.to_pylist() for c in batch.columns)
        keep = []
        for i in range(batch.num_rows):
            if a[i] != last:
                last, left = a[i], exact_set(text_a[i], words)
            right = exact_set(text_b[i], words)
            both = len(left & right)
            keep.append(both > 0 and 100 * both >= percent * (len(left) + len(right) - both))
        yield pa.RecordBatch.from_arrays([x.filter(pa.array(keep, pa.bool_())) for x in batch.columns[:2]], ["a", "b"])


#: Links that one task joins at most; more are joined by all tasks, in several passes.
FEW_LINKS = 1_000_000


def join_few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(b, a) for each node b of the links (a, b) but the smallest, a, of its component."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = up.setdefault(y, y)
            x = up[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = sorted((top(a), top(b)))
            up[b] = a
    found = [(top(x), x) for x in up if top(x) != x]
    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*found, strict=True) if found else ([], []))], ["a", "b"])


def joined(table: Callable[[DataFrame], DataFrame], links: DataFrame) -> DataFrame:
    """(a, b): for each node b of the links but the smallest of its component, that smallest one, a."""
    edges = table(links.select("a", "b").distinct())
    if edges.count() <= FEW_LINKS:
        return edges.repartition(1).mapInArrow(join_few, "a long, b long")
    while True:
        # alternating large and small stars, until nothing changes
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # large star: neighbours above a node move to the smallest of its neighbourhood
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("m").alias("a"), "b").distinct()
        # small star: of its neighbours below, a node keeps the smallest and hands on the rest
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        lower = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(lower, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("b"), F.col("m").alias("a"))
        new = table(small.where("a <> b").select("a", "b").distinct())
        sums = lambda d: d.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if sums(new) == sums(edges):
            return edges
        edges = new


def linked(signed: DataFrame, docs: DataFrame, words: int, percent: int, table: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(classes: node, seq; the nodes' roots)."""
    some = signed.where("n > 0").groupBy("seq").agg(F.min(F.struct("k1", "k2")).alias("first"), F.any_value("bands").alias("bands"))
    classes = table(some.select(F.monotonically_increasing_id().alias("node"), "seq", "first.k1", "first.k2", "bands"))
    held = classes.select("node", F.explode("bands").alias("bucket"))
    shared = held.groupBy("bucket").agg(F.count("*").alias("m")).where("m > 1").select("bucket")
    members = table(held.join(shared, "bucket"))
    wanted = members.select("node").distinct().join(classes.select("node", "k1", "k2"), "node")
    text = table(docs.select("k1", "k2", "text").join(wanted, ["k1", "k2"]).select("node", "text").dropDuplicates(["node"]))
    nodes = table(members.select("node").distinct())
    roots = nodes.select("node", F.col("node").alias("root"))
    # first each bucket's smallest class against the others
    heads = members.groupBy("bucket").agg(F.min("node").alias("a"))
    pairs = members.join(heads, "bucket").where("node <> a").select("a", F.col("node").alias("b")).distinct()
    left = pairs.join(text.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    full = left.join(text.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b").sortWithinPartitions("a")
    roots = moved(table, roots, table(full.mapInArrow(lambda batches: verify(batches, words, percent), "a long, b long")))
    # then what shares a bucket and isn't joined yet, part against part
    placed = members.join(roots, "node")
    sizes = table(placed.groupBy("bucket", "root").agg(F.count("*").alias("m")))
    mixed = sizes.groupBy("bucket").agg(F.max(F.struct("m", "root")).alias("most"), F.sum("m").alias("all"), F.count("*").alias("roots")).where("roots > 1")
    dealt = mixed.select("bucket", F.col("most.root").alias("main"), F.ceil((F.col("all") - F.col("most.m")) / PART).alias("rest"), F.ceil(F.col("most.m") / PART).alias("mains"))
    # parts of the rest, 0 to rest - 1, meet all parts; those of the largest component, from rest on, only the rest's
    inner, zero = F.col("root") == F.col("main"), F.lit(0).cast("long")
    part = F.when(inner, F.col("rest") + F.pmod(F.xxhash64("node"), "mains")).otherwise(F.pmod(F.xxhash64("node"), "rest"))
    others = F.when(inner, F.sequence(zero, F.col("rest") - 1)).otherwise(F.sequence(zero, F.col("rest") + F.col("mains") - 1))
    open_ = placed.join(dealt, "bucket").withColumn("part", part).withColumn("other", F.explode(others))
    open_ = open_.select("bucket", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "node", "root").join(text, "node").select("bucket", "lo", "hi", "node", "root", "text")
    met = open_.repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi")
    found = table(met.mapInArrow(lambda batches: verify_parts(batches, words, percent), "a long, b long"))
    return classes, moved(table, roots, found)


def moved(table: Callable[[DataFrame], DataFrame], roots: DataFrame, links: DataFrame) -> DataFrame:
    """roots once links between their nodes have joined them."""
    named = [roots.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}")) for x in "ab"]
    between = links.join(named[0], "a").join(named[1], "b").select(F.least("root_a", "root_b").alias("a"), F.greatest("root_a", "root_b").alias("b")).where("a <> b")
    news = joined(table, between).select(F.col("b").alias("root"), F.col("a").alias("new"))
    return table(roots.join(news, "root", "left").select("node", F.coalesce("new", "root").alias("root")))


def overlaps(sets: list[set[bytes]], slab: int = 4096) -> np.ndarray:
    """Sizes of the intersections of all sets, over slabs of the members that several share."""
    count = Counter(x for s in sets for x in s)
    number = {x: i for i, x in enumerate(x for x, n in count.items() if n > 1)}
    own = [np.sort(np.fromiter((number[x] for x in s if x in number), np.int64)) for s in sets]
    row, column = np.repeat(np.arange(len(sets)), [*map(len, own)]), np.concatenate(own)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    for a in range(0, len(number), slab):
        i, j = np.searchsorted(column, (a, a + slab))
        held = np.zeros((len(sets), slab), np.float32)
        held[row[i:j], column[i:j] - a] = 1
        out += held @ held.T
    return out.astype(np.int64)


def verify_parts(batches: Iterator[pa.RecordBatch], words: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Links (a, b) that join the rows (bucket, lo, hi, node, root, text) of each pair of parts, sorted by them: all pairs are tested, and no more links given than join them."""

    def solve(rows: list[tuple]) -> list[tuple[int, int]]:
        up = {r[4]: r[4] for r in rows}

        def top(x: int) -> int:
            while up[x] != x:
                x = up[x] = up[up[x]]
            return x

        if len(up) < 2:
            return []
        sets, out = [exact_set(r[5], words) for r in rows], []
        size = np.fromiter(map(len, sets), np.int64, len(sets))
        both = overlaps(sets)
        near = (both > 0) & (100 * both >= percent * (size[:, None] + size[None] - both))
        for i, j in zip(*np.nonzero(np.triu(near, 1)), strict=True):
            x, y = top(rows[i][4]), top(rows[j][4])
            if x != y:
                up[y] = x
                out.append((rows[i][3], rows[j][3]))
        return out

    held: list[tuple] = []
    for batch in batches:
        found = []
        for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and held[0][:3] != r[:3]:
                found += solve(held)
                held = []
            held.append(r)
        yield links_of(found)
    if held:
        yield links_of(solve(held))


def links_of(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*pairs, strict=True) if pairs else ([], []))], ["a", "b"])


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """k1, k2, doc_id, n_shingles, component (of a row), component_id (its smallest id) and kept (one row a component)."""
    own = keyed(docs, id_col, text_col)
    used: list[WorkTable] = []  # tables that nothing reads once the rows are placed

    def table(df: DataFrame) -> DataFrame:
        used.append(WorkTable(df))
        return used[-1].df

    signed = table(own.select("k1", "k2", "doc_id", "text").mapInArrow(lambda batches: sign(batches, words, bands, rows), SIGNED))
    classes, roots = linked(signed, own, words, percent, table)
    named = classes.select("seq", "node").join(roots, "node", "left").select("seq", F.coalesce("root", "node").alias("root"))
    rows_ = signed.select(F.monotonically_increasing_id().alias("uid"), "k1", "k2", "doc_id", "n", "seq")
    placed = WorkTable(rows_.join(named, "seq", "left").select("uid", "k1", "k2", "doc_id", "n", F.coalesce("root", -1 - F.col("uid")).alias("root"))).df
    for done in used:
        done.drop()
    heads = placed.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.min(F.struct(F.col("doc_id").isNull().alias("late"), F.col("doc_id"), F.col("k2"), F.col("uid"))).alias("head"))
    return placed.join(heads, "root").select("k1", "k2", "doc_id", F.col("n").alias("n_shingles"), "component_id", (F.col("uid") == F.col("head.uid")).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input's rows and columns, one row of each component."""
    kept = near_duplicates(docs, id_col=id_col, text_col=text_col).where("kept").select("k1", "k2", (F.col("n_shingles") == 0).alias("blank")).distinct()
    rows = keyed(docs, id_col, text_col).select("k1", "k2", "row").join(kept, ["k1", "k2"])
    alone = F.when(F.col("blank"), F.monotonically_increasing_id())  # blank rows link with nothing; others alike in id and text are copies
    return rows.withColumn("alone", alone).dropDuplicates(["k1", "k2", "alone"]).select("row.*")


def op10(docs: DataFrame) -> DataFrame:
    out = near_duplicates(docs)
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))
