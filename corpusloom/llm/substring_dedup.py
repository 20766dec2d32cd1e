"""Substring dedup by prefix-partitioned sparse suffix trees over words.

A window is `window` consecutive words of one document; words covered by a window
that occurs more than once are removed, wherever it occurs.

Sparse suffixes.  Every window holds an anchor: the run of GRAM words of least hash in
it, the same in equal windows.  Only suffixes that start at anchors go into trees,
each with the words before it, read backwards; this context, `window` words from the
anchor on and window - GRAM before it, decides all windows around the anchor.  Equal
contexts, told by fingerprints that rest on 64 bits a word, become one suffix with a weight before
anything is dealt out, so a passage copied into a third of all rows is a row a task.

Prefix partitioning.  Suffixes with the same first GRAM words form a group; a group of
one suffix of weight 1 holds nothing repeated.  While a group has more suffixes than
fit in memory, its prefix grows: each half of its windows, those reaching further to
the right and those reaching further to the left of the anchor, gets a group for each
distinct longer prefix in its direction.  A prefix that has grown to a whole window
is a single node of the tree, and its suffixes are repeats by being two.

Subtrees.  A group is two trees, of the words from the anchor on and of those before
it, built by sorting; a run of equal neighbours down to depth d is an internal node of
that depth.  A window that reaches r words to the right of the anchor's start and
window - r to the left is repeated if its node of depth r in one tree and its node of
depth window - r in the other have a weight of two or more in common.  Words are
compared there, not hashes.

Null and empty texts have no words.  Equal rows count as two occurrences each.  Null
and equal ids need no rule: rows are told apart by id and text, and rows alike in both
fare alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, WorkTable, grams, keyed, mix, slices, with_text

WINDOW, GRAM = 35, 8
#: Suffixes of one group that one task takes at most; with their words about a kilobyte each.
GROUP = 100_000
#: Stands for words before a text's first and after its last.
EDGE = np.uint64(7)


def sliding(x: np.ndarray, width: int, largest: bool = False) -> np.ndarray:
    """Extremes of all runs of `width` items, width - 1 fewer than items."""
    pick = np.maximum if largest else np.minimum
    reach, out = 1, x
    while reach * 2 <= width:
        out = pick(out[:-reach], out[reach:]) if len(out) > reach else out[:0]
        reach *= 2
    more = width - reach
    return pick(out[:-more], out[more:]) if more and len(out) > more else out if not more else out[:0]


def sparse_suffixes(hashes: np.ndarray, doc_at: np.ndarray, window: int, gram: int) -> dict[str, np.ndarray]:
    """The anchors of texts whose words' hashes lie end to end, text i from doc_at[i] on.

    doc, at: text and word; h: fingerprint of the anchor's words; c: of its context;
    valid: bit r - gram for each r for which the window with r words from the anchor on
    lies in the text.
    """
    back, size = window - gram, np.diff(doc_at)
    pad = back + window
    begin = doc_at[:-1] + np.arange(len(size)) * pad + back  # texts with edges before and after each
    padded = np.full(len(hashes) + len(size) * pad, EDGE, np.uint64)
    doc = np.repeat(np.arange(len(size)), size)
    padded[np.arange(len(hashes)) + (begin - doc_at[:-1])[doc]] = hashes
    h = grams(padded, gram, seed=5)
    wide = window - gram + 1
    least = sliding(h, wide)
    starts = np.zeros(len(least) + 1, np.int64)  # windows that lie in a text
    has = size >= window
    starts[begin[has]] += 1
    starts[begin[has] + size[has] - window + 1] -= 1
    least[np.cumsum(starts[:-1]) == 0] = 0
    reach = np.concatenate((np.zeros(wide - 1, np.uint64), least, np.zeros(max(0, len(h) - len(least)), np.uint64)))
    where = np.flatnonzero((sliding(reach, wide, largest=True)[: len(h)] == h) & (h > 0))
    doc = np.searchsorted(begin, where, side="right") - 1
    at = where - begin[doc]
    c = np.zeros(len(where), np.uint64)
    for j in sorted({*range(-back, 0, gram), -gram, *range(0, back, gram), back}):
        c = mix(c ^ h[where + j]) * np.uint64(0x9E3779B97F4A7C15)
    left, right = np.minimum(at, back), np.minimum(size[doc] - at, window)
    one = np.int64(1)
    valid = ((one << (right - gram + 1)) - 1) & ~((one << (back - left)) - 1)
    return {"doc": doc, "at": at, "h": h[where], "c": c, "valid": valid}


ANCHORS = "k1 long, k2 long, at int, h long, c long, valid int"


def find_anchors(batches: Iterator[pa.RecordBatch], window: int, gram: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        w = Words(batch.column(2))
        found = sparse_suffixes(w.hashes(), w.doc_at, window, gram)
        k1, k2 = (pa.array(c.to_numpy(zero_copy_only=False)[found["doc"]]) for c in batch.columns[:2])
        yield pa.RecordBatch.from_arrays([k1, k2, pa.array(found["at"].astype(np.int32)), pa.array(found["h"].view(np.int64)), pa.array(found["c"].view(np.int64)), pa.array(found["valid"].astype(np.int32))], ["k1", "k2", "at", "h", "c", "valid"])


SUFFIXES = "h long, c long, n long, left string, right string"


def contexts(batches: Iterator[pa.RecordBatch], window: int, gram: int) -> Iterator[pa.RecordBatch]:
    """(h, c, n, left, right) of the rows (text, wanted: array of (at, h, c, n)): the words before and from the anchors on."""
    back = window - gram
    for batch in slices(batches):
        w = Words(batch.column(0))
        wanted = batch.column(1)
        parts, n = wanted.flatten(), wanted.value_lengths().to_numpy(zero_copy_only=False)
        at, h, c, weight = (x.to_numpy(zero_copy_only=False) for x in parts.flatten())
        doc = np.repeat(np.arange(batch.num_rows), n)
        first, last = w.doc_at[:-1][doc], w.doc_at[1:][doc]
        place = first + at
        raw = memoryview(w.data)
        begin, end = w.begin, w.end
        lo, hi = np.maximum(first, place - back), np.minimum(last, place + window) - 1
        left = [bytes(raw[a:b]) if b > a else b"" for a, b in zip(begin[lo].tolist(), np.where(place > lo, end[np.maximum(place - 1, 0)], 0).tolist(), strict=True)]
        right = [bytes(raw[a:b]) for a, b in zip(begin[place].tolist(), end[hi].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(c), pa.array(weight), *(pa.array(x, pa.binary()).cast(pa.string()) for x in (left, right))], ["h", "c", "n", "left", "right"])


def word_table(strings: pa.Array, width: int, backwards: bool) -> np.ndarray:
    """Numbers of the words of each string, -1 where it has no more; equal numbers for equal words."""
    w = Words(strings)
    size = np.diff(w.doc_at)
    row = np.repeat(np.arange(len(strings)), size)
    place = np.arange(len(w)) - w.doc_at[:-1][row]
    if backwards:
        place = size[row] - 1 - place
    out = np.full((len(strings), width), -1, np.int32)
    fits = place < width
    out[row[fits], place[fits]] = w.index[fits]
    return out


def nodes(group: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The tree of each group: for each suffix and depth d, the number of its ancestor of depth d; -1 where it has fewer words."""
    n, width = words.shape
    order = np.lexsort((*words.T[::-1], group))
    g, w = group[order], words[order]
    same = np.zeros((n, width + 1), bool)  # equal to the neighbour above down to depth d
    same[1:, 0] = g[1:] == g[:-1]
    same[1:, 1:] = w[1:] == w[:-1]
    same = np.logical_and.accumulate(same, axis=1)
    ancestor = np.cumsum(~same, axis=0, dtype=np.int32)
    out = np.empty((n, width + 1), np.int32)
    out[order] = ancestor
    out[:, 1:][words < 0] = -1
    return out


def repeated_windows(group: np.ndarray, weight: np.ndarray, x: np.ndarray, y: np.ndarray, left: np.ndarray, right: np.ndarray, window: int, gram: int) -> np.ndarray:
    """For each suffix, the set of r (as bit r - gram), x <= r <= window - y, for which its window with r words from the anchor on has weight 2 in the group."""
    forth, back = nodes(group, right), nodes(group, left)
    mask = np.zeros(len(group), np.int64)
    for r in range(gram, window + 1):
        a, b = forth[:, r].astype(np.int64), back[:, window - r].astype(np.int64)
        whole = np.flatnonzero((a >= 0) & (b >= 0) & (x <= r) & (r <= window - y))
        _, inverse = np.unique((a[whole] << 32) | b[whole], return_inverse=True)
        mask[whole[np.bincount(inverse, weight[whole])[inverse] > 1]] |= 1 << (r - gram)
    return mask


DEALT = "h long, c long, n long, left string, right string, g binary, x int, y int"
MASKS = "h long, c long, mask long"


def grow_subtrees(batches: Iterator[pa.RecordBatch], window: int, gram: int, lot: int = 20_000) -> Iterator[pa.RecordBatch]:
    """(h, c, mask) of the suffixes of a partition sorted by group; whole groups are taken together."""
    held: list[pa.RecordBatch] = []
    count = 0

    def solve(table: pa.Table) -> pa.RecordBatch:
        batch = table.combine_chunks().to_batches()[0]
        one = lambda c: batch.column(batch.schema.get_field_index(c))
        group = one("g").dictionary_encode().indices.to_numpy()
        n, x, y = (one(c).to_numpy() for c in ("n", "x", "y"))
        # words are numbered over both sides apart, and never compared across them
        mask = repeated_windows(group, n, x, y, word_table(one("left"), window - gram, True), word_table(one("right"), window, False), window, gram)
        keep = pa.array(mask != 0)
        return pa.RecordBatch.from_arrays([*(one(c).filter(keep) for c in ("h", "c")), pa.array(mask).filter(keep)], ["h", "c", "mask"])

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        if count < lot:
            continue
        table = pa.Table.from_batches(held)
        g = table.column("g")
        last, cut = g[count - 1].as_py(), count  # the last group may go on
        while cut and g[cut - 1].as_py() == last:
            cut -= 1
        if cut:
            yield solve(table.slice(0, cut))
        rest = table.slice(cut).combine_chunks()
        held, count = rest.to_batches(), rest.num_rows
    if held:
        yield solve(pa.Table.from_batches(held))


def lengthened(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Each suffix in the groups of its two longer prefixes, of (x, y) words in either direction; without those whose words don't reach so far."""
    for batch in batches:
        out: list[tuple] = []
        for h, c, n, left, right, _, x, y in zip(*(v.to_pylist() for v in batch.columns), strict=True):
            before, after = left.encode().split()[::-1], right.encode().split()
            middle = (x + window - y + 1) // 2
            for to_x, to_y in ((middle, y), (x, window - middle + 1)):
                if len(after) >= to_x and len(before) >= to_y:
                    g = xxhash.xxh3_128_digest(b"%d %d " % (to_x, to_y) + b" ".join(before[:to_y] + after[:to_x]))
                    out.append((h, c, n, left, right, g, to_x, to_y))
        columns = zip(*out, strict=True) if out else [[]] * 8
        types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int32(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(v, type=t) for v, t in zip(columns, types, strict=True)], ["h", "c", "n", "left", "right", "g", "x", "y"])


def masks_of(suffixes: DataFrame, window: int, gram: int, group: int) -> DataFrame:
    """(h, c, mask) of the suffixes (h, c, n, left, right) with repeated windows; a suffix may come several times."""
    dealt = suffixes.withColumns({"g": F.unhex(F.lpad(F.hex("h"), 16, "0")), "x": F.lit(gram), "y": F.lit(0)})
    out = None
    while True:
        large = WorkTable(dealt.groupBy("g").agg(F.count("*").alias("size")).where(F.col("size") > group).select("g")).df
        more = large.limit(1).count() > 0
        ready = dealt.join(large, "g", "left_anti").select(dealt.columns) if more else dealt
        found = ready.repartition("g").sortWithinPartitions("g").mapInArrow(lambda batches: grow_subtrees(batches, window, gram), MASKS)
        out = found if out is None else out.unionByName(found)
        if not more:
            return out
        over = dealt.join(large, "g", "left_semi").select(dealt.columns)
        whole = over.where(F.col("x") + F.col("y") == window).select("h", "c", F.expr(f"shiftleft(1L, x - {gram})").alias("mask"))
        out = out.unionByName(whole)
        dealt = WorkTable(over.where(F.col("x") + F.col("y") < window).mapInArrow(lambda batches: lengthened(batches, window), DEALT)).df


def marked(docs: DataFrame, window: int, gram: int, group: int) -> DataFrame:
    """(k1, k2, marks: array of (at, mask)) of the rows of keyed() with a repeated window."""
    own = docs.select("k1", "k2", "text")
    anchors = WorkTable(own.mapInArrow(lambda batches: find_anchors(batches, window, gram), ANCHORS))
    twice = WorkTable(anchors.df.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"))
    repeated = WorkTable(anchors.df.join(twice.df, "h").select(anchors.df.columns)).df
    weights = repeated.groupBy("h", "c").agg(F.count("*").alias("n"), F.min(F.struct("k1", "k2", "at")).alias("one"), F.min("valid").alias("valid"))
    suffixes = WorkTable(weights)
    several = WorkTable(suffixes.df.groupBy("h").agg(F.count("*").alias("m")).where("m > 1").select("h"))
    alone = suffixes.df.join(several.df, "h", "left_anti").select("h", "c", F.col("valid").cast("long").alias("mask"))  # all of weight 2 or more
    some = suffixes.df.join(several.df, "h", "left_semi")
    wanted = some.groupBy("one.k1", "one.k2").agg(F.collect_list(F.struct("one.at", "h", "c", "n")).alias("wanted"))
    fetched = own.dropDuplicates(["k1", "k2"]).join(wanted, ["k1", "k2"]).select("text", "wanted")
    with_words = WorkTable(fetched.mapInArrow(lambda batches: contexts(batches, window, gram), SUFFIXES))
    masks = WorkTable(masks_of(with_words.df, window, gram, group).unionByName(alone)).df
    for done in (anchors, twice, suffixes, several, with_words):
        done.drop()
    return repeated.select("k1", "k2", "at", "h", "c").join(masks, ["h", "c"]).groupBy("k1", "k2").agg(F.collect_set(F.struct("at", "mask")).alias("marks"))


def cover(n: int, at: np.ndarray, mask: np.ndarray, window: int, gram: int) -> np.ndarray:
    """For each of n words, whether a marked window covers it."""
    depth = np.zeros(n + 1, np.int64)
    for bit in range(window - gram + 1):
        start = at[(mask >> bit & 1) == 1] + bit + gram - window
        depth[: n + 1] += np.bincount(start, minlength=n + 1) - np.bincount(start + window, minlength=n + 1)
    return np.cumsum(depth[:-1]) > 0


def cut_out(batches: Iterator[pa.RecordBatch], window: int, gram: int) -> Iterator[pa.RecordBatch]:
    """(key, n_words, n_removed, kept): what stays, joined by single spaces."""
    for batch in slices(batches):
        totals, gone, kept = [], [], []
        marks = batch.column(2)
        size = marks.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        at, mask = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in marks.flatten().flatten())
        bounds = np.cumsum([0, *size.tolist()])
        for text, a, b in zip(batch.column(1).to_pylist(), bounds[:-1], bounds[1:], strict=True):
            own = text.encode().split()
            totals.append(len(own))
            if b > a:
                out = cover(len(own), at[a:b], mask[a:b], window, gram)
                gone.append(int(out.sum()))
                own = [x for x, c in zip(own, out.tolist(), strict=True) if not c]
            else:
                gone.append(0)
            kept.append(b" ".join(own).decode())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(totals, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], ["key", "n_words", "n_removed", "kept"])


def judged(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, group: int = GROUP, id_col: str = "doc_id", text_col: str = "text", key: str = "row") -> DataFrame:
    """key (the input row, or doc_id), n_words, n_removed and kept (the words that stay, joined by spaces)."""
    rows = keyed(docs, id_col, text_col)
    found = rows.join(marked(rows, window, gram, group), ["k1", "k2"], "left").select(F.col(key).alias("key"), "text", "marks")
    kind = found.schema["key"].dataType.simpleString()
    return found.mapInArrow(lambda batches: cut_out(batches, window, gram), f"key {kind}, n_words long, n_removed long, kept string")


def dedup_substrings(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input's rows and columns; a text that loses words is what stays of it, joined by spaces, others stay as they are."""
    out = judged(docs, window, id_col=id_col, text_col=text_col)
    kept = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.coalesce(F.col(f"key.{text_col}"), F.lit("")))
    return with_text(out.select(F.col("key").alias("row"), kept.alias("kept")), "kept", text_col)


def op8(docs: DataFrame) -> DataFrame:
    out = judged(docs, key="doc_id")
    return out.select(F.col("key").alias("doc_id"), "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
