"""Mixing sources to target weights: a low-discrepancy schedule of equal blocks of words, in DataFrame functions alone.

Each source's documents are shuffled by a hash and their words cut into blocks of
`block` words.  A source that is to give t words owns as many slots as it takes blocks
for them, whole passes over its words first.  Slots are numbers 0 to 2^k - 1; slot n's
point is n with its k bits reversed (van der Corput), and a source owns the slots whose
points fall into its interval of the cumulated numbers of slots, so that the parts of
every stretch of the schedule are those of the whole but for a few slots a source.
A source's slots, ranked, take its blocks in turn, the last one only up to t words.

The rank of a slot in its source is counted from the bits of its point, not by sorting;
running sums of sizes go by (source, hash prefix), so a source with any share of all
rows is dealt over 4,096 groups a pass.

Defined results: a null text has no words; null is a source, the last one; null and
repeated ids are rows like others, rows alike in id, source and size are interchangeable;
a row without words takes none; without any words all targets are 0; an empty table
gives no rows.  Other columns aren't touched.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.work import WorkTable
from .placing import in_order

WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
#: Words a slot takes.
BLOCK = 1024
#: Slots that one row lists at most.
CHUNK = 1 << 14
WORD = r"[^\x20\x09-\x0D]+"


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "42") -> DataFrame:
    """(doc_id, key, size, draw, bucket): key is the source in code point order, null last; draw shuffles, bucket is its beginning."""
    doc_id, text, source = F.col(id_col).cast("long"), F.col(text_col).cast("string"), F.col(source_col).cast("string")
    draw = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    rows = docs.select(doc_id.alias("doc_id"), F.coalesce(F.concat(F.lit("0"), source), F.lit("1")).alias("key"), F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"), draw.alias("draw"))
    return rows.withColumn("bucket", F.substring("draw", 1, 3))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> tuple[DataFrame, list[WorkTable]]:
    """(key, size) with source (its number in the order of keys), weight and target.

    All sources together get share times all sizes by weight; what would be over `most`
    times a source's size goes to the others by weight, until none is above.  In the
    order of size by weight, those above are a beginning: the first source that isn't
    above when all before it are marks its end.
    """
    numbered, one = in_order(sources, [F.col("key")], place="source")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("source") % len(weights) + 1).cast("int")).cast("long")
    told = numbered.withColumn("weight", weight).withColumn("room", F.col("size") * most)
    placed, two = in_order(told, [F.col("room") / F.col("weight"), F.col("source")], {"room_before": F.col("room"), "weight_before": F.col("weight")}, place="fullness")
    whole = placed.agg(F.sum("size").alias("size"), F.sum("weight").alias("weight")).first()
    wanted, weighed = share * (whole["size"] or 0), whole["weight"] or 0
    level = (F.lit(wanted) - F.col("room_before")), F.lit(weighed) - F.col("weight_before")
    fits = F.col("room").cast("double") * level[1] >= F.col("weight") * level[0]
    end = placed.where(fits).agg(F.min_by(F.struct("fullness", level[0].alias("words"), level[1].alias("weights")), "fullness").alias("e")).first()["e"]
    full = F.lit(True) if end is None else F.col("fullness") < end["fullness"]
    even = F.lit(0.0) if end is None else F.col("weight") * F.lit(end["words"]) / F.lit(float(end["weights"]))
    return placed.select("key", "size", "source", "weight", F.when(full, F.col("room").cast("double")).otherwise(even).alias("target")), [one, two]


def below(point: Column, bound: Column, bits: int) -> Column:
    """How many numbers smaller than the one whose reversed bits are `point` have reversed bits below `bound`."""
    terms = [F.lit(0).cast("long")]
    for t in range(bits):  # the smaller numbers that differ first at bit t: a progression of step 2^(bits - t)
        high = bits - 1 - t
        free = F.shiftright(bound - point.bitwiseAND(F.lit((1 << high) - 1)) + F.lit((1 << (bits - t)) - 1), bits - t)
        terms.append(F.when(F.shiftright(point, high).bitwiseAND(F.lit(1)) == 1, F.greatest(free, F.lit(0).cast("long"))).otherwise(F.lit(0).cast("long")))
    return functools.reduce(operator.add, terms)


def reversed_bits(number: Column, bits: int) -> Column:
    return F.conv(F.reverse(F.lpad(F.bin(number), bits, "0")), 2, 10).cast("long")


def slots(sources: DataFrame, block: int = BLOCK) -> tuple[DataFrame, WorkTable]:
    """(source, slot, rank, pass, block, words): which block each slot takes in which pass, and how many of its words."""
    goal, size = F.floor("target").cast("long"), F.col("size")
    blocks = lambda words: F.floor((words + block - 1) / block).cast("long")
    passes = F.when(size > 0, F.floor(goal / size).cast("long")).otherwise(0)
    own = sources.select("source", "size", goal.alias("goal"), blocks(size).alias("blocks"), (passes * blocks(size) + blocks(goal - passes * size)).alias("slots")).where("slots > 0")
    placed, table = in_order(own, [F.col("source")], {"first": F.col("slots")})
    total = placed.agg(F.sum("slots")).first()[0] or 0
    bits = max(1, (total - 1).bit_length())
    chunks = placed.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("slots") - 1) / CHUNK)))).repartition("source", "chunk")
    each = chunks.withColumn("i", F.explode(F.sequence(F.col("chunk") * CHUNK, F.least(F.col("chunk") * CHUNK + CHUNK, F.col("slots")) - 1)))
    each = each.withColumn("point", F.col("first") + F.col("i"))
    rank = below(F.col("point"), F.col("first") + F.col("slots"), bits) - below(F.col("point"), F.col("first"), bits)
    each = each.withColumn("slot", reversed_bits(F.col("point"), bits)).withColumn("rank", rank)
    each = each.withColumn("pass", F.floor(F.col("rank") / F.col("blocks")).cast("long")).withColumn("block", F.col("rank") % F.col("blocks"))
    left = F.least(F.col("size") - F.col("block") * block, F.lit(block), F.col("goal") - F.col("pass") * F.col("size") - F.col("block") * block)
    return each.select("source", "slot", "rank", "pass", "block", left.alias("words")), table


class Mix:
    """A mix of documents: `docs` (a row a document, with its source's size and target), `pieces` (what each slot takes of which document) and the tables both are read from."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, block: int = BLOCK, seed: str = "42"):
        rows = WorkTable(sized(docs, id_col, text_col, source_col, seed))
        buckets = WorkTable(rows.df.groupBy("key", "bucket").agg(F.sum("size").alias("words")))
        told, tables = targets(buckets.df.groupBy("key").agg(F.sum("words").alias("size")), weights, share, most)
        sources = WorkTable(told)
        dealt, third = slots(sources.df, block)
        taking = WorkTable(dealt)
        self.sources, self.slots, self.tables = sources.df, taking.df, [rows, buckets, sources, taking]
        for t in (*tables, third):
            t.drop()
        before = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        starts = buckets.df.select("key", "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("offset"))
        starts = starts.join(self.sources.select("key", "source", F.col("size").alias("source_size"), "target"), "key")
        within = Window.partitionBy("key", "bucket").orderBy("draw", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
        placed = rows.df.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0))).join(starts, ["key", "bucket"])
        #: (doc_id, source, size, source_size, target, start): start counts the words of its source's shuffled documents before it.
        self.docs = placed.select("doc_id", "source", "size", "source_size", "target", (F.col("offset") + F.col("inside")).alias("start"))
        cut = self.docs.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))))
        self._cut = cut.withColumns({"low": F.greatest(F.col("start") - F.col("block") * block, F.lit(0)), "high": F.least(F.col("start") + F.col("size") - F.col("block") * block, F.lit(block))})
        self.block = block

    def pieces(self) -> DataFrame:
        """(slot, at, doc_id, source, pass, first_word, n_words): the mix in the order of (slot, at); words count from 0 in their document."""
        met = self._cut.join(self.slots, ["source", "block"]).where("low < words")
        return met.select("slot", F.col("low").alias("at"), "doc_id", "source", "pass", (F.col("block") * self.block + F.col("low") - F.col("start")).alias("first_word"), (F.least("high", "words") - F.col("low")).alias("n_words"))

    def taken(self) -> DataFrame:
        """A row a document: doc_id, size, source_size, target, taken."""
        words = F.greatest(F.least(F.col("high"), F.coalesce("words", F.lit(0))) - F.col("low"), F.lit(0))
        met = self._cut.join(self.slots.select("source", "block", "words"), ["source", "block"], "left")
        some = met.groupBy("source", "start").agg(*[F.any_value(c).alias(c) for c in ("doc_id", "size", "source_size", "target")], F.coalesce(F.sum(words), F.lit(0)).alias("taken"))
        none = self.docs.where("size = 0").withColumn("taken", F.lit(0).cast("long"))
        columns = ("doc_id", "size", "source_size", "target", "taken")
        return some.select(*columns).unionByName(none.select(*columns))


def op11(docs: DataFrame) -> DataFrame:
    return Mix(docs).taken()
