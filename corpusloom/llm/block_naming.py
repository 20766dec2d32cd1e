"""Exact dedup by deterministic block naming, in DataFrame operations alone.

A normalised text (white space deleted) is cut into blocks of BLOCK characters.  The
distinct blocks are sorted and numbered; a text is then the list of its blocks'
numbers.  Adjacent numbers are paired, distinct pairs numbered in turn, and so on
until each text has one number: its identity, which no other text can share, as
numbers are given to contents and not to hashes.  A hash only finds a block's number
quickly; blocks that share a hash are told apart by content.

Null text counts as empty, and empty texts are equal.  The row of most code points in
its original text stays, then the smallest id, nulls first; rows alike in both are
ordered by their place in the input, so that exactly one row of a group stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WorkTable, texts

BLOCK = 4096
#: Stands in for the second number of a pair at the end of a list.
NONE = -1


def numbered(distinct: DataFrame, by: list[str]) -> DataFrame:
    """Distinct rows sorted and numbered; written, so that a number never changes once given."""
    return WorkTable(distinct.sortWithinPartitions(*by).select(*by, F.monotonically_increasing_id().alias("name"))).df


def name_blocks(held: DataFrame) -> DataFrame:
    """(uid, names) from (uid, blocks)."""
    found = held.select("uid", F.posexplode(F.transform("blocks", lambda b: F.xxhash64(b))).alias("place", "h"))
    blocks = held.select(F.explode("blocks").alias("block")).select(F.xxhash64("block").alias("h"), "block")
    named = WorkTable(blocks.distinct().sortWithinPartitions("h", "block").select("h", F.monotonically_increasing_id().alias("name"))).df
    shared = named.groupBy("h").agg(F.count("*").alias("n"), F.min("name").alias("name")).withColumnRenamed("h", "of")
    shared = WorkTable(shared).df
    out = found.join(shared.where("n = 1"), F.col("h") == F.col("of")).select("uid", "place", "name")
    if shared.where("n > 1").limit(1).count():  # hashes that several blocks share
        some = held.select("uid", F.posexplode("blocks").alias("place", "block")).withColumn("h", F.xxhash64("block"))
        some = some.join(shared.where("n > 1"), F.col("h") == F.col("of"), "left_semi")
        by_content = numbered(some.select("h", "block").distinct(), ["h", "block"])
        # below every other number, which are from 0 on
        apart = by_content.select(F.col("h").alias("of"), F.col("block").alias("content"), (F.lit(-2) - F.col("name")).alias("name"))
        out = out.unionByName(some.join(apart, (F.col("h") == F.col("of")) & (F.col("block") == F.col("content"))).select("uid", "place", "name"))
    return in_order(out)


def in_order(found: DataFrame) -> DataFrame:
    names = F.sort_array(F.collect_list(F.struct("place", "name")))
    return found.groupBy("uid").agg(F.transform(names, lambda x: x["name"]).alias("names"))


def identities(held: DataFrame, longest: int) -> DataFrame:
    """(uid, level, name): equal in both for equal block lists alone."""
    level, lists, out = 0, WorkTable(name_blocks(held)).df, None
    while True:
        done = lists.where(F.size("names") == 1).select("uid", F.lit(level).alias("level"), F.col("names")[0].alias("name"))
        out = done if out is None else out.unionByName(done)
        if longest <= 1:
            return out
        pairs = F.transform(F.sequence(F.lit(0), F.floor((F.size("names") - 1) / 2).cast("int")), lambda i: F.struct(F.get("names", 2 * i).alias("a"), F.coalesce(F.get("names", 2 * i + 1), F.lit(NONE)).alias("b")))
        found = lists.where(F.size("names") > 1).select("uid", F.posexplode(pairs).alias("place", "pair")).select("uid", "place", "pair.a", "pair.b")
        named = numbered(found.select("a", "b").distinct(), ["a", "b"])
        lists = WorkTable(in_order(found.join(named, ["a", "b"]).select("uid", "place", "name"))).df
        level, longest = level + 1, (longest + 1) // 2


def dedup(docs: DataFrame, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 and n_chars of every row."""
    bare = F.regexp_replace("text", r"[\x20\x09-\x0D]+", "")
    held = texts(docs, id_col, text_col).select("doc_id", F.length("text").alias("n_chars"), bare.alias("bare"))
    held = held.select(
        F.monotonically_increasing_id().alias("uid"), "doc_id", "n_chars", F.sha2(F.col("bare").cast("binary"), 256).alias("text_sha256"),
        F.when(F.length("bare") <= block, F.array("bare")).otherwise(F.regexp_extract_all("bare", F.lit(f"(?s).{{1,{block}}}"), F.lit(0))).alias("blocks"),
    )
    held = WorkTable(held).df
    longest = held.agg(F.max(F.size("blocks"))).first()[0] or 1
    rows = held.select("uid", "doc_id", "n_chars", "text_sha256").join(identities(held.select("uid", "blocks"), longest), "uid")
    rows = WorkTable(rows).df
    best = F.min(F.struct((-F.col("n_chars")).alias("short"), F.col("doc_id"), F.col("uid"))).alias("best")
    groups = rows.groupBy("level", "name").agg(F.count("*").alias("group_size"), best)
    out = rows.join(groups, ["level", "name"])
    return out.select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("uid") == F.col("best.uid")).alias("kept"), "text_sha256", "n_chars")


def op4(docs: DataFrame) -> DataFrame:
    return dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
