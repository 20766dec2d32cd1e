"""Keyed upsert of a table of sorted Parquet files: merge on read, then compaction that copies only what changed.

The table is written as files of `rows_per_file` rows in key order.  Changes are staged
beside it: which rows of a file go, by their Parquet row_index (its deletion vector),
and the new rows (upsert deltas).  Reading takes the files without the vectors' rows and
the deltas with them.  A file is marked if its vector isn't empty once updates without
effect are left out, or if rows are inserted into it; compaction writes anew only the
marked files, and joins neighbours that became small.

A key's home is found by one range sort of changed keys and files' first keys, rows of a
home that took many inserts are dealt by their places.  What meets in one task is the
rows of one file, a row a shuffle partition, and a few bytes for each file of a run of
neighbours written anew and not full.  The driver gets the names of replaced files, as
many as it deletes, one after the other.

Defined results: the change of a key with the highest order wins, of repeated ones the
greatest in all columns; a change without a key is none.  Rows of the table with a
repeated key stay, and a change applies to each; null keys stand first and never change.
Without starting files there is no home and changes do nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.work import work_dir
from .placing import file_place, in_order

#: The columns of op12's changes that an update sets.
SETS = ("source", "segment", "city", "balance")


@dataclass
class FileTable:
    """A table in a folder: `start` holds the first files, `rewritten` those of the compaction, `staging` what is pending."""

    spark: SparkSession
    folder: str
    schema: T.StructType
    key: str
    rows_per_file: int

    def read(self, part: str) -> DataFrame:
        """(row, key, file, row_index, path) of the files of one part; file is a number in their order."""
        found = self.spark.read.schema(self.schema).option("recursiveFileLookup", "true").parquet(f"{self.folder}/{part}")
        meta = found.metadataColumn("_metadata")
        return found.select(F.struct("*").alias("row"), F.col(self.key).alias("key"), file_place(meta["file_name"]).alias("file"), meta["row_index"].alias("row_index"), meta["file_path"].alias("path"))

    def files(self) -> DataFrame:
        """(file, first_key, n_rows, path) of the starting files."""
        return self.read("start").groupBy("file").agg(F.min_by("key", "row_index").alias("first_key"), F.count("*").alias("n_rows"), F.any_value("path").alias("path"))

    def staged(self, kind: str) -> DataFrame:
        """(file, row_index, row): kind is delete, update or insert."""
        schema = T.StructType([T.StructField("file", T.LongType()), T.StructField("row_index", T.LongType()), T.StructField("row", self.schema)])
        return self.spark.read.schema(schema.add("kind", "string")).parquet(f"{self.folder}/staging").where(F.col("kind") == kind).drop("kind")

    def merged(self) -> DataFrame:
        """(row, key, file): the table as it reads while changes are pending."""
        gone = self.staged("delete").unionByName(self.staged("update")).select("file", "row_index")
        deltas = self.staged("update").unionByName(self.staged("insert"))
        kept = self.read("start").join(gone, ["file", "row_index"], "left_anti").select("row", "key", "file")
        return kept.unionByName(deltas.select("row", F.col("row")[self.key].alias("key"), "file"))

    def marked(self) -> DataFrame:
        """The files with a vector or inserted rows."""
        return self.spark.read.schema("file long, kind string").parquet(f"{self.folder}/staging").select("file").distinct()


def tie(row: str, schema: T.StructType) -> Column:
    """Orders rows of one key alike each time."""
    return F.xxhash64(*[F.col(row)[f.name] for f in schema.fields if "map<" not in f.dataType.simpleString()])


def create(df: DataFrame, key: str, rows_per_file: int) -> FileTable:
    """Writes a table, sorted by key, as files of exactly rows_per_file rows but for the last one."""
    out = FileTable(df.sparkSession, work_dir(df.sparkSession), T.StructType([T.StructField(f.name, f.dataType) for f in df.schema]), key, rows_per_file)
    rows = df.select(F.struct("*").alias("row"), F.col(key).alias("key"))
    placed, table = in_order(rows, [F.col("key"), tie("row", df.schema)])
    cut = placed.select("row", "place", F.floor(F.col("place") / rows_per_file).alias("file"))
    # a task holds whole files, the last of all at its end, so that the writer's own limit cuts between them
    dealt = cut.repartitionByRange("file").sortWithinPartitions("place").select("row.*")
    dealt.write.option("maxRecordsPerFile", rows_per_file).parquet(f"{out.folder}/start")
    table.drop()
    return out


def winners(changes: DataFrame, key: str, order: list[str]) -> DataFrame:
    """(key, change): the last change of each key."""
    rest = [c for c in changes.columns if c not in order]
    sortable = [c for c in rest if "map<" not in dict(changes.dtypes)[c]]
    rows = changes.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.struct(*order, *sortable, *[c for c in rest if c not in sortable]).alias("change"))
    return rows.groupBy("key").agg(F.max("change").alias("change"))


def with_home(table: FileTable, keys: DataFrame) -> DataFrame:
    """Adds home, the last starting file that begins at or below the key, else the first, and home_key, its first key; no rows without starting files."""
    files = table.files()
    first = files.agg(F.min_by(F.struct("file", "first_key"), "file").alias("f")).first()["f"]
    if first is None:
        return keys.withColumns({"home": F.lit(None).cast("long"), "home_key": F.lit(None).cast(keys.schema["key"].dataType)}).where(F.lit(False))
    marks = files.select(F.col("first_key").alias("key"), F.struct("file", "first_key").alias("mark"))
    both = marks.unionByName(keys, allowMissingColumns=True)
    lowest = F.struct(F.lit(first["file"]).alias("file"), F.lit(first["first_key"]).cast(keys.schema["key"].dataType).alias("first_key"))
    placed, _ = in_order(both, [F.col("key"), F.col("mark.file").asc_nulls_last()], lasts={"home_mark": F.col("mark")})
    at = F.coalesce("home_mark", lowest)
    return placed.where("mark is null").withColumns({"home": at["file"], "home_key": at["first_key"]}).select(*keys.columns, "home", "home_key")


def stage(table: FileTable, changes: DataFrame, order: list[str], sets: tuple[str, ...], ignored: Callable[[Column], Column], deletes: Callable[[Column], Column]) -> None:
    """Writes deletion vectors and upsert deltas of the winning changes; `ignored` and `deletes` are told the first key of a change's home and may use column `change`."""
    home = F.col("home_key")
    acting = with_home(table, winners(changes, table.key, order)).where(~F.coalesce(ignored(home), F.lit(False))).withColumn("gone", F.coalesce(deletes(home), F.lit(False))).select("key", "change", "home", "gone")
    new = F.col("row")
    for c in sets:
        new = new.withField(c, F.col("change")[c].cast(table.schema[c].dataType))
    same = F.lit(True)
    for c in sets:
        same = same & F.col("row")[c].eqNullSafe(F.col("change")[c].cast(table.schema[c].dataType))
    rows = table.read("start").select("row", "key", "file", "row_index")
    touched = rows.join(acting, "key").where(F.col("gone") | ~same).select("file", "row_index", new.alias("row"), F.when(F.col("gone"), "delete").otherwise("update").alias("kind"))
    absent = acting.where(~F.col("gone")).join(rows.select("key"), "key", "left_anti")
    value = lambda f: F.col("key") if f.name == table.key else F.col("change")[f.name] if f.name in sets else F.lit(None)
    inserted = absent.select(F.col("home").alias("file"), F.lit(None).cast("long").alias("row_index"), F.struct(*[value(f).cast(f.dataType).alias(f.name) for f in table.schema]).alias("row"), F.lit("insert").alias("kind"))
    touched.unionByName(inserted).write.partitionBy("kind").parquet(f"{table.folder}/staging")


def cut_evenly(homes: DataFrame, most: int) -> DataFrame:
    """(file, piece, size, low): the fewest pieces of at most `most` of a home's n rows, sizes at most one apart, larger first; low is the place of the first row."""
    k = F.floor((F.col("n") + most - 1) / most).cast("long")
    each = homes.withColumn("k", k).withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)))
    small, larger = F.floor(F.col("n") / F.col("k")).cast("long"), F.col("n") % F.col("k")
    return each.select("file", "piece", (small + F.when(F.col("piece") < larger, 1).otherwise(0)).alias("size"), (F.col("low") + F.col("piece") * small + F.least("piece", larger)).alias("low"))


def joined_neighbours(pieces: DataFrame, unchanged: DataFrame, most: int) -> DataFrame:
    """Adds bin to pieces: in ascending order each joins the one to its left, as grown, where both have at most `most` rows.

    Unchanged files and full pieces part the runs within which that may happen.
    """
    wall = F.col("size").isNull() | (F.col("size") >= most)
    both = pieces.unionByName(unchanged.select("file", F.lit(0).cast("long").alias("piece")), allowMissingColumns=True)
    placed, _ = in_order(both, [F.col("file"), F.col("piece")], {"walls": F.when(wall, 1).otherwise(0)}, place="number")
    alone = placed.where((F.col("size") >= most) & F.col("size").isNotNull()).select("file", "piece", "size", "low", F.col("number").alias("bin"))

    def grow(run: pd.DataFrame) -> pd.DataFrame:
        run = run.sort_values("number")
        bins, held = [], most + 1
        for number, size in zip(run["number"], run["size"], strict=True):
            joins = held + size <= most
            held = held + size if joins else size
            bins.append(bins[-1] if joins else number)
        return run.assign(bin=bins)[["file", "piece", "size", "low", "bin"]]

    runs = placed.where(F.col("size") < most).select("file", "piece", "size", "low", "number", "walls")
    return alone.unionByName(runs.groupBy("walls").applyInPandas(grow, "file long, piece long, size long, low long, bin long"))


def compact(table: FileTable) -> None:
    """Writes the marked files anew, then deletes those and what was staged."""
    most, marked = table.rows_per_file, table.marked()
    rows = table.merged().join(marked, "file", "left_semi")
    placed, held = in_order(rows, [F.col("file"), F.col("key"), tie("row", table.schema)])
    homes = placed.groupBy("file").agg(F.count("*").alias("n"), F.min("place").alias("low"))
    unchanged = table.files().join(marked, "file", "left_anti")
    bins = joined_neighbours(cut_evenly(homes, most), unchanged, most)
    # a home may have any number of rows: they meet their pieces by stretches of places
    block = lambda c: F.floor(c / most).cast("long")
    at = bins.select("file", "low", (F.col("low") + F.col("size")).alias("high"), "bin", F.explode(F.sequence(block(F.col("low")), block(F.col("low") + F.col("size") - 1))).alias("block"))
    dealt = placed.withColumn("block", block(F.col("place"))).join(at, ["file", "block"]).where("place >= low and place < high")
    number = "bin"
    while number in table.schema.names:
        number += "_"
    written = dealt.select("row", "place", F.col("bin").alias(number)).repartition(number).sortWithinPartitions(number, "place")
    written.select("row.*", number).write.partitionBy(number).parquet(f"{table.folder}/rewritten")
    held.drop()
    java, conf = table.spark._jvm, table.spark._jsc.hadoopConfiguration()
    for old in table.files().join(marked, "file", "left_semi").select("path").toLocalIterator():
        path = java.org.apache.hadoop.fs.Path(java.java.net.URI(old["path"]))
        path.getFileSystem(conf).delete(path, False)
    staging = java.org.apache.hadoop.fs.Path(f"{table.folder}/staging")
    staging.getFileSystem(conf).delete(staging, True)


def final_rows(table: FileTable) -> DataFrame:
    """(row, key, path, row_index, rewritten) of the table's files after compaction."""
    part = lambda name, new: table.read(name).select("row", "key", "path", "row_index", F.lit(new).alias("rewritten"))
    return part("start", False).unionByName(part("rewritten", True))


def upsert(base: DataFrame, changes: DataFrame, key: str, rows_per_file: int, order: list[str], sets: tuple[str, ...], ignored: Callable[[Column], Column], deletes: Callable[[Column], Column]) -> FileTable:
    """A new table from base with the changes applied and compacted."""
    table = create(base, key, rows_per_file)
    stage(table, changes, order, sets, ignored, deletes)
    compact(table)
    return table


def crc(value: Column) -> Column:
    """Of a value as text; of null as of ''."""
    return F.crc32(F.coalesce(value.cast("string"), F.lit("")).cast("binary"))


def op12(clients: DataFrame, changes: DataFrame) -> DataFrame:
    """A row a file of `clients` after its changes; a balance that isn't finite counts no cents."""
    most = 1 + clients.count() // 1500
    base = clients.where("client_id is not null").where(crc(F.col("client_id")) % 7 > 3)
    h = lambda first: crc(first) % 10
    gone = lambda first: F.coalesce(F.col("change.op") == "D", F.lit(False)) | (F.col("change.change_id").isNotNull() & (crc(F.col("change.change_id")) % 8 < h(first)))
    table = upsert(base, changes, "client_id", most, ["seq", "change_id"], SETS, lambda first: h(first) > 7, gone)
    balance = F.col("row.balance")
    cents = F.when(balance.isNotNull() & ~F.isnan(balance) & (F.abs(balance) < float("inf")), F.floor(100 * balance + 0.5)).otherwise(0).cast("long")
    text = F.concat_ws("|", *[F.coalesce(F.col(f"row.{c}"), F.lit("")) for c in ("source", "segment", "city")])
    ids = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_index", F.col("key").cast("string").alias("id")))), lambda x: x["id"]), ",")
    files = final_rows(table).groupBy("path", "rewritten").agg(
        F.min("key").alias("first_id"), F.count("*").alias("n_rows"), F.sum(cents).alias("cents"), F.sum(crc(text)).alias("rows_crc"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"),
    )
    return files.select("first_id", "n_rows", "cents", "rows_crc", "ids_sha256", F.lit(",".join(table.schema.names)).alias("columns"), F.regexp_replace("path", "^file:/(?!/)", "file:///").alias("path"), "rewritten")
