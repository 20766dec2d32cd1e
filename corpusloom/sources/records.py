"""Record files: one JSON object a line, read with an explicit schema."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .named_files import write_named

GRADING = "struct<grade:boolean,solution:boolean,locked:boolean,grade_id:string,points:double,checksum:string>"
CELL = f"struct<cell_type:string,source:string,execution_count:bigint,outputs:array<struct<output_type:string>>,metadata:struct<nbgrader:{GRADING}>>"
NOTEBOOK = f"cells array<{CELL}>, worksheets array<struct<cells:array<{CELL}>>>, metadata struct<nb_index:bigint,repo:string,path:string,kernelspec:struct<name:string,language:string>>, nbformat int, nbformat_minor int"
CRAWL = "contents string, repo string, path string"


def read_records(spark: SparkSession, path: str, schema: str | T.StructType, extension: str = "*", first: int | None = None) -> DataFrame:
    """JSON lines under a path; a line that isn't JSON keeps its text in _corrupt_record if the schema has that column."""
    out = spark.read.schema(schema).option("mode", "PERMISSIVE").option("pathGlobFilter", extension).json(path)
    return out if first is None else out.limit(first)


def iterate_records(records: DataFrame, first: int | None = None) -> Iterator[Row]:
    """Rows one after the other, a partition of them at the driver at a time."""
    return (records if first is None else records.limit(first)).toLocalIterator(prefetchPartitions=True)


def read_lines(spark: SparkSession, path: str, without: str | None = None) -> DataFrame:
    """Raw lines, those that hold `without` left out before anything is parsed."""
    out = spark.read.text(path)
    return out if without is None else out.where(~F.contains("value", F.lit(without)))


def notebook_of(text: Column) -> Column:
    """A NOTEBOOK struct from its JSON text; null where that isn't a JSON object with cells.

    Fields are taken by kind, whatever else a notebook holds: a source may be a text or a
    list of lines, which are put together; any other empty value is ''.  A missing
    execution count is 0 and a null one stays null; missing outputs are none.  Metadata
    that are a list, or anything but an object, count as none.  Cells that aren't objects
    are empty cells, which keep their place.
    """
    whole = F.try_parse_json(text)
    get = lambda v, path, kind: F.try_variant_get(v, path, kind)
    empty = F.array().cast("array<struct<output_type:string>>")

    def cell(v: Column) -> Column:
        count, lines = get(v, "$.execution_count", "variant"), get(v, "$.source", "array<string>")
        source = F.when(F.schema_of_variant(get(v, "$.source", "variant")).isin("BIGINT", "BOOLEAN", "VOID") & (get(v, "$.source", "double").isNull() | (get(v, "$.source", "double") == 0)), "").otherwise(F.coalesce(F.array_join(lines, ""), get(v, "$.source", "string"), F.lit("")))
        outputs = get(v, "$.outputs", "array<struct<output_type:string>>")
        held = get(v, "$.metadata.nbgrader", GRADING)
        return F.struct(
            F.coalesce(get(v, "$.cell_type", "string"), F.lit("")).alias("cell_type"), source.alias("source"), F.when(count.isNull(), F.lit(0).cast("long")).otherwise(get(v, "$.execution_count", "bigint")).alias("execution_count"),
            F.coalesce(outputs, empty).alias("outputs"), F.struct(held.alias("nbgrader")).alias("metadata"),
        )

    cells = lambda v: F.transform(get(v, "$.cells", "array<variant>"), cell)
    sheets = F.transform(get(whole, "$.worksheets", "array<variant>"), lambda w: F.struct(cells(w).alias("cells")))
    named = lambda f: get(whole, f"$.metadata.{f}", "string").alias(f)
    kernel = get(whole, "$.metadata.kernelspec", "struct<name:string,language:string>")
    meta = F.struct(get(whole, "$.metadata.nb_index", "bigint").alias("nb_index"), named("repo"), named("path"), kernel.alias("kernelspec"))
    version = lambda f: get(whole, f"$.{f}", "int").alias(f)
    told = F.struct(cells(whole).alias("cells"), sheets.alias("worksheets"), meta.alias("metadata"), version("nbformat"), version("nbformat_minor"))
    return F.when(get(whole, "$.cells", "array<variant>").isNotNull() | get(whole, "$.worksheets", "array<variant>").isNotNull(), told)


def decode_notebooks(lines: DataFrame, column: str = "value") -> DataFrame:
    """Notebooks from lines that hold one each; lines without one go."""
    return lines.select(notebook_of(F.col(column)).alias("nb")).where("nb is not null").select("nb.*")


def decode_crawl(lines: DataFrame, column: str = "value") -> DataFrame:
    """Notebooks from crawl records whose contents are JSON in a string; records without a notebook go."""
    outer = lines.select(F.from_json(column, CRAWL).alias("r")).select("r.*")
    body = outer.select(notebook_of(F.col("contents")).alias("nb"), "repo", "path").where(F.col("nb").isNotNull() & F.col("nb.cells").isNotNull())
    meta = F.col("nb.metadata")
    return body.select("nb.cells", "nb.worksheets", F.struct(F.lit(None).cast("bigint").alias("nb_index"), "repo", "path", meta["kernelspec"].alias("kernelspec")).alias("metadata"), "nb.nbformat", "nb.nbformat_minor")


def encode_notebooks(notebooks: DataFrame) -> DataFrame:
    return notebooks.select(F.to_json(F.struct("*")).alias("value"))


def all_cells(notebooks: DataFrame) -> DataFrame:
    """Notebooks of either format with their cells in one array."""
    return notebooks.withColumn("cells", F.coalesce("cells", F.flatten(F.transform("worksheets", lambda w: w["cells"]))))


def write_records(df: DataFrame, path: str, single: str | None = None) -> None:
    """JSON lines, replacing what stood there; with `single` one file of that name, which one task writes as the rows come."""
    if single is None:
        df.write.mode("overwrite").json(path)
    else:
        write_named(df.select(F.lit(single).alias("name"), F.concat(F.to_json(F.struct("*")), F.lit("\n")).alias("value")).coalesce(1), path)


@contextmanager
def split_size(spark: SparkSession, size: str) -> Iterator[None]:
    """Reads planned and run inside cut files into splits of `size`, such as 120m."""
    name = "spark.sql.files.maxPartitionBytes"
    held = spark.conf.get(name)
    spark.conf.set(name, size)
    try:
        yield
    finally:
        spark.conf.set(name, held)


def dump_notebooks(notebooks: DataFrame, path: str) -> None:
    """Each notebook as one JSON document in a file nb_<index>.ipynb, in folders of about 1,000 files, for people to look at."""
    meta = F.col("metadata")
    body = F.struct("cells", F.struct(meta["kernelspec"].alias("kernelspec")).alias("metadata"), F.coalesce("nbformat", F.lit(4)).alias("nbformat"), F.coalesce("nbformat_minor", F.lit(2)).alias("nbformat_minor"))
    write_named(notebooks.select(F.format_string("nb_%d.ipynb", meta["nb_index"]).alias("name"), F.to_json(body).alias("value")), path, notebooks.count())


def count_lines(spark: SparkSession, path: str) -> int:
    return spark.read.text(path).count()
