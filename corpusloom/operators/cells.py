"""Notebooks as rows, one a cell, and the operators that look at a cell's neighbours.

All windows share one partitioning and ordering (notebook, cell index), so a plan of
several of them sorts once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..functions.language import has_code_tag
from ..sources.work import merging


def in_order() -> WindowSpec:
    return Window.partitionBy("nb_index").orderBy("cell_index")


def explode_cells(notebooks: DataFrame) -> DataFrame:
    """Cells with ids from their place in the notebook; missing fields get defaults, a null execution count stays null."""
    meta = F.col("metadata")
    rows = notebooks.select(meta["nb_index"].alias("nb_index"), meta["repo"].alias("repo"), meta["path"].alias("path"), F.posexplode("cells").alias("cell_index", "cell"))
    cell = F.col("cell")
    return rows.select(
        "nb_index", "cell_index", "repo", "path", F.coalesce(cell["cell_type"], F.lit("")).alias("cell_type"), F.coalesce(cell["source"], F.lit("")).alias("source"), cell["execution_count"].alias("execution_count"),
        F.coalesce(cell["outputs"], F.array().cast("array<struct<output_type:string>>")).alias("outputs"), cell["metadata"]["nbgrader"].alias("nbgrader"),
    )


def is_code() -> Column:
    return F.col("cell_type") == "code"


def is_markdown() -> Column:
    return F.col("cell_type") == "markdown"


def is_valid() -> Column:
    return (F.col("source") != "") & F.col("cell_type").isNotNull()


def is_strictly_valid() -> Column:
    return is_valid() & (F.col("cell_type") != "")


def kernel_name(kernelspec: Column) -> Column:
    return F.when(kernelspec.isNull(), "no kernel specified").otherwise(F.coalesce(kernelspec["language"], F.lit("no lang")))


def python_notebooks(notebooks: DataFrame) -> DataFrame:
    return notebooks.where(kernel_name(F.col("metadata.kernelspec")).isin("python", "python2"))


def is_python_notebook(kernelspec: Column, version: int | None = None) -> Column:
    """By the kernel's language, or for a version by its name (python3)."""
    told = kernelspec["language"] == "python" if version is None else kernelspec["name"] == f"python{version}"
    return F.coalesce(told, F.lit(False))


def make_cell(kind: Column, lines: Column) -> Column:
    """A cell as it stands in a notebook, from an array of lines."""
    return F.struct(kind.alias("cell_type"), F.array_join(lines, "\n").alias("source"), F.lit(None).cast("bigint").alias("execution_count"), F.array().cast("array<struct<output_type:string>>").alias("outputs"))


def with_code_tags(cells: DataFrame) -> DataFrame:
    """Cells of notebooks in which some markdown renders to HTML with a code tag; a notebook's answer is found before its cells are."""
    maybe = is_markdown() & F.col("source").rlike(r"(?i)`|~~~|<code|(?m)^(?: {4}|[ >]*\t)|(?:[-+*>]|\d[.)]) {4}")
    tagged = cells.where(maybe).where(has_code_tag(F.col("source"))).select("nb_index").distinct()
    return cells.join(merging(tagged), "nb_index", "left_semi")


def without_sources(cells: DataFrame, sources: list[str]) -> DataFrame:
    return cells.where(~F.col("source").isin(*sources)) if sources else cells


def repos_with_cells(cells: DataFrame) -> DataFrame:
    """Cells of each repo that has one at least, and its notebooks."""
    return cells.groupBy("repo").agg(F.count("*").alias("n_cells"), F.count_distinct("path").alias("n_notebooks"))


def in_languages(df: DataFrame, language: Column, wanted: tuple[str, ...] = ("English", "un")) -> DataFrame:
    return df.where(language.isin(*wanted))


def markdown_ratio(cells: DataFrame, least: float = 0.0) -> DataFrame:
    """Share of markdown among a notebook's cells, where it is `least` or more."""
    share = cells.groupBy("nb_index").agg(F.avg(F.when(is_markdown(), 1.0).otherwise(0.0)).alias("ratio"), F.count("*").alias("n_cells"), F.count_if(is_code()).alias("n_code"), F.count_if(is_markdown()).alias("n_markdown"))
    return share.where(F.col("ratio") >= least)


def code_after_markdown(cells: DataFrame) -> DataFrame:
    return cells.withColumn("above", F.lag("cell_type").over(in_order())).where(is_code() & (F.col("above") == "markdown")).drop("above")


def ascii_only(cells: DataFrame) -> DataFrame:
    """Without notebooks in which markdown directly above code holds a non-ASCII character."""
    flagged = cells.withColumn("_below", F.lead("cell_type").over(in_order()))
    bad = F.coalesce(is_markdown() & (F.col("_below") == "code") & ~X.is_ascii(F.col("source")), F.lit(False))
    return flagged.withColumn("_veto", F.max(bad).over(Window.partitionBy("nb_index"))).where(~F.col("_veto")).drop("_below", "_veto")


def train_cells(cells: DataFrame) -> DataFrame:
    """Code directly below markdown, in notebooks whose such markdown is all ASCII: one sort for all three windows."""
    seen = cells.withColumn("_above", F.lag(F.struct("cell_type", "source")).over(in_order()))
    below = is_code() & (F.col("_above.cell_type") == "markdown")
    bad = F.coalesce(below & ~X.is_ascii(F.col("_above.source")), F.lit(False))
    every = in_order().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return seen.withColumn("_veto", F.max(bad).over(every)).where(below & ~F.col("_veto")).drop("_above", "_veto")


def markdown_within(cells: DataFrame, distance: int, name: str = "has_markdown") -> DataFrame:
    """Whether one of the `distance` cells above is markdown, be it empty."""
    near = in_order().rowsBetween(-distance, -1)
    return cells.withColumn(name, F.coalesce(F.max(is_markdown()).over(near), F.lit(False)))


def nearest_markdown(cells: DataFrame, distance: int, name: str = "nl", value: str = "source") -> DataFrame:
    """`value` of the nearest markdown above that isn't empty, at most `distance` cells away."""
    near = in_order().rowsBetween(-distance, -1)
    return cells.withColumn(name, F.last(F.when(is_markdown() & is_valid(), F.col(value)), ignorenulls=True).over(near))


def markdown_distance(cells: DataFrame, distance: int, name: str = "nl_distance") -> DataFrame:
    """How far above the cell of nearest_markdown() is; 0 without one."""
    near = in_order().rowsBetween(-distance, -1)
    at = F.last(F.when(is_markdown() & is_valid(), F.col("cell_index")), ignorenulls=True).over(near)
    return cells.withColumn(name, F.coalesce(F.col("cell_index") - at, F.lit(0)))


def test_outcomes(rows: DataFrame, is_test: Column, passed: Column, has_outputs: Column, keys: list[str], order: list[str]) -> DataFrame:
    """test_below_passed: outcome of the nearest test below, null without one; from_output_nb: whether any test below has outputs; any_test_below."""
    below = Window.partitionBy(*keys).orderBy(*order).rowsBetween(1, Window.unboundedFollowing)
    return rows.withColumns({
        "test_below_passed": F.first(F.when(is_test, passed), ignorenulls=True).over(below),
        "from_output_nb": F.coalesce(F.max(is_test & has_outputs).over(below), F.lit(False)),
        "any_test_below": F.coalesce(F.max(is_test).over(below), F.lit(False)),
    })


def cell_passed(execution_count: Column, outputs: Column) -> Column:
    """A test passes unless it shows an error or was never run (count 0); a null count passes."""
    return ~(F.coalesce(F.get(outputs, F.lit(0))["output_type"] == "error", F.lit(False)) | F.coalesce(execution_count == 0, F.lit(False)))


def exploded_context(cells: DataFrame, targets: DataFrame, length: int) -> DataFrame:
    """A row for each target and each valid cell at most `length` above it, with its distance."""
    above = cells.where(is_valid()).select("nb_index", F.col("cell_index").alias("context_index"), F.col("cell_type").alias("context_type"), F.col("source").alias("context_source"))
    distance = F.col("cell_index") - F.col("context_index")
    return targets.join(merging(above), "nb_index").where(distance.between(1, length)).withColumn("distance_target", distance)


def with_context(cells: DataFrame, length: int, fields: list[str] | dict[str, str], wanted: Column | None = None) -> DataFrame:
    """`context`: the valid (and wanted) cells at most `length` above, nearest first, with their distance and `fields` (columns, or columns by name), and `num_cells_above`."""
    named = fields if isinstance(fields, dict) else {f: f for f in fields}
    use = is_valid() if wanted is None else is_valid() & wanted
    held = F.when(use, F.struct(F.col("cell_index").alias("at"), *[F.col(c).alias(f) for f, c in named.items()]))
    frame = in_order().rowsBetween(-length, -1)
    own = cells.withColumn("_above", F.reverse(F.collect_list(held).over(frame)))
    context = F.transform("_above", lambda c: F.struct((F.col("cell_index") - c["at"]).cast("int").alias("distance_target"), *[c[f].alias(f) for f in named]))
    return own.withColumn("context", context).withColumn("num_cells_above", F.col("cell_index")).drop("_above")


def runs(rows: DataFrame, keys: list[str], order: list[str], flag: Column, name: str = "run") -> DataFrame:
    """`name`: the number, from 1, of the run of equal flags that a row lies in, by keys and in order; null is a flag like others."""
    placed = Window.partitionBy(*keys).orderBy(*order)
    first = (F.row_number().over(placed) == 1) | ~flag.eqNullSafe(F.lag(flag).over(placed))
    begun = rows.withColumn("_begins", first.cast("int"))
    return begun.withColumn(name, F.sum("_begins").over(placed.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_begins")


def last_markdown(cells: DataFrame, name: str = "above") -> DataFrame:
    """`name`: struct (cell_index, source) of the nearest markdown above that isn't empty, however far, in one pass over a notebook."""
    above = in_order().rowsBetween(Window.unboundedPreceding, -1)
    return cells.withColumn(name, F.last(F.when(is_markdown() & is_valid(), F.struct("cell_index", "source")), ignorenulls=True).over(above))


def notebook_context(cells: DataFrame, fields: dict[str, str], wanted: Column | None = None) -> DataFrame:
    """(nb_index, cells): one array a notebook of its valid (and wanted) cells in order, with their place `at` and `fields` (columns by name)."""
    use = cells.where(is_valid() if wanted is None else is_valid() & wanted)
    one = F.struct(F.col("cell_index").alias("at"), *[F.col(c).alias(f) for f, c in fields.items()])
    return use.groupBy("nb_index").agg(F.sort_array(F.collect_list(one)).alias("cells"))


def sliced_context(targets: DataFrame, contexts: DataFrame, length: int) -> DataFrame:
    """with_context() for few targets and long contexts: what lies at most `length` above a target in notebook_context(), nearest first; a notebook's cells are held once."""
    first = F.col("cell_index") - length
    taken = F.reverse(F.filter("_cells", lambda c: (c["at"] < F.col("cell_index")) & (c["at"] >= first)))
    fields = contexts.schema["cells"].dataType.elementType.names[1:]
    context = F.transform(taken, lambda c: F.struct((F.col("cell_index") - c["at"]).cast("int").alias("distance_target"), *[c[f].alias(f) for f in fields]))
    both = targets.join(merging(contexts.select("nb_index", F.col("cells").alias("_cells"))), "nb_index", "left")
    kind = T.ArrayType(T.StructType([T.StructField("distance_target", T.IntegerType()), *contexts.schema["cells"].dataType.elementType.fields[1:]]))
    return both.withColumn("context", F.coalesce(context, F.array().cast(kind))).withColumn("num_cells_above", F.col("cell_index")).drop("_cells")


def import_places(cells: DataFrame, name: str = "n_imports") -> DataFrame:
    """`name`: how many import tokens the code cells from the first to this one hold, a running sum."""
    found = F.size(X.import_tokens(F.when(is_code(), F.col("source"))))
    upto = in_order().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return cells.withColumn(name, F.sum(F.greatest(found, F.lit(0))).over(upto).cast("int"))


def notebook_imports(notebooks: DataFrame) -> DataFrame:
    """(nb_index, all_imports): the import tokens of a notebook's code cells, from its array of cells."""
    code = F.filter(F.col("cells"), lambda c: (c["cell_type"] == "code") & c["source"].isNotNull())
    return notebooks.select(F.col("metadata.nb_index").alias("nb_index"), F.flatten(F.transform(code, lambda c: X.import_tokens(c["source"]))).alias("all_imports")).where(F.size("all_imports") > 0)


def cell_imports(cells: DataFrame) -> DataFrame:
    """notebook_imports() of exploded cells."""
    own = cells.where(is_code()).select("nb_index", F.struct("cell_index", X.import_tokens(F.col("source")).alias("found")).alias("x")).where(F.size("x.found") > 0)
    return own.groupBy("nb_index").agg(F.flatten(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["found"])).alias("all_imports"))


def sliced_imports(counted: DataFrame, whole: DataFrame, name: str = "imports", count: str = "n_imports") -> DataFrame:
    """Import tokens of all code cells from the first to this one, repeats kept: the first so many (import_places()) of the one array that holds a notebook's."""
    some = F.slice("all_imports", F.lit(1), F.col(count))
    return counted.join(merging(whole), "nb_index", "left").withColumn(name, F.coalesce(some, F.array().cast("array<string>"))).drop("all_imports", count)


def running_imports(cells: DataFrame, name: str = "imports") -> DataFrame:
    """Import tokens of all code cells from the first to this one, repeats kept."""
    return sliced_imports(import_places(cells), cell_imports(cells), name)
