"""Notebooks made from the whole conversations table, so that the pipelines run over the driver's tables.

The tables hold no code; user turns become markdown and assistant turns code cells
whose text follows from the turn's, in a form that SQL can follow too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.cells import explode_cells
from ..sources import records
from . import pipelines

TEMPLATE = "# YOUR CODE HERE\nraise NotImplementedError()"


def turns(s: SparkSession, d: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return s.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "role", text.alias("text"), F.length(text).alias("n"))


def cell(kind: str, source: Column, count: Column | None = None, outputs: Column | None = None, mark: Column | None = None) -> Column:
    null = F.lit(None)
    made = F.struct(
        F.lit(kind).alias("cell_type"), source.alias("source"), (null if count is None else count).cast("bigint").alias("execution_count"),
        (F.array() if outputs is None else outputs).cast("array<struct<output_type:string>>").alias("outputs"), F.struct((null if mark is None else mark).cast(records.GRADING).alias("nbgrader")).alias("metadata"),
    )
    return made.cast(records.CELL)


def notebooks(rows: DataFrame, cells: Column, repo: Column, path: Column) -> DataFrame:
    """One notebook a (conv_id, repo, path), the cells of its turns in order."""
    placed = rows.select("conv_id", repo.alias("repo"), path.alias("path"), F.struct("turn", "role", "text", cells.alias("cells")).alias("x"))
    books = placed.groupBy("conv_id", "repo", "path").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    kernel = F.struct(F.lit("python3").alias("name"), F.lit("python").alias("language"))
    return books.select(F.flatten(F.transform("xs", lambda x: x["cells"])).alias("cells"), F.struct(F.col("conv_id").alias("nb_index"), "repo", "path", kernel.alias("kernelspec")).alias("metadata"))


def by_role(markdown: Column, code: Column) -> Column:
    return F.when(F.col("role") == "user", markdown).when(F.col("role") == "assistant", code).otherwise(F.array(cell("raw", F.col("text"))))


def crawled(s: SparkSession, d: str) -> DataFrame:
    """A line of notebook JSON for each conversation; by turn, cells differ in what they leave out or spell otherwise."""
    quoted = lambda c: F.substring(F.to_json(F.array(c)), F.lit(2), F.length(F.to_json(F.array(c))) - 2)
    text = F.col("text")
    lines = F.to_json(F.split(text, r"(?<=\n)", -1))
    kind = F.col("turn") % 5
    made = (
        F.when(kind == 0, F.concat(F.lit('{"cell_type":"code","source":'), lines, F.lit(',"metadata":[],"execution_count":null}')))
        .when(kind == 1, F.concat(F.lit('{"cell_type":"markdown","source":'), quoted(text), F.lit(',"metadata":{"tags":[1]},"extra":{"x":[null]}}')))
        .when(kind == 2, F.concat(F.lit('{"source":'), quoted(text), F.lit(',"execution_count":7,"outputs":[{"output_type":"error","text":"t"}],"metadata":{"nbgrader":{"grade":true,"points":2}}}')))
        .when(kind == 3, F.lit('{"cell_type":"code","source":null}')).otherwise(F.lit('"no cell"'))
    )
    cells = turns(s, d).select("conv_id", F.struct("turn", made.alias("made")).alias("x")).groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["made"]), ",").alias("cells"))
    return cells.select(F.concat(F.lit('{"cells":['), "cells", F.lit('],"metadata":{"nb_index":'), "conv_id", F.lit(',"repo":"r"}}')).alias("value"))


def decoded(s: SparkSession, d: str) -> DataFrame:
    """Those lines as cells again."""
    mark = F.col("nbgrader")
    return explode_cells(records.decode_notebooks(crawled(s, d))).select("nb_index", F.col("cell_index").cast("long").alias("cell_index"), "cell_type", F.md5(F.col("source").cast("binary")).alias("source_md5"), F.coalesce("execution_count", F.lit(-1)).alias("count_or_null"), F.size("outputs").cast("long").alias("n_outputs"), F.coalesce(mark["grade"], F.lit(False)).alias("graded"))


def train_books(s: SparkSession, d: str) -> DataFrame:
    """Markdown names its text by md5, with an accent where the text isn't ASCII."""
    some = lambda c: F.when(F.col("text") == "", "").otherwise(c)
    prose = some(F.concat(F.lit("about "), F.md5(F.col("text").cast("binary")), F.when(X.is_ascii(F.col("text")), "").otherwise(" é")))
    code = some(F.concat(F.lit("import m\n%time\nvalue = run('"), F.md5(F.col("text").cast("binary")), F.lit("', "), F.col("n"), F.lit(")\nvalue.show()")))
    return notebooks(turns(s, d), by_role(F.array(cell("markdown", prose)), F.array(cell("code", code))), F.lit("r"), F.lit("p"))


def train(s: SparkSession, d: str) -> DataFrame:
    """The train pipeline."""
    out = pipelines.train(train_books(s, d))
    return out.select("nb_index", F.col("cell_index").cast("long").alias("cell_index"), "nl", F.size("context").cast("long").alias("n_context"), F.size("imports").cast("long").alias("n_imports"), F.array_join("code.api_sequence", ",").alias("api"), F.size("code.code_tokens_clean").cast("long").alias("n_tokens"))


def graded_books(s: SparkSession, d: str) -> DataFrame:
    """Assignments, one for each of 50 remainders of a turn's length; some are answered between an instructor's marks, some with nothing but a comment there."""
    name = F.concat(F.lit("q"), F.col("n") % 50)
    released = F.md5(F.concat(F.lit(TEMPLATE), F.lit("codeFalseTrueFalse"), name).cast("binary"))
    mark = lambda grade, solution, locked, points, checksum: F.struct(F.lit(grade).alias("grade"), F.lit(solution).alias("solution"), F.lit(locked).alias("locked"), name.alias("grade_id"), F.lit(points).cast("double").alias("points"), checksum.alias("checksum"))
    own = F.concat(F.lit("answer = compute("), F.col("n") % 7, F.lit(")"))
    between = lambda c: F.concat(F.lit("x = 1\n### BEGIN SOLUTION\n"), c, F.lit("\n### END SOLUTION"))
    kind = F.col("n") % 50 % 10
    answer = F.when(F.col("conv_id") % 3 == 0, TEMPLATE).when(kind == 7, between(own)).when(kind == 8, between(F.lit("# none"))).otherwise(own)
    failed = F.when(F.col("conv_id") % 5 == 1, F.array(F.struct(F.lit("error").alias("output_type")))).otherwise(F.array().cast("array<struct<output_type:string>>"))
    code = F.array(cell("code", answer, F.lit(1), None, mark(False, True, False, None, released)), cell("code", F.lit("assert answer"), F.col("turn") % 4, failed, mark(True, False, True, 1.0, F.lit("t"))))
    return notebooks(turns(s, d), by_role(F.array(cell("markdown", F.concat(F.lit("task "), F.col("n") % 50))), code), F.lit("r"), F.concat(F.lit("p"), F.col("conv_id")))


def graded(s: SparkSession, d: str) -> DataFrame:
    """The graded pipeline; n_context tells how many cells a record's context holds."""
    out = pipelines.graded(graded_books(s, d))
    joined = lambda c: F.array_join(c, " ").alias(c)
    return out.select("question", "status", "template", "extracted", joined("extracted_tokens"), joined("template_tokens"), F.col("n_solutions").cast("long").alias("n_solutions"), F.when(F.col("context").isNull(), 0).otherwise(F.size("context")).cast("long").alias("n_context"))


def exercise_books(s: SparkSession, d: str) -> DataFrame:
    """Each conversation is a repo with a solution and its submission, whose code differs."""
    rows = turns(s, d).withColumn("path", F.explode(F.array(F.lit("hw_solution.ipynb"), F.lit("hw.ipynb"))))
    answer = F.when(F.col("path") == "hw.ipynb", "").otherwise(F.concat(F.lit("best = search("), F.col("n") % 3, F.lit(")")))
    prose = F.concat(F.lit("this is the task for "), F.col("n") % 20)
    return notebooks(rows, by_role(F.array(cell("markdown", prose), cell("markdown", F.concat(prose, F.lit(" and that is all of it")))), F.array(cell("code", answer))), F.concat(F.lit("r"), F.col("conv_id")), F.col("path"))


def exercise(s: SparkSession, d: str) -> DataFrame:
    """The exercise pipeline."""
    return pipelines.exercise(exercise_books(s, d)).select("group", "status", "target", "boilerplate", F.col("n_code").cast("long").alias("n_code"), F.col("n_repos").cast("long").alias("n_repos"))


def splits(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    graded_part = pipelines.dev_and_test(pipelines.graded_records(pipelines.graded(graded_books(s, d))))
    return graded_part, pipelines.dev_and_test(pipelines.exercise_records(pipelines.exercise(exercise_books(s, d))))


def graded_split(s: SparkSession, d: str) -> DataFrame:
    return pipelines.dev_and_test(pipelines.graded_records(pipelines.graded(graded_books(s, d)))).select("id", "part")


def exercise_split(s: SparkSession, d: str) -> DataFrame:
    return pipelines.dev_and_test(pipelines.exercise_records(pipelines.exercise(exercise_books(s, d)))).select("id", "part")


def final_dataset(s: SparkSession, d: str) -> DataFrame:
    """dev, test and train of all three pipelines, in their orders (shuffle_key)."""
    parts = pipelines.final_dataset(*splits(s, d), pipelines.train(train_books(s, d)))
    some = [df.select(F.lit(part).alias("part"), "kind", "id", "shuffle_key") for part, df in parts.items()]
    return some[0].unionByName(some[1]).unionByName(some[2])
