"""What a student added to a template, by line diff."""

from __future__ import annotations

import difflib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .slices import by_value

# Fixed value: the template that stands for no code at all.
EMPTY_TEMPLATE = "# YOUR CODE HERE\nraise NotImplementedError()"
TRIVIAL_TOKENS = ["raise", "NotImplementedError", "(", ")"]


def diff_lines(template: str, solution: str) -> list[str]:
    """The lines of a diff, each behind its mark (+, - or blank) and a space; what only hints at changes inside lines is left out."""
    return [x for x in difflib.Differ().compare(template.splitlines(), solution.splitlines()) if x[0] != "?"]


def diffs(template: Column, solution: Column) -> Column:
    """diff_lines() as a column; null for null."""
    return by_value(lambda a, b: None if a is None or b is None else diff_lines(a, b), "array<string>", pa.list_(pa.string()), template, solution, once=True)


def telling_lines(diff: Column) -> Column:
    """The lines of a diff that count, as (added, body): added ones that are more than comments, docstrings or imports, and common ones that are more than comments or a raise."""
    rows = F.transform(diff, lambda x: F.struct(F.substring(x, 1, 1).alias("mark"), F.substr(x, F.lit(3)).alias("body")))
    spaces = r"[\s\x1C-\x1F\x85]+"
    bare = lambda c: F.regexp_replace(c, f"^{spaces}|{spaces}$", "")
    starts = lambda c, *marks: F.lit(False) if not marks else F.startswith(c, F.lit(marks[0])) | starts(c, *marks[1:])
    # of an added line + and blanks are taken off before it is judged
    open_ = lambda x: F.btrim(x["body"], F.lit("+ "))
    new = lambda x: (x["mark"] == "+") & (bare(open_(x)) != "") & ~starts(open_(x), '"""', "#") & ~F.contains(open_(x), F.lit("import "))
    old = lambda x: (x["mark"] == " ") & (bare(x["body"]) != "") & ~starts(bare(x["body"]), "?", "#", "raise")
    return F.transform(F.filter(rows, lambda x: new(x) | old(x)), lambda x: F.struct((x["mark"] == "+").alias("added"), x["body"].alias("body")))


def single_run(lines: Column) -> Column:
    """The bodies of the one run of added lines; null without any, '' if there are several runs: a run begins where a line is added and the one before isn't."""
    begins = F.filter(lines, lambda x, i: x["added"] & ((i == 0) | ~F.get(lines, i - 1)["added"]))
    added = F.transform(F.filter(lines, lambda x: x["added"]), lambda x: x["body"])
    return F.when(F.size(begins) == 1, F.array_join(added, "\n")).when(F.size(begins) > 1, "")


def with_target(rows: DataFrame, template: Column, solution: Column, name: str) -> DataFrame:
    """`name`: what a solution adds to its template in one run of lines; an empty template gives the whole solution, nothing or several runs give ''.

    Python only makes the diff; its lines are judged and put together by Spark.
    """
    compared = rows.withColumn("_diff", diffs(F.when(template != EMPTY_TEMPLATE, template), solution))
    added = F.coalesce(single_run(telling_lines(F.col("_diff"))), F.lit(""))
    return compared.withColumn(name, F.when(template.isNull() | solution.isNull(), None).when(template == EMPTY_TEMPLATE, solution).otherwise(added)).drop("_diff")


def is_trivial(tokens: Column) -> Column:
    """Whether tokens, leading NEWLINEs off, only raise NotImplementedError()."""
    start = F.array_position(F.transform(tokens, lambda x: x != "NEWLINE"), True)
    return F.when(start > 0, F.slice(tokens, F.greatest(start, F.lit(1)).cast("int"), F.greatest(F.size(tokens), F.lit(1))) == F.array(*map(F.lit, TRIVIAL_TOKENS))).otherwise(False)
