"""What a grading mark makes of a cell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.work import merging


def grading_type(present: Column, has_solution: Column, solution: Column, has_grade: Column, grade: Column) -> Column:
    """Flags that are absent differ from null ones: has_solution and has_grade say whether the key is there."""
    s, g = F.coalesce(solution, F.lit(False)), F.coalesce(grade, F.lit(False))
    plain_false = F.coalesce(~solution, F.lit(False))
    grade_false = F.coalesce(~grade, F.lit(False))
    return (
        F.when(~present, "no nbgrader").when(~has_solution & g, "autograder tests")
        .when(has_solution & has_grade, F.when(s & grade_false, "autograded code").when(s & g, "manual graded code").when(plain_false & g, "autograder tests").otherwise("read only"))
        .otherwise("no nbgrader")
    )


def exercise_grading_type(present: Column, solution: Column, grade: Column) -> Column:
    """The coarser marks of exercise notebooks, where a missing flag decides nothing."""
    return (
        F.when(~present, "unknown").when(solution & ~grade, "autograded code").when(solution & grade, "manual graded code")
        .when(~solution & grade, "autograder tests").otherwise("unknown")
    )


def grading_of(mark: Column) -> Column:
    """grading_type() of a typed mark, whose null fields count as absent."""
    return grading_type(mark.isNotNull(), mark["solution"].isNotNull(), mark["solution"], mark["grade"].isNotNull(), mark["grade"])


def checksum_of(source: Column, cell_type: Column, mark: Column) -> Column:
    return X.cell_checksum(source, cell_type, mark["grade"], mark["solution"], mark["locked"], F.coalesce(mark["grade_id"], F.lit("dummy!!!id")), mark["points"])


def mark_cells(cells: DataFrame) -> DataFrame:
    """Adds grading, is_boilerplate (the cell still has its released checksum) and is_instructor_answer."""
    mark = F.col("nbgrader")
    return cells.withColumns({
        "grading": grading_of(mark),
        "is_boilerplate": F.coalesce(checksum_of(F.col("source"), F.col("cell_type"), mark) == mark["checksum"], F.lit(False)),
        "is_instructor_answer": F.contains("source", F.lit("BEGIN SOLUTION")),
    })


#: Templates, and grading marks, that one cell of the grid tries against each other at most on average.
BLOCK = 1000


def boilerplates_by_checksum(targets: DataFrame, boilerplates: DataFrame, block: int = BLOCK) -> DataFrame:
    """Each target's released text: the boilerplate that has the checksum of the target's mark, the smallest of several, null without one.

    A text that was itself released with that checksum is met by an equi-join.  The text
    may also have been released under another mark (another grade_id, say); then its
    checksum depends on both sides, and every text is tried with every mark that is left.
    Texts are dealt over the rows of a grid and marks over its columns; each cell of the
    grid is one group of an equi-join and hashes the pairs of its two blocks.
    """
    digest = F.sha2(F.to_json(F.struct("nbgrader", "cell_type")).cast("binary"), 256)
    asked = targets.withColumn("_mark", digest)
    marks = asked.where("nbgrader.checksum is not null").select("_mark", "nbgrader", "cell_type").dropDuplicates(["_mark"])
    texts = boilerplates.where("is_boilerplate").select(F.col("source").alias("released"), F.col("nbgrader.checksum").alias("own")).distinct()
    hit = checksum_of(F.col("released"), F.col("cell_type"), F.col("nbgrader")) == F.col("nbgrader.checksum")
    first = lambda found: found.where(hit).groupBy("_mark").agg(F.min("released").alias("released"))
    known = first(marks.join(merging(texts), F.col("nbgrader.checksum") == F.col("own")))
    rest, all_texts = marks.join(merging(known), "_mark", "left_anti"), texts.select("released").distinct()
    rows, columns = (max(1, -(-side.count() // block)) for side in (all_texts, rest))
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    down = all_texts.select("released", F.pmod(F.xxhash64("released"), F.lit(rows)).cast("int").alias("_row"), numbers(columns).alias("_column"))
    across = rest.select("_mark", "nbgrader", "cell_type", F.pmod(F.xxhash64("_mark"), F.lit(columns)).cast("int").alias("_column"), numbers(rows).alias("_row"))
    tried = first(across.join(merging(down), ["_row", "_column"]))
    return asked.join(merging(known.unionByName(tried)), "_mark", "left").drop("_mark")
