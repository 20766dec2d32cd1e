"""Places and running sums over a whole table without a task that sees all of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.work import WorkTable

#: One Parquet file's place among those of a write: the number of its task, then of the file in the task.
FILE_PLACE = r"part-(\d+)-.*?(?:-c(\d+))?\.[^/]*$"


def file_place(file_name: Column) -> Column:
    """A number that orders the files of one write as the tasks that wrote them."""
    part = lambda k: F.coalesce(F.nullif(F.regexp_extract(file_name, FILE_PLACE, k), F.lit("")).cast("long"), F.lit(0))
    return part(1) * (1 << 32) + part(2)


def in_order(df: DataFrame, order: list[Column], sums: dict[str, Column] | None = None, place: str = "place", lasts: dict[str, Column] | None = None) -> tuple[DataFrame, WorkTable]:
    """(rows with their place from 0 in the order, for each of `sums` the sum over all rows before, and for each of `lasts` its last value that isn't null up to the row; the table they are read from).

    The range sort is written, a file a task.  A row's place is its row_index in its
    file and the rows of the files before; the rest likewise.  Only a row a file (of
    which there are as many as shuffle partitions) meets in one task and is broadcast.
    Rows alike in the whole order may swap places when written anew.
    """
    sums, lasts = sums or {}, lasts or {}
    table = WorkTable(df.withColumns({f"_{n}": c for n, c in (sums | lasts).items()}).repartitionByRange(*order).sortWithinPartitions(*order))
    meta = table.df.metadataColumn("_metadata")
    rows = table.df.withColumn("_at", F.struct(file_place(meta["file_name"]).alias("file"), meta["row_index"].alias("row")))
    held = lambda n: F.max_by(F.col(f"_{n}"), F.when(F.col(f"_{n}").isNotNull(), F.col("_at.row"))).alias(f"_last_{n}")
    files = rows.groupBy(F.col("_at.file").alias("_file")).agg(F.count("*").alias("_n"), *[F.sum(f"_{n}").alias(f"_sum_{n}") for n in sums], *map(held, lasts))
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    starts = files.select("_file", zero("_n").alias("_n"), *[zero(f"_sum_{n}").alias(f"_sum_{n}") for n in sums], *[F.last(f"_last_{n}", ignorenulls=True).over(before).alias(f"_last_{n}") for n in lasts])
    out = rows.join(F.broadcast(starts), F.col("_at.file") == F.col("_file"))
    own = Window.partitionBy("_file").orderBy("_at.row")
    above, upto = own.rowsBetween(Window.unboundedPreceding, -1), own.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = {n: F.col(f"_sum_{n}") + F.coalesce(F.sum(f"_{n}").over(above), F.lit(0)) for n in sums}
    running |= {n: F.coalesce(F.last(f"_{n}", ignorenulls=True).over(upto), F.col(f"_last_{n}")) for n in lasts}
    out = out.withColumns({place: F.col("_n") + F.col("_at.row"), **running})
    return out.drop("_at", "_file", "_n", *[f"_{n}" for n in (*sums, *lasts)], *[f"_sum_{n}" for n in sums], *[f"_last_{n}" for n in lasts]), table
