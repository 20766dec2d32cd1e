"""Python functions of one row's values as Arrow UDFs that make results for a few rows at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rows whose results are held in Python at once: 10,000 rows come in, and their results may be far longer than they.
ROWS = 256


def results(one: Callable, arrow: pa.DataType, parts: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
    """`one` of the values of each row."""
    for part in parts:
        for at in range(0, len(part[0]), ROWS):
            yield pa.array([one(*x) for x in zip(*(c.slice(at, ROWS).to_pylist() for c in part), strict=True)], arrow)


def by_value(one: Callable, kind: str, arrow: pa.DataType, *columns: Column, once: bool = False) -> Column:
    """results() as Spark type `kind`; with `once` marked as not deterministic, so that no projection repeats it."""

    def of_one(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return results(one, arrow, ((part,) for part in parts))

    def of_several(parts: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        return results(one, arrow, parts)

    udf = F.arrow_udf(of_one if len(columns) == 1 else of_several, kind)
    return (udf.asNondeterministic() if once else udf)(*columns)
