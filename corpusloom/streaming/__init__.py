"""Structured Streaming forms of the operators that make sense on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame


def first_records(stream: DataFrame, keys: list[str], event_time: str, delay: str) -> DataFrame:
    """Exact dedup on a stream: one record a key among those no later than `delay` after each other; state older than that is dropped."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)
