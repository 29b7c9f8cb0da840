"""Aggregates of series over ranges, intervals and chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _value() -> Column:
    """The value; NaN counts as missing in extremes."""
    return F.when(~F.isnan("value"), F.col("value"))


def _of(how: str) -> Column:
    known = {
        "mean": lambda: F.avg("value"),
        "max": lambda: F.max(_value()),
        "min": lambda: F.min(_value()),
        "count": lambda: F.count(F.lit(1)).cast("double"),
        "sum": lambda: F.sum("value"),
    }
    if how not in known:
        raise ValueError(f"not an aggregate: {how!r}")
    return known[how]()


def _aggregate(records: DataFrame, how: str, *keys: str) -> DataFrame:
    first = F.min_by(F.struct("timestamp", "context", "resource_type"), F.struct("chunk_id", "ingest_seq"))
    rows = records.groupBy("metric_name", *keys).agg(_of(how).alias("value"), first.alias("first"))
    return rows.select("metric_name", *keys, "value", "first.timestamp", "first.context", "first.resource_type")


def aggregate_range(records: DataFrame, how: str) -> DataFrame:
    """One row per series: the aggregate, with all else from the row inserted first."""
    return _aggregate(records, how)


def aggregate_intervals(records: DataFrame, seconds: int, how: str) -> DataFrame:
    """The same per interval; ``timestamp`` is the first row's, ``bucket_start`` the interval's."""
    if seconds <= 0:
        raise ValueError("intervals must be longer than zero seconds")
    return _aggregate(records.withColumn("bucket_start", F.col("timestamp") - F.col("timestamp") % seconds), how, "bucket_start")


def time_chunked(records: DataFrame, seconds: int) -> DataFrame:
    """Whole rows with the interval of ``seconds`` that they are in, ``chunk_start`` to ``chunk_end``.

    Rows stay rows: they come in order of intervals and of insertion, and an
    interval may be as large as it likes.
    """
    if seconds <= 0:
        raise ValueError("chunks must be longer than zero seconds")
    start = F.floor(F.col("timestamp") / seconds).cast("long") * seconds
    return records.select(start.alias("chunk_start"), (start + seconds).alias("chunk_end"), *records.columns).orderBy("chunk_start", "ingest_seq")


def time_chunk_sizes(records: DataFrame, seconds: int) -> DataFrame:
    """Only how many rows and series each interval has."""
    start = F.floor(F.col("timestamp") / seconds).cast("long") * seconds
    return records.groupBy(start.alias("chunk_start")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("metric_name").alias("metrics"))


def chunk_summary(records: DataFrame) -> DataFrame:
    return records.groupBy("chunk_id", "metric_name").agg(F.count(F.lit(1)).alias("n"), F.min(_value()).alias("min"), F.max(_value()).alias("max"), F.avg("value").alias("avg"))


def union_of_means(records: DataFrame, metrics: list[str]) -> DataFrame:
    """The mean of each listed series, one row each."""
    return records.where(F.col("metric_name").isin(*metrics)).groupBy("metric_name").agg(F.avg("value").alias("mean"))
