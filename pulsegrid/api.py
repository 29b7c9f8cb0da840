"""One function for each service endpoint, over a records table.

Times are Unix seconds. ``now`` closes the default ranges: the last day for
analytics, everything for resources.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import aggregate, analytics, scan
from .sources import fhir, records


def observation(table: DataFrame, patient: str, code: str) -> DataFrame:
    """The latest row of the first series of a patient and code."""
    return scan.api_projection(scan.latest_by_prefix(table, f"{patient}|{code}"))


def resources(table: DataFrame, resource_type: str, now: int, since: str | int | None = None, until: str | int | None = None, strict: bool = False) -> DataFrame:
    start, end = scan.default_range(now, since, until, lookback=None)
    return scan.api_projection(scan.by_resource_type(table, resource_type, start, end, strict))


def time_chunks(table: DataFrame, now: int, resource_type: str = "Observation", start: str | int | None = None, end: str | int | None = None, chunk_size: int = 3600) -> DataFrame:
    """Rows with their interval, in order of intervals and of insertion."""
    return aggregate.time_chunked(scan.by_resource_type(table, resource_type, *scan.default_range(now, start, end)), chunk_size)


def trend(table: DataFrame, now: int, metric: str | None = None, resource_type: str | None = None, pattern: str = "", start: str | int | None = None, end: str | int | None = None) -> DataFrame:
    """Of one series, or of a type's series whose name holds ``pattern``, steepest first."""
    first, last = scan.default_range(now, start, end)
    if metric is not None:
        return analytics.trend(scan.time_range(table, first, last, metric))
    if resource_type is None:
        raise ValueError("a metric or a resource type is needed")
    return analytics.trend_by_resource(table, resource_type, pattern, first, last)


def stats(table: DataFrame, now: int, metric: str, start: str | int | None = None, end: str | int | None = None) -> DataFrame:
    """Statistics with a map of percentiles, ``p5`` to ``p99``."""
    return analytics.stats(scan.time_range(table, *scan.default_range(now, start, end), metric), analytics.PERCENTILES)


def outliers(table: DataFrame, now: int, metric: str, start: str | int | None = None, end: str | int | None = None, threshold: float = 2.0) -> DataFrame:
    return analytics.outliers(scan.time_range(table, *scan.default_range(now, start, end), metric), threshold)


def rate(table: DataFrame, now: int, metric: str, start: str | int | None = None, end: str | int | None = None, period: int = 3600) -> DataFrame:
    return scan.api_projection(scan.rate_of_change(scan.time_range(table, *scan.default_range(now, start, end), metric), period))


def metrics(table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(series by resource type, counts)."""
    return scan.catalogue(table), scan.catalogue_counts(table)


def post(bodies: DataFrame, path: str, resource: str = "Bundle", batch: int | None = None) -> DataFrame:
    """Parse ``seq, body``, append the records and return what was rejected (``seq, body, error``).

    Rejected are bodies, and single records whose value is not finite or whose
    time is outside of its chunk. Records go by ``seq``, entry and place. The
    number of the batch is the table's next odd one, unless given: a batch that
    is posted again then replaces itself. Even ones are a stream's.
    """
    spark = bodies.sparkSession
    number = records.next_batch(spark, path) | 1 if batch is None else batch
    if number % 2 == 0:
        raise ValueError(f"an even number is a stream's: {number}")
    ordered = bodies.orderBy("seq").persist()
    try:
        found, rejected = fhir.bundles(ordered)[:2] if resource == "Bundle" else fhir.PARSERS[resource](ordered)
        good, late = records.accepted(records.numbered(found.withColumnRenamed("ingest_seq", "seq").drop("place"), number))
        records.write(good.drop("seq"), path, mode="overwrite", batch=number)
        late = records.as_rejected(late.withColumn("ingest_seq", F.col("seq")))
        return rejected.unionByName(late)
    finally:
        ordered.unpersist()
