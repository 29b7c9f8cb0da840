"""Sliding windows that begin at each series' first time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.series import SERIES


def sliding_windows(records: DataFrame, size: int = 3600, step: int = 900, how: str = "volatility") -> DataFrame:
    """``metric_name, k, start, end, n, value``: slope, sample deviation or range per window.

    Windows lie ``step`` apart and are whole: none goes beyond the last time.
    Windows without rows are left out. Only the rows' own windows are generated,
    ``size / step`` a row.
    """
    values = {
        "trend": F.coalesce(F.regr_slope("value", F.col("d").cast("double")), F.lit(0.0)),
        "volatility": F.coalesce(F.stddev_samp("value"), F.lit(0.0)),
        "range": F.max("value") - F.min("value"),
    }
    if size <= 0 or step <= 0:
        raise ValueError("size and step must be positive")
    if how not in values:
        raise ValueError(f"not a statistic: {how!r}")
    spans = records.groupBy(SERIES).agg(F.min("timestamp").alias("t0"), (F.max("timestamp") - F.min("timestamp")).alias("span"))
    rows = records.select(SERIES, "timestamp", "value").join(spans, SERIES).withColumn("d", F.col("timestamp") - F.col("t0"))
    rows = rows.where(F.col("span") >= size)
    first = F.greatest(F.lit(0), F.floor((F.col("d") - size) / step) + 1)
    last = F.least(F.floor(F.col("d") / step), F.floor((F.col("span") - size) / step))
    inside = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
    rows = rows.withColumn("k", F.explode(inside))
    out = rows.groupBy(SERIES, "k").agg(F.min("t0").alias("t0"), F.count(F.lit(1)).alias("n"), values[how].alias("value"))
    start = F.col("t0") + F.col("k") * step
    return out.select(SERIES, "k", start.alias("start"), (start + size).alias("end"), "n", "value")


def anomalous_windows(records: DataFrame, size: int = 3600, step: int = 900, how: str = "volatility", threshold: float = 1.5) -> DataFrame:
    """Windows whose value is over ``threshold`` sample deviations of all the series' windows off their mean."""
    windows = sliding_windows(records, size, step, how)
    moments = windows.groupBy(SERIES).agg(F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("sd"))
    rows = windows.join(moments, SERIES)
    return rows.where(F.abs(F.col("value") - F.col("mean")) > threshold * F.col("sd")).select(*windows.columns)
