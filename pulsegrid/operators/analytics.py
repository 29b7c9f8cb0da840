"""Trend, descriptive statistics and z-score outliers, all series at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.series import ORDER, SERIES, with_rank, value_places
from .scan import by_resource_type

#: The percentiles of ``percentiles``.
PERCENTILES = (5, 10, 25, 75, 90, 95, 99)


def trend(records: DataFrame) -> DataFrame:
    """Least squares of value on time in seconds, and what else describes a series.

    Without spread in time the slope is 0, without spread in value R² is 0.
    ``std_dev`` is the population's.
    """
    at, v, ts = F.struct(*ORDER), F.col("value"), F.col("timestamp").cast("double")
    return records.groupBy(SERIES).agg(
        F.coalesce(F.regr_slope(v, ts), F.lit(0.0)).alias("slope"),
        F.when(F.var_pop(v) == 0, 0.0).otherwise(F.coalesce(F.regr_r2(v, ts), F.lit(0.0))).alias("r_squared"),
        F.min_by(v, at).alias("start_value"),
        F.max_by(v, at).alias("end_value"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
        F.stddev_pop(v).alias("std_dev"),
        F.count(F.lit(1)).alias("n"),
    )


def trend_samples(records: DataFrame) -> DataFrame:
    """About twenty rows of each series: every ``n div 20``th by time, and the last if its time is not among them."""
    rows = with_rank(records.select(SERIES, "value", *ORDER)).withColumn("step", F.greatest(F.floor(F.col("n") / 20), F.lit(1)))
    sampled = F.col("rank") % F.col("step") == 0
    ends = rows.where(sampled).groupBy(SERIES).agg(F.max("timestamp").alias("sampled_to"))
    rows = rows.join(ends, SERIES)
    last = (F.col("rank") == F.col("n") - 1) & (F.col("timestamp") != F.col("sampled_to"))
    return rows.where(sampled | last).select(SERIES, "rank", "timestamp", "value")


def trend_by_resource(records: DataFrame, resource_type: str, pattern: str, start: int, end: int) -> DataFrame:
    """Trends of a type's series whose name holds ``pattern``, steepest first."""
    rows = by_resource_type(records, resource_type, start, end).where(F.contains(SERIES, F.lit(pattern)))
    return trend(rows).orderBy(F.abs("slope").desc(), SERIES)


def _at(percent: float) -> Column:
    return F.round(F.lit(percent / 100) * (F.col("n") - 1)).cast("long")


def _percents(places: DataFrame, percents: tuple[int, ...]) -> DataFrame:
    wanted = F.filter(F.array(*[F.struct(F.lit(p).alias("percentile"), _at(p).alias("at")) for p in percents]), lambda x: x["at"].between(F.col("low"), F.col("high")))
    return places.select(SERIES, "value", F.explode(wanted).alias("x")).select(SERIES, "x.percentile", "value")


def percentiles(records: DataFrame, percents: tuple[int, ...] = PERCENTILES) -> DataFrame:
    """``metric_name, percentile, value``: the value at rank ``round(p / 100 * (n - 1))``, without interpolation."""
    return _percents(value_places(records.select(SERIES, "value")), percents)


def stats(records: DataFrame, percents: tuple[int, ...] = ()) -> DataFrame:
    """Extremes, mean, median (the mean of the middle two) and population deviation.

    With ``percents``, also a map of percentiles, ``p5`` and so on; values are
    put in order once for both.
    """
    v = F.col("value")
    plain = records.groupBy(SERIES).agg(F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std_dev"), F.count(F.lit(1)).alias("n"))
    ranks = {**{f"p{p}": _at(p) for p in percents}, "low": F.floor((F.col("n") - 1) / 2), "high": F.floor(F.col("n") / 2)}
    taken = [F.max(F.when(at.between(F.col("low"), F.col("high")), F.col("value"))).alias(name) for name, at in ranks.items()]
    picked = value_places(records.select(SERIES, "value")).groupBy(SERIES).agg(*taken)
    shown = [F.create_map(*[x for p in percents for x in (F.lit(f"p{p}"), F.col(f"p{p}"))]).alias("percentiles")] if percents else []
    return plain.join(picked.select(SERIES, ((F.col("low") + F.col("high")) / 2).alias("median"), *shown), SERIES)


def outliers(records: DataFrame, threshold: float = 2.0) -> DataFrame:
    """Rows further than ``threshold`` population deviations from their series' mean, strictly.

    ``score`` is |z| / (|z| + 1); a series without spread has none.
    """
    moments = records.groupBy(SERIES).agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"))
    rows = records.join(moments.where("sd > 0"), SERIES).withColumn("deviation", F.col("value") - F.col("mean"))
    rows = rows.withColumn("z", F.abs(F.col("deviation") / F.col("sd"))).where(F.col("z") > threshold)
    rows = rows.select(SERIES, "timestamp", "ingest_seq", "value", "deviation", (F.col("z") / (F.col("z") + 1)).alias("score"))
    return rows.orderBy(F.col("score").desc(), *[SERIES, "ingest_seq"])
