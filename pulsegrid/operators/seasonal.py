"""Seasonal decomposition of series into trend, seasonal part and residual."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.series import ORDER, SERIES, with_rank


def moving_average(records: DataFrame, half: int, out: str = "trend") -> DataFrame:
    """``records`` with the mean of all rows of the series within ``half`` seconds, both ends included.

    Series are cut into slabs of time; rows near an edge also go to the slab
    beyond it, so that no task needs a whole series. Time is cut again into
    blocks as long as the range of a row, which therefore is the end of one
    block and the beginning of the next: two running sums, one from each side.
    A row costs the same however many are near it, and nothing is subtracted.
    """
    if half < 0:
        raise ValueError("half must not be negative")
    width = 2 * half + 1
    length = 8 * half + 3600
    slab = lambda t: F.floor(t / length)
    ts = F.col("timestamp")
    rows = records.withColumn("slab", F.explode(F.sequence(slab(ts - half), slab(ts + half)))).withColumn("block", F.floor(ts / width))
    rows = rows.repartition(SERIES, "slab")
    ways = {"head": F.col("timestamp").asc(), "tail": F.col("timestamp").desc()}
    for name, order in ways.items():
        so_far = Window.partitionBy(SERIES, "slab", "block").orderBy(order).rangeBetween(Window.unboundedPreceding, 0)
        rows = rows.withColumn(name, F.struct("block", F.sum("value").over(so_far).alias("sum"), F.count("value").over(so_far).alias("n")))
    for name, order in ways.items():
        rows = rows.withColumn(name, F.last(name).over(Window.partitionBy(SERIES, "slab").orderBy(order).rangeBetween(Window.unboundedPreceding, half)))
    rows = rows.where(F.col("slab") == slab(ts))
    first, final = F.floor((ts - half) / width), F.floor((ts + half) / width)
    tail = F.when(F.col("tail.block") == first, F.col("tail"))
    head = F.when((F.col("head.block") == final) & (first != final), F.col("head"))
    total = F.when(tail["sum"].isNull(), head["sum"]).when(head["sum"].isNull(), tail["sum"]).otherwise(tail["sum"] + head["sum"])
    count = F.coalesce(tail["n"], F.lit(0)) + F.coalesce(head["n"], F.lit(0))
    return rows.withColumn(out, F.try_divide(total, count)).drop("slab", "block", "head", "tail")


def decompose(records: DataFrame, period: int = 86400, method: str = "additive", min_points: int = 24) -> DataFrame:
    """``trend``, ``seasonal`` and ``residual`` for each row, and the series' period in rows, ``season``.

    Series with fewer than ``min_points`` rows, or whose times do not differ or
    lie further apart than the period allows, have no season and are left out.
    The seasonal part is the mean of its place in the season over detrended
    values, less (or over) the mean of all places, empty ones counting as 0.
    Rows at one time share the seasonal part of the first of them.
    """
    if method not in ("additive", "multiplicative"):
        raise ValueError(f"not a method: {method!r}")
    additive = method == "additive"
    base = with_rank(records.select(SERIES, "value", *ORDER))
    spans = base.groupBy(SERIES).agg(F.min("timestamp").alias("t0"), F.max("timestamp").alias("t1"), F.count(F.lit(1)).alias("rows"))
    season = F.round(F.try_divide(F.lit(float(period)), F.try_divide(F.col("t1") - F.col("t0"), F.col("rows") - 1))).cast("long")
    spans = spans.where(F.col("rows") >= max(min_points, 2)).select(SERIES, season.alias("season")).where("season >= 1")
    rows = moving_average(base.join(spans, SERIES), period // 10 // 2).withColumn("place", F.col("rank") % F.col("season"))
    if additive:
        mean = F.avg(F.col("value") - F.col("trend"))
    else:
        mean = F.coalesce(F.sum(F.when(F.col("trend") != 0, F.col("value") / F.col("trend"))), F.lit(0.0)) / F.count(F.lit(1))
    pattern = rows.groupBy(SERIES, "season", "place").agg(mean.alias("mean"))
    level = pattern.groupBy(SERIES).agg((F.sum("mean") / F.max("season")).alias("level"))
    pattern = pattern.join(level, SERIES)
    part = F.col("mean") - F.col("level") if additive else F.when(F.col("level") != 0, F.col("mean") / F.col("level")).otherwise(F.col("mean"))
    rows = rows.join(pattern.select(SERIES, "place", part.alias("seasonal")), [SERIES, "place"])
    same = Window.partitionBy(SERIES, "timestamp").orderBy("rank")
    rows = rows.withColumn("seasonal", F.first("seasonal").over(same))
    scale = F.col("trend") * F.col("seasonal")
    rest = F.col("value") - F.col("trend") - F.col("seasonal") if additive else F.when(scale != 0, F.col("value") / scale).otherwise(F.col("value"))
    return rows.select(SERIES, "timestamp", "ingest_seq", "value", "season", "trend", "seasonal", rest.alias("residual"))

