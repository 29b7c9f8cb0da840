"""Outliers and correlation over several series at common times."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.series import SERIES

#: Added to the diagonal from three dimensions on; cut of the z-score method.
RIDGE = 1e-6
MAX_Z = 3.0


def bucket_means(records: DataFrame, seconds: int = 3600) -> DataFrame:
    """The mean of each series per bucket, which puts independent series on common times."""
    start = F.col("timestamp") - F.col("timestamp") % seconds
    return records.groupBy(SERIES, start.alias("timestamp")).agg(F.avg("value").alias("value"), F.max("ingest_seq").alias("ingest_seq"))


def _one_per_time(records: DataFrame) -> DataFrame:
    return records.groupBy(SERIES, "timestamp").agg(F.max_by("value", "ingest_seq").alias("value"))


def aligned(records: DataFrame, group: list[str]) -> DataFrame:
    """``timestamp`` and a column x0, x1, ... for each series of ``group``, at times that all have.

    Of rows of one series at one time the last inserted counts.
    """
    rows = records.where(F.col(SERIES).isin(*group))
    picks = [F.max_by("value", F.when(F.col(SERIES) == m, F.col("ingest_seq"))).alias(f"x{i}") for i, m in enumerate(group)]
    wide = rows.groupBy("timestamp").agg(F.count_distinct(SERIES).alias("k"), *picks)
    return wide.where(F.col("k") == len(group)).drop("k")


def correlation_pairs(records: DataFrame, least_common: int = 3) -> DataFrame:
    """``metric_a, metric_b, r, n`` for each two series; 0 with few common times or without spread."""
    rows = _one_per_time(records)
    a = rows.select(F.col(SERIES).alias("metric_a"), "timestamp", F.col("value").alias("x"))
    b = rows.select(F.col(SERIES).alias("metric_b"), "timestamp", F.col("value").alias("y"))
    r = F.try_divide(F.covar_pop("x", "y"), F.stddev_pop("x") * F.stddev_pop("y"))
    pairs = a.join(b, "timestamp").where("metric_a < metric_b").groupBy("metric_a", "metric_b").agg(F.count(F.lit(1)).alias("n"), r.alias("r"))
    return pairs.select("metric_a", "metric_b", F.when(F.col("n") < least_common, 0.0).otherwise(F.coalesce("r", F.lit(0.0))).alias("r"), "n")


def correlated_groups(records: DataFrame, threshold: float = 0.7) -> list[list[str]]:
    """Greedy groups of two or more: each series not yet taken, in order of names, takes those correlated with it.

    Only the pairs that reach the threshold come to the driver.
    """
    close: dict[str, set[str]] = {}
    for row in correlation_pairs(records).where(F.abs("r") >= threshold).select("metric_a", "metric_b").collect():
        close.setdefault(row[0], set()).add(row[1])
        close.setdefault(row[1], set()).add(row[0])
    groups, taken = [], set()
    for seed in sorted(close):
        if seed not in taken:
            group = [seed, *sorted(close[seed] - taken)]
            taken |= {*group}
            if len(group) > 1:
                groups.append(group)
    return groups


def _inverse(covariance: np.ndarray) -> np.ndarray | None:
    p = len(covariance)
    if p <= 2:
        det = covariance[0, 0] if p == 1 else covariance[0, 0] * covariance[1, 1] - covariance[0, 1] * covariance[1, 0]
        return None if det == 0 else np.linalg.inv(covariance)
    try:
        return np.linalg.inv(covariance + RIDGE * np.eye(p))
    except np.linalg.LinAlgError:
        return None


def _sum(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)


def mahalanobis(records: DataFrame, group: list[str], threshold: float = 3.0) -> DataFrame:
    """Times at which the values of ``group`` lie further than ``threshold`` from their mean.

    One job takes means and sample covariances; with fewer than p + 1 common
    times, or covariances that have no inverse, there is no row.
    """
    wide, p = aligned(records, group), len(group)
    names = [f"x{i}" for i in range(p)]
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    moments = wide.agg(F.count(F.lit(1)).alias("n"), *[F.avg(x).alias(f"m{i}") for i, x in enumerate(names)], *[F.covar_samp(names[i], names[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    inverse = None
    if moments["n"] >= p + 1:
        covariance = np.zeros((p, p))
        for i, j in pairs:
            covariance[i, j] = covariance[j, i] = moments[f"c{i}_{j}"]
        inverse = _inverse(covariance)
    if inverse is None:
        return wide.withColumn("distance", F.lit(None).cast("double")).where("false")
    off = [F.col(x) - F.lit(float(moments[f"m{i}"])) for i, x in enumerate(names)]
    square = _sum([off[i] * off[j] * F.lit(float(inverse[i, j])) for i in range(p) for j in range(p)])
    return wide.withColumn("distance", F.sqrt(F.greatest(square, F.lit(0.0)))).where(F.col("distance") > threshold)


def max_zscore(records: DataFrame, group: list[str], cut: float = MAX_Z) -> DataFrame:
    """Times at which some series of ``group`` lies over ``cut`` population deviations from its mean."""
    wide, names = aligned(records, group), [f"x{i}" for i in range(len(group))]
    moments = wide.agg(*[f(x).alias(f"{k}{x}") for x in names for k, f in (("m", F.avg), ("s", F.stddev_pop))])
    rows = wide.crossJoin(F.broadcast(moments))  # one row
    scores = [F.coalesce(F.try_divide(F.abs(F.col(x) - F.col(f"m{x}")), F.col(f"s{x}")), F.lit(0.0)) for x in names]
    score = F.greatest(*scores) if len(scores) > 1 else scores[0]
    return rows.withColumn("score", score).where(F.col("score") > cut).select("timestamp", *names, "score")


def multivariate_outliers(records: DataFrame, groups: list[list[str]] | None = None, method: str = "mahalanobis", threshold: float = 3.0, correlation: float = 0.7) -> list[tuple[list[str], DataFrame]]:
    """(group, outliers) for each usable group; without any, for groups of correlated series.

    A group is usable if all its series exist.
    """
    if method not in ("mahalanobis", "isolationforest"):
        raise ValueError(f"not a method: {method!r}")
    named = sorted({m for g in groups or [] for m in g})
    there = {r[0] for r in records.where(F.col(SERIES).isin(*named)).select(SERIES).distinct().collect()} if named else set()
    usable = [g for g in groups or [] if g and {*g} <= there] or correlated_groups(records, correlation)
    return [(g, mahalanobis(records, g, threshold) if method == "mahalanobis" else max_zscore(records, g)) for g in usable]
