"""Golden values of small series, worked out by hand, and brute-force twins."""

import math
import os
import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import aggregate, analytics, changepoints, multivariate, scan, seasonal, windows
from pulsegrid.sources.records import RECORD

A = [(600, 1), (660, 2), (720, 3), (780, 4), (840, 5)]
B = [(1200, 10), (1000, 7), (1100, 8), (1100, 9), (4000, 10)]
C = [(3600 + 60 * i, 88 if i == 5 else 98) for i in range(10)]
D = [(60 * i, 10 if i < 10 else 20) for i in range(20)]
E = [(100, 1), (1000, 2), (2000, 5), (3700, 4), (4700, 9), (5500, 9)]


def made(spark, **series):
    rows = [(t, name, float(v), {"k": str(i)}, "Observation", i, t - t % 3600) for name, points in series.items() for i, (t, v) in enumerate(points)]
    return spark.createDataFrame(rows, RECORD).repartition(3)


def one(df):
    (row,) = df.collect()
    return row


def test_trend(spark):
    rows = {r.metric_name: r for r in analytics.trend(made(spark, A=A, B=B, C=C, flat=[(0, 5), (60, 5)], single=[(9, 4)])).collect()}
    assert math.isclose(rows["A"].slope, 1 / 60) and math.isclose(rows["A"].r_squared, 1) and (rows["A"].start_value, rows["A"].end_value, rows["A"].n) == (1, 5, 5)
    assert math.isclose(rows["A"].std_dev, math.sqrt(2))
    assert math.isclose(rows["B"].slope, 0.000560166, rel_tol=1e-5) and math.isclose(rows["B"].r_squared, 0.311386380, rel_tol=1e-6) and rows["B"].start_value == 7
    assert math.isclose(rows["C"].r_squared, 0.003367003, rel_tol=1e-6) and math.isclose(rows["C"].std_dev, 3)
    assert rows["flat"].slope == rows["flat"].r_squared == rows["single"].slope == rows["single"].r_squared == 0


@pytest.mark.parametrize("n, expected", [(5, 5), (25, 25), (39, 39), (40, 21), (59, 30), (100, 21)])
def test_trend_samples(spark, n, expected):
    assert analytics.trend_samples(made(spark, x=[(i * 700, i) for i in range(n)])).count() == expected


def test_stats_and_percentiles(spark):
    rows = made(spark, A=A, B=B, C=C)
    stats = {r.metric_name: r for r in analytics.stats(rows).collect()}
    assert (stats["A"].mean, stats["A"].median, stats["B"].median, stats["C"].median) == (3, 3, 9, 98) and math.isclose(stats["B"].mean, 8.8)
    found = {(r.metric_name, r.percentile): r.value for r in analytics.percentiles(rows).collect()}
    assert [found["A", p] for p in (5, 10, 25, 75, 90, 95, 99)] == [1, 1, 2, 4, 5, 5, 5]
    assert [found["B", p] for p in (5, 10, 25, 75, 90)] == [7, 7, 8, 10, 10] and [found["C", p] for p in (5, 10)] == [88, 98]


def test_percentiles_of_long_series(spark):
    rng = random.Random(4)
    values = [rng.choice([1, 2, 2, 3]) if i % 3 else rng.gauss(0, 9) for i in range(2000)]
    found = {r.percentile: r.value for r in analytics.percentiles(made(spark, x=list(enumerate(values)))).collect()}
    assert found == {p: sorted(values)[math.floor(p / 100 * 1999 + 0.5)] for p in analytics.PERCENTILES}


def test_outliers(spark):
    row = one(analytics.outliers(made(spark, C=C), 2.0))
    assert (row.timestamp, row.deviation) == (3900, -9) and math.isclose(row.score, 0.75)
    assert sorted(r.timestamp for r in analytics.outliers(made(spark, A=A), 1.0).collect()) == [600, 840]
    assert analytics.outliers(made(spark, flat=[(0, 5), (60, 5)])).count() == 0


def test_rate(spark):
    rows = scan.rate_of_change(made(spark, A=A, B=B), 3600).collect()
    assert sorted((r.timestamp, round(r.value, 9)) for r in rows if r.metric_name == "A_rate") == [(t, 60) for t in (660, 720, 780, 840)]
    assert sorted((r.timestamp, round(r.value, 9)) for r in rows if r.metric_name == "B_rate") == [(1100, 36), (1200, 36), (4000, 0)]
    assert rows[0].context["rate_period_seconds"] == "3600"
    spark.conf.set("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
    assert scan.rate_of_change(scan.rate_of_change(made(spark, A=A))).count() == 3


def test_latest_and_ranges(spark):
    assert one(scan.latest(made(spark, B=B))).value == 10
    last = one(scan.latest(made(spark, B=B[:-1])))
    assert (last.timestamp, last.value) == (1100, 9)
    assert sorted(r.value for r in scan.time_range(made(spark, B=B), 1000, 1200).collect()) == [7, 8, 9]
    with pytest.raises(ValueError):
        scan.time_range(made(spark, B=B), 5, 5)
    assert scan.multi_metric_range(made(spark, A=A, B=B), ["A", "B", "A"], 0, 9000).count() == 15
    assert scan.default_range(100000, "x", None) == (13600, 100000) and scan.default_range(9, None, "5", None) == (0, 5)


def test_intervals(spark):
    rows = {r.bucket_start: r for r in aggregate.aggregate_intervals(made(spark, B=B), 3600, "mean").collect()}
    assert (rows[0].value, rows[0].timestamp, rows[3600].value, rows[3600].timestamp) == (8.5, 1200, 10, 4000)
    with pytest.raises(ValueError):
        aggregate.aggregate_intervals(made(spark, B=B), 0, "mean")
    assert one(aggregate.aggregate_range(made(spark, x=[(0, float("nan")), (1, 3)]), "max")).value == 3
    chunks = aggregate.time_chunked(made(spark, B=B), 3600).collect()
    assert [(c.chunk_start, c.chunk_end, c.value) for c in chunks] == [(0, 3600, 10), (0, 3600, 7), (0, 3600, 8), (0, 3600, 9), (3600, 7200, 10)]


def test_percentiles_of_series_with_few_values(spark):
    """Constant and two-valued series next to a plain one: places come from counts of equal values."""
    series = {"constant": [(t, 7) for t in range(300)], "two": [(t, t % 3 == 0) for t in range(300)], "plain": [(t, t * 37 % 300) for t in range(300)]}
    got = {(r.metric_name, r.percentile): r.value for r in analytics.percentiles(made(spark, **series)).collect()}
    for name, points in series.items():
        values = sorted(v for _, v in points)
        assert all(got[name, p] == values[math.floor(p / 100 * 299 + 0.5)] for p in analytics.PERCENTILES)
    whole = {r.metric_name: r for r in analytics.stats(made(spark, **series), analytics.PERCENTILES).collect()}
    assert whole["two"].median == 0 and whole["plain"].median == 149.5 and whole["plain"].percentiles["p95"] == got["plain", 95]


def test_places_of_rows_that_arrive_in_another_order_each_time(spark):
    """Places are put together from two passes over the rows, whose order no shuffle promises."""

    def dealt(batches):
        for batch in batches:
            order = np.random.default_rng(int.from_bytes(os.urandom(4))).permutation(batch.num_rows)
            yield batch.take(pa.array(order))

    rows = spark.range(0, 120_000, 1, 8).select(F.lit("x").alias("metric_name"), (F.pmod(F.xxhash64("id"), F.lit(10**9)) / 1000).alias("value"))
    values = sorted(r.value for r in rows.collect())
    rows = rows.mapInArrow(dealt, rows.schema)
    found = {r.percentile: r.value for r in analytics.percentiles(rows).collect()}
    assert found == {p: values[math.floor(p / 100 * 119_999 + 0.5)] for p in analytics.PERCENTILES}
    assert one(analytics.stats(rows)).median == (values[59_999] + values[60_000]) / 2


def test_cusum(spark):
    rows = sorted(changepoints.cusum(made(spark, D=D), 2.0).collect(), key=lambda r: r["index"])
    assert [r["index"] for r in rows] == [4, 9, 14, 19]
    assert [(round(r.before, 4), round(r.after, 4)) for r in rows] == [(10, 16.25), (10, 19.0909), (18, 20), (20, 20)]


def brute_cusum(points, threshold):
    v = [x for _, x in points]
    n, mean = len(v), sum(v) / len(v)
    sd = math.sqrt(sum((x - mean) ** 2 for x in v) / (n - 1))
    high = low = 0.0
    out = []
    for i, x in enumerate(v):
        high, low = max(0, high + x - mean - sd / 2), max(0, low - x + mean - sd / 2)
        if max(high, low) > threshold * sd:
            out.append(i)
            high = low = 0.0
    return out


def test_cusum_of_random_series(spark):
    rng = random.Random(2)
    series = {f"s{k}": [(i * 50, round(rng.gauss(k, 3) + (i > 60) * 4, 3)) for i in range(130)] for k in range(4)}
    found = changepoints.cusum(made(spark, **series), 1.5).collect()
    for name, points in series.items():
        assert sorted(r["index"] for r in found if r.metric_name == name) == brute_cusum(points, 1.5)


def test_cusum_of_a_series_that_is_most_of_the_table(spark):
    """Spark splits large partitions of a join; a series must not begin anew in the middle."""
    rng = random.Random(9)
    points = [(i * 50, round(rng.gauss(5, 3), 3)) for i in range(20_000)]
    small = {f"s{k}": [(i * 50, round(rng.gauss(k, 3), 3)) for i in range(30)] for k in range(9)}
    rows = made(spark, x=points, **small).repartition(8)
    tuned = {"autoBroadcastJoinThreshold": "-1", "adaptive.autoBroadcastJoinThreshold": "-1", "adaptive.advisoryPartitionSizeInBytes": "20000", "adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000"}
    for key, value in tuned.items():
        spark.conf.set(f"spark.sql.{key}", value)
    try:
        found = changepoints.cusum(rows).collect()
    finally:
        for key in tuned:
            spark.conf.unset(f"spark.sql.{key}")
    for name, points in {"x": points, **small}.items():
        assert sorted(r["index"] for r in found if r.metric_name == name) == brute_cusum(points, 2.0)


def test_cusum_means_of_a_long_series(spark):
    """Means are of few values, the running sums behind them of all: 300,000 values about 1e6, exactly added up."""
    rows = spark.range(0, 300_000, 1, 4).select(F.col("id").alias("timestamp"), F.lit("x").alias("metric_name"), (1e6 + F.pmod(F.xxhash64("id"), F.lit(10_000)) / 100).alias("value"), F.lit("Observation").alias("resource_type"), F.col("id").alias("ingest_seq"), (F.col("id") - F.col("id") % 3600).alias("chunk_id"))
    values = [r.value for r in rows.orderBy("timestamp").collect()]
    found = changepoints.cusum(rows).orderBy("index").collect()
    assert len(found) > 5000
    for r in found[:3] + found[-300:]:
        last = max([0, *[x["index"] for x in found if x["index"] < r["index"]]])
        before = math.fsum(values[last : r["index"]]) / (r["index"] - last)
        after = math.fsum(values[r["index"] :]) / (len(values) - r["index"])
        assert abs(r.before - before) < 1e-9 and abs(r.after - after) < 1e-9


def test_optimal_partition(spark):
    rng = random.Random(8)
    points = [(i * 60, (0 if i < 30 else 12 if i < 55 else 3) + rng.gauss(0, 0.5)) for i in range(80)]
    assert sorted(r["index"] for r in changepoints.optimal_partition(made(spark, x=points), 0.5, 3.0).collect()) == [30, 55]
    assert changepoints.optimal_partition(made(spark, x=points[:19])).count() == 0


def brute_partition(values, penalty, least):
    """Each end against all starts, variances from the values themselves."""
    n = len(values)
    cost, come = [0.0] + [math.inf] * n, [0] * (n + 1)
    for end in range(least, n + 1):
        for start in [0, *range(least, end - least + 1)]:
            if end - start < least:
                continue
            part = values[start:end]
            variance = 0.0 if len(set(part)) == 1 else float(np.var(part, ddof=1))
            total = cost[start] + (len(part) * math.log(variance) / 2 if variance > 0 else -math.inf) + penalty
            if total <= cost[end]:
                cost[end], come[end] = total, start
    found, at = [], n
    while at > 0 and come[at] > 0:
        at = come[at]
        found.append(at)
    return found[::-1]


def test_partition_drops_no_start_that_wins():
    rng = np.random.default_rng(3)
    for k in range(24):
        n = int(rng.integers(3, 130))
        values = rng.normal(0, 1, n) * rng.choice([0.1, 1, 30], n if k % 2 else 1) + (np.arange(n) // 30) * (k % 3)
        if k % 6 == 5:  # equal values, whose cost is minus infinity
            values[n // 2 : n // 2 + 9] = 0.1
        for penalty, least in ((0.0, 2), (1.0, 5), (8.0, 7)):
            assert changepoints.best_partition(values, penalty, least) == brute_partition(values, penalty, least)


def test_partition_of_a_long_series():
    """200,000 rows: with all starts looked at, hundreds of times the work of 10,000."""
    rng = np.random.default_rng(4)
    values = rng.normal(0, 1, 200_000) + np.arange(200_000) // 50 % 2 * 9
    began = time.monotonic()
    found = changepoints.best_partition(values, 1.0)
    assert time.monotonic() - began < 100
    assert len({*range(50, 200_000, 50)} - {*found}) < 40


def test_partition_of_series_in_parts(spark):
    """Series that end inside a batch and series that span several; the same rows for any size of batch."""
    rng = random.Random(6)
    series = {f"s{k}": [(i * 60, (i // 25 % 2) * 8 + rng.gauss(0, 1)) for i in range(60 + 40 * k)] for k in range(5)}
    rows = made(spark, **series)
    whole = sorted(changepoints.optimal_partition(rows, 0.5).collect())
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert sorted(changepoints.optimal_partition(rows, 0.5).collect()) == whole
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert {r.metric_name for r in whole} == {*series}


def test_windows(spark):
    rows = sorted(windows.sliding_windows(made(spark, E=E), 3600, 900, "range").collect(), key=lambda r: r.k)
    assert [(r.start, r.value) for r in rows] == [(100, 4), (1000, 3), (1900, 5)]
    assert windows.sliding_windows(made(spark, A=A), 3600, 900).count() == 0
    with pytest.raises(ValueError):
        windows.sliding_windows(made(spark, A=A), 3600, 0)


def test_moving_average(spark):
    rng = random.Random(5)
    points = [(rng.randrange(40000), rng.random()) for _ in range(300)]
    found = {r.ingest_seq: r.trend for r in seasonal.moving_average(made(spark, x=points), 700).collect()}
    for i, (t, _) in enumerate(points):
        near = [v for u, v in points if abs(u - t) <= 700]
        assert math.isclose(found[i], sum(near) / len(near), rel_tol=1e-9)


def test_moving_average_of_dense_and_uneven_rows(spark):
    """Gaps, several rows at a time, edges of blocks, and a value beside which all others vanish."""
    rng = random.Random(7)
    points = [(t, rng.choice([rng.random(), 5.0])) for t in [*rng.choices(range(300), k=250), *range(20_000, 20_040), *rng.choices(range(0, 90_000, 7), k=200), 33_333]]
    points[100] = (points[100][0], 1e17)
    for half in (0, 3, 50, 4320):
        found = {r.ingest_seq: r.trend for r in seasonal.moving_average(made(spark, x=points), half).collect()}
        assert len(found) == len(points)
        for i, (t, _) in enumerate(points):
            near = [v for u, v in points if abs(u - t) <= half]
            assert math.isclose(found[i], math.fsum(near) / len(near), rel_tol=1e-12)


def test_moving_average_costs_a_row_the_same_however_many_are_near(spark):
    """400,000 rows within an hour: by frames that are added up row by row 1.6e11 steps."""
    rows = spark.range(0, 400_000, 1, 4).select((F.col("id") % 3600).alias("timestamp"), F.lit("x").alias("metric_name"), (F.col("id") % 10).cast("double").alias("value"))
    began = time.monotonic()
    assert one(seasonal.moving_average(rows, 4320).agg(F.min("trend").alias("low"), F.max("trend").alias("high"))) == (4.5, 4.5)
    assert time.monotonic() - began < 60


def test_seasonal(spark):
    points = [(600 * i, 10 + (i % 6)) for i in range(60)]
    rows = sorted(seasonal.decompose(made(spark, x=points), 3600).collect(), key=lambda r: r.timestamp)
    assert {r.season for r in rows} == {6} and math.isclose(sum(r.seasonal for r in rows[:6]), 0, abs_tol=1e-9)
    assert all(math.isclose(r.value, r.trend + r.seasonal + r.residual) for r in rows)
    assert seasonal.decompose(made(spark, x=points[:20]), 3600).count() == 0
    assert seasonal.decompose(made(spark, x=[(5, 1)] * 30), 3600).count() == 0


def test_multivariate(spark):
    a = [(3600 * i, float(i % 7)) for i in range(60)]
    b = [(t, 2 * v + (100 if t == 3600 * 40 else 0) + (i % 3) / 10) for i, (t, v) in enumerate(a)]
    c = [(3600 * i, float((i * 5) % 11)) for i in range(60)]
    rows = made(spark, a=a, b=b, c=c, flat=[(t, 1) for t, _ in a])
    assert [r.timestamp for r in multivariate.mahalanobis(rows, ["a", "b"]).collect()] == [3600 * 40]
    assert [r.timestamp for r in multivariate.mahalanobis(rows, ["a", "b", "c"]).collect()] == [3600 * 40]
    assert [r.timestamp for r in multivariate.max_zscore(rows, ["a", "b"]).collect()] == [3600 * 40]
    assert multivariate.mahalanobis(rows, ["a", "flat"]).count() == 0
    r = {(x.metric_a, x.metric_b): x.r for x in multivariate.correlation_pairs(rows).collect()}
    assert r["a", "flat"] == 0 and -1 <= r["a", "c"] <= 1
    linear = made(spark, a=a, twin=[(t, 3 * v + 1) for t, v in a], c=c)
    assert multivariate.correlated_groups(linear) == [["a", "twin"]]
    assert [g for g, _ in multivariate.multivariate_outliers(linear, [["a", "missing"]])] == [["a", "twin"]]


def test_order_and_delta(spark):
    rows = made(spark, B=B)
    assert [r.delta for r in scan.delta_timestamps(rows).orderBy("ingest_seq").collect()] == [1200, -200, 100, 0, 4000]
    assert [r.ingest_seq for r in scan.order_violations(rows).collect()] == [1]
    assert [r.violation for r in scan.order_violations(rows.withColumn("chunk_id", F.lit(7200))).collect()] == ["outside chunk"] * 5
