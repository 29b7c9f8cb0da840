"""Change points: two one-sided cumulative sums with reset, and optimal partitioning."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.series import ORDER, SERIES

_L, _D = T.LongType(), T.DoubleType()
_CUSUM = [SERIES, "index", "timestamp", "value", "before", "after", "magnitude", "score_ratio", "confidence"]
_PELT = T.StructType([T.StructField(SERIES, T.StringType()), *[T.StructField(n, t) for n, t in (("index", _L), ("timestamp", _L), ("value", _D), ("before", _D), ("after", _D), ("magnitude", _D))]])


def cusum(records: DataFrame, threshold: float = 2.0, min_points: int = 10) -> DataFrame:
    """Rows at which a one-sided sum of deviations passes ``threshold`` sample deviations.

    Slack is half a deviation; both sums begin anew after a crossing. ``before``
    is the mean since the last change (null at the first row), ``after`` that of
    all rows from the change on. Each series passes once through a task in order
    of time, with a state of a few numbers, whatever its length. Both means are
    of differences between running sums, which are kept with what rounding took
    from them: in a long series that is more than the differences' last digits.
    """
    moments = records.groupBy(SERIES).agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.count(F.lit(1)).alias("n"))
    # Moments come as the first row of a series, without a time. After a join by series its
    # shuffle would stay the last, and Spark may split what it takes for a skewed side of a join.
    rows = records.select(SERIES, "value", *ORDER).unionByName(moments.where((F.col("n") >= min_points) & (F.col("sd") > 0)), allowMissingColumns=True)
    rows = rows.repartition(SERIES).sortWithinPartitions(SERIES, *[F.col(c).asc_nulls_first() for c in ORDER]).select(SERIES, "timestamp", "value", "mean", "sd", "n")
    names = [SERIES, "index", "timestamp", "value", "before", "left", "sum", "rest", "score_ratio"]
    types = [pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), *[pa.float64()] * 3]

    def run(batches):
        name, state, mean, sd, n = None, None, None, None, None
        for batch in batches:
            out: list[tuple] = []
            for series, ts, v, *given in zip(*[c.to_pylist() for c in batch.columns]):
                if given[2] is not None:
                    name, (mean, sd, n) = series, given
                    state = (0, 0.0, 0.0, 0.0, 0.0, 0, 0.0, 0.0)  # index, high, low, sum so far and its rest, last change, sum and rest there
                    continue
                if series != name:
                    continue
                i, high, low, seen, rest, last, seen_last, rest_last = state
                high, low = max(0.0, high + v - mean - sd / 2), max(0.0, low - v + mean - sd / 2)
                if high > threshold * sd or low > threshold * sd:
                    before = ((seen - seen_last) + (rest - rest_last)) / (i - last) if i > last else None
                    out.append((series, i, ts, v, before, n - i, seen, rest, max(high, low) / (threshold * sd)))
                    high = low = 0.0
                    last, seen_last, rest_last = i, seen, rest
                total = seen + v
                rest += (seen - total) + v if abs(seen) >= abs(v) else (v - total) + seen
                if i + 1 == n:  # the whole sum follows the changes
                    out.append((series, None, ts, v, None, 0, total, rest, None))
                state = (i + 1, high, low, total, rest, last, seen_last, rest_last)
            columns = list(zip(*out)) if out else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=names)

    kinds = ["string", "long", "long", "double", "double", "long", "double", "double", "double"]
    found = rows.mapInArrow(run, ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds)))
    whole, series = F.col("index").isNull(), Window.partitionBy(SERIES)
    found = found.withColumns({c: F.max(F.when(whole, F.col(c))).over(series) - F.col(c) for c in ("sum", "rest")}).where(~whole)
    found = found.withColumn("after", (F.col("sum") + F.col("rest")) / F.col("left"))
    return found.withColumns({"magnitude": F.abs(F.col("after") - F.col("before")), "confidence": F.least("score_ratio", F.lit(1.0))}).select(*_CUSUM)


@np.errstate(divide="ignore")
def best_partition(values: np.ndarray, penalty: float, least: int = 5, sweep: int = 16) -> list[int]:
    """Starts of the segments after the first, of least total cost.

    A segment costs half its length times the log of its sample variance, and a
    penalty; of equal costs the later start wins.

    Starts that cannot win any more are dropped, which changes no result. With
    the variance over all ``n`` points, a cut never raises the cost of a
    segment; the divisor ``n - 1`` adds ``n * log(n / (n - 1)) / 2``, which falls
    from its value at ``least`` to 1/2, so a cut raises it by ``slack`` at most. A
    start that is worse than the best at ``end`` by more than that loses to
    ``end`` itself from ``end + least`` on. Behind a cost of minus infinity (equal values)
    all costs are that, and the later start wins. Variances are updated point by
    point, so that those of equal values are zero.
    """
    n = len(values)
    slack = least * np.log(least / (least - 1)) - 0.5 + 1e-3  # the last term is for rounding
    come, gone = np.zeros(n + 1, np.int64), n + 1
    state = np.zeros((4, 256))  # of each start: cost up to it, mean and squares since, end from which it is dropped
    start = np.zeros(256, np.int64)
    state[3, 0], m = gone, 1
    for end in range(1, n + 1):
        v, size = values[end - 1], end - start[:m]
        cost, mean, squares, until = state[:, :m]
        off = v - mean
        mean += off / size
        squares += off * (v - mean)
        if end < least:
            continue
        k = int(np.searchsorted(start[:m], end - least, "right"))
        size = size[:k]
        total = cost[:k] + size * np.log(squares[:k] / (size - 1)) / 2
        best = k - 1 - int(total[::-1].argmin())
        lowest, come[end] = total[best] + penalty, start[best]
        np.minimum(until[:k], np.where(total > lowest + slack, end + least, gone) if lowest > -np.inf else end + least, out=until[:k])
        if m == len(start) or end % sweep == 0:
            kept = np.flatnonzero(until > end)
            start[: len(kept)], state[:, : len(kept)], m = start[kept], state[:, kept], len(kept)
            if 2 * m > len(start):
                start, state = np.concatenate([start, np.zeros_like(start)]), np.concatenate([state, np.zeros_like(state)], axis=1)
        start[m], state[:, m], m = end, (lowest, 0.0, 0.0, gone), m + 1
    found, at = [], n
    while at > 0 and come[at] > 0:
        at = int(come[at])
        found.append(at)
    return found[::-1]


def optimal_partition(records: DataFrame, threshold: float = 2.0, penalty: float = 1.0, min_points: int = 20, least: int = 5) -> DataFrame:
    """Changes between segments of least total cost whose means differ by over ``threshold`` sample deviations.

    A series passes once through one task in order of time, as three numbers a
    row. The search keeps the starts that can still win, see ``best_partition``:
    their number follows the length of segments, not that of the series.
    """
    rows = records.select(SERIES, "value", *ORDER).repartition(SERIES).sortWithinPartitions(SERIES, *ORDER).select(SERIES, "timestamp", "value")

    def changes(series: str, parts: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple]:
        ts, v = map(np.concatenate, zip(*parts))
        sd = v.std(ddof=1) if len(v) >= min_points else 0.0
        out = []
        if sd > 0:
            edges = [0, *best_partition(v, penalty, least), len(v)]
            means = [v[i:j].mean() for i, j in zip(edges, edges[1:])]
            for at, before, after in zip(edges[1:-1], means, means[1:]):
                if abs(after - before) > threshold * sd:
                    out.append((series, at, int(ts[at]), v[at], before, after, abs(after - before)))
        return out

    def made(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out)) if out else [()] * len(_PELT)
        types = [pa.string(), pa.int64(), pa.int64(), *[pa.float64()] * 4]
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=_PELT.names)

    def run(batches):
        name, parts = None, []
        for batch in batches:
            for run_ in _runs(batch):
                series = run_.column(0)[0].as_py()
                if parts and series != name:
                    yield made(changes(name, parts))
                    parts = []
                name = series
                parts.append((run_.column(1).to_numpy(zero_copy_only=False).copy(), run_.column(2).to_numpy(zero_copy_only=False).copy()))
        if parts:
            yield made(changes(name, parts))

    return rows.mapInArrow(run, _PELT)


def _runs(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The slices of ``batch`` that are of one series."""
    if batch.num_rows:
        name = batch.column(0)
        edge = (np.flatnonzero(pc.not_equal(name[1:], name[:-1]).to_numpy(zero_copy_only=False)) + 1).tolist()
        for i, j in zip([0, *edge], [*edge, batch.num_rows]):
            yield batch.slice(i, j - i)
