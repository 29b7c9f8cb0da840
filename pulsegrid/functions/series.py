"""Order inside long series, without a task that holds a whole series.

A series is cut at its time chunks: windows run inside (series, chunk), and
what crosses a chunk's edge comes from a table of one row per series and chunk.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ORDER = ["timestamp", "chunk_id", "ingest_seq"]
SERIES = "metric_name"
#: Values of a series that its ranges are drawn from, at most.
SAMPLE = 4096


def with_previous(records: DataFrame, take: list[str], out: str = "previous") -> DataFrame:
    """``records`` with a struct of ``take`` of the row before in the series, or null."""
    item = F.struct(*take)
    within = Window.partitionBy(SERIES, "chunk_id").orderBy(*ORDER)
    edges = records.groupBy(SERIES, "chunk_id").agg(F.max_by(item, F.struct(*ORDER)).alias("last"))
    edges = edges.select(SERIES, "chunk_id", F.lag("last").over(Window.partitionBy(SERIES).orderBy("chunk_id")).alias("edge"))
    rows = records.withColumn(out, F.lag(item).over(within)).join(edges, [SERIES, "chunk_id"])
    return rows.withColumn(out, F.coalesce(out, "edge")).drop("edge")


def with_rank(records: DataFrame, out: str = "rank") -> DataFrame:
    """``records`` with the place in the series by time, from 0, and the series' ``n``."""
    counts = records.groupBy(SERIES, "chunk_id").agg(F.count(F.lit(1)).alias("c"))
    before = Window.partitionBy(SERIES).orderBy("chunk_id").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(SERIES, "chunk_id", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("skip"), F.sum("c").over(Window.partitionBy(SERIES)).alias("n"))
    within = Window.partitionBy(SERIES, "chunk_id").orderBy(*ORDER)
    rows = records.withColumn(out, F.row_number().over(within)).join(counts, [SERIES, "chunk_id"])
    return rows.withColumn(out, F.col(out) - 1 + F.col("skip")).drop("skip")


def value_places(records: DataFrame, value: str = "value") -> DataFrame:
    """``metric_name, value, low, high, n``: the places, from 0, that each distinct value takes in its series' order.

    Equal values are counted before anything is ordered, so a series of one or
    two values is as spread as any. Distinct values fall into ranges between
    percentiles of a sample of their series: of each of ``SAMPLE`` classes of
    hashes the value of the least. The ranges are needed twice, and unlike
    approximate percentiles they do not depend on the order in which rows arrive.
    """
    rows = records.groupBy(SERIES, value).agg(F.count(F.lit(1)).alias("c"))
    drawn = F.struct(F.xxhash64(value).alias("hash"), F.col(value).alias("value"))
    sample = rows.groupBy(SERIES, F.pmod(drawn["hash"], F.lit(SAMPLE)).alias("class")).agg(F.min(drawn)["value"].alias("drawn"), F.sum("c").alias("c"))
    sample = sample.groupBy(SERIES).agg(F.sort_array(F.collect_list("drawn")).alias("drawn"), F.sum("c").alias("n"))
    steps = F.transform(F.sequence(F.lit(1), F.lit(99)), lambda i: F.get("drawn", F.floor(i * F.size("drawn") / 100).cast("int")))
    cuts = sample.select(SERIES, steps.alias("cuts"), "n")
    rows = rows.join(cuts, SERIES).withColumn("part", F.size(F.filter("cuts", lambda c: c < F.col(value)))).drop("cuts")
    counts = rows.groupBy(SERIES, "part").agg(F.sum("c").alias("all"))
    before = Window.partitionBy(SERIES).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(SERIES, "part", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("skip"))
    up_to = Window.partitionBy(SERIES, "part").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("up_to", F.sum("c").over(up_to)).join(counts, [SERIES, "part"])
    high = F.col("skip") + F.col("up_to") - 1
    return rows.select(SERIES, value, (high - F.col("c") + 1).alias("low"), high.alias("high"), "n")
