"""Neighbours in a total order, without ever ordering all rows in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import cut


def neighbours(df: DataFrame, order: list[str], take: list[str], lead: str = "after", lag: str = "before") -> DataFrame:
    """``df`` with structs of ``take`` of the row after and the row before, null at the ends.

    Rows are range-partitioned by ``order`` (ascending, nulls first) and written;
    windows run inside a partition, and its edges come from a table of one row
    per partition. ``order`` should tell all rows apart.
    """
    ranged = df.repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    ranged = cut(ranged, "ordered")
    within = Window.partitionBy("part").orderBy(*order)
    item, key = F.struct(*take), F.struct(*order)
    edges = ranged.groupBy("part").agg(F.min_by(item, key).alias("low"), F.max_by(item, key).alias("high"))
    line = Window.orderBy("part")  # one row per partition of the ordered table
    edges = cut(edges.select("part", F.lead("low").over(line).alias("edge_after"), F.lag("high").over(line).alias("edge_before")), "edges")
    out = ranged.withColumns({lead: F.lead(item).over(within), lag: F.lag(item).over(within)})
    out = out.join(F.broadcast(edges), "part")  # at most as many rows as the ordered table had partitions
    return out.withColumns({lead: F.coalesce(lead, "edge_after"), lag: F.coalesce(lag, "edge_before")}).drop("part", "edge_after", "edge_before")
