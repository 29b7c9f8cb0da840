"""Connected components of an edge table, distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import cut


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step: edges move to smaller nodes."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
    down = large.groupBy("a").agg(F.min("b").alias("m"))
    small = large.join(down, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
    return small.select("e.a", "e.b").where("a != b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, component``: the smallest node that each node of ``a, b`` reaches.

    Alternates large-star and small-star steps; each round is a written table.
    Ends when a round changes nothing: every node then points at its smallest.
    """
    tally = lambda e: tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    now = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b"), "edges")
    seen = tally(now)
    while seen[0]:
        now = cut(_stars(now), "edges")
        last, seen = seen, tally(now)
        if last == seen:
            break
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.union(stars.select("component", "component").distinct())
