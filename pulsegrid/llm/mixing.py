"""Mixing sources to target weights by systematic sampling.

Within a source every document is expected ``target / size of the source``
times. Documents stand in order of size, so the prefix sums of expected copies
run evenly over all sizes; one random offset is added, and a document is
emitted once per integer boundary that its part of the prefix sum crosses.

The prefix sum of equal steps is step x rank. Ranks come from counts of
(source, size, bucket) groups, so no task orders a whole source: the windows
run over at most the distinct sizes of a source, the buckets of one size, and
the documents of one bucket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shingles import words
from .storage import Carried, cut

SPACES = "[\\x20\\x09-\\x0D]+"


def _bucket(column: str) -> F.Column:
    return F.substring(F.md5(F.coalesce(F.col(column).cast("string"), F.lit(""))), 1, 2)


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``source, source_size`` -> with ``target``: ``share`` of all sizes, dealt by weight.

    Sources take the weights in code point order, null last. A target stops at
    ``most`` times its source's size; the excess goes to the others by weight
    until none is above. With the sources in order of size over weight, the
    ones that stop are a prefix, and the level of the rest follows from sums.
    One row per source; sources without words get zero.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")).cast("long")
    ranked = sizes.withColumn("weight", weight).withColumn("ratio", F.col("source_size").cast("double") / F.col("weight"))
    up_to = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    everyone = Window.partitionBy()
    ranked = ranked.withColumns({
        "stopped": F.coalesce(F.sum("source_size").over(up_to), F.lit(0)),
        "gone": F.coalesce(F.sum("weight").over(up_to), F.lit(0)),
        "total": F.sum("source_size").over(everyone),
        "all_weight": F.sum("weight").over(everyone),
    })
    level = (F.lit(share) * F.col("total") - F.lit(most) * F.col("stopped")) / (F.col("all_weight") - F.col("gone")).cast("double")
    ranked = ranked.withColumn("level", F.when(level <= F.lit(most) * F.col("ratio"), level))
    ranked = ranked.withColumn("level", F.max("level").over(everyone))
    cap = F.lit(most) * F.col("source_size")
    target = F.least(cap, F.coalesce(F.col("level") * F.col("weight"), cap))
    return ranked.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, text: str = "text", source: str = "source", ident: str = "doc_id", weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all by default) with ``size``, ``source_size``, ``target`` and ``copies``.

    ``size`` counts words (runs of anything but x20 and x09-x0D; null text: 0).
    ``copies`` is how often the mix takes the document: the integers between
    two neighbouring prefix sums, so never more than ``most`` rounded up. The
    random offset of a source is drawn from its name (12 bits, so that whole steps
    add without rounding), and reruns agree.
    Rows tied in size and id are interchangeable. A null source is a source of
    its own. Every row is returned, also with zero copies.
    """
    kept = docs.columns if keep is None else keep
    carried = Carried(docs, text, list(dict.fromkeys([*kept, source, ident, text])))
    c_source, c_id = carried.at(source), carried.at(ident)
    sized = carried.df.withColumns({
        "size": F.size(words("body", SPACES)).cast("long"),
        "source": F.col(c_source).cast("string"),
        "bucket": _bucket(c_id),
    })
    if text.lower() not in {n.lower() for n in kept}:
        sized = cut(sized.drop("body"), "mix-sizes")  # texts are read once, to be counted
    groups = cut(sized.groupBy("source", "size", "bucket").agg(F.count(F.lit(1)).alias("n")), "mix-groups")
    of_size = groups.groupBy("source", "size").agg(F.sum("n").alias("n"))
    by_source = targets(of_size.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size")), weights, share, most)
    before_size = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    before_bucket = Window.partitionBy("source", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    of_size = of_size.select("source", "size", F.coalesce(F.sum("n").over(before_size), F.lit(0)).alias("smaller"))
    same = lambda a, b, *names: [a[x].eqNullSafe(b[x]) for x in names]
    inner = groups.withColumn("before", F.coalesce(F.sum("n").over(before_bucket), F.lit(0)))
    starts = inner.join(of_size, same(inner, of_size, "source", "size"), "inner").select(inner["source"], inner["size"], "bucket", (F.col("before") + F.col("smaller")).alias("before"))
    starts = starts.join(by_source, same(starts, by_source, "source"), "inner").select(starts["source"].alias("s_source"), starts["size"].alias("s_size"), F.col("bucket").alias("s_bucket"), "before", "source_size", "target")
    within = Window.partitionBy("source", "size", "bucket").orderBy(c_id)
    ranked = sized.withColumn("rank", F.row_number().over(within)).join(starts, [F.col("source").eqNullSafe(F.col("s_source")), F.col("size") == F.col("s_size"), F.col("bucket") == F.col("s_bucket")], "inner")
    step = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size").cast("double")).otherwise(0.0)
    offset = F.conv(F.substring(F.md5(F.coalesce("source", F.lit(""))), 1, 3), 16, 10).cast("double") / F.lit(4096.0)
    ranked = ranked.withColumns({"step": step, "offset": offset, "place": (F.col("before") + F.col("rank")).cast("double")})
    copies = F.floor(F.col("place") * F.col("step") + F.col("offset")) - F.floor((F.col("place") - 1.0) * F.col("step") + F.col("offset"))
    new = ["size", "source_size", "target", "copies"]
    ranked = ranked.withColumn("copies", copies.cast("long"))
    given = [F.col(c).alias(n) for c, n in zip(carried.order, carried.names) if n.lower() in {k.lower() for k in kept} - {*new}]
    return ranked.select(*given, *new)
