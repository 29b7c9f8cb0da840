"""Threshold-scaled document sketches, in DataFrame functions only.

A sketch keeps every shingle hash below a fixed fraction of the hash range,
so its size follows the document's and the share of kept hashes found in
another sketch estimates containment without bias, however unequal the two
documents are. A text in which no hash is below keeps its least hash, so that
only a text without words has an empty sketch. Sketches merge: the union of
two, without what lies above the threshold if anything lies below.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .order import neighbours
from .shingles import grams, words
from .storage import Carried, cut

SPACES = "[\\x20\\x09-\\x0D]+"


def _threshold(fraction: float) -> int:
    return min(-(1 << 63) + int(fraction * (1 << 64)), (1 << 63) - 1)


def sketches(df: DataFrame, text: str, out: str, shingle: int = 5, fraction: float = 0.125) -> DataFrame:
    """``df`` with ``out``: the sorted sketch of the whole of ``text``.

    Shingles are ``shingle`` words in a row; a text of fewer words is one
    shingle. Null, empty and blank texts have an empty sketch. Repeated
    shingles count once.
    """
    names = df.columns
    df = df.withColumn("sk_words", words(text, SPACES))
    df = grams(df, "sk_words", shingle, "sk_hash")
    df = df.withColumn("sk_hash", F.when(F.size("sk_words").between(1, shingle - 1), F.array(F.xxhash64("sk_words"))).otherwise(F.col("sk_hash")))
    return df.withColumn(out, F.array_sort(F.array_distinct(F.filter("sk_hash", lambda h: h < F.lit(_threshold(fraction)))))).select(*[n for n in names if n != out], out)


def merged(a: str, b: str) -> Column:
    """The sketch of the union of two documents' shingles."""
    return F.array_sort(F.array_union(a, b))


def containment(a: str, b: str) -> Column:
    """Estimated share of the smaller document's shingles that the other has.

    Two empty sketches are equal: 1; an empty one and another: 0.
    """
    smaller = F.least(F.size(a), F.size(b))
    shared = F.size(F.array_intersect(a, b)).cast("double") / F.when(smaller > 0, smaller.cast("double"))
    return F.coalesce(shared, F.when(F.size(a) == F.size(b), 1.0).otherwise(0.0))


def printed(sketch: str) -> Column:
    return F.array_join(F.transform(sketch, lambda h: F.lower(F.hex(h))), " ")


def fingerprints(docs: DataFrame, text: str = "text", keep: list[str] | None = None, shingle: int = 5, fraction: float = 0.125) -> DataFrame:
    """The columns ``keep`` of ``docs`` with ``sketch`` (sorted array of longs)."""
    carried = Carried(docs, text, keep)
    return carried.restore(sketches(carried.df, "body", "sketch", shingle, fraction), "sketch")


def compared_with_edits(docs: DataFrame, text: str = "text", ident: str = "doc_id", keep: list[str] | None = None, shingle: int = 5, fraction: float = 0.125) -> DataFrame:
    """Sketches of texts, of edited texts, and their likeness.

    In an edited text the last ``floor(n / 3)`` of n code points give way to
    as many first code points (or all) of the next document by descending id,
    after the last that of the first. Null ids come last; equal ids go by a
    hash of the row; rows that repeat a whole row stand in one place. A null
    text is empty. New columns: ``n_chars``, ``edited``, ``sketch``,
    ``edited_sketch``, ``near_edited`` and ``near_next``; input columns of
    these names are replaced.

    Only keys and lengths are put in order. Texts are sketched once and
    shuffled once, by key; of the next text no more than the part that is
    taken is sent on.
    """
    carried = Carried(docs, text, keep)
    c_id = carried.at(ident)
    if c_id not in carried.columns:
        raise ValueError(f"keep must hold {ident}")
    base = carried.df.withColumns({"key": carried.row_key(), "body": F.coalesce("body", F.lit(""))})
    lengths = base.groupBy(F.col(c_id).alias("id"), "key").agg(F.max(F.char_length("body")).alias("n"))
    ordered = cut(neighbours(lengths, ["id", "key"], ["key", "n"]).select("key", "n", "after", "before"), "order")
    first = ordered.where("before is null").select("key", "n").head()  # the least id: its next is the greatest
    if first is not None:
        ordered = ordered.withColumn("after", F.coalesce("after", F.struct(F.lit(first["key"]).alias("key"), F.lit(first["n"]).alias("n"))))
    goes = ordered.select(F.col("key").alias("from_key"), F.col("after.key").alias("to_key"), F.floor(F.col("after.n") / 3).cast("int").alias("take"))
    dealt = sketches(base, "body", "sketch", shingle, fraction).repartition("key")
    # A hash of the other columns goes along so that the exchange of ``dealt`` is the same for both uses.
    head = F.struct(F.substring("body", F.lit(1), F.col("take")).alias("head"), F.col("sketch").alias("next_sketch"), F.xxhash64(*carried.columns).alias("rest"))
    sent = dealt.join(goes, F.col("key") == F.col("from_key")).select("to_key", head.alias("next"))
    sent = sent.groupBy("to_key").agg(F.first("next").alias("next")).select("to_key", "next.head", "next.next_sketch")
    both = dealt.join(sent, F.col("key") == F.col("to_key"))
    n = F.char_length("body")
    both = both.withColumns({"n_chars": n.cast("long"), "edited": F.concat(F.substring("body", F.lit(1), n - F.floor(n / 3).cast("int")), F.col("head"))})
    both = sketches(both, "edited", "edited_sketch", shingle, fraction)
    both = both.withColumns({"near_edited": containment("sketch", "edited_sketch"), "near_next": containment("sketch", "next_sketch")})
    return carried.restore(both, "n_chars", "edited", "sketch", "edited_sketch", "near_edited", "near_next")
