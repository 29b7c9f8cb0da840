"""Benchmark decontamination by winnowing, in DataFrame functions only.

A text's fingerprints are the least ``k``-gram hashes of every ``window``
words, each kept once with the first and last window it is least in: about two
for every ``window - k + 2`` words. Two texts that share ``window`` words in a row
have the same least hash there, so the join of training and test fingerprints
misses no shared window. Each hit is extended to the windows it stands for and
compared word by word, so that equal hashes of different words do no harm.

An item shorter than a window is one window. There are at most ``window - 1``
such lengths; each that occurs gets fingerprints of its own length, from the
same pass over the words. Texts themselves stay where they are: only hits move.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shingles import grams, lower_ascii, minima, words
from .storage import Carried, cut, joined

SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: The same for texts whose A-Z are still as they were.
_UNFOLDED = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"


def _changes(at: str) -> F.Column:
    """(mark, first) wherever the array ``at`` has another value than just before."""
    fresh = lambda m, i: F.when((i == 0) | (F.get(at, i - 1) != m), F.struct(m.alias("mark"), i.alias("first")))
    return F.filter(F.transform(at, fresh), lambda r: r.isNotNull())


def _ended(runs: str, at: str, size: int) -> F.Column:
    """(size, mark, first, last) of ``_changes``."""
    last = lambda i: F.coalesce(F.get(runs, i + 1)["first"], F.size(at)) - 1
    return F.transform(runs, lambda r, i: F.struct(F.lit(size).alias("size"), r["mark"].alias("mark"), r["first"].alias("first"), last(i).alias("last")))


def _marks(df: DataFrame, sizes: list[int], k: int, window: int) -> DataFrame:
    """``df`` with ``marks`` instead of ``words``: (size, mark, first, last) of each fingerprint and the windows it is of."""
    names = [c for c in df.columns if c != "words"]
    found = []
    for size in sizes:
        at = f"marks_{size}"
        if size == window:
            df = minima(grams(df, "words", k, at), at, size - k + 1)
        else:
            df = grams(df, "words", size, at)
        # Each projection uses an array of the one before, which is then computed once.
        df = df.withColumn(f"runs_{size}", _changes(at))
        df = df.withColumn(f"runs_{size}", _ended(f"runs_{size}", at, size))
        found.append(f"runs_{size}")
    return df.select(*names, F.flatten(F.array(*found)).alias("marks") if len(found) > 1 else F.col(found[0]).alias("marks"))


def _text(at: str, size: str) -> F.Column:
    return F.array_join(F.slice("words", F.col(at) + 1, F.col(size)), " ")


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = 10, k: int = 4, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` with what occurs of ``benchmark`` in each.

    New columns: ``n_words``, ``n_hit`` (words inside any occurrence of a
    window), ``spans`` (array of start and end, in words, merged), ``items``
    (sorted ids, as strings, of the items with an occurring window). Words are
    runs of digits, letters and all signs beyond ASCII, with A-Z lower-cased.
    Null and empty texts have no words and no hits; items without words have no
    window. Repeated items with one id count once; rows that repeat a row are
    judged alike. An item with a null id hits but is not listed. Columns named
    like a new one are replaced.
    """
    carried = Carried(docs, text, keep)
    base = carried.df.withColumn("key", carried.row_key())
    tests = cut(
        benchmark.select(F.col(item).cast("string").alias("item"), words(lower_ascii(F.col(item_text).cast("string")), SEPARATORS).alias("words"))
        .where(F.size("words") > 0)
        .withColumn("size", F.least(F.size("words"), F.lit(window)))
        .distinct(),
        "tests",
    )
    sizes = sorted(r["size"] for r in tests.select("size").distinct().collect())  # window at most
    spaced = base.select("key", words(lower_ascii("body"), SEPARATORS).alias("words"))
    if not sizes:
        tests, sizes = tests.where("false"), [window]
    # Outer: an inferred filter on the size would compute the arrays again and again.
    own = _marks(tests.select("size", "words"), sizes, k, window).select(F.col("size").alias("own"), F.inline_outer("marks"))
    own = cut(own.where("own = size").select("size", "mark").distinct(), "marks")
    hits = _marks(spaced, sizes, k, window).select("key", F.inline_outer("marks"))
    hits = cut(joined(hits, own, ["size", "mark"], "left_semi").select("key", "size", "first", "last"), "hits")
    starts = cut(hits.groupBy("key").agg(F.collect_set(F.struct("size", "first", "last")).alias("runs")), "starts")
    near = joined(base.select("key", "body"), starts, ["key"], "inner").select("key", "runs", words(lower_ascii("body"), SEPARATORS).alias("words"))
    near = near.select("key", "words", F.explode(F.flatten(F.transform("runs", lambda r: F.transform(F.sequence(r["first"], r["last"]), lambda i: F.struct(i.alias("at"), r["size"].alias("size")))))).alias("w"))
    near = near.select("key", "w.*", _text("w.at", "w.size").alias("text"))
    shown = tests.withColumn("at", F.explode(F.sequence(F.lit(0), F.size("words") - F.col("size")))).select("item", "size", _text("at", "size").alias("text")).distinct()
    shown = cut(shown, "windows")
    real = cut(joined(near, cut(shown.select("size", "text").distinct(), "texts"), ["size", "text"], "left_semi").distinct(), "real")
    ends = real.groupBy("key").agg(F.sort_array(F.collect_set(F.struct(F.col("at").alias("start"), (F.col("at") + F.col("size")).alias("end")))).alias("spans"))
    listed = joined(real.select("key", "size", "text").distinct(), shown, ["size", "text"], "inner").select("key", "item").distinct()
    listed = listed.groupBy("key").agg(F.sort_array(F.collect_set("item")).alias("items"))
    found = cut(ends.join(listed, "key", "left").select("key", _merge("spans").alias("spans"), "items"), "found")
    none = "array<struct<start:int,end:int>>"
    counted = base.select("key", *dict.fromkeys(carried.order), F.size(words("body", _UNFOLDED)).cast("long").alias("n_words"))
    result = joined(counted, found, ["key"], "left")
    result = result.withColumns({"spans": F.coalesce("spans", F.array().cast(none)), "items": F.coalesce("items", F.array().cast("array<string>"))})
    result = result.withColumn("n_hit", F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["start"])))
    return carried.restore(result, "n_words", "n_hit", "spans", "items")


def _merge(spans: str) -> F.Column:
    """Sorted spans of start and end, with those that overlap or touch made one."""
    def add(done: F.Column, s: F.Column) -> F.Column:
        last = F.try_element_at(done, F.lit(-1))
        grown = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))))
        return F.when((F.size(done) > 0) & (last["end"] >= s["start"]), grown).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(spans, F.array().cast("array<struct<start:int,end:int>>"), add)
