"""Substring dedup with a count-min prefilter.

A window is ``window`` consecutive words of one text. Pass 1 winnows each text:
a window belongs to the least hash of its k-grams, equal windows to equal ones,
and neighbouring windows mostly share theirs. The selected k-grams, one for
each range of windows, are counted in a count-min sketch of ``depth`` rows;
each map task pre-aggregates the cells of its own sketch and the shuffle merges
them by addition. A k-gram occurs as often as any window that belongs to it or
more often, and a cell never undercounts, so windows with an estimate of one
occur once; all others are estimated repeated and none is lost. Pass 2
groups exactly what is estimated repeated. Ranges of windows with equal words
throughout are grouped whole: all their windows are repeated. Where ranges share
the k-gram but not all words, one of each kind is spread into its windows,
which are grouped by a 96-bit hash of their words.

All counts return the complement: a cell or window that was counted once
still knows the text and position it came from, so positions come back without
a join on a hot key, and no task ever holds the group of a frequent window.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tokens
from .storage import Carried, lists, pieces, rebuild, utf8

_L, _I = T.LongType(), T.IntegerType()
_CELL = T.StructType([T.StructField("cell", _L), T.StructField("key", _L), T.StructField("low", _I), T.StructField("high", _I)])
# Not null, so that joins add no filters and the exchange of ranges is the same for every use.
_RANGE = T.StructType([*[T.StructField(n, _L, False) for n in ("a", "e", "key")], T.StructField("low", _I, False), T.StructField("high", _I, False)])
_WINDOW = T.StructType([T.StructField("h", _L), T.StructField("g", _I), T.StructField("weight", _I), T.StructField("key", _L), T.StructField("pos", _I)])


def remove_repeated(docs: DataFrame, text: str = "text", window: int = 35, k: int = 8, depth: int = 2, keep: list[str] | None = None) -> DataFrame:
    """Remove each word that a window occurring anywhere else covers.

    Returns the columns ``keep`` of ``docs`` (all by default) with ``n_words``, ``n_removed`` and
    ``kept_text`` (kept words joined by one space). Words are runs of anything
    but x20 and x09-x0D. Null and empty texts have no words and give an empty
    ``kept_text``; texts shorter than a window lose nothing. Windows are judged
    on the input. Rows that repeat a whole row count as other occurrences, so
    both lose their windows. Columns named like a new one are replaced.
    """
    width = _width(docs, text)
    carried = Carried(docs, text, keep)
    order = carried.order
    base = carried.df.withColumn("key", carried.row_key())

    def cells(batches):
        for batch in batches:
            data, offsets, _ = utf8(batch.column(0))
            keys = batch.column(1).to_numpy()
            for i, j in pieces(offsets):
                part = data[offsets[i] : offsets[j]]
                starts, ends, at = tokens.words(part, offsets[i : j + 1] - offsets[i])
                grams = tokens.Rolling(tokens.word_codes(part, starts, ends)).grams(k)
                own, doc, low, high = tokens.owned_ranges(grams, at, window, k)
                if not len(own):
                    continue
                h = grams[own]
                cell = [(tokens.mix(h + np.uint64(r * 0x9E3779B1)) & np.uint64(width - 1)).astype(np.int64) + r * width for r in range(depth)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(cell)), pa.array(np.tile(keys[i:j][doc], depth)), *[pa.array(np.tile((x - at[doc]).astype(np.int32), depth)) for x in (low, high)]], names=_CELL.names)

    sketch = base.select("body", "key").where("body is not null").mapInArrow(cells, _CELL)
    alone = sketch.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), *[F.min(c).alias(c) for c in ("key", "low", "high")]).where("n = 1")
    once = alone.groupBy(F.col("key").alias("key_unique")).agg(F.collect_list("low").alias("low"), F.collect_list("high").alias("high"))
    dealt = base.repartition("key")
    judged = dealt.join(once, F.col("key") == F.col("key_unique"), "left").drop("key_unique")

    def ranges(batches):
        for batch in batches:
            data, offsets, _ = utf8(batch.column(0))
            keys = batch.column(1).to_numpy()
            unique, unique_at = lists(batch.column(batch.num_columns - 2))
            for i, j in pieces(offsets):
                part = data[offsets[i] : offsets[j]]
                starts, ends, at = tokens.words(part, offsets[i : j + 1] - offsets[i])
                rolling = tokens.Rolling(tokens.word_codes(part, starts, ends))
                grams = rolling.grams(k)
                own, doc, low, high = tokens.owned_ranges(grams, at, window, k)
                known = unique[unique_at[i] : unique_at[j]] + np.repeat(at[:-1], np.diff(unique_at[i : j + 1]))
                open_ = ~np.isin(low, known)
                own, doc, low, high = own[open_], doc[open_], low[open_], high[open_]
                if len(own):
                    inner = ((own - low).astype(np.uint64) << np.uint64(32)) | (high - low).astype(np.uint64)
                    content = tokens.mix(rolling.runs(low, high + window) ^ tokens.mix(inner + np.uint64(1)))
                    yield pa.RecordBatch.from_arrays([pa.array(grams[own].view(np.int64)), pa.array(content.view(np.int64)), pa.array(keys[i:j][doc]), *[pa.array((x - at[doc]).astype(np.int32)) for x in (low, high)]], names=_RANGE.names)

    # All columns, although the text and key would do: only then is the exchange of ``dealt`` the same for every use.
    found = judged.select("body", "key", *carried.columns, "low", "high").mapInArrow(ranges, _RANGE)
    # Equal ranges are equally long; the representative is fixed by its key, also if a task runs again.
    equal = found.groupBy("a", "e").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("key"), F.min_by("low", "key").alias("low"), F.min(F.col("high") - F.col("low")).alias("more"))
    by_gram = equal.groupBy("a").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"), *[F.min(c).alias(c) for c in ("key", "low", "more")])
    by_gram = by_gram.where("total > 0 and key is not null and low >= 0 and more >= 0")  # always so; keeps the columns, and thus the exchanges, the same for both uses
    false = by_gram.where("total = 1").withColumn("high", F.col("low") + F.col("more"))
    false = false.groupBy(F.col("key").alias("key_false")).agg(F.collect_list("low").alias("false_low"), F.collect_list("high").alias("false_high"))
    spread = equal.join(by_gram.where("kinds > 1").select("a"), "a", "left_semi").withColumn("high", F.col("low") + F.col("more"))
    spread = spread.groupBy(F.col("key").alias("key_open")).agg(F.collect_list(F.struct("low", "high", F.when(F.col("n") > 1, 2).otherwise(1).alias("weight"))).alias("open"))
    spread = spread.select("key_open", F.col("open.low").alias("open_low"), F.col("open.high").alias("open_high"), F.col("open.weight").alias("open_weight"))
    opened = judged.join(spread, F.col("key") == F.col("key_open")).select("body", "key", *carried.columns, "low", "high", "open_low", "open_high", "open_weight")

    def windows(batches):
        for batch in batches:
            data, offsets, _ = utf8(batch.column(0))
            keys = batch.column(1).to_numpy()
            low, low_at = lists(batch.column(batch.num_columns - 3))
            high, _ = lists(batch.column(batch.num_columns - 2))
            weight, _ = lists(batch.column(batch.num_columns - 1))
            for i, j in pieces(offsets):
                part = data[offsets[i] : offsets[j]]
                starts, ends, at = tokens.words(part, offsets[i : j + 1] - offsets[i])
                take = slice(low_at[i], low_at[j])
                of, pos = tokens.spread(low[take], high[take])
                doc = np.repeat(np.arange(j - i), np.diff(low_at[i : j + 1]))[of]
                rolling = tokens.Rolling(tokens.word_codes(part, starts, ends))
                s = pos + at[doc]
                h, g = rolling.runs(s, s + k), rolling.runs(s + k, s + window)
                h, g = (h ^ (g & np.uint64(0xFFFFFFFF00000000))).view(np.int64), (g & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(g), pa.array(weight[take][of].astype(np.int32)), pa.array(keys[i:j][doc]), pa.array(pos.astype(np.int32))], names=_WINDOW.names)

    grouped = opened.mapInArrow(windows, _WINDOW).groupBy("h", "g")
    alone = grouped.agg(F.sum("weight").alias("n"), F.min("key").alias("key"), F.min("pos").alias("pos")).where("n = 1")
    lone = alone.groupBy(F.col("key").alias("key_lone")).agg(F.collect_list("pos").alias("lone"))
    result = judged.join(false, F.col("key") == F.col("key_false"), "left").join(lone, F.col("key") == F.col("key_lone"), "left")
    low, high = (F.concat(F.coalesce(x, F.array()), F.coalesce(f"false_{x}", F.array())) for x in ("low", "high"))
    result = result.select("body", low.alias("low"), high.alias("high"), "lone", *carried.columns)
    schema = T.StructType([*carried.fields(), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())])

    def apply(batches):
        for batch in batches:
            data, offsets, _ = utf8(batch.column(0))
            low, low_at = lists(batch.column(1))
            high, _ = lists(batch.column(2))
            lone, lone_at = lists(batch.column(3))
            raw = data.tobytes()
            n_words, n_removed, kept = [], [], []
            for d in range(batch.num_rows):
                ws = raw[offsets[d] : offsets[d + 1]].split()
                flags = tokens.outside(len(ws) - window + 1, low[low_at[d] : low_at[d + 1]], high[low_at[d] : low_at[d + 1]])
                flags[lone[lone_at[d] : lone_at[d + 1]]] = False
                hit = np.flatnonzero(flags)
                n_words.append(len(ws))
                if not len(hit):
                    n_removed.append(0)
                    kept.append(b" ".join(ws))
                    continue
                edge = np.zeros(len(ws) + 1, np.int64)
                np.add.at(edge, hit, 1)
                np.add.at(edge, hit + window, -1)
                keep = np.cumsum(edge)[:-1] == 0
                n_removed.append(int(len(ws) - keep.sum()))
                kept.append(b" ".join(compress(ws, keep.tolist())))
            yield pa.RecordBatch.from_arrays([*rebuild(batch, order), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=schema.names)

    return carried.restore(result.mapInArrow(apply, schema), "n_words", "n_removed", "kept_text", mapped=True)


def _width(docs: DataFrame, text: str) -> int:
    """Cells of a sketch row: a power of two that follows the size of the input.

    A selected k-gram comes about every 65 bytes, so a cell for every four
    bytes keeps the load of a row near a tenth at any input size.
    """
    size = docs.agg(F.sum(F.octet_length(F.col(text).cast("string"))).alias("size")).first()["size"] or 0
    return 1 << max(10, int(size // 4).bit_length())
