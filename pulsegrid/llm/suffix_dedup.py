"""Exact removal of repeated byte strings by depth-limited radix passes over suffixes.

A suffix is told apart from others only through its first ``depth`` bytes.
Passes take its digits in text order, the most significant first; a group that
holds one suffix is final and leaves, a group that is left after the last pass
is exactly a repeated ``depth``-byte string.

Ordering every suffix would move a row for each byte, so rows stand for runs of
neighbouring suffixes for as long as possible:

* Sampling. The least hash of ``digit`` bytes within a suffix's ``depth`` bytes
  is its anchor. Equal suffixes have equal anchors at equal places, and the
  suffixes of one text that share an anchor form one run (one row per 130
  bytes). Runs whose anchor occurs once leave; runs that are equal from their
  first suffix's start to their last suffix's end become one, of weight two.
* Pass 1. Runs that share an anchor without being equal are cut, at fixed
  distances from the anchor, into runs of ``width`` suffixes. What the suffixes
  of a run have in common, the run's stem, is the most significant digit: all
  but ``width - 1`` of the ``depth`` bytes. Runs that are equal throughout
  become one again.
* Pass 2. Runs whose stem is shared with other runs are spread into suffixes,
  and the last digit takes what is left of the ``depth`` bytes.

Groups are keyed by hashes of the digits so far: 64 bits where a collision
only delays a suffix's leaving, 128 bits where it would decide. Each pass counts
with map-side combine, and what is counted once returns its own text and place
(the complement of the repeated), so no hot group is gathered.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tokens
from .storage import Carried, cut, lists, pieces, rebuild, utf8

_L, _I = T.LongType(), T.IntegerType()
_ROW = [T.StructField("key", _L), T.StructField("tag", _I)]
_RUN = T.StructType([T.StructField("anchor", _L), T.StructField("content", _L), *_ROW, *[T.StructField(n, _I) for n in ("low", "high", "at")]])
_STEM = T.StructType([T.StructField("stem", _L), T.StructField("content", _L), *_ROW, *[T.StructField(n, _I) for n in ("weight", "low", "high")]])
_SUFFIX = T.StructType([T.StructField("d", _L), T.StructField("e", _L), T.StructField("weight", _I), *_ROW, T.StructField("pos", _I)])


def _int(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.int32))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _content(rolling: tokens.Rolling, mark: np.ndarray, low: np.ndarray, high: np.ndarray, depth: int) -> np.ndarray:
    """Equal for runs of suffixes that are equal throughout and lie alike around ``mark``."""
    inner = ((mark - low).astype(np.uint64) << np.uint64(32)) | (high - low).astype(np.uint64)
    return tokens.mix(rolling.runs(low, high + depth) ^ tokens.mix(inner + np.uint64(1)))


def stems(low: np.ndarray, high: np.ndarray, anchor: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(index of the run, first and last start, start of the stem) of runs cut at multiples of ``width`` before their anchor.

    A stem starts at such a multiple, also where its run ends before: equal
    suffixes then have equal stems, whatever is around them.
    """
    run, step = tokens.spread((anchor - high) // width, (anchor - low) // width)
    stem = anchor[run] - step * width
    return run, np.maximum(stem - width + 1, low[run]), np.minimum(stem, high[run]), stem


def _by_row(rows: DataFrame, suffix: str, *columns: str) -> DataFrame:
    """One row per text: ``key_``, ``tag_`` and the lists of ``columns``, each with ``suffix``."""
    grouped = rows.groupBy(F.col("key").alias(f"key_{suffix}"), F.col("tag").alias(f"tag_{suffix}")).agg(F.collect_list(F.struct(*columns)).alias("found"))
    return grouped.select(f"key_{suffix}", f"tag_{suffix}", *[F.col(f"found.{c}").alias(f"{suffix}_{c}") for c in columns])


def _met(dealt: DataFrame, found: DataFrame, suffix: str, how: str) -> DataFrame:
    return dealt.join(found, (F.col("key") == F.col(f"key_{suffix}")) & (F.col("tag") == F.col(f"tag_{suffix}")), how)


def remove_repeated_bytes(docs: DataFrame, text: str = "text", depth: int = 400, digit: int | None = None, keep: list[str] | None = None) -> DataFrame:
    """Remove each byte that a ``depth``-byte string starting anywhere else covers.

    Returns the columns ``keep`` of ``docs`` (all by default) with ``n_bytes``, ``n_removed``, ``spans``
    (array of start and end of the maximal removed runs) and ``kept`` (binary:
    the remaining bytes; a cut may fall inside a UTF-8 sequence). Null and
    empty texts have no bytes; texts shorter than ``depth`` lose nothing. Rows
    that repeat a whole row count as other occurrences. Strings never cross
    texts and are judged on the input. Columns named like a new one are
    replaced.
    """
    digit = digit or depth // 6
    width = max(2, depth // 8)
    stem = depth - width + 1
    carried = Carried(docs, text, keep)
    order = carried.order
    base = carried.df.withColumns({"key": carried.row_key(), "tag": carried.row_tag()})

    def runs(batches):
        for batch in batches:
            data, offsets, _ = utf8(batch.column(0))
            keys, tags = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for i, j in pieces(offsets):
                at = offsets[i : j + 1] - offsets[i]
                rolling = tokens.Rolling(tokens.byte_codes()[data[offsets[i] : offsets[j]]])
                grams = rolling.grams(digit)
                own, doc, low, high = tokens.owned_ranges(grams, at, depth, digit)
                if len(own):
                    yield pa.RecordBatch.from_arrays([_signed(grams[own]), _signed(_content(rolling, own, low, high, depth)), pa.array(keys[i:j][doc]), pa.array(tags[i:j][doc]), *[_int(x - at[doc]) for x in (low, high, own)]], names=_RUN.names)

    sampled = base.select("body", "key", "tag").where(F.octet_length("body") >= depth).mapInArrow(runs, _RUN)
    # first() takes all from one row, any of the equal runs; the written table fixes which.
    equal = cut(sampled.groupBy("anchor", "content").agg(F.count(F.lit(1)).alias("n"), *[F.first(c).alias(c) for c in _RUN.names[2:]]), "runs")
    place = [F.min(c).alias(c) for c in ("key", "tag", "low", "high")]  # of groups of one, in which they are of one row
    always = "total > 0 and key is not null and tag is not null and low >= 0 and high >= 0"  # keeps all columns, and thus one exchange for both uses
    by_anchor = equal.groupBy("anchor").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"), *place).where(always)
    weight = F.when(F.col("n") > 1, 2).otherwise(1).cast("int").alias("weight")
    shared = equal.join(by_anchor.where("kinds > 1").select("anchor"), "anchor", "left_semi")
    shared = _by_row(shared.select("key", "tag", weight, "low", "high", "at"), "run", "weight", "low", "high", "at")

    # All columns, although text and key would do: only then is the exchange of ``dealt`` the same for every use.
    dealt = base.repartition("key", "tag")
    columns = ["body", "key", "tag", *carried.columns]

    def cut_runs(batches):
        for batch in batches:
            data, offsets, _ = utf8(batch.column(0))
            keys, tags = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            (weight, run_at), *found = [lists(batch.column(batch.num_columns - k)) for k in (4, 3, 2, 1)]
            low, high, anchor = (x.astype(np.int64) for x, _ in found)
            for i, j in pieces(offsets):
                rolling = tokens.Rolling(tokens.byte_codes()[data[offsets[i] : offsets[j]]])
                take = slice(run_at[i], run_at[j])
                run, first, last, start = stems(low[take], high[take], anchor[take], width)
                doc = np.repeat(np.arange(i, j), np.diff(run_at[i : j + 1]))[run]
                base_at = offsets[doc] - offsets[i]
                content = _content(rolling, start + base_at, first + base_at, last + base_at, depth)
                yield pa.RecordBatch.from_arrays([_signed(rolling.runs(start + base_at, start + base_at + stem)), _signed(content), pa.array(keys[doc]), pa.array(tags[doc]), _int(weight[take][run]), _int(first), _int(last)], names=_STEM.names)

    open_ = _met(dealt, shared, "run", "inner").select(*columns, "run_weight", "run_low", "run_high", "run_at").mapInArrow(cut_runs, _STEM)
    alone = by_anchor.where("total = 1").select("key", "tag", "low", "high")
    # Of equal runs one stands for all: they are equally long, and its row is fixed by its place, also if a task runs again.
    order_of = F.struct("key", "tag", "low")
    same = open_.groupBy("stem", "content").agg(F.sum("weight").alias("total"), F.min(order_of).alias("p"), F.min(F.col("high") - F.col("low")).alias("more"))
    same = same.select("stem", "content", "total", "p.*", (F.col("p.low") + F.col("more")).alias("high")).where(always)
    counted = same.groupBy("stem").agg(F.sum("total").alias("total"), F.count(F.lit(1)).alias("kinds"), *place).where(always)
    alone = alone.union(counted.where("total = 1").select("key", "tag", "low", "high"))
    open_ = same.join(counted.where("kinds > 1").select("stem"), "stem", "left_semi")
    spread = _by_row(open_.select("key", "tag", "low", "high", F.least("total", F.lit(2)).cast("int").alias("weight")), "open", "low", "high", "weight")

    def suffixes(batches):
        for batch in batches:
            data, offsets, _ = utf8(batch.column(0))
            keys, tags = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            (low, low_at), (high, _), (weight, _) = (lists(batch.column(batch.num_columns - k)) for k in (3, 2, 1))
            for i, j in pieces(offsets):
                part = data[offsets[i] : offsets[j]]
                one, other = (tokens.Rolling(codes[part]) for codes in (tokens.byte_codes(), tokens.byte_codes(1)))
                take = slice(low_at[i], low_at[j])
                of, pos = tokens.spread(low[take], high[take])
                doc = np.repeat(np.arange(i, j), np.diff(low_at[i : j + 1]))[of]
                s = pos + offsets[doc] - offsets[i]
                yield pa.RecordBatch.from_arrays([_signed(one.runs(s, s + depth)), _signed(other.runs(s, s + depth)), _int(weight[take][of]), pa.array(keys[doc]), pa.array(tags[doc]), _int(pos)], names=_SUFFIX.names)

    judged = _met(dealt, spread, "open", "inner").select(*columns, "open_low", "open_high", "open_weight")
    counted = judged.mapInArrow(suffixes, _SUFFIX).groupBy("d", "e").agg(F.sum("weight").alias("n"), *[F.min(c).alias(c) for c in ("key", "tag", "pos")])
    lone = _by_row(counted.where("n = 1"), "lone", "pos")
    result = _met(_met(dealt, _by_row(alone, "alone", "low", "high"), "alone", "left"), lone, "lone", "left").select("body", "alone_low", "alone_high", "lone_pos", *carried.columns)
    span = T.ArrayType(T.StructType([T.StructField("start", _I), T.StructField("end", _I)]))
    schema = T.StructType([*carried.fields(), T.StructField("n_bytes", _L), T.StructField("n_removed", _L), T.StructField("spans", span), T.StructField("kept", T.BinaryType())])

    def apply(batches):
        for batch in batches:
            data, offsets, _ = utf8(batch.column(0))
            (low, low_at), (high, _), (lone, lone_at) = (lists(batch.column(k)) for k in (1, 2, 3))
            n_removed, spans, kept = [], [], []
            for d in range(batch.num_rows):
                n = int(offsets[d + 1] - offsets[d])
                starts = n - depth + 1
                body = data[offsets[d] : offsets[d + 1]]
                hit = np.zeros(0, np.int64)
                if starts > 0:
                    flags = tokens.outside(starts, low[low_at[d] : low_at[d + 1]], high[low_at[d] : low_at[d + 1]])
                    flags[lone[lone_at[d] : lone_at[d + 1]]] = False
                    hit = np.flatnonzero(flags)
                if not len(hit):
                    n_removed.append(0)
                    spans.append([])
                    kept.append(body.tobytes())
                    continue
                edge = np.zeros(n + 1, np.int64)
                np.add.at(edge, hit, 1)
                np.add.at(edge, hit + depth, -1)
                gone = np.cumsum(edge)[:-1] > 0
                turn = np.flatnonzero(np.diff(np.concatenate([[0], gone, [0]]))).reshape(-1, 2)
                n_removed.append(int(gone.sum()))
                spans.append([{"start": int(x), "end": int(y)} for x, y in turn])
                kept.append(body[~gone].tobytes())
            yield pa.RecordBatch.from_arrays([*rebuild(batch, order), pa.array(np.diff(offsets)), pa.array(n_removed, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(kept, pa.binary())], names=schema.names)

    return carried.restore(result.mapInArrow(apply, schema), "n_bytes", "n_removed", "spans", "kept", mapped=True)
