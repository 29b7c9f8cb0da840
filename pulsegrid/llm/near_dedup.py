"""SimHash near-dedup over a forest of vantage-point trees.

Fingerprints that differ in at most ``d`` of 64 bits are linked. The forest has
a tree for each pair of bands: the bits are split into ``d + 1`` bands, and the
bits outside a band again, and a linked pair agrees on all bits of some band and,
among the rest, of some second band. The root of a tree has a branch for each
value of its bands; in one tree over all 64 bits nothing could be pruned, since
unrelated fingerprints lie about 32 +- 4 bits from any vantage point and a
radius of 3 then takes both sides of nearly every split.

Below the root a branch of up to ``leaf`` fingerprints is a leaf, and its pairs
are compared. A larger one is split around a vantage point, the least of its
fingerprints, into shells of equal Hamming distance, and shells into blocks of
about ``leaf``. By the triangle bound only shells whose distances differ by
``d`` or less can hold a pair, so each block is compared with the blocks of its
own and of the overlapping shells, every such pair of blocks as a group of its
own: tasks stay balanced however large a branch is. Links leave a group as a
spanning forest, never as all its pairs, and connected components join them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .graph import components
from .shingles import lower_ascii, words
from .storage import Carried, cut, joined, lists, rebuild

_EDGE = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
_U = np.uint64
SPACES = "[\\x20\\x09-\\x0D]+"
_BYTES = _U(0x0101010101010101)


def shingled(df: DataFrame, text: str, shingle: int, out: str) -> DataFrame:
    """``df`` with ``out``: XXH64 (seed 42) of each run of ``shingle`` words; of all words, where there are fewer.

    Words are runs of anything but x20 and x09-x0D, with A-Z lower-cased,
    joined by one space. A text without words has no hash.
    """
    df = df.withColumn("sh_words", words(lower_ascii(text), SPACES))
    n = F.size("sh_words")
    grams = F.transform(F.sequence(F.lit(1), F.greatest(n - (shingle - 1), F.lit(1))), lambda i: F.xxhash64(F.array_join(F.slice("sh_words", i, shingle), " ")))
    whole = F.when(n > 0, F.array(F.xxhash64(F.array_join("sh_words", " ")))).otherwise(F.array().cast("array<bigint>"))
    return df.withColumn(out, F.when(n > shingle, grams).otherwise(whole)).drop("sh_words")


def simhashes(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The signed fingerprint of each run of ``hashes`` between two offsets: bits set in over half; of none, zero.

    Bits are counted eight to a word, in chunks of at most 255 hashes.
    """
    sizes = np.diff(at)
    fps = np.zeros(len(sizes), np.int64)
    some = np.flatnonzero(sizes)
    if not len(some):
        return fps
    hashes, chunks = hashes.view(_U), -(-sizes[some] // 255)
    first = np.cumsum(chunks) - chunks
    starts = np.repeat(at[:-1][some] - first * 255, chunks) + 255 * np.arange(chunks.sum())
    bits = np.zeros((len(some), 8, 8), bool)
    for k in range(8):
        sums = np.add.reduceat((hashes >> _U(k)) & _BYTES, starts).view(np.uint8).reshape(-1, 8)
        bits[:, :, k] = 2 * np.add.reduceat(sums, first, axis=0, dtype=np.int64) > sizes[some, None]
    fps[some] = np.packbits(bits.reshape(-1, 64), axis=1, bitorder="little").view(np.int64)[:, 0]
    return fps


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = 3, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` with ``fp`` (long), the SimHash of whole texts; no words: zero."""
    carried = Carried(docs, text, keep)
    order = carried.order
    schema = T.StructType([*carried.fields(), T.StructField("fp", T.LongType())])

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*rebuild(batch, order), pa.array(simhashes(*lists(batch.column(batch.num_columns - 1))))], names=schema.names)

    hashed = shingled(carried.df, "body", shingle, "hashes")
    return carried.restore(hashed.select(*dict.fromkeys(order), "hashes").mapInArrow(run, schema), "fp", mapped=True)


def _bands(bits: list[int], n: int) -> list[list[int]]:
    cut_at = [round(i * len(bits) / n) for i in range(n + 1)]
    return [bits[a:b] for a, b in zip(cut_at, cut_at[1:])]


def branches(max_distance: int = 3) -> list[F.Column]:
    """For each tree, the branch of its root that ``fp`` is in."""
    keys = []
    for band in _bands(list(range(64)), max_distance + 1):
        for other in _bands([b for b in range(64) if b not in band], max_distance + 1):
            mask = sum(1 << b for b in [*band, *other])
            keys.append(F.xxhash64(F.lit(len(keys)), F.col("fp").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))))
    return keys


def _find(root: np.ndarray, i: int) -> int:
    while root[i] != i:
        root[i] = root[root[i]]
        i = root[i]
    return i


def spanning(fps: np.ndarray, max_distance: int, split: int | None = None, block: int = 1024) -> np.ndarray:
    """A spanning forest (pairs of indices) of the links of a group; with ``split``, of those from below it to above.

    Blocks meet only where distances from the first fingerprint differ by ``max_distance`` or less.
    """
    distance = np.bitwise_count(fps ^ fps[0]).astype(np.int64)
    sides = [np.arange(len(fps))] * 2 if split is None else [np.arange(split), np.arange(split, len(fps))]
    left, right = (side[np.argsort(distance[side], kind="stable")] for side in sides)
    root, out = np.arange(len(fps)), []
    for i in range(0, len(left), block):
        x = left[i : i + block]
        low, high = np.searchsorted(distance[right], [distance[x[0]] - max_distance, distance[x[-1]] + max_distance + 1])
        for j in range(i if split is None else int(low), int(high), block):
            y = right[j : min(j + block, int(high))]
            near_x, near_y = np.nonzero(np.bitwise_count(fps[x][:, None] ^ fps[y][None, :]) <= max_distance)
            near_x, near_y = x[near_x], y[near_y]
            for _ in range(3):  # pairs that are joined already need no visit
                root = root[root]
            keep = root[near_x] != root[near_y]
            for a, b in zip(near_x[keep].tolist(), near_y[keep].tolist()):
                ra, rb = _find(root, a), _find(root, b)
                if ra != rb:
                    root[max(ra, rb)] = min(ra, rb)
                    out.append((a, b))
    return np.array(out, np.int64).reshape(-1, 2)


def _groups(batches: Iterator[pa.RecordBatch], keys: int, search: Callable, most: int | None = None, beyond: Callable | None = None) -> Iterator[pa.RecordBatch]:
    """``search`` of the columns of whole groups; rows are sorted by the first ``keys`` columns.

    The last group of a batch may go on and waits for the next. A group that
    has waited until it has more than ``most`` rows goes through ``beyond``
    instead, in parts.
    """
    rest: list[list[np.ndarray]] = []
    last, over = None, False

    def flush(*more: list[np.ndarray]):
        nonlocal rest
        rows, rest = [*rest, *more], []
        return (beyond if over else search)(*map(np.concatenate, zip(*rows)))

    for batch in batches:
        now = [np.asarray(c.to_numpy(zero_copy_only=False)) for c in batch.columns]
        if not len(now[0]):
            continue
        change = np.zeros(len(now[0]) - 1, bool)
        for c in now[:keys]:
            change |= c[1:] != c[:-1]
        edge = np.flatnonzero(change) + 1
        if last != tuple(c[0] for c in now[:keys]):
            if rest:
                yield flush()
            over = False
        if over and len(edge):
            yield flush([c[: edge[0]] for c in now])
            now, edge, over = [c[edge[0] :] for c in now], edge[1:] - edge[0], False
        if len(edge):
            yield flush([c[: edge[-1]] for c in now])
            now = [c[edge[-1] :] for c in now]
        rest.append(now)
        last = tuple(c[-1] for c in now[:keys])
        if most is not None and sum(len(r[0]) for r in rest) > most:
            over = True
        if over:
            yield flush()
    if rest:
        yield flush()


def links(distinct: DataFrame, max_distance: int = 3, leaf: int = 4096, small: int = 24) -> DataFrame:
    """``a, b``: links between distinct fingerprints ``fp`` that connect all linked ones; none of an empty table."""
    partitions = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = distinct.repartition(partitions, "fp").select(F.explode(F.array(*branches(max_distance))).alias("branch"), "fp")
    rows = rows.repartition("branch").sortWithinPartitions("branch", "fp")
    schema = T.StructType([*_EDGE.fields, T.StructField("open", T.BooleanType())])

    def paired(fp: np.ndarray, found: np.ndarray) -> list[np.ndarray]:
        x, y = fp[found[:, 0]].view(np.int64), fp[found[:, 1]].view(np.int64)
        return [np.minimum(x, y), np.maximum(x, y)]

    def search(branch: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        fp = fp.view(_U)
        edge = np.flatnonzero(np.diff(branch)) + 1
        begin, end = np.concatenate([[0], edge]), np.append(edge, len(branch))
        sizes = end - begin
        of = np.repeat(sizes, sizes)
        left = np.where(of > small, 0, np.repeat(end, sizes) - np.arange(len(branch)) - 1)
        pairs, at = [np.zeros((0, 2), np.int64)], np.flatnonzero(left >= 1)
        for step in range(1, small):
            at = at[left[at] >= step]
            if not len(at):
                break
            near = np.bitwise_count(fp[at] ^ fp[at + step]) <= max_distance
            pairs.append(np.stack([at[near], at[near] + step], 1))
        for k in np.flatnonzero((sizes > small) & (sizes <= leaf)):
            pairs.append(spanning(fp[begin[k] : end[k]], max_distance) + begin[k])
        a, b = paired(fp, np.concatenate(pairs))
        large = of > leaf  # these go on as they are
        columns = [np.concatenate([a, branch[large]]), np.concatenate([b, fp[large].view(np.int64)]), np.arange(len(a) + large.sum()) >= len(a)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=schema.names)

    def beyond(branch: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(branch), pa.array(fp), pa.array(np.ones(len(fp), bool))], names=schema.names)

    met = cut(rows.mapInArrow(lambda batches: _groups(batches, 1, search, leaf, beyond), schema), "branches")
    found = met.where("not open").select("a", "b")
    large = met.where("open").select(F.col("a").alias("branch"), F.col("b").alias("fp"))
    if not large.isEmpty():
        found = found.union(_between_shells(large, max_distance, leaf, paired))
    return found.distinct()


def _between_shells(large: DataFrame, max_distance: int, leaf: int, paired: Callable) -> DataFrame:
    """Links inside branches of more than ``leaf``: ``branch, fp``, by pairs of blocks of overlapping shells."""
    vantage = cut(large.groupBy("branch").agg(F.min("fp").alias("vantage")), "vantage")
    shell = F.bit_count(F.col("fp").bitwiseXOR(F.col("vantage"))).cast("int")
    rows = cut(joined(large, vantage, ["branch"], "inner").select("branch", shell.alias("shell"), "fp"), "shells")
    blocks = rows.groupBy("branch", "shell").agg(F.ceil(F.count(F.lit(1)) / leaf).cast("int").alias("blocks"))
    # A block is shell * 2^24 + its number; a branch lists its blocks.
    blocks = blocks.select("branch", "shell", "blocks", F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: F.col("shell") * (1 << 24) + i)).alias("block"))
    listed = cut(blocks.groupBy("branch").agg(F.collect_list("block").alias("all"), F.map_from_entries(F.collect_set(F.struct("shell", "blocks"))).alias("blocks")), "blocks")
    own = F.col("shell") * (1 << 24) + F.pmod(F.xxhash64("fp"), F.element_at("blocks", F.col("shell"))).cast("int")
    near = F.filter("all", lambda b: F.abs(F.floor(b / (1 << 24)) - F.col("shell")) <= max_distance)
    met = rows.join(listed, "branch").select("branch", own.alias("own"), F.explode(near).alias("other"), "fp")
    met = met.select("branch", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), F.when(F.col("own") > F.col("other"), 1).otherwise(0).alias("side"), "fp")
    met = met.repartition("branch", "x", "y").sortWithinPartitions("branch", "x", "y", "side", "fp")

    def search(branch: np.ndarray, x: np.ndarray, y: np.ndarray, side: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        fp = fp.view(_U)
        edge = np.flatnonzero((branch[1:] != branch[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])) + 1
        pairs = [np.zeros((0, 2), np.int64)]
        for i, j in zip([0, *edge.tolist()], [*edge.tolist(), len(fp)]):
            split = None if x[i] == y[i] else int(np.searchsorted(side[i:j], 1))
            if split is None or 0 < split < j - i:
                pairs.append(spanning(fp[i:j], max_distance, split) + i)
        return pa.RecordBatch.from_arrays([pa.array(c) for c in paired(fp, np.concatenate(pairs))], names=["a", "b"])

    return met.mapInArrow(lambda batches: _groups(batches, 3, search), _EDGE)


def near_duplicates(docs: DataFrame, text: str = "text", ident: str = "doc_id", shingle: int = 3, max_distance: int = 3) -> DataFrame:
    """``doc_id``, ``fp`` and ``component_id`` (the smallest id reachable over links).

    Exact copies share a fingerprint and are one node of the graph. Null and
    wordless texts have fingerprint zero and are linked like any other. One
    row per input row, also for repeated rows; a null id never is the smallest
    unless a component has no other.
    """
    marked = cut(fingerprints(docs, text, shingle, keep=[ident]).select(F.col(ident).alias("doc_id"), "fp"), "simhash")
    nodes = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = components(links(nodes.select("fp"), max_distance))
    nodes = nodes.join(found, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    least = nodes.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = nodes.join(least, "root").select("fp", "component_id")
    return marked.join(by_fp, "fp").select("doc_id", "fp", "component_id")


#: Bands and minima of each: texts of similarity s meet in some band but for (1 - s ** 5) ** 25 of them, 5e-5 at 0.8.
BANDS, ROWS = 25, 5
_FACTORS = np.random.default_rng(65).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * _U(2) + _U(1)


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """For each band, a key of the least of ``hashes`` in ``ROWS`` orders; none for an empty set."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, ~_U(0))
    for i in range(0, len(hashes), 4096):
        least = np.minimum(least, (hashes[None, i : i + 4096] * _FACTORS[:, None]).min(axis=1))
    keys = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        keys = (keys ^ column) * _U(0x9E3779B97F4A7C15)
        keys ^= keys >> _U(29)
    return keys.view(np.int64)


def _sets(hashes: pa.Array) -> list[np.ndarray]:
    values, at = lists(hashes)
    return [np.unique(values[a:b].view(_U)) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


def _marked(rows: DataFrame, shingle: int) -> DataFrame:
    """``doc_id, key, node, bands`` of ``doc_id, key, body``; a node is a set of shingles."""
    schema = T.StructType([rows.schema["doc_id"], T.StructField("key", T.LongType()), T.StructField("node", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))])

    def run(batches):
        for batch in batches:
            sets = _sets(batch.column(2))
            nodes = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
            bands = pa.array([band_keys(s) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(nodes), bands], names=schema.names)

    return shingled(rows, "body", shingle, "hashes").select("doc_id", "key", "hashes").mapInArrow(run, schema)


def _shingled(rows: DataFrame, shingle: int) -> DataFrame:
    """``node, shingles`` of ``node, body``."""
    schema = T.StructType([T.StructField("node", T.LongType()), T.StructField("shingles", T.ArrayType(T.LongType()))])

    def run(batches):
        for batch in batches:
            found = [s.view(np.int64) for s in _sets(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=schema.names)

    return shingled(rows, "body", shingle, "hashes").select("node", "hashes").mapInArrow(run, schema)


#: In shards of at most so many nodes all pairs meet at once.
SMALL = 9


def _candidates(shards: DataFrame, small: int = SMALL) -> DataFrame:
    """``a, b``: of ``shard, node``, all pairs in shards of at most ``small`` nodes, and each node with the next in larger ones."""
    def search(shard: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
        edge = np.flatnonzero(np.diff(shard)) + 1
        sizes = np.diff([0, *edge.tolist(), len(shard)])
        left = np.repeat(np.append(edge, len(shard)), sizes) - np.arange(len(shard)) - 1
        most = np.minimum(left, np.where(np.repeat(sizes, sizes) <= small, small, 1))
        at = np.repeat(np.arange(len(shard)), most)
        x, y = node[at], node[at + 1 + np.arange(len(at)) - np.repeat(np.cumsum(most) - most, most)]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

    ordered = shards.select("shard", "node").repartition("shard").sortWithinPartitions("shard", "node")
    # A shard that comes in parts lacks a few neighbours; its blocks meet later.
    return ordered.mapInArrow(lambda batches: _groups(batches, 1, search, 1 << 16, search), _EDGE).distinct()


def _blocks(open_: DataFrame, sets: DataFrame, least: float, size: int) -> DataFrame:
    """``a, b``: links between components in shards ``shard, component, node``.

    Shards are dealt out in blocks of about ``size`` nodes, every two blocks of
    a shard as a group of its own, and sets are compared where they meet: no
    pair of nodes becomes a row. Nodes that share several shards are compared
    in the first of them.
    """
    blocks = cut(open_.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("blocks")), "blocks")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    met = joined(open_, blocks, ["shard"], "inner").select("shard", "component", "node", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    met = met.select("shard", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), F.when(F.col("own") > F.col("other"), 1).otherwise(0).alias("side"), "component", "node")
    met = met.join(sets, "node").select("shard", "x", "y", "side", "component", "node", "bands", "shingles")
    met = met.repartition("shard", "x", "y").sortWithinPartitions("shard", "x", "y", "side", "node")

    def compare(shard, x, y, side, component, node, bands, shingles) -> list[tuple[int, int]]:
        _, root = np.unique(component, return_inverse=True)
        if root.max() == 0:
            return []
        keys, sizes = np.stack(bands), np.array([len(s) for s in shingles])
        at = np.concatenate([[0], np.cumsum(sizes)])
        _, ids = np.unique(np.concatenate(shingles), return_inverse=True)
        rank = (keys == shard[0]).argmax(axis=1)
        seen, out = np.zeros(ids.max() + 1, bool), []
        same = x[0] == y[0]
        right = np.arange(len(node)) if same else np.flatnonzero(side == 1)
        for i in range(len(node)) if same else np.flatnonzero(side == 0).tolist():
            b = rank[i]
            to = right[(root[right] != root[i]) & (np.minimum(sizes[right], sizes[i]) >= least * np.maximum(sizes[right], sizes[i]))]
            to = to[(to > i) & ~(keys[to, :b] == keys[i, :b]).any(axis=1)]
            if not len(to):
                continue
            seen[ids[at[i] : at[i + 1]]] = True
            hit = np.concatenate([[0], np.cumsum(seen[np.concatenate([ids[at[j] : at[j + 1]] for j in to.tolist()])])])
            ends = np.cumsum(sizes[to])
            shared = hit[ends] - hit[ends - sizes[to]]
            seen[ids[at[i] : at[i + 1]]] = False
            for j in to[shared / (sizes[i] + sizes[to] - shared) >= least].tolist():
                if root[i] != root[j]:
                    out.append((int(node[i]), int(node[j])))
                    root[root == root[j]] = root[i]
        return out

    def search(*columns: np.ndarray) -> pa.RecordBatch:
        shard, x, y = columns[:3]
        edge = np.flatnonzero((shard[1:] != shard[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])) + 1
        found = [pair for i, j in zip([0, *edge.tolist()], [*edge.tolist(), len(shard)]) for pair in compare(*[c[i:j] for c in columns])]
        return pa.RecordBatch.from_arrays([pa.array([min(p) for p in found], pa.int64()), pa.array([max(p) for p in found], pa.int64())], names=["a", "b"])

    return met.mapInArrow(lambda batches: _groups(batches, 3, search), _EDGE)


def similar(docs: DataFrame, text: str = "text", ident: str = "doc_id", shingle: int = 5, least: float = 0.8, block: int = 256) -> DataFrame:
    """``doc_id``, ``key`` and ``root`` of each row: rows of one root are linked by similar texts.

    Texts are linked if the Jaccard similarity of their sets of shingles is
    ``least`` or more. Candidates come from bands of minima (MinHash), not from
    the forest of SimHashes: at similarity 0.8 SimHashes differ in up to 17 of 64
    bits, a radius that prunes nothing there. What meets in a shard is confirmed by exact sets: neighbours
    and small shards first, and shards that then still hold different
    components block by block. ``key`` is a hash of all values of a row. Texts
    without words are alike.
    """
    carried = Carried(docs, text)
    rows = carried.df.select(F.col(carried.at(ident) if ident != text else "body").alias("doc_id"), carried.row_key().alias("key"), "body")
    marked = cut(_marked(rows, shingle), "minima")
    nodes = marked.groupBy("node").agg(F.min("key").alias("key"), F.first("bands").alias("bands"))
    shards = marked.select("node", F.explode("bands").alias("shard")).distinct()
    several = shards.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("shard")
    shards = cut(shards.join(several, "shard", "left_semi"), "shards")
    wanted = cut(nodes.join(shards.select("node").distinct(), "node", "left_semi").select("node", "key", "bands"), "wanted")
    texts = joined(rows.select("key", "body"), wanted.select("node", "key"), ["key"], "inner").select("node", "body")
    sets = cut(_shingled(texts, shingle).dropDuplicates(["node"]), "sets")
    pairs = _candidates(shards)
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    both = both.select("a", "b", (F.size("x") + F.size("y")).alias("n"), F.size(F.array_intersect("x", "y")).alias("shared"))
    found = cut(both.where((F.col("shared") / (F.col("n") - F.col("shared"))) >= least).select("a", "b"), "links")
    named = shards.join(components(found), "node", "left").select("shard", F.coalesce("component", "node").alias("component"), "node")
    open_ = named.groupBy("shard").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("n")).where((F.col("low") != F.col("high")) & (F.col("n") > SMALL))
    open_ = cut(named.join(open_.select("shard"), "shard", "left_semi"), "open")
    if not open_.isEmpty():
        found = found.union(cut(_blocks(open_, sets.join(wanted.select("node", "bands"), "node"), least, block), "links"))
    return marked.join(components(found), "node", "left").select("doc_id", "key", F.coalesce("component", "node").alias("root"))
