"""Shared helpers: intermediate tables, column bookkeeping and Arrow access."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    The cluster names it in ``spark.checkpoint.dir``. A folder of our own is
    made only where that setting is absent and driver and executors are one
    process; elsewhere executors would write to disks of their own.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return sc.getCheckpointDir()


def fresh(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    sc = spark.sparkContext
    place = sc._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that ``fresh`` named and that nothing reads any more."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here."""
    path = fresh(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _width(name: str, kind: T.DataType) -> F.Column:
    """About the bytes of a value in memory."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(name), F.lit(0)) + 24
    if isinstance(kind, T.ArrayType):
        each = 24 * len(kind.elementType.fields) if isinstance(kind.elementType, T.StructType) else 24
        held = F.octet_length(F.array_join(name, "")) if isinstance(kind.elementType, T.StringType) else F.lit(0)
        return F.coalesce(F.size(name) * each + held, F.lit(0)) + 24
    return F.lit(24)


def joined(left: DataFrame, right: DataFrame, on: list[str], how: str, most: int = 1 << 25) -> DataFrame:
    """A join that broadcasts ``right`` only if its values were summed to at most ``most`` bytes.

    ``right`` should be a written table, since it is read for that; it holds
    numbers, strings and arrays of them or of structs of numbers. Beyond the
    bound the join shuffles both sides.
    """
    width = sum((_width(f.name, f.dataType) for f in right.schema.fields), F.lit(0))
    size = right.agg(F.sum(width.cast("long")).alias("size")).first()["size"] or 0
    return left.join(F.broadcast(right) if size <= most else right, on, how)


#: Rows of a batch that goes to Python. Texts of a few KB make batches of a few MB, of which a worker holds several copies.
BATCH_ROWS = "2000"


def small_batches(spark: SparkSession) -> None:
    """Hold Arrow batches to ``BATCH_ROWS`` unless the session has a number of its own; results do not depend on it."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, BATCH_ROWS)


class Carried:
    """A DataFrame under positional column names, so that no name can clash.

    ``df`` holds the kept input columns as ``c0, c1, ...``, but for ``text``,
    which is there once, as the string column ``body``. ``restore`` gives the
    columns their names back; a new column replaces an input column of its
    name.
    """

    def __init__(self, df: DataFrame, text: str | None = None, keep: list[str] | None = None):
        small_batches(df.sparkSession)
        lower = [n.lower() for n in df.columns]
        plain = df.toDF(*[f"i{i}" for i in range(len(lower))])
        wanted = range(len(lower)) if keep is None else [lower.index(n.lower()) for n in keep]
        self.names = [df.columns[i] for i in wanted]
        self._text = lower.index(text.lower()) if text else None
        self.columns = [f"c{i}" for i in wanted if i != self._text]
        self.order = ["body" if i == self._text else f"c{i}" for i in wanted]
        self._index = {n: f"c{i}" for i, n in reversed(list(enumerate(lower)))}
        body = [F.col(f"i{self._text}").cast("string").alias("body")] if text else []
        self.df = plain.select(*[F.col(f"i{c[1:]}").alias(c) for c in self.columns], *body)
        kinds = {f"c{i}": f.dataType for i, f in enumerate(df.schema.fields)} | {"body": T.StringType()}
        self.types = [kinds[c] for c in self.order]

    def at(self, name: str) -> str:
        return self._index[name.lower()]

    def _values(self) -> list[F.Column]:
        """What tells rows apart: their values, and which of them are null (hashes pass over nulls)."""
        hashable = [c for c, t in zip(self.order, self.types) if not re.search("map|variant", t.simpleString())]
        found = list(dict.fromkeys([*hashable, *(["body"] if self._text is not None else [])]))
        return [*map(F.col, found), F.concat(F.lit(""), *[F.col(c).isNull().cast("string") for c in found])]

    def row_key(self) -> F.Column:
        """A 64-bit key of the row's values; whole repeats of a row share it."""
        return F.xxhash64(*self._values())

    def row_tag(self) -> F.Column:
        """32 more bits, independent of ``row_key``, for tables in which 64 bits would collide."""
        return F.hash(*self._values())

    def fields(self) -> list[T.StructField]:
        """Of the kept columns, in the order of ``rebuild(batch, self.order)``."""
        return [T.StructField(f"k{i}", t) for i, t in enumerate(self.types)]

    def restore(self, df: DataFrame, *new: str, mapped: bool = False) -> DataFrame:
        taken = {n.lower() for n in new}
        kept = [F.col(f"k{i}" if mapped else c).alias(n) for i, (c, n) in enumerate(zip(self.order, self.names)) if n.lower() not in taken]
        return df.select(*kept, *[F.col(n) for n in new])


def rebuild(batch: pa.RecordBatch, order: list[str]) -> list[pa.Array]:
    """The kept columns of a batch of ``Carried.df``."""
    at = {n: i for i, n in enumerate(batch.schema.names)}
    return [batch.column(at[c]) for c in order]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, present) of a string column, without copying the text.

    A null has no bytes, so it has the same offsets as an empty text.
    """
    if not (pa.types.is_string(column.type) or pa.types.is_binary(column.type)):
        column = column.cast(pa.string() if not pa.types.is_large_binary(column.type) else pa.binary())
    n = len(column)
    present = np.ones(n, bool) if column.null_count == 0 else column.is_valid().to_numpy(zero_copy_only=False)
    _, offsets, data = column.buffers()
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64), present
    o = np.frombuffer(offsets, np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    d = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    d, o = d[o[0] : o[-1]], o - o[0]
    if not present.all():
        sizes = np.diff(o)
        if sizes[~present].any():  # bytes under a null are legal; drop them
            keep = np.repeat(present, sizes)
            d = d[keep]
            o = np.concatenate([[0], np.cumsum(np.where(present, sizes, 0))])
    return d, o, present


def lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets) of a list column; a null is an empty list."""
    values = np.asarray(column.flatten().to_numpy(zero_copy_only=False))
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return values, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def pieces(offsets: np.ndarray, limit: int = 1 << 19):
    """Runs (i, j) of texts of at most ``limit`` bytes together, or of one text."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)
