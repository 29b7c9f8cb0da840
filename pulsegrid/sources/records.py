"""The canonical records table: one row per numeric measurement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK_SECONDS = 3600
RECORD = T.StructType(
    [
        T.StructField("timestamp", T.LongType(), False),
        T.StructField("metric_name", T.StringType(), False),
        T.StructField("value", T.DoubleType(), False),
        T.StructField("context", T.MapType(T.StringType(), T.StringType()), False),
        T.StructField("resource_type", T.StringType(), False),
        T.StructField("ingest_seq", T.LongType(), False),
        T.StructField("chunk_id", T.LongType(), False),
    ]
)


def prepared(spark: SparkSession) -> SparkSession:
    """Times are read as UTC; a repeated key of a map takes the later value."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
    return spark


def chunk_of(timestamp: Column | str, seconds: int = CHUNK_SECONDS) -> Column:
    """The start of the chunk; like the remainder, it truncates toward zero."""
    if seconds <= 0:
        raise ValueError("chunks must be longer than zero seconds")
    timestamp = F.col(timestamp) if isinstance(timestamp, str) else timestamp
    return timestamp - timestamp % seconds


def in_bounds(timestamp: Column | str, seconds: int = CHUNK_SECONDS) -> Column:
    """Whether the chunk holds its own row; a negative time must be a chunk's start."""
    timestamp = F.col(timestamp) if isinstance(timestamp, str) else timestamp
    return (timestamp >= 0) | (timestamp % seconds == 0)


def accepted(rows: DataFrame, seconds: int = CHUNK_SECONDS) -> tuple[DataFrame, DataFrame]:
    """(records with ``chunk_id``, rejected rows with ``error``)."""
    fine = in_bounds("timestamp", seconds) & F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf"))
    good = rows.where(F.coalesce(fine, F.lit(False))).withColumn("chunk_id", chunk_of("timestamp", seconds))
    bad = rows.where(~F.coalesce(fine, F.lit(False)))
    return good, bad.withColumn("error", F.when(in_bounds("timestamp", seconds), "Value is not finite").otherwise("Timestamp out of chunk range"))


def as_rejected(rows: DataFrame) -> DataFrame:
    """Rows that ``accepted`` refused as ``seq, body, error``, like rejected bodies."""
    return rows.select(F.col("ingest_seq").alias("seq"), F.to_json(F.struct("metric_name", "timestamp", "value")).alias("body"), "error")


def from_events(spark: SparkSession, sf_dir: str, fine: bool = False) -> DataFrame:
    """The ``events`` table as records; series are event types or, if ``fine``, users' event types."""
    events = prepared(spark).read.parquet(f"{sf_dir}/events.parquet")
    even = F.col("event_id") % 2 == 0
    kind = (
        F.when(F.col("event_type") == "purchase", "MedicationAdministration")
        .when(F.col("event_type") == "error", "DeviceObservation")
        .when((F.col("event_type") == "signup") | even, "Observation")
        .otherwise("VitalSigns")
    )
    name = F.concat_ws("|", F.col("user_id").cast("string"), "event_type", F.lit("u")) if fine else F.col("event_type")
    rows = events.select(
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("timestamp"),
        name.alias("metric_name"),
        F.col("value").cast("double").alias("value"),
        F.create_map(F.lit("k"), F.get_json_object("props", "$.k")).alias("context"),
        kind.alias("resource_type"),
        F.col("event_id").cast("long").alias("ingest_seq"),
    )
    return rows.withColumn("chunk_id", chunk_of("timestamp"))


#: Rows of a batch that ``numbered`` can tell apart; the batch number takes the other 27 bits of ``ingest_seq``.
BATCH_ROWS = 1 << 36


def numbered(rows: DataFrame, batch: int) -> DataFrame:
    """``rows`` with ``ingest_seq``: the batch and the place in it, dense, in the order of partitions and of rows in them.

    Rows are counted by partition first, so ``rows`` must come out alike twice:
    from a scan, or from something persisted.
    """
    if not 0 <= batch < 1 << 27:
        raise ValueError(f"not a batch number: {batch}")
    marked = rows.withColumn("id", F.monotonically_increasing_id()).withColumn("part", F.shiftright("id", 33))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    starts = marked.groupBy("part").agg(F.count(F.lit(1)).alias("c")).select("part", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("start"))
    placed = marked.join(F.broadcast(starts), "part")
    return placed.withColumn("ingest_seq", F.lit(batch).cast("long") * BATCH_ROWS + F.col("start") + F.col("id").bitwiseAND(F.lit((1 << 33) - 1))).drop("id", "part", "start")


def write(records: DataFrame, path: str, mode: str = "append", seconds: int = CHUNK_SECONDS, rows_per_file: int = 1_000_000, batch: int = 0) -> None:
    """Write to a Parquet table partitioned by chunk, then batch, sorted by series and time inside a file.

    A time range lists and reads only its chunks. With the mode ``overwrite``, a
    batch replaces what the same batch wrote before and nothing else. Rows are
    dealt by chunk and a salt that follows the row, so that a chunk with many
    rows is written by several tasks.
    """
    rows = records.withColumns({"chunk_id": chunk_of("timestamp", seconds), "batch": F.lit(batch)})
    dealt = rows.repartition("chunk_id", F.pmod(F.xxhash64("metric_name"), F.lit(8)))
    ordered = dealt.sortWithinPartitions("chunk_id", "metric_name", "timestamp")
    ordered.write.mode(mode).option("maxRecordsPerFile", rows_per_file).option("partitionOverwriteMode", "dynamic").partitionBy("chunk_id", "batch").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return prepared(spark).read.schema(T.StructType([*RECORD.fields, T.StructField("batch", T.IntegerType())])).parquet(path).select(*RECORD.names)


def _folders(spark: SparkSession, path: str) -> list:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [(files, f.getPath()) for f in files.listStatus(place) if f.isDirectory()] if files.exists(place) else []


def next_batch(spark: SparkSession, path: str) -> int:
    """One more than the greatest batch of a table; 0 for a table that is not there."""
    if not _folders(spark, path):
        return 0
    last = spark.read.parquet(path).agg(F.max("batch")).first()[0]
    return 0 if last is None else last + 1


def drop_chunks(spark: SparkSession, path: str, now: int, retention: int) -> list[int]:
    """Delete the folders of chunks that start before ``now - retention``; returns their starts."""
    gone = []
    for files, folder in _folders(spark, path):
        name, _, start = folder.getName().partition("=")
        if name == "chunk_id" and start.lstrip("-").isdigit() and int(start) < now - retention:
            files.delete(folder, True)
            gone.append(int(start))
    return sorted(gone)
