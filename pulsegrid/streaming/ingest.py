"""Ingest of JSON files as a stream: each micro-batch is parsed and appended once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import fhir, records


def ingest(spark: SparkSession, source: str, table: str, rejected: str, checkpoint: str, resource: str = "Observation", **trigger) -> StreamingQuery:
    """Follow ``source`` (files with a JSON resource per line) into the records table.

    ``ingest_seq`` is the batch and the place in it: files, lines and parts of a
    resource in order. A batch that runs again after a failure replaces what it
    wrote; its number in the table is twice its own, so that it never meets a
    posted one. A table takes one stream. No watermark: any time is accepted whenever it comes.
    """
    lines = records.prepared(spark).readStream.text(source).where("trim(value) != ''")

    def append(batch: DataFrame, number: int) -> None:
        bodies = batch.select(F.monotonically_increasing_id().alias("seq"), F.col("value").alias("body")).persist()
        try:
            found, bad = fhir.PARSERS[resource](bodies)
            good, late = records.accepted(records.numbered(found.drop("ingest_seq", "place"), 2 * number))
            records.write(good, table, mode="overwrite", batch=2 * number)
            bad.unionByName(records.as_rejected(late)).write.mode("overwrite").json(f"{rejected}/batch={number}")
        finally:
            bodies.unpersist()

    return lines.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def interval_means(rows: DataFrame, seconds: int, lateness: str = "1 hour") -> DataFrame:
    """Means by series and interval of a stream of records; rows later than ``lateness`` are dropped."""
    timed = rows.withColumn("event_time", F.timestamp_seconds("timestamp")).withWatermark("event_time", lateness)
    means = timed.groupBy("metric_name", F.window("event_time", f"{seconds} seconds").alias("w")).agg(F.avg("value").alias("mean"), F.count(F.lit(1)).alias("n"))
    return means.select("metric_name", F.unix_seconds("w.start").alias("bucket_start"), "mean", "n")
