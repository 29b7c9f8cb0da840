"""Readers for chunk files (JSON) and write-ahead logs (length-prefixed JSON)."""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .records import CHUNK_SECONDS, chunk_of, in_bounds

_ROW = "struct<timestamp:bigint,metric_name:string,value:double,context:map<string,string>,resource_type:string>"


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Rows of chunk files, each a JSON document with ``records`` by series.

    A file that cannot be parsed gives no row. ``ingest_seq`` is the place of
    a row in its file, after the rows of series that sort before.
    """
    files = spark.read.text(path, wholetext=True).select(F.from_json("value", f"start_time bigint, records map<string,array<{_ROW}>>").alias("f"))
    ordered = F.transform(F.array_sort(F.map_keys("f.records")), lambda name: F.element_at("f.records", name))
    rows = files.select(F.col("f.start_time").alias("chunk_id"), F.posexplode(F.flatten(ordered)).alias("place", "r"))
    return rows.select("r.*", F.col("place").cast("long").alias("ingest_seq"), "chunk_id")


def log_records(content: bytes) -> list[str]:
    """The JSON documents of a log; a partial header ends it, a partial body is an error."""
    out, at = [], 0
    while at + 4 <= len(content):
        (size,) = struct.unpack_from(">I", content, at)
        if at + 4 + size > len(content):
            raise ValueError("the log ends inside a record")
        out.append(content[at + 4 : at + 4 + size].decode())
        at += 4 + size
    return out


def read_log(spark: SparkSession, path: str, seconds: int = CHUNK_SECONDS) -> DataFrame:
    """Rows of write-ahead logs in the order they were written."""
    split = F.udf(log_records, T.ArrayType(T.StringType()))
    rows = spark.read.format("binaryFile").load(path).select(F.posexplode(split("content")).alias("ingest_seq", "line"))
    rows = rows.select(F.from_json("line", _ROW).alias("r"), F.col("ingest_seq").cast("long").alias("ingest_seq")).select("r.*", "ingest_seq")
    return rows.withColumn("chunk_id", chunk_of("timestamp", seconds))


def recover(spark: SparkSession, folder: str, seconds: int = CHUNK_SECONDS) -> DataFrame:
    """All rows of a data folder: its chunk files, then its log, with ``origin`` (chunk or log).

    Chunk files that cannot be parsed are passed over; a log that ends inside a
    record is an error. Log rows follow the rows of their chunk in
    ``ingest_seq``; rows outside of their chunk's bounds are left out.
    """
    chunks = read_chunks(spark, f"{folder}/chunks/*.chunk").withColumn("origin", F.lit("chunk"))
    log = read_log(spark, f"{folder}/wal/*.wal", seconds).withColumns({"ingest_seq": F.col("ingest_seq") + (1 << 40), "origin": F.lit("log")})
    return chunks.unionByName(log).where(in_bounds("timestamp", seconds))
