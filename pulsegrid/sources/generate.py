"""Synthetic vital signs of one patient, for load tests; equal arguments give equal rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .records import chunk_of

START = 1704067200


def _noise(low: int, high: int, salt: int) -> Column:
    return F.pmod(F.xxhash64("i", F.lit(salt)), F.lit(high - low + 1)) + low


def vital_signs(spark: SparkSession, n: int = 25_000, patient: str = "123", start: int = START, seed: int = 0) -> DataFrame:
    """``n`` rows of heart rate, oxygen saturation and electrocardiogram each, and of both blood pressures.

    Heart rate and pressures rise over the series; each hundredth saturation
    is 88. The electrocardiogram has a row every 4 ms, in cycles of 25.
    """
    i, share, minute = F.col("i"), F.col("i") / n, start + F.col("i") * 60
    beat = F.when(i % 25 == 0, 1.5).when(i % 25 == 1, -0.5).when(i % 25 == 5, 0.75).otherwise(_noise(-10, 10, seed + 4) / 100)
    signals = {
        "8867-4|beats/minute": (minute, 70 + 20 * share + _noise(-2, 2, seed)),
        "85354-9|8480-6|mmHg": (minute, 120 + 10 * share + _noise(-4, 3, seed + 1)),
        "85354-9|8462-4|mmHg": (minute, 80 + 4 * share + _noise(-3, 2, seed + 2)),
        "59408-5|%": (minute, F.when(i % 100 == 50, 88).otherwise(98 + _noise(-1, 1, seed + 3))),
        "11524-6|sampled": (start + F.floor(i * 4 / 1000), beat),
    }
    rows = spark.range(n).withColumnRenamed("id", "i")
    parts = []
    for k, (name, (at, value)) in enumerate(signals.items()):
        parts.append(rows.select(at.cast("long").alias("timestamp"), F.lit(f"{patient}|{name}").alias("metric_name"), value.cast("double").alias("value"), F.create_map().cast("map<string,string>").alias("context"), F.lit("Observation").alias("resource_type"), (i * len(signals) + k).alias("ingest_seq")))
    return reduce(DataFrame.unionByName, parts).withColumn("chunk_id", chunk_of("timestamp"))
