"""Range scans, lookups, catalogues and projections over records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.series import ORDER, with_previous
from ..sources.records import CHUNK_SECONDS, chunk_of

#: Names of LOINC codes.
CODE_NAMES = {
    "8867-4": "Heart Rate",
    "85354-9": "Blood Pressure Panel",
    "8480-6": "Systolic Blood Pressure",
    "8462-4": "Diastolic Blood Pressure",
    "8310-5": "Body Temperature",
    "9279-1": "Respiratory Rate",
    "59408-5": "Oxygen Saturation",
    "2339-0": "Blood Glucose",
}


def time_range(records: DataFrame, start: int, end: int, metric: str | None = None, seconds: int = CHUNK_SECONDS) -> DataFrame:
    """Rows with ``start <= timestamp < end``; the bounds on ``chunk_id`` prune partitions."""
    if start >= end:
        raise ValueError("the range must begin before it ends")
    ts, chunk = F.col("timestamp"), F.col("chunk_id")
    first, last = chunk_of(F.lit(start), seconds), chunk_of(F.lit(end), seconds)
    rows = records.where((ts >= start) & (ts < end) & (chunk >= first) & (chunk <= last))
    return rows if metric is None else rows.where(F.col("metric_name") == metric)


def default_range(now: int, start: str | int | None = None, end: str | int | None = None, lookback: int | None = 86400) -> tuple[int, int]:
    """(start, end) as the API takes them: what is missing or no integer falls back on the last ``lookback`` seconds (None: since 0)."""
    def number(given: str | int | None, otherwise: int) -> int:
        try:
            return int(given)  # type: ignore[arg-type]
        except (TypeError, ValueError):
            return otherwise

    return number(start, 0 if lookback is None else now - lookback), number(end, now)


def multi_metric_range(records: DataFrame, metrics: list[str], start: int, end: int) -> DataFrame:
    """The range of each listed series; a name listed twice gives its rows twice."""
    rows = time_range(records, start, end).where(F.col("metric_name").isin(*set(metrics)))
    if len(set(metrics)) == len(metrics):
        return rows
    times = {m: metrics.count(m) for m in metrics}
    counts = F.create_map(*[F.lit(x) for pair in times.items() for x in pair])
    return rows.withColumn("again", F.explode(F.sequence(F.lit(1), counts[F.col("metric_name")]))).drop("again")


def latest(records: DataFrame) -> DataFrame:
    """Per series the row inserted last in its last chunk, which need not have the greatest time."""
    others = [c for c in records.columns if c != "metric_name"]
    last = F.max_by(F.struct(*others), F.struct("chunk_id", "ingest_seq"))
    return records.groupBy("metric_name").agg(last.alias("row")).select("metric_name", "row.*")


def prefix_metrics(records: DataFrame, prefix: str) -> DataFrame:
    return records.where(F.startswith("metric_name", F.lit(prefix))).select("metric_name").distinct()


def latest_by_prefix(records: DataFrame, prefix: str) -> DataFrame:
    """The latest row of the first series, in order of names, that starts with ``prefix``."""
    first = prefix_metrics(records, prefix).agg(F.min("metric_name").alias("metric_name"))
    return latest(records.join(F.broadcast(first), "metric_name"))


def substring_metrics(records: DataFrame, pattern: str) -> DataFrame:
    """Distinct series whose name holds ``pattern``; the empty pattern is in all."""
    return records.where(F.contains("metric_name", F.lit(pattern))).select("metric_name").distinct()


def metrics_by_resource(records: DataFrame, resource_type: str) -> DataFrame:
    return records.where(F.col("resource_type") == resource_type).select("metric_name").distinct()


def by_resource_type(records: DataFrame, resource_type: str, start: int, end: int, strict: bool = False) -> DataFrame:
    """Rows in range of every series that ever had the type.

    Rows of other types in such a series come along, unless ``strict``.
    """
    rows = time_range(records, start, end)
    if strict:
        return rows.where(F.col("resource_type") == resource_type)
    return rows.join(metrics_by_resource(records, resource_type), "metric_name", "left_semi")


def catalogue(records: DataFrame) -> DataFrame:
    """Each type with its sorted series."""
    return records.groupBy("resource_type").agg(F.sort_array(F.collect_set("metric_name")).alias("metrics"))


def catalogue_counts(records: DataFrame) -> DataFrame:
    counts = [F.count_distinct(c).alias(n) for c, n in (("chunk_id", "chunks"), ("metric_name", "metrics"), ("resource_type", "resource_types"))]
    return records.agg(*counts)


def chunk_metrics(records: DataFrame, chunk: int) -> DataFrame:
    return records.where(F.col("chunk_id") == chunk).select("metric_name").distinct()


def chunk_series(records: DataFrame, chunk: int, metric: str) -> DataFrame:
    return records.where((F.col("chunk_id") == chunk) & (F.col("metric_name") == metric))


def number_text(value: Column | str) -> Column:
    """A number without a needless fraction or exponent, to ten decimals: 4.0 is ``4``."""
    value = F.col(value) if isinstance(value, str) else value
    return F.regexp_replace(value.cast("decimal(38,10)").cast("string"), "[.]?0+$", "")


def key_parts(metric: str = "metric_name") -> dict[str, Column]:
    """Subject, code, component and unit of a series key of three or four parts.

    ``unit_legacy`` is the third part, which in keys of four is the component.
    """
    part = F.split(metric, "[|]")
    at = lambda i: F.coalesce(F.get(part, F.lit(i)), F.lit("unknown"))
    four = F.size(part) >= 4
    return {"subject_id": at(0), "code": at(1), "component": F.when(four, at(2)), "unit": F.when(four, at(3)).otherwise(at(2)), "unit_legacy": at(2)}


def api_projection(records: DataFrame, *more: str) -> DataFrame:
    """Records as the API shows them, with the columns ``more``; ``context`` stays a map."""
    parts = key_parts()
    names = F.create_map(*[F.lit(x) for pair in CODE_NAMES.items() for x in pair])
    iso = F.when(F.col("timestamp") > 0, F.date_format(F.timestamp_seconds("timestamp"), "yyyy-MM-dd'T'HH:mm:ssxxx")).otherwise("unknown")
    return records.select(
        F.concat_ws(":", "resource_type", "metric_name").alias("id"),
        "resource_type",
        "timestamp",
        iso.alias("iso_date"),
        "value",
        F.concat(F.lit("Patient/"), parts["subject_id"]).alias("subject"),
        "metric_name",
        *[c.alias(n) for n, c in parts.items()],
        F.lit("http://loinc.org").alias("code_system"),
        F.coalesce(F.try_element_at(names, parts["code"]), F.lit("")).alias("code_display"),
        "context",
        *more,
    )


def api_json(records: DataFrame) -> DataFrame:
    """``ingest_seq`` and ``body``: rows as the API sends them, the context's keys beside the other fields.

    A key of the context that is also a field's name comes after the field.
    """
    shown = api_projection(records, "ingest_seq")
    plain, more = F.to_json(F.struct(*[c for c in shown.columns if c not in ("context", "ingest_seq")])), F.to_json("context")
    joint = F.concat(F.substring(plain, F.lit(1), F.length(plain) - 1), F.lit(","), F.substring(more, F.lit(2), F.length(more)))
    return shown.select("ingest_seq", F.when(F.size("context") == 0, plain).otherwise(joint).alias("body"))


def subject_rows(records: DataFrame) -> DataFrame:
    """Rows by subject: ``subject_id`` and the record, subjects together and in order of time within files."""
    keyed = records.withColumn("subject_id", key_parts()["subject_id"])
    return keyed.repartition("subject_id", F.pmod(F.xxhash64("metric_name"), F.lit(8))).sortWithinPartitions("subject_id", *ORDER).select("subject_id", *records.columns)


def by_subject(records: DataFrame) -> DataFrame:
    """What each subject has: rows, series, and its first and last time."""
    keyed = records.withColumn("subject_id", key_parts()["subject_id"])
    return keyed.groupBy("subject_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("metric_name").alias("metrics"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))


def pressure_pairs(records: DataFrame) -> DataFrame:
    """Systolic over diastolic, as text, from rows that carry the other value in their context."""
    other = F.try_element_at("context", F.lit("bp_diastolic"))
    return records.where(other.isNotNull()).select("metric_name", "timestamp", F.concat_ws("/", number_text("value"), other).alias("pressure"))


def retained(records: DataFrame, now: int, retention: int) -> DataFrame:
    """Rows of chunks that do not start before ``now - retention``."""
    return records.where(F.col("chunk_id") >= now - retention)


def delta_timestamps(records: DataFrame) -> DataFrame:
    """Each row with its time less the one inserted before it in the chunk's series (the first: its time)."""
    order = Window.partitionBy("chunk_id", "metric_name").orderBy("ingest_seq")
    return records.withColumn("delta", F.col("timestamp") - F.lag("timestamp", 1, 0).over(order))


def order_violations(records: DataFrame, seconds: int = CHUNK_SECONDS) -> DataFrame:
    """Rows out of time order within a chunk's series, or outside the chunk."""
    order = Window.partitionBy("chunk_id", "metric_name").orderBy("ingest_seq")
    rows = records.withColumn("before", F.lag("timestamp").over(order))
    outside = (F.col("timestamp") < F.col("chunk_id")) | (F.col("timestamp") >= F.col("chunk_id") + seconds)
    kind = F.when(outside, "outside chunk").when(F.col("timestamp") < F.col("before"), "out of order")
    return rows.withColumn("violation", kind).where("violation is not null").drop("before")


def rate_of_change(records: DataFrame, period: int = 3600) -> DataFrame:
    """Change per ``period`` seconds from each row to the next by time; pairs at one time are left out.

    The new series is ``<name>_rate``, and its context says what it came from.
    """
    rows = with_previous(records, ["timestamp", "value"])
    gap = F.col("timestamp") - F.col("previous.timestamp")
    rate = (F.col("value") - F.col("previous.value")) / gap * period
    more = F.create_map(F.lit("rate_period_seconds"), F.lit(str(period)), F.lit("original_metric"), F.col("metric_name"))
    rows = rows.where(gap > 0).withColumn("rate", rate).withColumn("context", F.map_concat("context", more))
    return rows.select("timestamp", F.concat("metric_name", F.lit("_rate")).alias("metric_name"), F.col("rate").alias("value"), "context", "resource_type", "ingest_seq", "chunk_id")
