"""The registered queries over the test tables, each with its DuckDB oracle where SQL can express it."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregate, analytics, changepoints, multivariate, scan, seasonal, windows
from ..sources import fhir, records
from ..sources.records import from_events, prepared

DAY = 86400
START, END = 1704585600, 1705449600  # ten days of January 2024
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _records_sql(fine: bool) -> str:
    name = "concat_ws('|', CAST(user_id AS VARCHAR), event_type, 'u')" if fine else "event_type"
    return f"""recs AS (SELECT epoch_us(ts) // 1000000 AS timestamp, {name} AS metric_name, CAST(value AS DOUBLE) AS value, json_extract_string(props, '$.k') AS k,
  CASE WHEN event_type = 'purchase' THEN 'MedicationAdministration' WHEN event_type = 'error' THEN 'DeviceObservation'
    WHEN event_type = 'signup' OR event_id % 2 = 0 THEN 'Observation' ELSE 'VitalSigns' END AS resource_type,
  CAST(event_id AS BIGINT) AS ingest_seq, epoch_us(ts) // 1000000 - (epoch_us(ts) // 1000000) % 3600 AS chunk_id FROM events)"""


def _query(name: str, sql: str | None = None, fine: bool = False) -> Callable[[Callable[[DataFrame], DataFrame]], Query]:
    """Register a function of the records; ``sql`` follows ``WITH recs AS (...)``."""

    def register(f: Callable[[DataFrame], DataFrame]) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(from_events(spark, sf_dir, fine))

        QUERIES[name] = run
        if sql is not None:
            more = sql.strip()
            ORACLES[name] = f"WITH {_records_sql(fine)}{', ' + more[1:].strip() if more.startswith(',') else ' ' + more}"
        return run

    return register


def _rounded(df: DataFrame, digits: int = 6, **own: int) -> DataFrame:
    return df.select(*[F.round(c, own.get(c, digits)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


_FLAT = ["timestamp", "metric_name", "value", "context.k", "resource_type", "ingest_seq", "chunk_id"]
_FLAT_SQL = "SELECT timestamp, metric_name, value, k, resource_type, ingest_seq, chunk_id FROM"
_RANGE_SQL = f"timestamp >= {START} AND timestamp < {END}"


@_query("range_scan", f"{_FLAT_SQL} recs WHERE {_RANGE_SQL} AND metric_name = 'purchase'")
def _(r):
    return scan.time_range(r, START, END, "purchase").select(*_FLAT)


@_query("multi_metric_range", f"{_FLAT_SQL} recs WHERE {_RANGE_SQL} AND metric_name IN ('view', 'error') UNION ALL {_FLAT_SQL} recs WHERE {_RANGE_SQL} AND metric_name = 'view'")
def _(r):
    return scan.multi_metric_range(r, ["view", "error", "view"], START, END).select(*_FLAT)


@_query("latest_per_metric", "SELECT metric_name, arg_max(timestamp, ingest_seq) AS timestamp, arg_max(value, ingest_seq) AS value, arg_max(k, ingest_seq) AS k, arg_max(resource_type, ingest_seq) AS resource_type, max(ingest_seq) AS ingest_seq, arg_max(chunk_id, ingest_seq) AS chunk_id FROM (SELECT * FROM recs QUALIFY chunk_id = max(chunk_id) OVER (PARTITION BY metric_name)) GROUP BY metric_name", fine=True)
def _(r):
    return scan.latest(r).select(*_FLAT)


@_query("prefix_metrics", "SELECT DISTINCT metric_name FROM recs WHERE starts_with(metric_name, '1')", fine=True)
def _(r):
    return scan.prefix_metrics(r, "1")


@_query("latest_by_prefix", f", hit AS (SELECT * FROM recs WHERE metric_name = (SELECT min(metric_name) FROM recs WHERE starts_with(metric_name, '12'))) {_FLAT_SQL} hit QUALIFY row_number() OVER (ORDER BY chunk_id DESC, ingest_seq DESC) = 1", fine=True)
def _(r):
    return scan.latest_by_prefix(r, "12").select(*_FLAT)


@_query("substring_metrics", "SELECT DISTINCT metric_name FROM recs WHERE contains(metric_name, '7|s')", fine=True)
def _(r):
    return scan.substring_metrics(r, "7|s")


@_query("by_resource_type", f"{_FLAT_SQL} recs WHERE {_RANGE_SQL} AND metric_name IN (SELECT metric_name FROM recs WHERE resource_type = 'VitalSigns')")
def _(r):
    return scan.by_resource_type(r, "VitalSigns", START, END).select(*_FLAT)


@_query("by_resource_type_strict", f"{_FLAT_SQL} recs WHERE {_RANGE_SQL} AND resource_type = 'VitalSigns'")
def _(r):
    return scan.by_resource_type(r, "VitalSigns", START, END, strict=True).select(*_FLAT)


@_query("metrics_by_resource", "SELECT DISTINCT metric_name FROM recs WHERE resource_type = 'Observation'", fine=True)
def _(r):
    return scan.metrics_by_resource(r, "Observation")


@_query("catalogue", "SELECT resource_type, string_agg(DISTINCT metric_name, ',' ORDER BY metric_name) AS metrics FROM recs GROUP BY resource_type")
def _(r):
    return scan.catalogue(r).select("resource_type", F.array_join("metrics", ",").alias("metrics"))


@_query("catalogue_counts", "SELECT count(DISTINCT chunk_id) AS chunks, count(DISTINCT metric_name) AS metrics, count(DISTINCT resource_type) AS resource_types FROM recs", fine=True)
def _(r):
    return scan.catalogue_counts(r)


@_query("chunk_metrics", "SELECT DISTINCT metric_name FROM recs WHERE chunk_id = 1704672000", fine=True)
def _(r):
    return scan.chunk_metrics(r, 1704672000)


@_query("chunk_series", f"{_FLAT_SQL} recs WHERE chunk_id = 1704672000 AND metric_name = 'view'")
def _(r):
    return scan.chunk_series(r, 1704672000, "view").select(*_FLAT)


@_query("api_projection", """SELECT resource_type || ':' || metric_name AS id, resource_type, timestamp, strftime(to_timestamp(timestamp) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S') || '+00:00' AS iso_date, value,
  'Patient/' || split_part(metric_name, '|', 1) AS subject, metric_name, split_part(metric_name, '|', 1) AS subject_id, split_part(metric_name, '|', 2) AS code, CAST(NULL AS VARCHAR) AS component,
  'u' AS unit, 'u' AS unit_legacy, 'http://loinc.org' AS code_system, '' AS code_display, k FROM recs""", fine=True)
def _(r):
    return scan.api_projection(r).withColumn("k", F.col("context")["k"]).drop("context")


@_query("by_subject", "SELECT split_part(metric_name, '|', 1) AS subject_id, count(*) AS n, count(DISTINCT metric_name) AS metrics, min(timestamp) AS first, max(timestamp) AS last FROM recs GROUP BY 1", fine=True)
def _(r):
    return scan.by_subject(r)


@_query("subject_rows", f"SELECT split_part(metric_name, '|', 1) AS subject_id, timestamp, metric_name, value, k, resource_type, ingest_seq, chunk_id FROM recs", fine=True)
def _(r):
    return scan.subject_rows(r).select("subject_id", *_FLAT)


@_query("api_json", "SELECT ingest_seq, metric_name, resource_type || ':' || metric_name AS id, 'u' AS unit, k FROM recs", fine=True)
def _(r):
    sent = scan.api_json(r)
    return sent.select("ingest_seq", *[F.get_json_object("body", f"$.{n}").alias(n) for n in ("metric_name", "id", "unit", "k")])


def stored_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range of one series out of a written table, whose chunks prune the scan."""
    shared = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="spark-")
    path = f"{shared}/records-{uuid.uuid4().hex}"
    records.write(records.from_events(spark, sf_dir), path)
    return scan.time_range(records.load(spark, path), START, END, "purchase").select(*_FLAT)


QUERIES["stored_range"] = stored_range
ORACLES["stored_range"] = f"WITH {_records_sql(False)} {_FLAT_SQL} recs WHERE {_RANGE_SQL} AND metric_name = 'purchase'"


@_query("retention_filter", f"{_FLAT_SQL} recs WHERE chunk_id >= {END} - 259200")
def _(r):
    return scan.retained(r, END, 259200).select(*_FLAT)


@_query("delta_timestamps", "SELECT chunk_id, metric_name, ingest_seq, timestamp - lag(timestamp, 1, 0) OVER (PARTITION BY chunk_id, metric_name ORDER BY ingest_seq) AS delta FROM recs")
def _(r):
    return scan.delta_timestamps(r).select("chunk_id", "metric_name", "ingest_seq", "delta")


# Inserted by a hash of the id instead of in order of time, so that there is something to find.
@_query("validate_order", ", mixed AS (SELECT *, (ingest_seq * 7919) % 1000003 AS seq FROM recs) SELECT metric_name, chunk_id, seq AS ingest_seq, timestamp FROM (SELECT *, lag(timestamp) OVER (PARTITION BY chunk_id, metric_name ORDER BY seq) AS p FROM mixed) WHERE timestamp < p")
def _(r):
    mixed = r.withColumn("ingest_seq", F.col("ingest_seq") * 7919 % 1000003)
    return scan.order_violations(mixed).select("metric_name", "chunk_id", "ingest_seq", "timestamp")


for _how, _sql in (("mean", "avg(value)"), ("max", "max(value)"), ("min", "min(value)"), ("count", "CAST(count(*) AS DOUBLE)"), ("sum", "sum(value)")):

    @_query(f"agg_{_how}", f"SELECT metric_name, round({_sql}, 6) AS value, arg_min(timestamp, ingest_seq) AS timestamp, arg_min(k, ingest_seq) AS k, arg_min(resource_type, ingest_seq) AS resource_type FROM recs WHERE {_RANGE_SQL} GROUP BY metric_name")
    def _(r, how=_how):
        out = aggregate.aggregate_range(scan.time_range(r, START, END), how)
        return _rounded(out.select("metric_name", "value", "timestamp", F.col("context")["k"].alias("k"), "resource_type"))


@_query("agg_by_interval", "SELECT metric_name, timestamp - timestamp % 21600 AS bucket_start, round(avg(value), 6) AS value, arg_min(timestamp, ingest_seq) AS first_time FROM recs GROUP BY 1, 2")
def _(r):
    return _rounded(aggregate.aggregate_intervals(r, 21600, "mean").select("metric_name", "bucket_start", "value", F.col("timestamp").alias("first_time")))


@_query("time_chunked", f"SELECT timestamp - timestamp % 86400 AS chunk_start, timestamp - timestamp % 86400 + 86400 AS chunk_end, count(*) AS n, string_agg(CAST(ingest_seq AS VARCHAR), ',' ORDER BY ingest_seq) AS seqs FROM recs WHERE {_RANGE_SQL} AND metric_name IN (SELECT metric_name FROM recs WHERE resource_type = 'DeviceObservation') GROUP BY 1, 2")
def _(r):
    out = aggregate.time_chunked(scan.by_resource_type(r, "DeviceObservation", START, END), DAY)
    listed = out.groupBy("chunk_start", "chunk_end").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("ingest_seq")).alias("seqs"))
    return listed.withColumn("seqs", F.array_join(F.transform("seqs", lambda x: x.cast("string")), ","))


@_query("time_chunked_rows", f"SELECT timestamp - timestamp % 86400 AS chunk_start, timestamp - timestamp % 86400 + 86400 AS chunk_end, timestamp, metric_name, value, k, resource_type, ingest_seq FROM recs WHERE {_RANGE_SQL} AND metric_name IN (SELECT metric_name FROM recs WHERE resource_type = 'VitalSigns')")
def _(r):
    out = aggregate.time_chunked(scan.by_resource_type(r, "VitalSigns", START, END), DAY)
    return out.select("chunk_start", "chunk_end", "timestamp", "metric_name", "value", "context.k", "resource_type", "ingest_seq")


@_query("time_chunked_counts", "SELECT timestamp - timestamp % 21600 AS chunk_start, count(*) AS n, count(DISTINCT metric_name) AS metrics FROM recs GROUP BY 1", fine=True)
def _(r):
    return aggregate.time_chunk_sizes(r, 21600)


@_query("chunk_summary", "SELECT chunk_id, metric_name, count(*) AS n, min(value) AS min, max(value) AS max, round(avg(value), 6) AS avg FROM recs GROUP BY 1, 2")
def _(r):
    return _rounded(aggregate.chunk_summary(r))


@_query("union_of_means", "SELECT metric_name, round(avg(value), 6) AS mean FROM recs WHERE metric_name IN ('click', 'view') GROUP BY 1")
def _(r):
    return _rounded(aggregate.union_of_means(r, ["click", "view"]))


_TREND_SQL = "metric_name, round(coalesce(regr_slope(value, CAST(timestamp AS DOUBLE)), 0), 9) AS slope, round(CASE WHEN var_pop(value) = 0 THEN 0 ELSE coalesce(regr_r2(value, CAST(timestamp AS DOUBLE)), 0) END, 6) AS r_squared, arg_min(value, timestamp * 1000000 + ingest_seq) AS start_value, arg_max(value, timestamp * 1000000 + ingest_seq) AS end_value, min(value) AS min, max(value) AS max, round(stddev_pop(value), 6) AS std_dev, count(*) AS n"


@_query("trend_by_metric", f"SELECT {_TREND_SQL} FROM recs GROUP BY metric_name")
def _(r):
    return _rounded(analytics.trend(r), slope=9)


@_query("trend_ranked", f"SELECT {_TREND_SQL} FROM recs WHERE {_RANGE_SQL} AND contains(metric_name, 'i') AND metric_name IN (SELECT metric_name FROM recs WHERE resource_type = 'Observation') GROUP BY metric_name")
def _(r):
    return _rounded(analytics.trend_by_resource(r, "Observation", "i", START, END), slope=9)


@_query("trend_samples", """, ranked AS (SELECT *, row_number() OVER (PARTITION BY metric_name ORDER BY timestamp, ingest_seq) - 1 AS rank, count(*) OVER (PARTITION BY metric_name) AS n FROM recs),
stepped AS (SELECT *, rank % greatest(n // 20, 1) = 0 AS sampled FROM ranked), ends AS (SELECT *, max(CASE WHEN sampled THEN timestamp END) OVER (PARTITION BY metric_name) AS sampled_to FROM stepped)
SELECT metric_name, CAST(rank AS BIGINT) AS rank, timestamp, value FROM ends WHERE sampled OR rank = n - 1 AND timestamp != sampled_to""")
def _(r):
    return analytics.trend_samples(r).withColumn("rank", F.col("rank").cast("long"))


@_query("stats_basic", "SELECT metric_name, min(value) AS min, max(value) AS max, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std_dev, count(*) AS n, round(median(value), 6) AS median FROM recs GROUP BY 1")
def _(r):
    return _rounded(analytics.stats(r))


@_query("stats_percentiles", f""", ranked AS (SELECT *, row_number() OVER (PARTITION BY metric_name ORDER BY value) - 1 AS rank, count(*) OVER (PARTITION BY metric_name) AS n FROM recs)
SELECT metric_name, CAST(p AS INTEGER) AS percentile, value FROM ranked, (SELECT unnest({list(analytics.PERCENTILES)}) AS p) WHERE rank = CAST(round((p / 100.0::DOUBLE) * (n - 1)) AS BIGINT)""")
def _(r):
    return analytics.percentiles(r)


@_query("zscore_outliers", ", m AS (SELECT *, avg(value) OVER (PARTITION BY metric_name) AS mean, stddev_pop(value) OVER (PARTITION BY metric_name) AS sd FROM recs), z AS (SELECT *, abs((value - mean) / sd) AS z FROM m WHERE sd > 0) SELECT metric_name, timestamp, ingest_seq, value, round(value - mean, 6) AS deviation, round(z / (z + 1), 6) AS score FROM z WHERE z > 2")
def _(r):
    return _rounded(analytics.outliers(r))


_RATE_SQL = ", p AS (SELECT *, lag(timestamp) OVER w AS t1, lag(value) OVER w AS v1 FROM {recs} WINDOW w AS (PARTITION BY metric_name ORDER BY timestamp, ingest_seq)) SELECT timestamp, metric_name || '_rate' AS metric_name, round((value - v1) / (timestamp - t1) * {period}, 6) AS value, ingest_seq FROM p WHERE timestamp > t1"


@_query("rate_of_change", _RATE_SQL.format(recs="recs", period=3600), fine=True)
def _(r):
    return _rounded(scan.rate_of_change(r).select("timestamp", "metric_name", "value", "ingest_seq"))


@_query("bucketed_derivative", ", b AS (SELECT metric_name, timestamp - timestamp % 3600 AS timestamp, avg(value) AS value, max(ingest_seq) AS ingest_seq FROM recs GROUP BY 1, 2)" + _RATE_SQL.format(recs="b", period=14400))
def _(r):
    means = multivariate.bucket_means(r).withColumns({"context": F.create_map().cast("map<string,string>"), "resource_type": F.lit("Observation"), "chunk_id": F.col("timestamp")})
    return _rounded(scan.rate_of_change(means, 14400).select("timestamp", "metric_name", "value", "ingest_seq"))


@_query("moving_average", "SELECT metric_name, ingest_seq, round(avg(value) OVER (PARTITION BY metric_name ORDER BY timestamp RANGE BETWEEN 4320 PRECEDING AND 4320 FOLLOWING), 6) AS trend FROM recs")
def _(r):
    return _rounded(seasonal.moving_average(r, 4320).select("metric_name", "ingest_seq", "trend"))


def _season_sql(additive: bool) -> str:
    off = "value - trend" if additive else "CASE WHEN trend != 0 THEN value / trend END"
    mean = f"avg({off})" if additive else f"coalesce(sum({off}), 0) / count(*)"
    part = "mean - level" if additive else "CASE WHEN level != 0 THEN mean / level ELSE mean END"
    rest = "value - trend - seasonal" if additive else "CASE WHEN trend * seasonal != 0 THEN value / (trend * seasonal) ELSE value END"
    return f""", t AS (SELECT *, avg(value) OVER (PARTITION BY metric_name ORDER BY timestamp RANGE BETWEEN 4320 PRECEDING AND 4320 FOLLOWING) AS trend,
  row_number() OVER (PARTITION BY metric_name ORDER BY timestamp, ingest_seq) - 1 AS rank FROM recs),
s AS (SELECT metric_name, CAST(round(86400.0::DOUBLE / (CAST(max(timestamp) - min(timestamp) AS DOUBLE) / (count(*) - 1))) AS BIGINT) AS season FROM recs GROUP BY 1 HAVING count(*) >= 24),
p AS (SELECT t.*, season, rank % season AS place FROM t JOIN s USING (metric_name) WHERE season >= 1),
g AS (SELECT metric_name, season, place, {mean} AS mean FROM p GROUP BY 1, 2, 3),
l AS (SELECT *, sum(mean) OVER (PARTITION BY metric_name) / season AS level FROM g),
q AS (SELECT p.*, first_value(part) OVER (PARTITION BY p.metric_name, timestamp ORDER BY rank) AS seasonal FROM p JOIN (SELECT metric_name, place, {part} AS part FROM l) USING (metric_name, place))
SELECT metric_name, timestamp, ingest_seq, value, CAST(season AS BIGINT) AS season, round(trend, 6) AS trend, round(seasonal, 6) AS seasonal, round({rest}, 6) AS residual FROM q"""


@_query("seasonal_additive", _season_sql(True))
def _(r):
    return _rounded(seasonal.decompose(r))


@_query("seasonal_multiplicative", _season_sql(False))
def _(r):
    return _rounded(seasonal.decompose(r, method="multiplicative"))


_HOURLY_SQL = ", h AS (SELECT metric_name, timestamp - timestamp % 3600 AS ts, avg(value) AS v FROM recs GROUP BY 1, 2)"


@_query("correlation_pairs", _HOURLY_SQL + " SELECT a.metric_name AS metric_a, b.metric_name AS metric_b, round(CASE WHEN count(*) < 3 OR stddev_pop(a.v) * stddev_pop(b.v) = 0 THEN 0 ELSE covar_pop(a.v, b.v) / (stddev_pop(a.v) * stddev_pop(b.v)) END, 6) AS r, count(*) AS n FROM h a JOIN h b ON a.ts = b.ts AND a.metric_name < b.metric_name GROUP BY 1, 2")
def _(r):
    return _rounded(multivariate.correlation_pairs(multivariate.bucket_means(r)))


_PAIR_SQL = _HOURLY_SQL + ", w AS (SELECT a.ts AS timestamp, a.v AS x0, b.v AS x1 FROM h a JOIN h b ON a.ts = b.ts WHERE a.metric_name = 'click' AND b.metric_name = 'view')"


@_query("mahalanobis_2d", _PAIR_SQL + ", m AS (SELECT *, avg(x0) OVER () AS m0, avg(x1) OVER () AS m1, var_samp(x0) OVER () AS a, var_samp(x1) OVER () AS d, covar_samp(x0, x1) OVER () AS b FROM w), s AS (SELECT *, sqrt((d * (x0 - m0) ** 2 - 2 * b * (x0 - m0) * (x1 - m1) + a * (x1 - m1) ** 2) / (a * d - b * b)) AS distance FROM m) SELECT timestamp, round(x0, 6) AS x0, round(x1, 6) AS x1, round(distance, 6) AS distance FROM s WHERE distance > 3")
def _(r):
    return _rounded(multivariate.mahalanobis(multivariate.bucket_means(r), ["click", "view"]))


_TRIPLE_SQL = _HOURLY_SQL + """, w AS (SELECT a.ts AS timestamp, a.v AS x0, b.v AS x1, c.v AS x2 FROM h a JOIN h b ON a.ts = b.ts JOIN h c ON a.ts = c.ts WHERE a.metric_name = 'click' AND b.metric_name = 'error' AND c.metric_name = 'view'),
m AS (SELECT avg(x0) AS m0, avg(x1) AS m1, avg(x2) AS m2, var_samp(x0) + 1e-6 AS a, var_samp(x1) + 1e-6 AS d, var_samp(x2) + 1e-6 AS f, covar_samp(x0, x1) AS b, covar_samp(x0, x2) AS c, covar_samp(x1, x2) AS e FROM w),
o AS (SELECT timestamp, x0, x1, x2, x0 - m0 AS p, x1 - m1 AS q, x2 - m2 AS r, a, b, c, d, e, f, a * (d * f - e * e) - b * (b * f - c * e) + c * (b * e - c * d) AS det FROM w, m),
s AS (SELECT timestamp, x0, x1, x2, sqrt(((d * f - e * e) * p * p + (a * f - c * c) * q * q + (a * d - b * b) * r * r + 2 * (c * e - b * f) * p * q + 2 * (b * e - c * d) * p * r + 2 * (b * c - a * e) * q * r) / det) AS distance FROM o)
SELECT timestamp, round(x0, 6) AS x0, round(x1, 6) AS x1, round(x2, 6) AS x2, round(distance, 6) AS distance FROM s WHERE distance > 3"""


@_query("mahalanobis_3d", _TRIPLE_SQL)
def _(r):
    return _rounded(multivariate.mahalanobis(multivariate.bucket_means(r), ["click", "error", "view"]))


_GROUPS_SQL = _HOURLY_SQL + """, c AS (SELECT a.metric_name AS one, b.metric_name AS other, CASE WHEN count(*) < 3 OR stddev_pop(a.v) * stddev_pop(b.v) = 0 THEN 0 ELSE covar_pop(a.v, b.v) / (stddev_pop(a.v) * stddev_pop(b.v)) END AS r FROM h a JOIN h b ON a.ts = b.ts AND a.metric_name != b.metric_name GROUP BY 1, 2),
seeds AS (SELECT one, list_sort(list(other)) AS others, row_number() OVER (ORDER BY one) AS k FROM c WHERE abs(r) >= 0.02 GROUP BY one),
walk AS (WITH RECURSIVE w AS (
  SELECT CAST(0 AS BIGINT) AS k, CAST([] AS VARCHAR[]) AS taken, CAST([] AS VARCHAR[]) AS members
  UNION ALL SELECT k, list_concat(taken, members), members FROM (
    SELECT s.k, w.taken, CASE WHEN list_contains(w.taken, s.one) THEN CAST([] AS VARCHAR[]) ELSE list_concat([s.one], list_filter(s.others, lambda x: NOT list_contains(w.taken, x))) END AS members FROM w JOIN seeds s ON s.k = w.k + 1))
  SELECT * FROM w),
named AS (SELECT row_number() OVER (ORDER BY k) - 1 AS group_id, members FROM walk WHERE len(members) > 1)
SELECT group_id, unnest(members) AS metric_name FROM named"""


@_query("correlated_groups", _GROUPS_SQL)
def _(r):
    """Groups of series correlated over 0.02 by the hour: far below the default, so that these independent series have some."""
    groups = multivariate.correlated_groups(multivariate.bucket_means(r), 0.02)
    rows = [(i, m) for i, group in enumerate(groups) for m in group]
    return prepared(r.sparkSession).createDataFrame(rows, "group_id long, metric_name string")


@_query("max_zscore", _PAIR_SQL + ", m AS (SELECT *, greatest(abs(x0 - avg(x0) OVER ()) / stddev_pop(x0) OVER (), abs(x1 - avg(x1) OVER ()) / stddev_pop(x1) OVER ()) AS score FROM w) SELECT timestamp, round(x0, 6) AS x0, round(x1, 6) AS x1, round(score, 6) AS score FROM m WHERE score > 3")
def _(r):
    return _rounded(multivariate.max_zscore(multivariate.bucket_means(r), ["click", "view"]))


@_query("cusum_changepoints", """, x AS MATERIALIZED (SELECT metric_name, timestamp, value, row_number() OVER w - 1 AS i, avg(value) OVER p AS mean, stddev_samp(value) OVER p AS sd, count(*) OVER p AS n, sum(value) OVER p AS total, sum(value) OVER w - value AS seen
  FROM recs WINDOW p AS (PARTITION BY metric_name), w AS (PARTITION BY metric_name ORDER BY timestamp, ingest_seq)),
walk AS (WITH RECURSIVE r AS (
  SELECT metric_name, CAST(-1 AS BIGINT) AS i, 0.0::DOUBLE AS hi, 0.0::DOUBLE AS lo, false AS hit FROM x WHERE i = 0 AND n >= 10 AND sd > 0
  UNION ALL SELECT metric_name, i, CASE WHEN over THEN 0.0::DOUBLE ELSE hi END, CASE WHEN over THEN 0.0::DOUBLE ELSE lo END, over FROM (
    SELECT *, hi > 2 * sd OR lo > 2 * sd AS over FROM (SELECT x.metric_name, x.i, x.sd, greatest(0.0::DOUBLE, r.hi + value - mean - sd / 2) AS hi, greatest(0.0::DOUBLE, r.lo - value + mean - sd / 2) AS lo FROM r JOIN x ON x.metric_name = r.metric_name AND x.i = r.i + 1)))
  SELECT metric_name, i FROM r WHERE hit),
c AS (SELECT x.*, lag(i, 1, 0) OVER o AS last, lag(seen, 1, 0.0::DOUBLE) OVER o AS seen_last FROM walk JOIN x USING (metric_name, i) WINDOW o AS (PARTITION BY metric_name ORDER BY i)),
d AS (SELECT *, CASE WHEN i > last THEN (seen - seen_last) / (i - last) END AS before, (total - seen) / (n - i) AS after FROM c)
SELECT metric_name, CAST(i AS BIGINT) AS index, timestamp, value, round(before + 1e-9, 6) AS before, round(after + 1e-9, 6) AS after, round(abs(after - before) + 1e-9, 6) AS magnitude FROM d""")
def _(r):
    found = changepoints.cusum(r)
    means = [(F.col(c) + 1e-9).alias(c) for c in ("before", "after", "magnitude")]  # off the ties of rounding
    return _rounded(found.select("metric_name", "index", "timestamp", "value", *means))


@_query("pelt_changepoints")
def _(r):
    return _rounded(changepoints.optimal_partition(r, threshold=0.5))


def _sliding_sql(value: str) -> str:
    return f""", s AS (SELECT metric_name, min(timestamp) AS t0, max(timestamp) AS t1 FROM recs GROUP BY 1),
g AS (SELECT metric_name, t0, unnest(generate_series(0, (t1 - t0 - 3600) // 900)) AS k FROM s WHERE t1 - t0 >= 3600),
v AS (SELECT g.metric_name, CAST(g.k AS BIGINT) AS k, t0 + g.k * 900 AS start, t0 + g.k * 900 + 3600 AS "end", count(*) AS n, {value} AS value FROM g JOIN recs r ON r.metric_name = g.metric_name AND r.timestamp >= t0 + g.k * 900 AND r.timestamp < t0 + g.k * 900 + 3600 GROUP BY 1, 2, 3, 4)"""


_DEVIATION = "coalesce(stddev_samp(value), 0)"
for _how, _sql, _digits in (("volatility", _DEVIATION, 6), ("range", "max(value) - min(value)", 6), ("trend", "CASE WHEN count(*) < 2 OR var_pop(timestamp) = 0 THEN 0 ELSE regr_slope(value, CAST(timestamp - t0 AS DOUBLE)) END", 6)):

    @_query(f"sliding_{_how}", _sliding_sql(_sql) + f' SELECT metric_name, k, start, "end", n, round(value, {_digits}) AS value FROM v')
    def _(r, how=_how):
        return _rounded(windows.sliding_windows(r, how=how))


@_query("anomalous_windows", _sliding_sql(_DEVIATION) + ', m AS (SELECT *, avg(value) OVER (PARTITION BY metric_name) AS mean, stddev_samp(value) OVER (PARTITION BY metric_name) AS sd FROM v) SELECT metric_name, k, start, "end", n, round(value, 6) AS value FROM m WHERE abs(value - mean) > 1.5 * sd')
def _(r):
    return _rounded(windows.anomalous_windows(r))


def _coded(code: str) -> Column:
    return F.struct(F.array(F.struct(F.lit("http://loinc.org").alias("system"), F.lit(code).alias("code"), F.lit("shown").alias("display"))).alias("coding"))


def _quantity(value: Column, unit: str) -> Column:
    return F.struct(value.alias("value"), F.lit(unit).alias("unit"), F.lit("http://unitsofmeasure.org").alias("system"), F.lit(unit).alias("code"))


def _bodies(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """Events of a type as resources: ``seq``, ``body``."""
    events = prepared(spark).read.parquet(f"{sf_dir}/events.parquet").where(F.col("event_type") == kind)
    ref = lambda prefix, id_: F.struct(F.concat(F.lit(prefix), id_.cast("string")).alias("reference"))
    when = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSxxx").alias("effectiveDateTime")
    patient, v = ref("Patient/", F.col("user_id")).alias("subject"), F.round(F.col("value").cast("double"), 2)
    fields = {
        "view": [F.lit("Observation").alias("resourceType"), F.lit("final").alias("status"), _coded("8867-4").alias("code"), patient, when, _quantity(v, "beats/minute").alias("valueQuantity"), ref("Device/", F.col("event_id")).alias("device")],
        "click": [F.lit("Observation").alias("resourceType"), F.lit("final").alias("status"), _coded("85354-9").alias("code"), patient, when, F.array(*[F.struct(_coded(c).alias("code"), _quantity(x, "mmHg").alias("valueQuantity")) for c, x in (("8480-6", v + 100), ("8462-4", v + 50))]).alias("component")],
        "purchase": [F.lit("MedicationAdministration").alias("resourceType"), F.lit("completed").alias("status"), _coded("1191").alias("medication"), _quantity(v, "mg").alias("dosage"), F.struct(F.lit("s").alias("system"), F.lit("o").alias("code"), F.lit("oral").alias("display")).alias("route"), patient, when],
        "error": [F.lit("DeviceObservation").alias("resourceType"), F.lit("final").alias("status"), ref("Device/", F.col("event_id") % 10).alias("device"), _coded("150456").alias("code"), _quantity(v, "%").alias("valueQuantity"), when, patient, F.lit("monitor").alias("deviceType"), F.lit("measurement").alias("metricType")],
        "signup": [F.lit("VitalSigns").alias("resourceType"), F.when(F.col("event_id") % 3 == 0, _coded("8310-5")).otherwise(_coded("0-0")).alias("code"), patient, when, _quantity(v, "Cel").alias("valueQuantity")],
    }[kind]
    return events.select(F.col("event_id").cast("long").alias("seq"), F.to_json(F.struct(*fields)).alias("body"))


_ROW = ["timestamp", "metric_name", "value", "resource_type", "ingest_seq", "place"]


def _fhir(name: str, kind: str, resource: str, sql: str, *context: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        records, _ = fhir.PARSERS[resource](_bodies(spark, sf_dir, kind))
        return records.select(*_ROW, *[F.try_element_at("context", F.lit(k)).alias(k) for k in context])

    QUERIES[name] = run
    ORACLES[name] = f"WITH e AS (SELECT epoch_us(ts) // 1000000 AS timestamp, CAST(event_id AS BIGINT) AS ingest_seq, event_id, user_id, round(CAST(value AS DOUBLE), 2) AS v FROM events WHERE event_type = '{kind}') {sql}"


_fhir("fhir_observation", "view", "Observation", "SELECT timestamp, user_id || '|8867-4|beats/minute' AS metric_name, v AS value, 'Observation' AS resource_type, ingest_seq, 0 AS place, CAST(event_id AS VARCHAR) AS device_id FROM e", "device_id")
_fhir("fhir_components", "click", "Observation", "SELECT timestamp, user_id || '|85354-9|8480-6|mmHg' AS metric_name, v + 100 AS value, 'Observation' AS resource_type, ingest_seq, 0 AS place FROM e UNION ALL SELECT timestamp, user_id || '|85354-9|8462-4|mmHg', v + 50, 'Observation', ingest_seq, 1 FROM e")
_fhir("fhir_medication", "purchase", "MedicationAdministration", "SELECT timestamp, user_id || '|1191|mg' AS metric_name, v AS value, 'MedicationAdministration' AS resource_type, ingest_seq, 0 AS place, 'oral' AS route, CAST(NULL AS VARCHAR) AS practitioner_id FROM e", "route", "practitioner_id")
_fhir("fhir_device", "error", "DeviceObservation", "SELECT timestamp, (event_id % 10) || '|150456|%' AS metric_name, v AS value, 'DeviceObservation' AS resource_type, ingest_seq, 0 AS place, 'monitor' AS device_type, CAST(user_id AS VARCHAR) AS patient_id FROM e", "device_type", "patient_id")
_fhir("fhir_vital_signs", "signup", "VitalSigns", "SELECT timestamp, user_id || '|8310-5|Cel' AS metric_name, v AS value, 'VitalSigns' AS resource_type, ingest_seq, 0 AS place FROM e WHERE event_id % 3 = 0")


def fhir_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fhir.vital_signs(_bodies(spark, sf_dir, "signup"))[1].select("seq", "error")


QUERIES["fhir_rejected"] = fhir_rejected
ORACLES["fhir_rejected"] = "SELECT CAST(event_id AS BIGINT) AS seq, 'Unknown vital sign code' AS error FROM events WHERE event_type = 'signup' AND event_id % 3 != 0"


def _events(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{sf_dir}/events.parquet").where(F.col("event_type") == kind)


def _common(code: str) -> list[Column]:
    """Status, code, subject and time of a resource made of an event."""
    when = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSxxx").alias("effectiveDateTime")
    return [F.lit("final").alias("status"), _coded(code).alias("code"), F.struct(F.concat(F.lit("Patient/"), F.col("user_id").cast("string")).alias("reference")).alias("subject"), when]


def fhir_sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three samples 600 ms apart and one token that is no number."""
    k = F.col("event_id") % 100
    data = F.concat_ws(" ", k, F.lit("E"), k + 1, k + 2)
    wave = F.struct(F.lit("0").alias("origin"), F.lit(600.0).alias("period"), F.lit(2.0).alias("factor"), F.lit(1).alias("dimensions"), data.alias("data"))
    bodies = _events(spark, sf_dir, "view").select(F.col("event_id").cast("long").alias("seq"), F.to_json(F.struct(F.lit("Observation").alias("resourceType"), *_common("11524-6"), wave.alias("valueSampledData"))).alias("body"))
    return fhir.observations(bodies)[0].select(*_ROW, F.col("context")["period_ms"].alias("period_ms"))


def _bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bundle for each user: clicks as observations, of which some have no value, and other resources between them."""
    v = F.round(F.col("value").cast("double"), 2)
    quantity = F.when(F.col("event_id") % 5 != 0, _quantity(v, "mg"))
    resource = F.struct(F.when(F.col("event_id") % 7 == 0, "Patient").otherwise("Observation").alias("resourceType"), *_common("8867-4"), quantity.alias("valueQuantity"))
    entry = F.struct("event_id", F.struct(resource.alias("resource"), F.struct(F.lit("POST").alias("method"), F.lit("Observation").alias("url")).alias("request")).alias("entry"))
    grouped = _events(spark, sf_dir, "click").groupBy("user_id").agg(F.array_sort(F.collect_list(entry), lambda a, b: F.signum(a["event_id"] - b["event_id"]).cast("int"))["entry"].alias("entry"))
    return grouped.select(F.col("user_id").cast("long").alias("seq"), F.to_json(F.struct(F.lit("Bundle").alias("resourceType"), F.lit("batch").alias("type"), "entry")).alias("body"))


def fhir_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fhir.bundles(_bundles(spark, sf_dir))[0].select(*_ROW)


def fhir_bundle_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fhir.bundles(_bundles(spark, sf_dir))[2].select("seq", "processed", "errors", "status")


def _pressures(spark: SparkSession, sf_dir: str) -> DataFrame:
    high, low = F.col("event_id") % 50 + 100, F.col("event_id") % 40 + 50
    parts = F.array(*[F.struct(_coded(c).alias("code"), _quantity(x.cast("double"), "mmHg").alias("valueQuantity")) for c, x in ((fhir.SYSTOLIC, high), (fhir.DIASTOLIC, low))])
    bodies = _events(spark, sf_dir, "purchase").select(F.col("event_id").cast("long").alias("seq"), F.to_json(F.struct(F.lit("VitalSigns").alias("resourceType"), *_common(fhir.PRESSURE), parts.alias("component"))).alias("body"))
    return fhir.vital_signs(bodies)[0]


def fhir_pressure(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _pressures(spark, sf_dir)
    return found.select(*_ROW, *[F.try_element_at("context", F.lit(k)).alias(k) for k in ("bp_diastolic", "bp_systolic")])


def pressure_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.pressure_pairs(_pressures(spark, sf_dir))


def fhir_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pressures to records and back to resources."""
    back = fhir.to_resources(_pressures(spark, sf_dir))
    read = lambda path: F.get_json_object("body", path)
    return back.select("resource_type", "subject_id", "code", "timestamp", read("$.vitalType").alias("vital"), read("$.valueQuantity.value").cast("double").alias("value"), read("$.diastolic").cast("double").alias("diastolic"))


@_query("fhir_unconvertible", "SELECT ingest_seq, 'Unknown vital code: ' || split_part(metric_name, '|', 2) AS error FROM recs WHERE resource_type = 'VitalSigns'", fine=True)
def _(r):
    return fhir.unconvertible(r).select("ingest_seq", "error")


QUERIES |= {"fhir_sampled": fhir_sampled, "fhir_bundle": fhir_bundle, "fhir_bundle_summary": fhir_bundle_summary, "fhir_pressure": fhir_pressure, "pressure_pairs": pressure_pairs, "fhir_back": fhir_back}
_EVENT_SQL = "WITH e AS (SELECT epoch_us(ts) // 1000000 AS timestamp, CAST(event_id AS BIGINT) AS event_id, user_id, round(CAST(value AS DOUBLE), 2) AS v, event_id % 50 + 100 AS high, event_id % 40 + 50 AS low FROM events WHERE event_type = '{kind}')"
_ENTRY_SQL = _EVENT_SQL.format(kind="click") + ", n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS nth FROM e)"
_PRESSURE_SQL = _EVENT_SQL.format(kind="purchase")
ORACLES |= {
    "fhir_sampled": _EVENT_SQL.format(kind="view") + " SELECT timestamp + i * 600 // 1000 AS timestamp, user_id || '|11524-6|sampled' AS metric_name, CAST((event_id % 100 + i) * 2 AS DOUBLE) AS value, 'Observation' AS resource_type, event_id AS ingest_seq, CAST(i AS INTEGER) AS place, '600' AS period_ms FROM e, (SELECT unnest([0, 1, 2]) AS i)",
    "fhir_bundle": _ENTRY_SQL + " SELECT timestamp, user_id || '|8867-4|mg' AS metric_name, v AS value, 'Observation' AS resource_type, CAST(user_id * 67108864 + nth AS BIGINT) AS ingest_seq, 0 AS place FROM n WHERE event_id % 7 != 0 AND event_id % 5 != 0",
    "fhir_bundle_summary": _ENTRY_SQL + " SELECT CAST(user_id AS BIGINT) AS seq, count(*) FILTER (event_id % 7 != 0 AND event_id % 5 != 0) AS processed, count(*) FILTER (event_id % 7 != 0 AND event_id % 5 = 0) AS errors, CASE WHEN errors > 0 THEN 'partial' ELSE 'success' END AS status FROM n GROUP BY user_id",
    "fhir_pressure": _PRESSURE_SQL + " SELECT timestamp, user_id || '|8480-6|mmHg' AS metric_name, CAST(high AS DOUBLE) AS value, 'VitalSigns' AS resource_type, event_id AS ingest_seq, 0 AS place, CAST(low AS VARCHAR) AS bp_diastolic, NULL AS bp_systolic FROM e UNION ALL SELECT timestamp, user_id || '|8462-4|mmHg', CAST(low AS DOUBLE), 'VitalSigns', event_id, 1, NULL, CAST(high AS VARCHAR) FROM e",
    "pressure_pairs": _PRESSURE_SQL + " SELECT user_id || '|8480-6|mmHg' AS metric_name, timestamp, high || '/' || low AS pressure FROM e",
    "fhir_back": _PRESSURE_SQL + " SELECT 'VitalSigns' AS resource_type, CAST(user_id AS VARCHAR) AS subject_id, '8480-6' AS code, timestamp, 'BloodPressure' AS vital, CAST(high AS DOUBLE) AS value, CAST(low AS DOUBLE) AS diastolic FROM e UNION ALL SELECT 'VitalSigns', CAST(user_id AS VARCHAR), '8462-4', timestamp, 'BloodPressure', CAST(low AS DOUBLE), NULL FROM e",
}
