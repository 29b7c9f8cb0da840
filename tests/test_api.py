"""The functions that stand for the service's endpoints."""

import json

import pytest

from pulsegrid import api
from pulsegrid.sources import records
from pulsegrid.streaming import ingest

from .test_series import A, B, C, made
from .test_sources import PANEL, coding, observation, quantity


def test_queries(spark):
    table = made(spark, **{"p|8867-4|bpm": A, "p|2|x": B, "q|59408-5|%": C})
    row = api.observation(table, "p", "8867-4").first()
    assert (row.subject, row.code_display, row.iso_date, row.value) == ("Patient/p", "Heart Rate", "1970-01-01T00:14:00+00:00", 5)
    assert api.observation(table, "z", "1").count() == 0
    assert api.resources(table, "Observation", 10000).count() == 20 and api.resources(table, "Observation", 10000, since="4000").count() == 4
    assert api.time_chunks(table, 5000).select("chunk_start").distinct().count() == 2
    assert api.trend(table, 90000, "p|8867-4|bpm", start=0).first().n == 5
    assert [r.metric_name for r in api.trend(table, 5000, resource_type="Observation", pattern="p|").collect()] == ["p|8867-4|bpm", "p|2|x"]
    with pytest.raises(ValueError):
        api.trend(table, 5000)
    assert api.stats(table, 5000, "p|8867-4|bpm").first().percentiles["p75"] == 4
    assert api.outliers(table, 5000, "q|59408-5|%").count() == 1 and api.rate(table, 5000, "p|8867-4|bpm").count() == 4
    by_type, counts = api.metrics(table)
    assert by_type.count() == 1 and counts.first().metrics == 3


def test_post(spark, tmp_path):
    body = json.dumps({"resourceType": "Bundle", "entry": [{"resource": observation(code=coding("85354-9"), component=PANEL), "request": {"method": "POST"}}, {"resource": observation(), "request": {"method": "POST"}}]})
    bodies = spark.createDataFrame([(1, body)], "seq long, body string")
    assert api.post(bodies, str(tmp_path / "t")).count() == 1
    single = spark.createDataFrame([(2, json.dumps(observation(valueQuantity=quantity(5))))], "seq long, body string")
    assert api.post(single, str(tmp_path / "t"), "Observation").count() == 0
    rows = records.load(spark, str(tmp_path / "t")).orderBy("ingest_seq").collect()
    assert [r.value for r in rows] == [120, 80, 5] and [r.ingest_seq for r in rows] == [records.BATCH_ROWS, records.BATCH_ROWS + 1, 3 * records.BATCH_ROWS]
    api.post(single, str(tmp_path / "t"), "Observation", batch=3)
    with pytest.raises(ValueError):
        api.post(single, str(tmp_path / "t"), "Observation", batch=2)
    assert records.load(spark, str(tmp_path / "t")).count() == 3


def test_single_records_are_rejected(spark, tmp_path):
    """Of a waveform with a sample beyond all numbers the others stay, and the caller hears of it."""
    wave = {"period": 4, "data": "1 1e999 3"}
    bodies = spark.createDataFrame([(7, json.dumps(observation(valueSampledData=wave)))], "seq long, body string")
    bad = api.post(bodies, str(tmp_path / "t"), "Observation").collect()
    assert [(r.seq, r.error) for r in bad] == [(7, "Value is not finite")]
    rows = records.load(spark, str(tmp_path / "t")).orderBy("ingest_seq").collect()
    assert [r.value for r in rows] == [1, 3] and len({r.ingest_seq for r in rows}) == 2


def test_posts_and_streams_share_a_table(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(json.dumps(observation(valueSampledData={"period": 4, "data": " ".join(map(str, range(70_000)))})) for _ in range(2)))
    ingest.ingest(spark, str(tmp_path / "in"), str(tmp_path / "t"), str(tmp_path / "bad"), str(tmp_path / "c")).awaitTermination()
    single = spark.createDataFrame([(2, json.dumps(observation(valueQuantity=quantity(5))))], "seq long, body string")
    api.post(single, str(tmp_path / "t"), "Observation")
    table = records.load(spark, str(tmp_path / "t"))
    assert table.count() == table.select("ingest_seq").distinct().count() == 140_001
    (tmp_path / "in" / "b.json").write_text(json.dumps(observation(valueQuantity=quantity(6))))
    ingest.ingest(spark, str(tmp_path / "in"), str(tmp_path / "t"), str(tmp_path / "bad"), str(tmp_path / "c")).awaitTermination()
    assert sorted(r.value for r in records.load(spark, str(tmp_path / "t")).where("metric_name NOT LIKE '%sampled'").collect()) == [5, 6]
    waves = [r.value for r in table.where("metric_name LIKE '%sampled'").orderBy("ingest_seq").collect()]
    assert waves == [*range(70_000)] * 2
