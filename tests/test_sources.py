"""FHIR parsing, imports, tables, settings and stream ingest."""

import json
import struct

import pytest
from pyspark.sql import functions as F

from pulsegrid.functions import config
from pulsegrid.operators import scan
from pulsegrid.sources import fhir, imports, records
from pulsegrid.streaming import ingest


def coding(code):
    return {"coding": [{"system": "http://loinc.org", "code": code, "display": code}]}


def quantity(value, unit="mmHg"):
    return {"value": value, "unit": unit, "system": "s", "code": unit}


def observation(**more):
    return {"resourceType": "Observation", "status": "final", "code": coding("8867-4"), "subject": {"reference": "Patient/123"}, "effectiveDateTime": "1970-01-01T01:00:00Z"} | more


PANEL = [{"code": coding("8480-6"), "valueQuantity": quantity(120)}, {"code": coding("8462-4"), "valueQuantity": quantity(80)}]


def parse(spark, resource, *bodies):
    rows = [(i, b if isinstance(b, str) else json.dumps(b)) for i, b in enumerate(bodies)]
    good, bad = fhir.PARSERS[resource](spark.createDataFrame(rows, "seq long, body string"))
    return good.orderBy("ingest_seq", "place").collect(), {r.seq: r.error for r in bad.collect()}


def test_observation(spark):
    good, bad = parse(
        spark, "Observation",
        observation(valueQuantity=quantity(72, "beats/minute"), device={"reference": "Device/d1"}),
        observation(code=coding("85354-9"), component=PANEL),
        observation(valueSampledData={"origin": "0", "period": 4, "factor": 2, "dimensions": 1, "data": "1.5 E -0.5"}),
        observation(valueQuantity=quantity(1, "x"), component=PANEL),
        observation(), "not json", observation(valueQuantity=quantity(1), effectiveDateTime="2025-05-19"),
        observation(valueQuantity=quantity(1), effectiveDateTime="1969-12-31T23:58:20Z"), observation(code={"coding": []}, valueQuantity=quantity(1)),
        observation(valueQuantity=quantity(1, "x"), effectiveDateTime="2025-05-19T20:36:40.900+02:00"),
    )
    got = [(r.ingest_seq, r.timestamp, r.metric_name, r.value) for r in good]
    assert got[:6] == [(0, 3600, "123|8867-4|beats/minute", 72), (1, 3600, "123|85354-9|8480-6|mmHg", 120), (1, 3600, "123|85354-9|8462-4|mmHg", 80), (2, 3600, "123|8867-4|sampled", 3), (2, 3600, "123|8867-4|sampled", -1), (3, 3600, "123|8867-4|x", 1)]
    assert got[6][1] == 1747679800
    assert good[0].context == {"device_id": "d1"} and good[3].context == {"sample_type": "sampled_data", "period_ms": "4", "factor": "2"}
    assert bad == {4: "No value", 5: "Invalid JSON", 6: "Invalid timestamp format", 7: "Timestamp out of chunk range", 8: "Empty coding"}


@pytest.mark.parametrize("field", ["status", "subject"])
def test_observation_lacks_a_field(spark, field):
    good, bad = parse(spark, "Observation", {k: v for k, v in observation(valueQuantity=quantity(1)).items() if k != field})
    assert good == [] and bad == {0: f"Missing {field}"}


def test_observation_lacks_a_part(spark):
    lone = {k: v for k, v in quantity(1).items() if k != "unit"}
    part = [PANEL[0], {"code": coding("8462-4"), "valueQuantity": lone}]
    good, bad = parse(spark, "Observation", observation(valueQuantity=lone), observation(component=part), observation(component=[{"code": {"coding": []}, "valueQuantity": quantity(1)}]), observation(valueSampledData={"data": "1 2"}), observation(valueQuantity=lone, component=PANEL))
    assert good == [] and bad == {0: "Missing value or unit", 1: "Missing part of a component", 2: "Missing part of a component", 3: "Missing part of the sampled data", 4: "Missing value or unit"}


def test_other_resources_lack_a_field(spark):
    for resource, body, fields in (("MedicationAdministration", MEDICATION, {"status": "status", "subject": "subject", "route": "route"}), ("DeviceObservation", DEVICE, {"status": "status", "device": "device", "deviceType": "deviceType", "metricType": "metricType"})):
        bodies = [{k: v for k, v in body.items() if k != field} for field in fields]
        good, bad = parse(spark, resource, *bodies)
        assert good == [] and list(bad.values()) == [f"Missing {name}" for name in fields.values()]
    for resource, body, field in (("MedicationAdministration", MEDICATION, "dosage"), ("DeviceObservation", DEVICE, "valueQuantity")):
        good, bad = parse(spark, resource, body | {field: {"value": 1}}, {k: v for k, v in body.items() if k != "effectiveDateTime"})
        assert good == [] and bad == {0: "Missing unit", 1: "Invalid timestamp format"}
    vital = {"resourceType": "VitalSigns", "code": coding("8310-5"), "effectiveDateTime": "1970-01-01T01:00:00Z", "valueQuantity": quantity(1)}
    assert parse(spark, "VitalSigns", vital, vital | {"subject": {"reference": "Patient/1"}, "valueQuantity": {"value": 1}})[1] == {0: "Missing subject", 1: "Missing value or unit"}


def test_waveform_spans_seconds(spark):
    good, _ = parse(spark, "Observation", observation(valueSampledData={"period": 4, "data": " ".join(["1"] * 300)}))
    assert [r.timestamp for r in good] == [3600] * 250 + [3601] * 50


def test_vital_signs(spark):
    base = {"resourceType": "VitalSigns", "subject": {"reference": "Patient/123"}, "effectiveDateTime": "1970-01-01T01:00:00Z"}
    good, bad = parse(spark, "VitalSigns", base | {"code": coding("85354-9"), "component": PANEL}, base | {"code": coding("1-1"), "valueQuantity": quantity(1)}, base | {"code": coding("8310-5"), "valueQuantity": quantity(37.5, "Cel")}, base | {"resourceType": "Observation", "code": coding("8310-5")})
    assert [(r.metric_name, r.context) for r in good[:2]] == [("123|8480-6|mmHg", {"component": "systolic", "bp_diastolic": "80"}), ("123|8462-4|mmHg", {"component": "diastolic", "bp_systolic": "120"})]
    assert good[2].context == {"vital_type": "Temperature"} and bad == {1: "Unknown vital sign code", 3: "Resource type must be VitalSigns"}


MEDICATION = {"resourceType": "MedicationAdministration", "status": "completed", "medication": coding("m1"), "dosage": quantity(5, "mg"), "route": {"display": "oral"}, "subject": {"reference": "Patient/7"}, "effectiveDateTime": "1970-01-01T01:00:00Z", "performer": {"reference": "Practitioner/p9"}}
DEVICE = {"resourceType": "DeviceObservation", "status": "final", "device": {"reference": "Device/d"}, "code": coding("c"), "valueQuantity": quantity(1, "%"), "effectiveDateTime": "1970-01-01T01:00:00Z", "deviceType": "t", "metricType": "m"}


def test_medication_and_device(spark):
    (row,), _ = parse(spark, "MedicationAdministration", MEDICATION)
    assert row.metric_name == "7|m1|mg" and row.context == {"medication_display": "m1", "route": "oral", "status": "completed", "practitioner_id": "p9"}
    (row,), _ = parse(spark, "DeviceObservation", DEVICE)
    assert row.metric_name == "d|c|%" and "patient_id" not in row.context


def test_entries_of_large_bundles_keep_apart(spark):
    """Over a million entries of one bundle, and those of the next: the order of records follows bundle and entry."""
    entry = json.dumps({"resource": {"resourceType": "Patient"}, "request": {"method": "POST"}})
    last = json.dumps({"resource": observation(valueQuantity=quantity(1)), "request": {"method": "POST", "url": "Observation"}})
    bodies = [(1, '{"resourceType": "Bundle", "entry": [' + f"{entry}, " * 1_000_001 + last + "]}"), (2, '{"resourceType": "Bundle", "entry": [' + entry + ", " + last + "]}")]
    good, bad, summary = fhir.bundles(spark.createDataFrame(bodies, "seq long, body string"))
    assert [r.ingest_seq for r in good.orderBy("ingest_seq").collect()] == [fhir.ENTRIES + 1_000_001, 2 * fhir.ENTRIES + 1]
    assert [(r.seq, r.processed, r.errors) for r in summary.orderBy("seq").collect()] == [(1, 1, 0), (2, 1, 0)]


def test_bundle(spark):
    post = {"method": "POST", "url": "Observation"}
    entries = [{"resource": observation(valueQuantity=quantity(1)), "request": post}, {"resource": observation(valueQuantity=quantity(1), effectiveDateTime="x"), "request": post}, {"resource": observation(), "request": post}, {"resource": {"resourceType": "Patient"}, "request": post}]
    body = json.dumps({"resourceType": "Bundle", "type": "batch", "entry": entries})
    good, bad, summary = fhir.bundles(spark.createDataFrame([(3, body)], "seq long, body string"))
    assert (good.count(), bad.count()) == (1, 2)
    assert [tuple(r) for r in summary.select("seq", "processed", "errors", "status").collect()] == [(3, 1, 2, "partial")]


def test_back_to_resources(spark):
    good, _ = fhir.observations(spark.createDataFrame([(0, json.dumps(observation(code=coding("85354-9"), component=PANEL))), (1, json.dumps(observation(valueSampledData={"period": 4, "factor": 2, "data": "1.5 -0.5"})))], "seq long, body string"))
    odd = good.limit(1).withColumns({"metric_name": F.lit("short"), "resource_type": F.lit("Observation")}).union(good.limit(1).withColumns({"metric_name": F.lit("p|0-0|x"), "resource_type": F.lit("VitalSigns")}))
    odd = odd.union(good.limit(1).withColumns({"metric_name": F.lit("p|0-0|x"), "context": F.create_map(F.lit("vital_type"), F.lit("Mood")), "resource_type": F.lit("VitalSigns")}))
    assert [r.error for r in fhir.unconvertible(odd).collect()] == ["Invalid metric name format: short", "Unknown vital code: 0-0", "Unknown vital type: Mood"]
    assert fhir.to_resources(odd).count() == 0 and fhir.unconvertible(good).count() == 0
    bodies = [json.loads(r.body) for r in fhir.to_resources(good).orderBy("code").collect()]
    assert [c["quantity"]["value"] for c in bodies[0]["component"]] == [80, 120]
    assert bodies[1]["valueSampledData"]["data"] == "1.5 -0.5"


def test_imports(spark, tmp_path):
    row = {"timestamp": 3601, "metric_name": "a|b|c", "value": 1.5, "context": {"k": "v"}, "resource_type": "Observation"}
    (tmp_path / "3600.chunk").write_text(json.dumps({"start_time": 3600, "end_time": 7200, "records": {"a|b|c": [row, row | {"value": 2.5}]}}))
    rows = imports.read_chunks(spark, str(tmp_path)).orderBy("ingest_seq").collect()
    assert [(r.value, r.chunk_id, r.context) for r in rows] == [(1.5, 3600, {"k": "v"}), (2.5, 3600, {"k": "v"})]
    (tmp_path / "7200.chunk").write_text(json.dumps({"start_time": 7200, "records": {"b": [row, row], "a": [row | {"value": 9.0}]}}))
    rows = imports.read_chunks(spark, str(tmp_path)).where("chunk_id = 7200").orderBy("ingest_seq").collect()
    assert [(r.ingest_seq, r.value) for r in rows] == [(0, 9.0), (1, 1.5), (2, 1.5)]
    line = json.dumps(row).encode()
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "records.wal").write_bytes((struct.pack(">I", len(line)) + line) * 2 + b"\0\0")
    assert [(r.timestamp, r.chunk_id) for r in imports.read_log(spark, str(tmp_path / "w")).collect()] == [(3601, 3600)] * 2
    with pytest.raises(ValueError):
        imports.log_records(struct.pack(">I", 9) + b"abc")


def test_recovery_of_an_old_folder(spark, tmp_path):
    row = {"timestamp": 3601, "metric_name": "a|b|c", "value": 1.5, "context": {}, "resource_type": "Observation"}
    (tmp_path / "chunks").mkdir()
    (tmp_path / "wal").mkdir()
    (tmp_path / "chunks" / "3600.chunk").write_text(json.dumps({"start_time": 3600, "records": {"a|b|c": [row]}}))
    (tmp_path / "chunks" / "7200.chunk").write_text("broken")
    lines = [json.dumps(row | {"value": v, "timestamp": t}).encode() for v, t in ((2.5, 3602), (3.5, -100))]
    (tmp_path / "wal" / "records.wal").write_bytes(b"".join(struct.pack(">I", len(x)) + x for x in lines))
    rows = imports.recover(spark, str(tmp_path)).orderBy("chunk_id", "ingest_seq").collect()
    assert [(r.value, r.origin, r.chunk_id) for r in rows] == [(1.5, "chunk", 3600), (2.5, "log", 3600)]
    records.write(imports.recover(spark, str(tmp_path)).drop("origin"), str(tmp_path / "t"))
    assert scan.latest(records.load(spark, str(tmp_path / "t"))).first().value == 2.5


def test_old_chunks_are_dropped(spark, tmp_path):
    rows = spark.createDataFrame([(t, "m", 1.0, {}, "Observation", t, 0) for t in (10, 3700, 7300)], records.RECORD)
    records.write(rows, str(tmp_path / "t"))
    assert records.drop_chunks(spark, str(tmp_path / "t"), 9000, 3600) == [0, 3600]
    assert [r.timestamp for r in records.load(spark, str(tmp_path / "t")).collect()] == [7300]
    assert records.drop_chunks(spark, str(tmp_path / "none"), 9000, 0) == []


def test_numbers_are_dense_and_in_order(spark):
    rows = spark.range(0, 1000, 1, 7).selectExpr("id AS at")
    got = [r.ingest_seq for r in records.numbered(rows, 3).orderBy("at").collect()]
    assert got == [3 * records.BATCH_ROWS + i for i in range(1000)]
    with pytest.raises(ValueError):
        records.numbered(rows, 1 << 27)


def test_table_round_trip_and_pruning(spark, tmp_path):
    rows = spark.createDataFrame([(t, "m", 1.0, {}, "Observation", t, 0) for t in range(0, 20000, 500)], records.RECORD)
    records.write(rows, str(tmp_path / "t"))
    table = records.load(spark, str(tmp_path / "t"))
    found = scan.time_range(table, 3600, 7200)
    assert found.count() == 7 and "PartitionFilters: [isnotnull(chunk_id" in found._jdf.queryExecution().executedPlan().toString()


def test_bounds(spark):
    rows = spark.createDataFrame([(-100, 1.0), (-3600, 1.0), (5, float("nan")), (5, None)], "timestamp long, value double")
    good, bad = records.accepted(rows)
    assert [(r.timestamp, r.chunk_id) for r in good.collect()] == [(-3600, -3600)] and bad.count() == 3


def test_settings(tmp_path):
    assert [config.seconds(x) for x in ("90s", "5m", "1h", "2d")] == [90, 300, 3600, 172800]
    with pytest.raises(ValueError):
        config.seconds("1w")
    (tmp_path / "d.toml").write_text('[global]\nenable_all = true\n[changepoint]\nmethod = "pelt"\npenalty = 3.0\n[moving_window]\nwindow_size = 60\n')
    found = config.load(str(tmp_path / "d.toml"))
    assert (found.changepoint.method, found.changepoint.penalty, found.moving_window.window_size, found.seasonal.period) == ("pelt", 3.0, 60, 86400)


def test_number_text(spark):
    rows = spark.createDataFrame([(4.0,), (1e7,), (0.25,), (-3.0,), (0.0,), (100.0,)], "v double")
    assert [r[0] for r in rows.select(scan.number_text("v")).collect()] == ["4", "10000000", "0.25", "-3", "0", "100"]


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines = [json.dumps(observation(valueQuantity=quantity(v))) for v in (1, 2)] + [json.dumps(observation())]
    (tmp_path / "in" / "a.json").write_text("\n".join(lines))
    go = lambda: ingest.ingest(spark, str(tmp_path / "in"), str(tmp_path / "t"), str(tmp_path / "bad"), str(tmp_path / "c")).awaitTermination()
    go()
    (tmp_path / "in" / "b.json").write_text(json.dumps(observation(valueQuantity=quantity(3))))
    go()
    rows = spark.read.parquet(str(tmp_path / "t")).collect()
    assert sorted(r.value for r in rows) == [1, 2, 3] and len({r.ingest_seq for r in rows}) == 3
    assert [r.value for r in sorted(rows, key=lambda r: r.ingest_seq)] == [1, 2, 3]
    assert [r.error for r in spark.read.json(str(tmp_path / "bad")).where("error is not null").collect()] == ["No value"]
