"""FHIR-style JSON to records, and records back to resources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.scan import key_parts, number_text

_CODING = "struct<coding:array<struct<system:string,code:string,display:string>>>"
_QUANTITY = "struct<value:double,unit:string,system:string,code:string>"
_REF = "struct<reference:string>"
_SAMPLED = "struct<origin:string,period:double,factor:double,dimensions:int,data:string>"
_COMPONENT = f"array<struct<code:{_CODING},valueQuantity:{_QUANTITY}>>"
_SHOWN = "struct<system:string,code:string,display:string>"
SCHEMAS = {
    "Observation": f"resourceType string, status string, code {_CODING}, subject {_REF}, effectiveDateTime string, valueQuantity {_QUANTITY}, component {_COMPONENT}, valueSampledData {_SAMPLED}, device {_REF}",
    "MedicationAdministration": f"resourceType string, status string, medication {_CODING}, dosage {_QUANTITY}, route {_SHOWN}, subject {_REF}, effectiveDateTime string, performer {_REF}",
    "DeviceObservation": f"resourceType string, status string, device {_REF}, code {_CODING}, valueQuantity {_QUANTITY}, effectiveDateTime string, subject {_REF}, deviceType string, metricType string",
    "VitalSigns": f"resourceType string, code {_CODING}, subject {_REF}, effectiveDateTime string, valueQuantity {_QUANTITY}, component {_COMPONENT}, method {_SHOWN}, position {_SHOWN}, reliability string",
}
#: Vital signs by LOINC code, and blood pressure's codes.
VITALS = {"8867-4": "HeartRate", "9279-1": "RespiratoryRate", "59408-5": "OxygenSaturation", "8310-5": "Temperature", "29463-7": "Weight", "8302-2": "Height"}
PRESSURE, SYSTOLIC, DIASTOLIC = "85354-9", "8480-6", "8462-4"
_TIME = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"
_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def unix_time(text: str) -> Column:
    """Whole seconds of an RFC 3339 time with an offset, rounded down; else null."""
    return F.when(F.col(text).rlike(_TIME), F.unix_seconds(F.try_to_timestamp(F.upper(text))))


def _stripped(reference: str) -> Column:
    return F.replace(F.col(reference), F.lit("Patient/"), F.lit(""))


def _coding(path: str) -> Column:
    return F.get(F.col(f"{path}.coding"), F.lit(0))


def _context(**values: Column) -> Column:
    made = F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v.cast("string"))])
    return F.map_filter(made, lambda _, v: v.isNotNull())


def _row(metric: Column, value: Column, context: Column) -> Column:
    return F.struct(metric.alias("metric_name"), value.cast("double").alias("value"), context.alias("context"))


def _errors(*checks: tuple[Column, str]) -> Column:
    """The message of the first check that does not hold."""
    return F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(message)) for ok, message in checks], F.lit(None).cast("string"))


def _there(**fields: Column | str) -> list[tuple[Column, str]]:
    """A check for each field that a record cannot do without."""
    return [((F.col(c) if isinstance(c, str) else c).isNotNull(), f"Missing {name}") for name, c in fields.items()]


def _whole_parts() -> tuple[Column, str]:
    """Components, where there are any, have a code, a value and a unit."""
    whole = F.forall("component", lambda c: F.get(c["code"]["coding"], F.lit(0))["code"].isNotNull() & c["valueQuantity"]["value"].isNotNull() & c["valueQuantity"]["unit"].isNotNull())
    return F.col("component").isNull() | whole, "Missing part of a component"


def _unit_of(quantity: str) -> tuple[Column, str]:
    """A quantity, where there is one, has a value and a unit."""
    return F.col(quantity).isNull() | (F.col(f"{quantity}.value").isNotNull() & F.col(f"{quantity}.unit").isNotNull()), "Missing value or unit"


def _finish(rows: DataFrame, resource: str) -> tuple[DataFrame, DataFrame]:
    """(records, rejected) of rows with ``seq, body, error, timestamp, made`` (array of rows)."""
    rows = rows.withColumn("error", F.coalesce("error", F.when(F.size("made") == 0, F.lit("No value"))))
    rejected = rows.where("error is not null").select("seq", "body", "error")
    fine = rows.where("error is null").select("seq", "timestamp", F.posexplode("made").alias("place", "r"))
    records = fine.select("timestamp", "r.metric_name", "r.value", "r.context", F.lit(resource).alias("resource_type"), F.col("seq").alias("ingest_seq"), "place")
    return records, rejected


def _once(value: Column) -> Column:
    """``value``, as the output of a generator: Spark then computes it once, and not again for each use and each sample."""
    return F.explode(F.array(value))


def _parsed(bodies: DataFrame, resource: str, check_type: bool) -> DataFrame:
    rows = bodies.select("seq", "body", _once(F.from_json("body", SCHEMAS[resource])).alias("j")).select("seq", "body", "j.*")
    rows = rows.withColumn("timestamp", unix_time("effectiveDateTime"))
    typed = [(F.col("resourceType") == resource, f"Resource type must be {resource}")] if check_type else []
    return rows.withColumn("error", _errors((F.col("resourceType").isNotNull(), "Invalid JSON"), *typed, (F.col("timestamp").isNotNull(), "Invalid timestamp format"), ((F.col("timestamp") >= 0) | (F.col("timestamp") % 3600 == 0), "Timestamp out of chunk range")))


def observations(bodies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, rejected) of ``seq, body``. A quantity goes before components, these before samples.

    A field that a record, its key or its context needs must be there; others,
    such as the system of a code, may be missing.
    """
    rows = _parsed(bodies, "Observation", check_type=False)
    patient, code = _stripped("subject.reference"), _coding("code")["code"]
    device = _context(device_id=F.replace(F.col("device.reference"), F.lit("Device/"), F.lit("")))
    key = lambda *parts: F.concat_ws("|", *parts)
    one = F.array(_row(key(patient, code, F.col("valueQuantity.unit")), F.col("valueQuantity.value"), device))
    many = F.transform("component", lambda c: _row(key(patient, code, F.get(c["code"]["coding"], F.lit(0))["code"], c["valueQuantity"]["unit"]), c["valueQuantity"]["value"], device))
    s = F.col("valueSampledData")
    factor = F.coalesce(s["factor"], F.lit(1.0))
    numbers = F.filter(F.split(F.trim(s["data"]), r"\s+"), lambda t: t.rlike(_NUMBER))
    about = F.map_concat(device, _context(sample_type=F.lit("sampled_data"), period_ms=number_text(s["period"]), factor=number_text(factor)))
    wave = F.transform(numbers, lambda t, i: F.struct((F.col("timestamp") + F.floor(i * F.floor(s["period"]) / 1000)).alias("at"), _row(key(patient, code, F.lit("sampled")), t.cast("double") * factor, about).alias("row")))
    wave = F.when(s.isNotNull(), wave)
    single = F.when(F.col("valueQuantity.value").isNotNull(), one).when(F.size("component") > 0, many)
    made = F.coalesce(F.transform(single, lambda r: F.struct(F.col("timestamp").alias("at"), r.alias("row"))), wave)
    rows = rows.withColumn("made", _once(made))
    sampled = (s.isNull() | (s["period"].isNotNull() & s["data"].isNotNull()), "Missing part of the sampled data")
    rows = rows.withColumn("error", F.coalesce("error", _errors((code.isNotNull(), "Empty coding"), *_there(status="status", subject=patient), _unit_of("valueQuantity"), _whole_parts(), sampled, (F.size("made") > 0, "No value"))))
    rejected = rows.where("error is not null").select("seq", "body", "error")
    fine = rows.where("error is null").select("seq", F.posexplode("made").alias("place", "m"))
    records = fine.select(F.col("m.at").alias("timestamp"), "m.row.metric_name", "m.row.value", "m.row.context", F.lit("Observation").alias("resource_type"), F.col("seq").alias("ingest_seq"), "place")
    return records, rejected


def medications(bodies: DataFrame) -> tuple[DataFrame, DataFrame]:
    rows = _parsed(bodies, "MedicationAdministration", check_type=True)
    coding = _coding("medication")
    about = _context(medication_display=coding["display"], route=F.col("route.display"), status=F.col("status"), practitioner_id=F.replace(F.col("performer.reference"), F.lit("Practitioner/"), F.lit("")))
    made = F.array(_row(F.concat_ws("|", _stripped("subject.reference"), coding["code"], F.col("dosage.unit")), F.col("dosage.value"), about))
    rows = rows.withColumn("error", F.coalesce("error", _errors((coding["code"].isNotNull(), "Empty coding"), (F.col("dosage.value").isNotNull(), "No dosage"), *_there(unit="dosage.unit", status="status", subject="subject.reference", route="route.display"))))
    return _finish(rows.withColumn("made", made), "MedicationAdministration")


def devices(bodies: DataFrame) -> tuple[DataFrame, DataFrame]:
    rows = _parsed(bodies, "DeviceObservation", check_type=True)
    coding = _coding("code")
    about = _context(device_type=F.col("deviceType"), metric_type=F.col("metricType"), status=F.col("status"), patient_id=_stripped("subject.reference"))
    device = F.replace(F.col("device.reference"), F.lit("Device/"), F.lit(""))
    made = F.array(_row(F.concat_ws("|", device, coding["code"], F.col("valueQuantity.unit")), F.col("valueQuantity.value"), about))
    rows = rows.withColumn("error", F.coalesce("error", _errors((coding["code"].isNotNull(), "Empty coding"), (F.col("valueQuantity.value").isNotNull(), "No value"), *_there(unit="valueQuantity.unit", status="status", device="device.reference", deviceType="deviceType", metricType="metricType"))))
    return _finish(rows.withColumn("made", made), "DeviceObservation")


def vital_signs(bodies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One record of a known sign, or two of a blood pressure with both parts."""
    rows = _parsed(bodies, "VitalSigns", check_type=True)
    patient, code = _stripped("subject.reference"), _coding("code")["code"]
    names = F.create_map(*[F.lit(x) for pair in VITALS.items() for x in pair])
    extra = {"method": F.col("method.display"), "position": F.col("position.display"), "reliability": F.col("reliability")}
    single = F.array(_row(F.concat_ws("|", patient, code, F.col("valueQuantity.unit")), F.col("valueQuantity.value"), _context(vital_type=F.try_element_at(names, code), **extra)))
    part = lambda c: F.get(F.filter("component", lambda x: F.get(x["code"]["coding"], F.lit(0))["code"] == c), F.lit(0))["valueQuantity"]["value"]
    unit = F.get(F.col("component"), F.lit(0))["valueQuantity"]["unit"]
    high, low = part(SYSTOLIC), part(DIASTOLIC)
    both = F.array(
        _row(F.concat_ws("|", patient, F.lit(SYSTOLIC), unit), high, _context(component=F.lit("systolic"), bp_diastolic=number_text(low), **extra)),
        _row(F.concat_ws("|", patient, F.lit(DIASTOLIC), unit), low, _context(component=F.lit("diastolic"), bp_systolic=number_text(high), **extra)),
    )
    has_one = F.col("valueQuantity.value").isNotNull()
    pressure = (code == PRESSURE) & (F.size("component") == 2) & high.isNotNull() & low.isNotNull()
    known = F.when(has_one, F.map_contains_key(names, code)).otherwise(True)
    rows = rows.withColumn("error", F.coalesce("error", _errors((code.isNotNull(), "Empty coding"), *_there(subject=patient), (known, "Unknown vital sign code"), _unit_of("valueQuantity"), (has_one | pressure, "No value"), (has_one | unit.isNotNull(), "Missing value or unit"))))
    return _finish(rows.withColumn("made", F.when(has_one, single).otherwise(both)), "VitalSigns")


PARSERS = {"Observation": observations, "MedicationAdministration": medications, "DeviceObservation": devices, "VitalSigns": vital_signs}


#: A body has less than 2^31 bytes and an entry takes over 32 of them, so entries of two bundles never meet.
ENTRIES = 1 << 26


def bundles(bodies: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records, rejected, summary) of bundles ``seq, body``.

    Only posted observations are read; other entries are passed over. The order
    of records follows the bundle and the entry.
    """
    entry = "struct<resource:string,request:struct<method:string,url:string>>"
    parsed = bodies.select("seq", _once(F.from_json("body", f"resourceType string, entry array<{entry}>")).alias("b"))
    entries = parsed.select(F.col("seq").alias("bundle"), F.posexplode("b.entry").alias("at", "e"))
    wanted = entries.where((F.get_json_object("e.resource", "$.resourceType") == "Observation") & (F.col("e.request.method") == "POST"))
    posted = wanted.select((F.col("bundle") * ENTRIES + F.col("at")).alias("seq"), F.col("e.resource").alias("body"))
    records, rejected = observations(posted)
    counts = posted.join(rejected.select("seq", F.lit(1).alias("bad")), "seq", "left").groupBy(F.shiftright("seq", 26).alias("seq"))
    counts = counts.agg(F.count(F.when(F.col("bad").isNull(), 1)).alias("processed"), F.count("bad").alias("errors"))
    summary = bodies.select("seq").join(counts, "seq", "left").na.fill(0, ["processed", "errors"])
    return records, rejected, summary.withColumn("status", F.when(F.col("errors") > 0, "partial").otherwise("success"))


def _vital() -> Column:
    names = F.create_map(*[F.lit(x) for pair in VITALS.items() for x in pair])
    told = F.try_element_at("context", F.lit("vital_type"))
    return F.when(F.col("code").isin(SYSTOLIC, DIASTOLIC), "BloodPressure").otherwise(F.coalesce(F.try_element_at(names, "code"), F.when(told.isin(*VITALS.values()), told)))


def unconvertible(records: DataFrame) -> DataFrame:
    """Records that ``to_resources`` leaves out, with ``error``: keys of fewer than three parts, unknown vital signs."""
    rows = records.withColumns(key_parts())
    told = F.try_element_at("context", F.lit("vital_type"))
    unknown = F.when(told.isNotNull(), F.concat(F.lit("Unknown vital type: "), told)).otherwise(F.concat(F.lit("Unknown vital code: "), F.col("code")))
    error = F.when(F.size(F.split("metric_name", "[|]")) < 3, F.concat(F.lit("Invalid metric name format: "), F.col("metric_name")))
    error = F.coalesce(error, F.when((F.col("resource_type") == "VitalSigns") & _vital().isNull(), unknown))
    return rows.withColumn("error", error).where("error is not null").select(*records.columns, "error")


def to_resources(records: DataFrame) -> DataFrame:
    """Records as resources: ``resource_type, subject_id, code, timestamp, body`` (JSON).

    Components of one panel and time make one Observation, samples of one time
    one waveform, and a pressure is rebuilt from the systolic row's context.
    What cannot be converted is left out; ``unconvertible`` lists it. Samples go by ``ingest_seq``
    and, where the records have it, ``place``.
    """
    parts = key_parts()
    order = [c for c in ("ingest_seq", "place") if c in records.columns]
    rows = records.where(F.size(F.split("metric_name", "[|]")) >= 3).withColumns(parts)
    at = lambda k, otherwise: F.coalesce(F.try_element_at("context", F.lit(k)), F.lit(otherwise))
    quantity = F.struct("value", "unit")
    observed = rows.where("resource_type = 'Observation'")
    panel = observed.where("component is not null").groupBy("resource_type", "subject_id", "code", "timestamp")
    panel = panel.agg(F.to_json(F.struct(F.sort_array(F.collect_list(F.struct("component", quantity.alias("quantity")))).alias("component"))).alias("body"))
    wave = observed.where("component is null and unit = 'sampled'").withColumn("factor", at("factor", "1").cast("double"))
    sample = F.struct(*order, (F.col("value") / F.col("factor")).alias("v"))
    wave = wave.groupBy("resource_type", "subject_id", "code", "timestamp").agg(F.sort_array(F.collect_list(sample)).alias("s"), F.max("factor").alias("factor"), F.max(at("period_ms", "1000")).alias("period"))
    data = F.array_join(F.transform("s", lambda x: number_text(x["v"])), " ")
    wave = wave.select("resource_type", "subject_id", "code", "timestamp", F.to_json(F.struct(F.struct(F.col("period").cast("double").alias("period"), "factor", data.alias("data")).alias("valueSampledData"))).alias("body"))
    others = rows.where("resource_type != 'Observation' or component is null and unit != 'sampled'")
    vital = _vital()
    other_value = F.coalesce(at("bp_diastolic", "0"), F.lit("0")).cast("double")
    body = (
        F.when(F.col("resource_type") == "MedicationAdministration", F.to_json(F.struct(at("medication_display", "Unknown Medication").alias("display"), at("route", "unspecified").alias("route"), at("status", "completed").alias("status"), quantity.alias("dosage"))))
        .when(F.col("resource_type") == "DeviceObservation", F.to_json(F.struct(at("device_type", "unknown").alias("deviceType"), at("metric_type", "measurement").alias("metricType"), at("status", "final").alias("status"), quantity.alias("valueQuantity"))))
        .when(F.col("resource_type") == "VitalSigns", F.to_json(F.struct(vital.alias("vitalType"), quantity.alias("valueQuantity"), F.when(F.col("code") == SYSTOLIC, other_value).alias("diastolic"))))
        .otherwise(F.to_json(F.struct(quantity.alias("valueQuantity"))))
    )
    others = others.where((F.col("resource_type") != "VitalSigns") | vital.isNotNull()).select("resource_type", "subject_id", "code", "timestamp", body.alias("body"))
    return panel.unionByName(wave).unionByName(others)
