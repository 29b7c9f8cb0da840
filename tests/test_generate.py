"""The load test's series."""

from pulsegrid.operators import analytics
from pulsegrid.sources import generate


def test_vital_signs(spark):
    rows = generate.vital_signs(spark, 2000)
    assert rows.count() == 10000 and rows.select("ingest_seq").distinct().count() == 10000
    assert sorted(map(str, rows.collect())) == sorted(map(str, generate.vital_signs(spark, 2000).repartition(5).collect()))
    by = {r.metric_name.split("|", 1)[1]: r for r in analytics.trend(rows).collect()}
    assert by["8867-4|beats/minute"].slope > 0 and by["59408-5|%"].min == 88 and by["11524-6|sampled"].max == 1.5
    found = analytics.outliers(rows.where("metric_name like '%59408-5%'"), 3.0).collect()
    assert len(found) == 20 and {r.value for r in found} == {88}
