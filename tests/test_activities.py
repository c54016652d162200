import json
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tessera.operators import activities as A


def test_rows_and_streams(spark, one):
    doc = {"id": 5, "name": "Ride", "type": "Ride", "average_heartrate": 140.5, "total_elevation_gain": 300, "external_id": "garmin_ping_77", "trainer": True}
    rows = A.activity_rows(spark.createDataFrame([(json.dumps(doc),), ("{bad",)], "payload string")).collect()
    assert [(r.activity_id, r.sport_type, r.avg_hr, r.elevation_gain, r.device_activity_id, r.trainer) for r in rows] == [(5, "Ride", 140.5, 300.0, "77", True)]
    streams = {"watts": [200.0] * 4, "heartrate": [100.0, 100.0, 125.0, 125.0]}
    s = A.stream_samples(spark.createDataFrame([(1, json.dumps(streams))], "k int, j string"), "k", "j", ["watts", "heartrate"])
    assert s.count() == 4
    assert A.decoupling(s, ["k"], "t", "watts", "heartrate").first().decoupling == pytest.approx(-0.2)
    assert one(A.external_id(F.lit("other_1"), "garmin_ping_")) is None
    assert one(A.from_device(F.lit("ACME Watch 5"), ["acme"])) is True


def test_daily_rules(one):
    assert one(A.recharge_efficiency(F.lit(40.0), F.lit(480.0))) == 5.0
    assert one(A.recharge_efficiency(F.lit(40.0), F.lit(0.0))) is None
    assert one(A.recovery_source(F.lit(None).cast("double"), F.lit(1.0), True)) == "proxy"
    assert one(*A.soil_bands([F.lit(float(x)) for x in (7, 7, 7, 7, 7)])) == (7.0, 7.0)


def test_descriptors(spark):
    days = [("r", date(2020, 1, 1) + timedelta(i), 2.0, -1.0 if i < 10 else 10.0, 50.0) for i in range(731)]
    d = A.climate_descriptors(spark.createDataFrame(days, "region string, date date, precipitation double, temperature double, lat double"), "region", "lat").first()
    assert d.mean_annual_precip == pytest.approx(731.0) and d.frost_days_per_year == 10.0
    assert 0 <= d.precip_seasonality < 0.1 and 0.3 < d.aridity_index < 3
