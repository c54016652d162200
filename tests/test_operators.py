import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tessera.operators import dedupe as D
from tessera.operators import joins as J
from tessera.operators import labels as L
from tessera.operators import placement as P
from tessera.operators import places as PL
from tessera.operators import spatial as SP
from tessera.operators import stats as S
from tessera.operators import wellness as H
from tessera.operators import windows as W

D0 = date(2024, 1, 1)


def days(spark, values, name="v"):
    return spark.createDataFrame([("a", D0 + timedelta(i), v) for i, v in enumerate(values)], f"k string, day date, {name} double")


@pytest.mark.parametrize("n, chunks", [(2, 1), (4, 1), (5, 2), (7, 2), (8, 3), (22, 6)])
def test_chunks(spark, n, chunks):
    """22 days aim at 7 chunks, of ceil(22 / 7) = 4 days each: 6 are filled."""
    d = days(spark, [1.0] * n).withColumn("c", W.balanced_chunk(["k"], "day"))
    sizes = [r["count"] for r in d.groupBy("c").count().collect()]
    assert len(sizes) == chunks and (n < 5 or max(sizes) <= 4)


def test_streaks_and_fill(spark):
    d = W.streak(days(spark, [1.0, 5.0, 6.0, None, 7.0]), F.col("v") > 4, ["k"], "day", "s")
    assert [r.s for r in d.orderBy("day").collect()] == [0, 1, 2, 0, 1]
    f = days(spark, [1.0, None, None, None]).withColumn("f", W.forward_fill(F.col("v"), ["k"], "day", 2))
    assert [r.f for r in f.orderBy("day").collect()] == [1.0, 1.0, 1.0, None]


def test_ewma_scan_equals_the_fold(spark):
    """One key with all rows runs in many tasks, and gives what the fold over its array gives."""
    rng = random.Random(6)
    rows = [(1, i, rng.uniform(-5, 50) if i % 17 else None) for i in range(5000)] + [(2, 3, 7.0), (3, 1, None), (None, 1, 4.0), (None, 2, 8.0)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k long, t long, v double").repartition(6)
    want = {}
    for k, _, v in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1])):
        if v is not None:
            want[k] = v if k not in want else want[k] + 2 / 8 * (v - want[k])
    for n in (1, 3, 16):
        got = {r.k: r.ewma for r in W.ewma_scan(df, ["k"], "t", "v", 7, n).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    spread = df.filter("k = 1").repartitionByRange(16, "k", "t").select(F.spark_partition_id().alias("p")).distinct().count()
    assert spread >= 12


def test_ewma(spark):
    d = W.ewma(days(spark, [10.0, 20.0, 30.0]), ["k"], "day", "v", 7)
    a = 2 / 8
    assert d.first().ewma == pytest.approx((10 + a * 10) + a * (30 - (10 + a * 10)))


def test_year_shift_clamps(spark):
    d = spark.createDataFrame([(date(2024, 2, 29), 2024)], "day date, y int")
    assert sorted(r.day for r in W.year_shifts(d, "day", "y", 2).collect()) == [date(2022, 2, 28), date(2023, 2, 28)]


def test_upsert_changed(spark):
    t = spark.createDataFrame([("a", "h1", "x", 0.5, 1, 1), ("b", "h2", "y", 0.7, 1, 1)], "k string, h string, body string, score double, last_seen int, last_changed int")
    s = spark.createDataFrame([("a", "h1", "x", 2), ("b", "h9", "z", 2), ("c", "h3", "w", 2)], "k string, h string, body string, last_seen int")
    out = {r.k: r for r in D.upsert_changed(t, s, ["k"], "h", ["body"], ["score"]).collect()}
    assert (out["a"].score, out["a"].changed_now, out["a"].last_seen, out["a"].last_changed) == (0.5, False, 2, 1)
    assert (out["b"].score, out["b"].changed_now, out["b"].body) == (None, True, "z")
    assert out["c"].changed_now and out["c"].last_changed == 2


def test_small_upserts(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    s = spark.createDataFrame([(2, "B"), (3, "C")], "k int, v string")
    pairs = lambda df: sorted(map(tuple, df.collect()))
    assert pairs(D.upsert(t, s, ["k"])) == [(1, "a"), (2, "B"), (3, "C")]
    assert pairs(D.upsert(D.upsert(t, s, ["k"]), s, ["k"])) == [(1, "a"), (2, "B"), (3, "C")]
    assert pairs(D.update_only(t, s, ["k"], ["v"])) == [(1, "a"), (2, "B")]
    assert pairs(D.insert_new(t, s, ["k"])) == [(1, "a"), (2, "b"), (3, "C")]
    assert pairs(D.delete_keys(t, s, ["k"])) == [(2, "b")]


def test_box_and_nearest(spark):
    p = spark.createDataFrame([(1, 0.5, 0.5), (2, 1.0, 0.5), (3, 9.0, 9.0)], "id int, x double, y double")
    b = spark.createDataFrame([("A", 0.0, 0.0, 1.0, 1.0)], "box string, x0 double, y0 double, x1 double, y1 double")
    assert {r.id: r.box for r in SP.first_box(p, b, "id", "x", "y", ("x0", "y0", "x1", "y1"), "box").collect()} == {1: "A", 2: None, 3: None}
    s = spark.createDataFrame([("A", 0.0, 0.0), ("B", 10.0, 10.0)], "site string, sx double, sy double")
    assert [r.nearest for r in SP.nearest_site(p, s, "x", "y", "site", "sx", "sy").orderBy("id").collect()] == ["A", "A", "B"]


def test_events_and_as_of(spark):
    d = days(spark, [0.0] * 20).withColumnRenamed("k", "region")
    e = spark.createDataFrame([("a", D0 + timedelta(3))], "region string, e date")
    out = [r._d for r in J.event_within(d, e, ["region"], "day", "e", 2, "_d").orderBy("day").collect()]
    assert out[:7] == [None, 2, 1, 0, 1, 2, None]
    h = spark.createDataFrame([("a", D0, 5.0)], "region string, day date, p double")
    assert {r.seed for r in J.as_of(d.drop("v"), h, ["region"], "day", "p", "seed").collect()} == {5.0}


def test_fire_labels(spark):
    d = spark.createDataFrame([("a", D0 + timedelta(i), 1.0 if i == 6 else 0.0) for i in range(14)], "region string, date date, hotspots double")
    assert [r.f for r in d.withColumn("f", L.fire_label(F.col("hotspots"))).orderBy("date").collect()] == [0, 1, 1, 2, 2, 2, 3, 2, 2, 2, 1, 1, 0, 0]


@pytest.mark.parametrize("spi, ndvi, soil, label", [(-1.5, True, False, 3), (-1.0, False, True, 2), (0.0, True, True, 2), (-0.8, True, False, 1), (-1.0, True, False, 1), (-0.8, False, False, 0), (None, True, None, 0)])
def test_drought(one, spi, ndvi, soil, label):
    assert one(L.drought_label(F.lit(spi).cast("double"), F.lit(ndvi), F.lit(soil).cast("boolean"))) == label


def test_sleep_debt(spark):
    def debt(nights, norm=420.0):
        d = days(spark, [float(x) for x in nights], "sleep_minutes")
        return H.sleep_debt(d, ["k"], F.lit(D0 + timedelta(len(nights) - 1)), F.lit(norm), "day").first()

    a = debt([420] * 6 + [480])
    assert (a.balance, a.surfaced) == (60, False)
    b = debt([250] * 7)
    assert (b.status, b.surfaced) == ("notable_deficit", True)
    c = debt([435, 492, 477, 420, 417, 468, 219], 452.0)
    assert (c.last_night, c.surfaced) == (-233, True)


def test_power_and_drift(spark):
    s = spark.createDataFrame([("a", i, 200.0 if i < 100 else 250.0) for i in range(200)], "k string, t int, watts double")
    assert 200 < H.normalized_power(s, ["k"]).first().normalized_power < 250
    hr = spark.createDataFrame([("a", i, 130.0 if i < 60 else 145.0) for i in range(120)], "k string, t int, hr double")
    assert H.half_drift(hr, ["k"], "t", "hr").first().drift == pytest.approx(15 / 130)


def test_states(one):
    base = {"strong": F.lit(0), "significant": F.lit(0), "mild": F.lit(0), "illness": F.lit(False), "load_ratio": F.lit(1.0), "ctl": F.lit(40.0), "patterns": F.array().cast("array<string>"), "hrv": F.lit(None).cast("string"), "fatigue": F.lit("none"), "short_sleep": F.lit(False), "since_rest": F.lit(0)}
    state = lambda **k: one(H.health_state(base | {a: F.lit(b) for a, b in k.items()}))
    assert state() == "green"
    assert state(strong=1) == "red"
    assert state(strong=1, fatigue="high") == "yellow"
    assert state(load_ratio=1.35) == "red"
    assert state(since_rest=7) == "yellow"
    assert one(H.illness_watch(F.lit(2.1), F.lit(-1.0), F.lit(1.2), F.lit(0.0), F.lit("none"))) == "elevated"
    assert one(H.illness_watch(F.lit(2.1), F.lit(-1.0), F.lit(1.2), F.lit(0.0), F.lit("high"))) is None


def test_regions_of_postings(one):
    fit = lambda place, text="": one(P.region_fit(P.constraints(F.lit("Engineer"), F.lit(place), F.lit(text)), ["EU"]))
    assert fit("United States (Remote)") is False
    assert fit("Remote (EU)") is True
    assert fit("", "You must be authorized to work in the United States.") is False
    assert fit("") is True


def test_imputation_and_correlations(spark):
    d = spark.createDataFrame([("a", 1.0, 1.0), ("a", 3.0, 2.0), ("a", None, 9.0)], "k string, x double, y double")
    assert sorted(r.x for r in S.median_impute(d, ["k"], ["x"]).collect()) == [1.0, 2.0, 3.0]
    e = spark.createDataFrame([(float(i), float(2 * i), float(i % 3)) for i in range(30)], "a double, b double, c double")
    assert S.correlated_to_drop(e, ["a", "b", "c"]) == ["b"]


def test_places(spark, one):
    assert one(PL.plain_name(F.lit("Córdoba_Department"))) == "cordoba"
    assert one(PL.parent_of(F.lit("North_Coast_sub_12"))) == "North_Coast"
    assert one(PL.without_complete(F.lit("Bhutan_Complete"))) == "Bhutan"
    r = spark.createDataFrame([("A", 0.0, 0.0, 4.0, 2.0, 40000.0, 2.0, 1.0)], "region string, lon_min double, lat_min double, lon_max double, lat_max double, area double, centroid_lon double, centroid_lat double")
    assert PL.split_area(r, "area", 12000.0, 8000.0).count() == 4
    assert PL.region_issues(r).first().issues == []
    assert one(PL.sparkline(F.array(F.lit(1.0), F.lit(None).cast("double"), F.lit(3.0)), 10.0, 4.0)) == "0.0,4.0 10.0,0.0"
    cells = spark.createDataFrame([(1.0, 1.0, D0, 5.0), (50.0, 50.0, D0, 9.0)], "lon double, lat double, date date, q double")
    far = spark.createDataFrame([("A", 0.0, 0.0, 4.0, 2.0, 2.0, 1.0), ("B", 60.0, 60.0, 61.0, 61.0, 60.5, 60.5)], "region string, lon_min double, lat_min double, lon_max double, lat_max double, centroid_lon double, centroid_lat double")
    assert {x.region: x.q for x in PL.grid_means(cells, far, "q").collect()} == {"A": 5.0, "B": 9.0}


def test_boxes_of_every_size_lie_in_few_cells(spark):
    rng = random.Random(9)
    sides = [0.0, 0.01, 0.3, 1.0, 2.0, 17.0, 180.0]
    boxes = [(i, x, y, x + rng.choice(sides), y + rng.choice(sides)) for i in range(300) for x, y in [(rng.choice([-180.0, rng.uniform(-180, 180)]), rng.uniform(-90, 90))]]
    boxes += [(900, 5.0, 5.0, 4.0, 6.0), (901, None, 0.0, 1.0, 1.0)]
    points = [(i, rng.uniform(-180, 180), rng.uniform(-90, 90)) for i in range(200)] + [(500 + b[0], b[1], b[2]) for b in boxes[:40]] + [(999, None, 1.0)]
    p, b = spark.createDataFrame(points, "p long, x double, y double"), spark.createDataFrame(boxes, "b long, x0 double, y0 double, x1 double, y1 double")
    bounds = ("x0", "y0", "x1", "y1")
    for strict in (True, False):
        inside = lambda v, lo, hi: lo < v < hi if strict else lo <= v <= hi  # noqa: E731, B023
        want = {(i, k) for i, x, y in points if x is not None for k, *c in boxes if c[0] is not None and inside(x, c[0], c[2]) and inside(y, c[1], c[3])}
        got = [(r.p, r.b) for r in SP.box_join(p, b, "x", "y", bounds, strict).select("p", "b").collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert SP.box_cells(b, bounds).groupBy("b").count().agg(F.max("count")).first()[0] <= 4


def test_points_of_a_crowded_cell_go_to_many_tasks(spark):
    """600 boxes and 200 points in one cell, joined without a broadcast: every pair, from more than one task."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        p = spark.range(200).select(F.col("id").alias("p"), (F.col("id") / 2).alias("x"), F.lit(60.0).alias("y"))
        b = spark.range(600).select(F.col("id").alias("b"), F.lit(1.0).alias("x0"), F.lit(1.0).alias("y0"), F.lit(91.0).alias("x1"), (F.col("id") % 30 + 40.0).alias("y1"))
        got = SP.box_join(p, b, "x", "y", ("x0", "y0", "x1", "y1"), False).select("p", "b", F.spark_partition_id().alias("task")).collect()
        want = {(i, k) for i in range(200) for k in range(600) if 1 <= i / 2 <= 91 and 60 <= k % 30 + 40}
        assert len(got) == len(want) and {(r.p, r.b) for r in got} == want
        assert len({r.task for r in got}) > 1
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("leaf", [1, 32])
def test_nearest_site_equals_brute_force(spark, monkeypatch, leaf):
    """Even and clustered sites, far points, ties, points on sites, one place with many sites, odd coordinates."""
    monkeypatch.setattr(SP, "LEAF_SITES", leaf)
    rng = random.Random(leaf)
    spots = [(rng.uniform(-180, 180), rng.uniform(-90, 90)) for _ in range(300)] + [(50 + rng.gauss(0, 1e-4), 20 + rng.gauss(0, 1e-4)) for _ in range(600)] + [(float(a), float(b)) for a in range(8) for b in range(8)] + [(3.0, 3.0)] * 40
    sites = [(f"s{i:04d}", x, y) for i, (x, y) in enumerate(spots)] + [("nan", float("nan"), 0.0), (None, 1.0, 1.0), ("null", None, 1.0)]
    points = [(i, rng.uniform(-300, 300), rng.uniform(-200, 200)) for i in range(150)] + [(200 + i, 3.5, float(i % 9) + 0.5) for i in range(20)] + [(300 + i, *spots[i]) for i in range(0, 900, 45)] + [(9999, None, 1.0), (9998, float("nan"), 1.0)]
    p, s = spark.createDataFrame(points, "p long, x double, y double"), spark.createDataFrame(sites, "site string, sx double, sy double")
    got = {r.p: (r.distance2, r.nearest) for r in SP.nearest_site(p, s, "x", "y", "site", "sx", "sy").collect()}
    known = [(k, x, y) for k, x, y in sites if k not in (None, "nan", "null")]
    want = {i: min(((x - a) * (x - a) + (y - b) * (y - b), k) for k, a, b in known) if x == x and x is not None else (None, None) for i, x, y in points}
    assert got == want
    none = SP.nearest_site(p, s.limit(0), "x", "y", "site", "sx", "sy")
    assert {r.nearest for r in none.collect()} == {None} and none.count() == len(points)


def test_a_million_sites(spark):
    """A sample of points against all sites, half of them in one place's neighbourhood."""
    i = F.col("id")
    spread = lambda c, m: F.pmod(F.xxhash64(i, F.lit(c)), F.lit(m)) / m
    near = i % 2 == 0
    s = spark.range(1_000_000).select(i.alias("site"), F.when(near, 10 + spread(1, 10_007) / 100).otherwise(spread(2, 1_000_003) * 360).alias("sx"), F.when(near, 5 + spread(3, 10_009) / 100).otherwise(spread(4, 1_000_033) * 180).alias("sy"))
    p = spark.range(40).select(i.alias("p"), (spread(5, 997) * 360).alias("x"), (spread(6, 991) * 180).alias("y")).unionByName(spark.range(10).select((i + 100).alias("p"), F.lit(10.005).alias("x"), (5 + i / 500).alias("y")))
    got = {r.p: r.nearest for r in SP.nearest_site(p, s, "x", "y", "site", "sx", "sy").collect()}
    d = (F.col("x") - F.col("sx")) * (F.col("x") - F.col("sx")) + (F.col("y") - F.col("sy")) * (F.col("y") - F.col("sy"))
    want = {r.p: r.b.site for r in s.join(F.broadcast(p)).groupBy("p").agg(F.min(F.struct(d.alias("d"), "site")).alias("b")).collect()}
    assert got == want and len(got) == 50
