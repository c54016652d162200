import sys
from datetime import date, timedelta
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
import __spark_entry__ as entry
from tessera.operators import rules as R
from tessera.operators import wellness as H
from tools.compare import rows_of

D0 = date(2024, 1, 1)


def days(spark, **columns):
    names = list(columns)
    rows = [("a", D0 + timedelta(i), *map(float, v)) for i, v in enumerate(zip(*columns.values(), strict=True))]
    return spark.createDataFrame(rows, "k string, day date, " + ", ".join(f"{n} double" for n in names))


ids = lambda df: sorted(r.id for r in df.collect())


def test_directions(one):
    d = lambda m, x, b=None: one(R.direction(F.lit(m), F.lit(x).cast("double"), F.lit(b).cast("double")))
    assert [d("rhr_bpm", -2), d("rhr_bpm", 2), d("rhr_bpm", 0.5), d("rem_minutes", 11), d("steps", 300, 2000), d("steps", 300, 500), d("steps", None)] == ["positive", "negative", "neutral", "positive", "positive", "neutral", None]


@pytest.mark.parametrize("metric, size, delta, level, bump, out", [
    ("rhr_bpm", "significant", 5.0, "moderate", 2.5, None), ("rhr_bpm", "strong", 9.0, "moderate", 2.5, "strong"), ("hrv_rmssd_ms", "mild", -3.0, "mild", 1.5, None),
    ("body_battery_high", "mild", -9.0, "high", 4.0, None), ("sleep_minutes", "mild", -30.0, "high", 4.0, "mild"), ("rhr_bpm", "mild", 3.0, "none", 0.0, "mild"),
])
def test_explained_by_training(one, metric, size, delta, level, bump, out):
    assert one(R.explained_magnitude(F.lit(metric), F.lit(size), F.lit(delta), F.lit(level), F.lit(bump))) == out


def test_confidence_and_masks(one):
    c = lambda m, today, base=60.0, odd=False: one(R.metric_confidence(F.lit(m), F.lit(today).cast("double"), F.lit(base).cast("double"), F.lit("mild"), F.lit(odd)))
    assert [c("rhr_bpm", None), c("rhr_bpm", 25), c("rhr_bpm", 60), c("sleep_minutes", 100, 420, True), c("rem_minutes", 0, 90), c("hrv_proxy_nocturnal", 5)] == ["low", "low", "high", "low", "low", "medium"]
    assert one(R.mask_unable(F.lit("hrv"), F.lit(1.0), {"hrv": False})) is None
    assert one(R.mask_partial(F.lit("steps"), F.lit(1.0), F.lit(False))) is None
    assert one(R.mask_partial(F.lit("rhr_bpm"), F.lit(1.0), F.lit(False))) == 1.0


def test_clearance(one):
    base = {"state": "green", "illness": False, "fatigue": "none", "since_hard": 5, "recovery": "high", "cognitive": "mid", "load_ratio": 1.0, "hard_days": 0}
    plan = lambda **k: one(R.clearance({a: F.lit(b) for a, b in (base | k).items()}, 170))
    assert (plan()["floor"], plan()["hours"], plan()["cap"]) == ("hard_ok", "2-3", 155)
    assert plan(hard_days=2)["session"] == "tempo" and plan(load_ratio=1.4)["floor"] == "normal"
    assert plan(state="yellow") is None and plan(since_hard=2) is None and plan(recovery="low") is None


@pytest.mark.parametrize("tss, effort, minutes, hard", [(80.0, 0.0, 0.0, False), (105.0, 0.0, 0.0, True), (105.0, 73.0, 0.0, False), (0.0, 110.0, 0.0, True), (0.0, 0.0, 60.0, True)])
def test_hard_day(one, tss, effort, minutes, hard):
    assert one(R.is_hard_day(F.lit(tss), F.lit(effort), F.lit(minutes))) is hard


def test_focus_and_scoring(one):
    assert one(R.argmax_with_ties({"flood": F.lit(2), "fire": F.lit(2), "drought": F.lit(0)})) == "flood"
    now = F.lit("2026-08-01").cast("timestamp")
    ago = lambda n: now - F.expr(f"interval {n} days")
    due = lambda posted: one(R.needs_scoring(F.lit(None).cast("timestamp"), now, [F.lit(1)], ago(posted), now, now, 30))
    assert (due(10), due(200)) == (True, False)
    assert one(R.needs_scoring(now, ago(1), [F.lit(1)], now, now, now, 30)) is False
    assert one(R.worth_narrating(F.lit(2), F.lit(1))) is True and one(R.worth_narrating(F.lit(1), F.lit(0))) is False


def test_verdicts(spark):
    jobs = spark.createDataFrame([(1, "Acme  Corp"), (2, "Bad"), (3, "New")], "id int, employer string")
    verdicts = spark.createDataFrame([("acme corp", True), ("bad", False)], "employer string, accepted boolean")
    passed, pending = R.cached_verdicts(jobs, verdicts)
    assert [r.id for r in passed.collect()] == [1] and [r.employer for r in pending.collect()] == ["new"]
    assert {r.approved for r in R.approve(spark.createDataFrame([("x",)], "s string"), "s", 1).collect()} == {False}


def test_detectors(spark):
    assert ids(R.detect_rising_stress(days(spark, v=[30.0] * 25 + [40, 45, 50, 55, 60]), ["k"], "day", "v")) == ["stress_trend_rising"]
    assert ids(R.detect_rising_stress(days(spark, v=[30.0] * 30), ["k"], "day", "v")) == []
    assert ids(R.detect_stress_timing(days(spark, morning=[20] * 7, work=[40] * 7, evening=[25] * 7), ["k"], "day")) == ["stress_timing_pattern"]
    assert ids(R.detect_stress_timing(days(spark, morning=[39] * 7, work=[40] * 7, evening=[38] * 7), ["k"], "day")) == []
    assert ids(R.detect_poor_recovery(days(spark, rest=[40.0] * 20 + [20.0] * 10), ["k"], "day", "rest")) == ["stress_poor_daytime_recovery"]
    flags = spark.createDataFrame([("a", 80.0, "positive", "mild", None, None, None, None, None), ("b", None, "neutral", None, None, "positive", True, None, None), ("c", None, None, None, None, None, None, None, None)], "k string, proxy_pct double, rem_direction string, rem_magnitude string, rem_max boolean, rhr_direction string, rhr_min boolean, recovery_band string, recovery_direction string")
    assert {r.k: r.salience for r in R.detect_positive(flags, ["k"]).collect()} == {"a": 68.0, "b": 58.0}
    stress = spark.createDataFrame([("a", 40.0, 8.0, "noise", True), ("b", 40.0, 8.0, "mild", False), ("c", 40.0, 1.0, "noise", False)], "k string, avg double, vs_baseline double, magnitude string, peak_by_exercise boolean")
    assert ids(R.detect_work_stress(stress, ["k"])) == ["yesterday_exercise_stress", "yesterday_work_stress"]
    x = spark.createDataFrame([("a", float(i), float(i % 10) + i) for i in range(40)], "k string, x double, y double")
    assert ids(H.detect_link(x, ["k"], "x", "y", "link", 1)) == ["link"] and ids(H.detect_link(x, ["k"], "x", "y", "link", -1)) == []
    f = H.detect_link(x, ["k"], "x", "y", "link", 1).unionByName(H.detect_link(x, ["k"], "x", "y", "other", 1))
    assert len(H.rank_findings(f, ["k"], most=1).collect()) == 1
    assert [r.reason for r in H.diagnostics(x, ["k"], "x", "y", "d").collect()] == ["passed"]


def test_week_and_night(spark):
    acts = spark.createDataFrame([("a", D0 + timedelta(i), 60.0, 110.0 if i == 5 else 30.0, 0.0, "run", f"s{i}") for i in (1, 3, 4, 5)], "k string, day date, minutes double, tss double, effort double, sport string, name string")
    w = R.training_week(acts, ["k"], "day", F.lit(D0 + timedelta(6))).first()
    assert (w.total_minutes, w.hard_days, w.days_since_hard, w.days_since_rest, w.hardest, w.sport_mix) == (240.0, 1, 1, 3, "s5", {"run": 240.0})
    hr = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate([60, 58, 50, 48, 47, 52])], "k string, t int, hr double")
    assert R.nocturnal_index(hr, ["k"], "t", "hr").first().nocturnal_index == pytest.approx(-23.5 + 26)


def test_career_links(spark):
    html = '<a href="/careers/">Jobs</a> <a href="https://jobs.lever.co/acme">x</a> <a href="mailto:a@b.c">m</a> <a href="https://other.example/x">o</a><a href="#t">t</a>'
    p = spark.createDataFrame([(1, "https://www.acme.org/home", html)], "page_id long, url string, html string")
    assert [(r.link, r.score) for r in R.career_links(p).orderBy(F.desc("score")).collect()] == [("https://jobs.lever.co/acme", 100 + 40), ("https://www.acme.org/careers", 50)]


def test_direction_of_a_slope_of_half_a_point(spark):
    """The last seven rise by exactly 0.5 a row, but for the last digit of the computed slope."""
    v = [60.89, 104.04, 195.28, 40.92, 186.64, 63.04, 20.42, 97.12, 147.4, 270.09, 303.38, 93.37, 7.22, 146.57, 30.39, 34.18, 48.51, 140.76, 9.72]
    last = H.trajectory(days(spark, v=v), ["k"], "day", "v").orderBy(F.desc("day")).first()
    assert last.slope_7d == pytest.approx(0.5) and last.slope_7d != 0.5
    assert last.direction == "steady"


def test_stress_means_at_a_tie(spark):
    """Means of 30.85 and 48.95 but for the last digit of their sums, which depends on the order; rows dealt in three ways."""
    at = "timestamp'2024-01-01 09:00:00' + make_interval(0, 0, 0, 0, 0, cast(n as int))"
    for v, mean in [([18.45, 2.4, 28.94, 89.72, 28.52, 17.07], 30.9), ([11.19, 76.49, 99.18, 25.18, 51.42, 30.24], 49.0), ([30.24, 51.42, 25.18, 99.18, 76.49, 11.19], 48.9)]:
        rows = spark.createDataFrame([("a", i, x) for i, x in enumerate(v)], "k string, n int, v double").withColumn("ts", F.expr(at))
        for dealt in (rows, rows.orderBy(F.desc("n")), rows.repartition(5, "v")):
            r = H.stress_day(dealt, ["k"], "ts", "v", {"work": (9, 17), "night": (22, 6)}).first()
            assert (r.work, r.night, r.peak_window, r.peak_value) == (mean, None, "09:00–12:00", round(sum(v) / 6))


def test_training_week_of_days_without_stress(spark, tmp_path):
    """Events of no value and great effort: the query says what its SQL says, the operator's rule stays the default."""
    rows = [(109, 1, "2024-01-28 10:00:00", 0.0), (239, 1, "2024-01-29 10:00:00", 90.0), (105, 2, "2024-01-30 10:00:00", 0.0), (106, 2, "2024-01-30 11:00:00", 0.5), (110, 3, "2024-01-27 11:00:00", 0.0)]
    e = spark.createDataFrame([(*r, "run") for r in rows], "event_id long, user_id long, ts string, value double, event_type string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    e.write.parquet(str(tmp_path / "events.parquet"))
    df = entry.queries()["training_week"](spark, str(tmp_path))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    cur = db.execute(entry.oracle_sql()["training_week"])
    assert rows_of(df.columns, df.collect()) == rows_of([c[0] for c in cur.description], cur.fetchall())
    assert {r.user_id: r.hard_days for r in df.collect()} == {1: 1, 2: 0, 3: 0}
    acts = e.select("user_id", F.to_date("ts").alias("day"), F.col("value").alias("minutes"), (F.col("value") * 1.2).alias("tss"), (F.col("event_id") % 130).cast("double").alias("effort"), F.lit("run").alias("sport"), F.lit("n").alias("name"))
    assert {r.user_id: r.hard_days for r in R.training_week(acts, ["user_id"], "day", F.lit("2024-01-30").cast("date")).collect()} == {1: 2, 2: 0, 3: 1}
