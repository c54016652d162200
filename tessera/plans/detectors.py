"""Detectors, gates and kernels over events: users as people, events as samples, days as days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import kernels as K
from tessera.functions import text as T
from tessera.operators import activities as A
from tessera.operators import labels as L
from tessera.operators import placement as P
from tessera.operators import rules as R
from tessera.operators import stats
from tessera.operators import wellness as H
from tessera.streaming import jobs as S

from .registry import query, table
from .risk import RD_SQL, region_days
from .streams import _events, _through
from .timeseries import UD_SQL, user_days
from .wellness import _BASE, deltas

LAST = f"{UD_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day DESC) AS rn FROM ud)"


def numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "user_id", "value", "ts")


class _Id:
    """event_id as a column, made when it is used: there may be no session yet when this is imported."""

    def __mod__(self, n: int) -> Column:
        return F.col("event_id") % n

    def cast(self, kind: str) -> Column:
        return F.col("event_id").cast(kind)

    def alias(self, name: str) -> Column:
        return F.col("event_id").alias(name)


ID = _Id()


def mod(n: int, scale: float = 1.0, shift: float = 0.0) -> Column:
    return (ID % n).cast("double") * scale + shift


# --- findings ----------------------------------------------------------------------------------------


@query(f"""WITH {_BASE} SELECT user_id, day, 'severe_short_sleep' AS id, 88.0::DOUBLE AS salience FROM d WHERE dv * 2 <= -90 AND user_id % 5 <> 0""")
def finding_short_sleep(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = deltas(spark, sf_dir).select("user_id", "day", F.lit("sleep_minutes").alias("metric"), (F.col("dv") * 2).alias("delta"), F.when(F.col("user_id") % 5 == 0, "low").when(F.col("user_id") % 5 == 1, "high").alias("confidence"))
    return H.detect_short_sleep(d, ["user_id", "day"]).drop("supporting")


@query(f"""WITH {UD_SQL}, x AS (SELECT user_id, day, CAST(round(v - 110) AS BIGINT) AS d, row_number() OVER (PARTITION BY user_id ORDER BY day) AS i FROM ud WHERE v > 0 AND day >= DATE '2024-01-24' AND day <= DATE '2024-01-30'),
s AS (SELECT user_id, sum(d) AS b, count(*) AS k, sum(d * list_extract([0.06, 0.09, 0.12, 0.15, 0.18, 0.20, 0.20]::DOUBLE[], i)) AS w, coalesce(max(CASE WHEN day = DATE '2024-01-30' THEN d END), 0) AS l FROM x GROUP BY 1),
j AS (SELECT *, CASE WHEN k = 7 THEN round(w) ELSE b END AS q FROM s) SELECT user_id, 'sleep_debt' AS id, CAST(least(100, 50 + abs(b) / 4.0) AS DOUBLE) AS salience FROM j WHERE l <= -90 OR q <= -150 OR (q <= -60 AND l < -30)""")
def finding_sleep_debt(spark: SparkSession, sf_dir: str) -> DataFrame:
    debt = H.sleep_debt(user_days(spark, sf_dir), ["user_id"], F.lit("2024-01-30").cast("date"), F.lit(110.0), "day", "v")
    return H.detect_sleep_debt(debt, ["user_id"]).drop("supporting")


@query("""WITH e AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'easy' WHEN 1 THEN 'moderate' WHEN 2 THEN 'hard' WHEN 3 THEN 'very_hard' END AS label, CAST(event_id % 140 AS DOUBLE) AS x FROM events),
f AS (SELECT *, coalesce(label IN ('hard', 'very_hard'), FALSE) OR x > 100 AS h, coalesce(label = 'moderate', FALSE) OR (x > 65 AND x <= 100) AS m, coalesce(label = 'very_hard', FALSE) OR x > 120 AS t FROM e WHERE label IS NOT NULL),
l AS (SELECT event_id, CASE WHEN NOT h AND NOT m THEN 'none' WHEN event_id % 11 = 0 THEN 'mild' WHEN h AND t THEN 'high' WHEN h THEN 'moderate' ELSE 'mild' END AS level,
CASE WHEN NOT h AND NOT m THEN 0.0 WHEN event_id % 11 = 0 THEN 1.0 WHEN h AND t THEN 4.0 WHEN h THEN 2.5 ELSE 1.5 END AS bump FROM f)
SELECT event_id, 'training_fatigue' AS id, CAST(CASE level WHEN 'mild' THEN 55 WHEN 'moderate' THEN 72 ELSE 78 END AS DOUBLE) AS salience, level, CAST(bump AS DOUBLE) AS bump FROM l WHERE level <> 'none'""")
def finding_fatigue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fatigue of the day after a session: level, expected bump of the resting rate, salience."""
    label = F.when(ID % 5 == 0, "easy").when(ID % 5 == 1, "moderate").when(ID % 5 == 2, "hard").when(ID % 5 == 3, "very_hard")
    e = numbers(spark, sf_dir).filter(label.isNotNull()).withColumn("fatigue", H.fatigue(label, mod(140), ID % 11 == 0))
    found = H.detect_fatigue(e.withColumn("bump", F.col("fatigue.rhr_bump")), ["event_id", "bump"])
    return found.select("event_id", "id", "salience", F.col("supporting")["level"].alias("level"), "bump")


@query("""WITH e AS (SELECT event_id, (event_id % 50) / 10.0 - 2 AS r, 1 - (event_id % 40) / 10.0 AS p, (event_id % 30) / 10.0 - 1 AS w, CASE WHEN event_id % 3 > 0 THEN (event_id % 35) / 10.0 - 1 END AS s, CASE event_id % 7 WHEN 0 THEN 'moderate' WHEN 1 THEN 'high' WHEN 2 THEN 'mild' ELSE 'none' END AS f FROM events),
g AS (SELECT event_id, greatest(r, w, coalesce(s, 0), abs(p)) AS k FROM e WHERE f NOT IN ('moderate', 'high') AND r >= 1 AND (w >= 1 OR coalesce(s >= 1, FALSE)) AND p <= -0.75)
SELECT event_id, CASE WHEN k >= 2 THEN 'elevated' WHEN k >= 1.5 THEN 'moderate' ELSE 'low' END AS severity, CAST(CASE WHEN k >= 2 THEN 95 WHEN k >= 1.5 THEN 85 ELSE 70 END AS DOUBLE) AS salience FROM g""")
def finding_illness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resting rate, respiration and the proxy agree, and training does not explain it."""
    tenth = lambda n, shift: F.round((ID % n) / 10.0 + shift, 1)
    level = F.when(ID % 7 == 0, "moderate").when(ID % 7 == 1, "high").when(ID % 7 == 2, "mild").otherwise("none")
    watch = H.illness_watch(tenth(50, -2.0), F.round(1 - (ID % 40) / 10.0, 1), tenth(30, -1.0), F.when(ID % 3 > 0, tenth(35, -1.0)), level)
    found = H.detect_illness(numbers(spark, sf_dir).withColumn("illness", watch), ["event_id"])
    return found.select("event_id", F.col("supporting")["severity"].alias("severity"), "salience")


@query(f"""WITH {LAST}, u AS (SELECT user_id, day, v, rn, coalesce(v > lag(v) OVER w, FALSE) AS up, v - lag(v, 2) OVER w AS moved FROM r WINDOW w AS (PARTITION BY user_id ORDER BY day)),
b AS (SELECT user_id, min(rn) FILTER (NOT up) - 1 AS run FROM u GROUP BY 1)
SELECT user_id, 'metric_streak' AS id, CAST(least(80, 50 + 5 * run) AS DOUBLE) AS salience, CAST(run AS VARCHAR) AS run FROM u JOIN b USING (user_id) WHERE rn = 1 AND run >= 2 AND moved >= 1""")
def finding_streak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run of rises up to the last day that moved far enough."""
    found = H.detect_streak(user_days(spark, sf_dir), ["user_id"], "day", "v", 2, 1.0)
    return found.select("user_id", "id", "salience", F.col("supporting")["run"].alias("run"))


@query(f"""WITH {LAST}, m AS (SELECT user_id, avg(v) FILTER (rn <= 7) - avg(v) FILTER (rn <= 30) AS d FROM r GROUP BY 1)
SELECT user_id, 'baseline_drift' AS id, round(least(90, 50 + 10 * abs(d) / 5), 6) AS salience FROM m WHERE abs(d) >= 5""")
def finding_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = H.detect_drift(user_days(spark, sf_dir), ["user_id"], "day", "v", 5.0)
    return found.select("user_id", "id", F.round("salience", 6).alias("salience"))


@query("""WITH a AS (SELECT user_id, avg(sin((hour(ts) * 60 + minute(ts)) * 2 * pi() / 1440)) AS s, avg(cos((hour(ts) * 60 + minute(ts)) * 2 * pi() / 1440)) AS c FROM events GROUP BY 1), d AS (SELECT user_id, sqrt(-2 * ln(sqrt(s * s + c * c))) * 1440 / (2 * pi()) AS sd FROM a)
SELECT user_id, 'circadian_irregularity' AS id, round(least(85, 40 + sd / 4), 4) AS salience FROM d WHERE sd >= 60""")
def finding_irregular_bedtime(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "events").select("user_id", (F.hour("ts") * 60 + F.minute("ts")).alias("m"))
    return H.detect_irregular_bedtime(m, ["user_id"], "m").select("user_id", "id", F.round("salience", 4).alias("salience"))


@query("""WITH e AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_id % 100 END AS proxy, event_id % 3 = 0 AS good, event_id % 5 = 0 AS mild, event_id % 7 = 0 AS rem_max, event_id % 11 = 0 AS rhr, event_id % 13 < 6 AS rhr_min, event_id % 17 = 0 AS high, event_id % 4 = 0 AS improving FROM events),
s AS (SELECT event_id, CASE WHEN coalesce(proxy >= 75, FALSE) AND good AND mild THEN 68 WHEN improving AND high THEN 65 WHEN good AND rem_max THEN 60 WHEN rhr AND rhr_min THEN 58 END AS s FROM e)
SELECT event_id, 'positive_reinforcement' AS id, CAST(s AS DOUBLE) AS salience FROM s WHERE s IS NOT NULL""")
def finding_positive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of four good signs."""
    e = numbers(spark, sf_dir).select(
        "event_id", F.when(ID % 2 == 0, mod(100)).alias("proxy_pct"), F.when(ID % 3 == 0, "positive").alias("rem_direction"), F.when(ID % 5 == 0, "mild").alias("rem_magnitude"), (ID % 7 == 0).alias("rem_max"),
        F.when(ID % 11 == 0, "positive").alias("rhr_direction"), (ID % 13 < 6).alias("rhr_min"), F.when(ID % 17 == 0, "high").alias("recovery_band"), F.when(ID % 4 == 0, "improving").alias("recovery_direction"),
    )
    return R.detect_positive(e, ["event_id"]).drop("supporting")


@query("""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'yesterday_exercise_stress' ELSE 'yesterday_work_stress' END AS id, CASE WHEN event_id % 4 = 0 THEN 70.0 ELSE 78.0 END::DOUBLE AS salience FROM events WHERE event_id % 6 < 2 OR event_id % 9 >= 6""")
def finding_work_stress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stressful day before, by work or by exercise."""
    size = F.when(ID % 6 == 0, "mild").when(ID % 6 == 1, "strong").when(ID % 6 == 2, "noise")
    e = numbers(spark, sf_dir).select("event_id", F.col("value").alias("avg"), mod(9).alias("vs_baseline"), size.alias("magnitude"), F.when(ID % 4 == 0, True).when(ID % 4 == 1, False).alias("peak_by_exercise"))
    return R.detect_work_stress(e, ["event_id"]).drop("supporting")


@query(f"""WITH {LAST}, u AS (SELECT user_id, day, v, rn, coalesce(v > lag(v) OVER (PARTITION BY user_id ORDER BY day), FALSE) AS up FROM r), b AS (SELECT user_id, min(rn) FILTER (NOT up) - 1 AS run, count(*) FILTER (rn <= 30) AS n, avg(v) FILTER (rn <= 7) - avg(v) FILTER (rn <= 30) AS d FROM u GROUP BY 1)
SELECT user_id, 'stress_trend_rising' AS id, 62.0::DOUBLE AS salience FROM b WHERE n >= 14 AND d >= 4 AND (run >= 2 OR d >= 6)""")
def finding_rising_stress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.detect_rising_stress(user_days(spark, sf_dir), ["user_id"], "day", "v").drop("supporting")


@query("""WITH h AS (SELECT user_id, CAST(ts AS DATE) AS day, avg(value) FILTER (hour(ts) < 8) AS m, avg(value) FILTER (hour(ts) BETWEEN 8 AND 15) AS w, avg(value) FILTER (hour(ts) >= 16) AS e FROM events GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day DESC) AS rn FROM h), g AS (SELECT user_id, count(*) AS n, avg(w) AS w, (coalesce(sum(m), 0) + coalesce(sum(e), 0)) / nullif(count(m) + count(e), 0) AS o, count_if(w > coalesce(m, 0)) + count_if(w > coalesce(e, 0)) AS d FROM r WHERE rn <= 7 GROUP BY 1)
SELECT user_id, 'stress_timing_pattern' AS id, 58.0::DOUBLE AS salience FROM g WHERE n >= 5 AND w > o + 3 AND d >= 4""")
def finding_stress_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work hours dominate the last seven days."""
    h, v = F.hour("ts"), F.col("value")
    bands = {"morning": h < 8, "work": (h >= 8) & (h < 16), "evening": h >= 16}
    d = table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(*(F.avg(F.when(c, v)).alias(n) for n, c in bands.items()))
    return R.detect_stress_timing(d, ["user_id"], "day").drop("supporting")


@query(f"""WITH {LAST}, g AS (SELECT user_id, count(*) FILTER (rn <= 30) AS n, avg(v) FILTER (rn <= 7) AS r, avg(v) FILTER (rn <= 30) AS b FROM r GROUP BY 1)
SELECT user_id, 'stress_poor_daytime_recovery' AS id, 55.0::DOUBLE AS salience FROM g WHERE n >= 14 AND (r < b - 3 OR r < 15)""")
def finding_poor_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.detect_poor_recovery(user_days(spark, sf_dir), ["user_id"], "day", "v").drop("supporting")


_LINK = """, c AS (SELECT user_id, count(*) AS n, corr(x, y) AS r FROM p GROUP BY 1) SELECT user_id, '{name}' AS id, round(50 + 40 * abs(r), 6) AS salience, CAST(n AS VARCHAR) AS n FROM c WHERE n >= {least} AND NOT isnan(r) AND r * {sign} >= 0.1"""
_HOURS = """p AS (SELECT user_id, CAST(ts AS DATE) AS day, avg(hour(ts) * 60 + minute(ts)) AS x, round(sum(value), 4) AS y FROM events GROUP BY 1, 2)"""


def _link(df: DataFrame, name: str, sign: int, least: int = 10) -> DataFrame:
    found = H.detect_link(df, ["user_id"], "x", "y", name, sign, least, 0.1)
    return found.select("user_id", "id", F.round("salience", 6).alias("salience"), F.col("supporting")["n"].alias("n"))


@query(f"""WITH {UD_SQL}, p AS (SELECT user_id, CAST(n AS DOUBLE) AS x, v AS y FROM ud) {_LINK.format(name='activity_helps', sign=1, least=10)}""")
def finding_activity_helps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A link of the expected sign on the same day."""
    return _link(user_days(spark, sf_dir).select("user_id", F.col("n").cast("double").alias("x"), F.col("v").alias("y")), "activity_helps", 1)


@query(f"""WITH {UD_SQL}, p AS (SELECT user_id, CAST(n AS DOUBLE) AS x, v / n AS y FROM ud) {_LINK.format(name='stress_costs_sleep', sign=-1, least=10)}""")
def finding_stress_costs_sleep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A link of the opposite sign."""
    return _link(user_days(spark, sf_dir).select("user_id", F.col("n").cast("double").alias("x"), (F.col("v") / F.col("n")).alias("y")), "stress_costs_sleep", -1)


@query(f"""WITH {_HOURS} {_LINK.format(name='bedtime_regularity', sign=1, least=10)}""")
def finding_bedtime_regularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hour of the day against the day's value."""
    e = table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.avg(F.hour("ts") * 60 + F.minute("ts")).alias("x"), F.round(F.sum("value"), 4).alias("y"))
    return _link(e, "bedtime_regularity", 1)


@query(f"""WITH {UD_SQL}, p AS (SELECT a.user_id, a.v AS x, b.v AS y FROM ud a JOIN ud b ON a.user_id = b.user_id AND b.day = a.day + 1) {_LINK.format(name='calm_next_day', sign=-1, least=8)}""")
def finding_calm_next_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A link with the day after."""
    d = user_days(spark, sf_dir)
    after = d.select("user_id", F.date_sub("day", 1).alias("day"), F.col("v").alias("y"))
    return _link(d.join(after, ["user_id", "day"]).select("user_id", F.col("v").alias("x"), "y"), "calm_next_day", -1, 8)


@query(f"""WITH {UD_SQL}, p AS (SELECT a.user_id, k, a.v AS x, b.v AS y FROM ud a, (SELECT unnest([1, 2]) AS k) t JOIN ud b ON a.user_id = b.user_id AND b.day = a.day + CAST(k AS INTEGER)),
m AS (SELECT user_id, avg(v) AS base FROM ud GROUP BY 1), l AS (SELECT p.user_id, k, avg(y) - max(base) AS bump, count(*) AS n FROM p JOIN m USING (user_id) WHERE x > 60 GROUP BY 1, 2)
SELECT user_id, CAST(lag AS BIGINT) AS lag, round(bump, 6) AS bump FROM (SELECT user_id, k AS lag, bump, row_number() OVER (PARTITION BY user_id ORDER BY bump DESC, k) AS rn FROM l) WHERE rn = 1""")
def finding_recovery_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of one and two days after a hard day, the lag with the larger mean bump over the usual value."""
    return H.recovery_lag(user_days(spark, sf_dir), ["user_id"], "day", F.col("v") > 60, "v").select("user_id", F.col("lag").cast("long").alias("lag"), F.round("bump", 6).alias("bump"))


@query("""WITH f AS (SELECT user_id, id, s * CASE WHEN id = 'b' THEN 0.6 ELSE 1 END * c AS score FROM (SELECT user_id, CASE event_id % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS id, max(value) AS s, CASE user_id % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.8 ELSE 0.5 END AS c FROM events GROUP BY ALL)),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, id) AS rn FROM f) SELECT user_id, id, round(score, 6) AS score FROM r WHERE rn <= 2 AND (score >= 45 OR rn = 1)""")
def findings_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Salience times confidence times novelty: two of each user above the threshold, else the best."""
    kind = F.when(ID % 3 == 0, "a").when(ID % 3 == 1, "b").otherwise("c")
    sure = F.when(F.col("user_id") % 3 == 0, "high").when(F.col("user_id") % 3 == 1, "medium").otherwise("low")
    f = numbers(spark, sf_dir).groupBy("user_id", kind.alias("id")).agg(F.max("value").alias("salience")).withColumn("sure", sure)
    return H.rank_findings(f, ["user_id"], "sure", ["b"], 45, 2).select("user_id", "id", F.round("rank_score", 6).alias("score"))


# --- masks, gates, scores ----------------------------------------------------------------------------


@query("""WITH e AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'rhr_bpm' WHEN 1 THEN 'hrv_proxy_nocturnal' WHEN 2 THEN 'sleep_minutes' ELSE 'steps' END AS m, CASE WHEN event_id % 9 > 0 THEN CAST(event_id % 130 AS DOUBLE) END AS t, CASE WHEN event_id % 8 > 0 THEN 60.0 END AS b FROM events)
SELECT event_id, CASE WHEN t IS NULL OR (m = 'sleep_minutes' AND event_id % 5 = 0) OR (m = 'sleep_minutes' AND t = 0 AND coalesce(b > 0, FALSE)) OR (m = 'rhr_bpm' AND (t < 30 OR t > 120)) OR (event_id % 6 = 0 AND b IS NULL) THEN 'low' WHEN m = 'hrv_proxy_nocturnal' THEN 'medium' ELSE 'high' END AS confidence,
CASE WHEN m <> 'rhr_bpm' THEN t END AS able, CASE WHEN event_id % 2 = 0 OR m <> 'steps' THEN t END AS whole FROM e""")
def metric_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence of a value, and masks for what a device cannot measure and for days that are not over."""
    m = F.when(ID % 4 == 0, "rhr_bpm").when(ID % 4 == 1, "hrv_proxy_nocturnal").when(ID % 4 == 2, "sleep_minutes").otherwise("steps")
    t, b, size = F.when(ID % 9 > 0, mod(130)), F.when(ID % 8 > 0, F.lit(60.0)), F.when(ID % 6 > 0, "mild")
    return numbers(spark, sf_dir).select(
        "event_id", R.metric_confidence(m, t, b, size, ID % 5 == 0).alias("confidence"), R.mask_unable(m, t, {"rhr_bpm": False, "steps": True}).alias("able"), R.mask_partial(m, t, ID % 2 == 0).alias("whole")
    )


@query("""WITH e AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'rhr_bpm' WHEN 1 THEN 'hrv_rmssd_ms' WHEN 2 THEN 'body_battery_high' ELSE 'sleep_minutes' END AS m, CASE event_id % 5 WHEN 0 THEN 'mild' WHEN 1 THEN 'significant' WHEN 2 THEN 'strong' ELSE 'noise' END AS s, CAST(event_id % 21 - 10 AS DOUBLE) AS d, CASE event_id % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'mild' ELSE 'high' END AS l FROM events)
SELECT event_id, CASE WHEN l <> 'none' AND s <> 'noise' AND ((m = 'rhr_bpm' AND d > 0 AND d <= 5) OR (m = 'hrv_rmssd_ms' AND s IN ('mild', 'significant') AND d <= 0) OR (m IN ('rhr_bpm', 'hrv_rmssd_ms', 'body_battery_high') AND l = 'high' AND s = 'mild')) THEN NULL ELSE s END AS size FROM e""")
def explained_by_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deviations that recent training explains are dropped."""
    m = F.when(ID % 4 == 0, "rhr_bpm").when(ID % 4 == 1, "hrv_rmssd_ms").when(ID % 4 == 2, "body_battery_high").otherwise("sleep_minutes")
    s = F.when(ID % 5 == 0, "mild").when(ID % 5 == 1, "significant").when(ID % 5 == 2, "strong").otherwise("noise")
    level = F.when(ID % 3 == 0, "none").when(ID % 3 == 1, "mild").otherwise("high")
    return numbers(spark, sf_dir).select("event_id", R.explained_magnitude(m, s, mod(21, 1, -10), level, F.lit(2.0)).alias("size"))


@query("""WITH e AS (SELECT event_id, event_id % 2 = 0 AS green, event_id % 13 = 0 AS ill, event_id % 5 = 0 AS tired, event_id % 7 AS since, event_id % 3 AS rec, event_id % 11 / 10.0 + 0.5 AS ratio, event_id % 4 AS days FROM events),
c AS (SELECT *, green AND NOT ill AND NOT tired AND since >= 3 AND rec < 2 AS ok FROM e), h AS (SELECT *, ok AND ratio < 1.3 AND rec = 0 AS hard FROM c)
SELECT event_id, CASE WHEN hard THEN 'hard_ok' ELSE 'normal' END AS floor, CASE WHEN hard AND days >= 2 THEN 'tempo' ELSE 'endurance_z2' END AS session, CASE WHEN hard AND days < 2 THEN '2-3' ELSE '1.5' END AS hours, CAST(CASE WHEN hard AND days >= 2 THEN 160 ELSE 155 END AS INTEGER) AS cap FROM h WHERE ok""")
def training_clearance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a green, rested day allows."""
    c = {
        "state": F.when(ID % 2 == 0, "green").otherwise("yellow"), "illness": ID % 13 == 0, "fatigue": F.when(ID % 5 == 0, "mild"), "since_hard": ID % 7, "recovery": F.when(ID % 3 == 0, "high").when(ID % 3 == 1, "mid").otherwise("low"),
        "cognitive": F.lit("mid"), "load_ratio": F.round((ID % 11) / 10.0 + 0.5, 1), "hard_days": ID % 4,
    }
    return numbers(spark, sf_dir).select("event_id", R.clearance(c, 170).alias("c")).filter("c is not null").select("event_id", "c.*")


@query("""WITH e AS (SELECT event_id, event_id % 4 AS s, CASE WHEN event_id % 5 > 0 THEN event_id % 3 END AS b, event_id % 21 - 10.0 AS d, event_id % 6 AS spread FROM events)
SELECT event_id, coalesce(s <> b, FALSE) AND (s >= 2 OR coalesce(b >= 2, FALSE)) AS narrated, CAST(CASE WHEN spread < 2.5 AND abs(d) < 5 THEN NULL ELSE d END AS DOUBLE) AS delta,
CASE WHEN event_id % 3 = 0 THEN 'nightly' WHEN event_id % 2 = 0 THEN 'proxy' ELSE 'none' END AS source, round(CASE WHEN event_id % 7 > 0 THEN 50.0 / ((event_id % 7) * 60.0 / 60) END, 6)::DOUBLE AS recharge FROM e""")
def small_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores worth a narrative, deltas above a device's resolution, source of recovery, and recharge by the hour of sleep."""
    before = F.when(ID % 5 > 0, ID % 3)
    delta = H.effective_delta(mod(21, 1, -10), F.lit(0.0), F.round((ID % 6) * 1.0, 1), 2.5)
    return numbers(spark, sf_dir).select(
        "event_id", R.worth_narrating(ID % 4, before).alias("narrated"), delta.alias("delta"),
        A.recovery_source(F.when(ID % 3 == 0, 1.0), F.when(ID % 2 == 0, 1.0), True).alias("source"), F.round(A.recharge_efficiency(F.lit(50.0), mod(7, 60.0)), 6).alias("recharge"),
    )


@query("""WITH e AS (SELECT event_id, value AS p, CAST(event_id % 5000 AS DOUBLE) AS s, CAST(event_id % 90 AS DOUBLE) AS c, CAST(event_id % 100 AS DOUBLE) AS w, CASE WHEN event_id % 3 = 0 THEN 'power' ELSE 'hr' END AS k, CASE WHEN event_id % 4 > 0 THEN event_id % 40 / 10.0 - 2 END AS z FROM events)
SELECT event_id, round(s * p * (p / 250) / (250 * 3600) * 100, 3) AS tss, k = 'power' AND s >= 1800 AND ((w + 60 >= 120 AND c < 25) OR (w >= 80 AND c < 40)) AS untrusted,
round(coalesce(z, 0) * 0 + CASE WHEN z IS NULL THEN NULL ELSE greatest(0, least(100, 50 + 17.5 * z)) END, 6) AS score,
round((coalesce(z * 0.4, 0) + 0.35 * 0.5 + 0.25 * -1.0) / (CASE WHEN z IS NULL THEN 0 ELSE 0.4 END + 0.35 + 0.25), 3) AS quality, CASE WHEN event_id % 10 = 0 THEN NULL ELSE round((s - 100) / (event_id % 10), 6) END AS arrival FROM e""")
def stress_kernels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training stress from power, caches that cannot be trusted, scores from deviations, sleep quality, arrival deviation."""
    z = F.when(ID % 4 > 0, F.round((ID % 40) / 10.0 - 2, 1))
    kind = F.when(ID % 3 == 0, "power").otherwise("hr")
    return numbers(spark, sf_dir).select(
        "event_id", F.round(K.tss_from_power(F.col("value"), mod(5000), F.lit(250.0)), 3).alias("tss"), H.cached_untrusted(mod(5000), mod(100, 1, 60), mod(100), mod(90), kind).alias("untrusted"),
        F.round(K.score_from_z(z), 6).alias("score"), H.sleep_quality(z, F.lit(0.5), F.lit(-1.0)).alias("quality"), F.round(K.arrival_z(mod(5000), F.lit(100), mod(10)), 6).alias("arrival"),
    )


@query(f"""WITH {UD_SQL}, x AS (SELECT user_id, day, v, v - max(v) OVER (PARTITION BY user_id ORDER BY day RANGE BETWEEN INTERVAL 2 DAY PRECEDING AND INTERVAL 2 DAY PRECEDING) AS d, row_number() OVER (PARTITION BY user_id ORDER BY day) AS i FROM ud),
s AS (SELECT *, CASE WHEN count(v) OVER w >= 3 THEN regr_slope(v, i) OVER w END AS s FROM x WINDOW w AS (PARTITION BY user_id ORDER BY day ROWS 6 PRECEDING)), q AS (SELECT user_id, quantile_cont(v, 0.33) AS a, quantile_cont(v, 0.66) AS b FROM ud GROUP BY 1)
SELECT s.user_id, s.day, round(d, 6) AS delta_2d, round(s, 6) AS slope_7d, CASE WHEN v <= a THEN 'low' WHEN v >= b THEN 'high' ELSE 'middle' END AS band, CASE WHEN round(s, 9) > 0.5 THEN 'improving' WHEN round(s, 9) < -0.5 THEN 'declining' ELSE 'steady' END AS direction FROM s JOIN q USING (user_id)""")
def score_trajectory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change over two days, slope of seven, place and direction."""
    t = H.trajectory(user_days(spark, sf_dir), ["user_id"], "day", "v")
    return t.select("user_id", "day", F.round("delta_2d", 6).alias("delta_2d"), F.round("slope_7d", 6).alias("slope_7d"), "band", "direction")


@query("""WITH m AS (SELECT event_id, [10.0, 20.0 + event_id % 9, 30.0] AS a, [10.0 + event_id % 13 - 6, 25.0, CASE WHEN event_id % 2 = 0 THEN 33.0 END] AS b FROM events),
c AS (SELECT event_id, (b[1] - a[1] + b[2] - a[2] + coalesce(b[3] - a[3], 0)) / (2 + CASE WHEN b[3] IS NULL THEN 0 ELSE 1 END) AS d FROM m) SELECT event_id, CASE WHEN d > 3 THEN 'worsening' WHEN d < -3 THEN 'improving' ELSE 'stable' END AS trend FROM c""")
def outlook_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean change of shared percentiles beyond a step."""
    pairs = lambda *v: F.create_map(*[x for k, c in zip("abc", v, strict=True) for x in (F.lit(k), c)])
    recent = pairs(F.lit(10.0), mod(9, 1, 20), F.lit(30.0))
    ahead = pairs(mod(13, 1, 4), F.lit(25.0), F.when(ID % 2 == 0, F.lit(33.0)))
    return numbers(spark, sf_dir).select("event_id", K.outlook_trend(recent, ahead).alias("trend"))


# --- names, addresses, dates -------------------------------------------------------------------------


@query("""WITH e AS (SELECT event_id AS k, event_id % 12 + 1 AS m, event_id % 28 + 1 AS d FROM events)
SELECT k, 'white' AS first, CASE WHEN k % 5 = 0 THEN NULL ELSE make_date(2020 + k % 3, m, d) END AS day, k % 3 = 0 OR k % 3 = 1 AND k % 2 = 0 AS posting, CASE k % 3 WHEN 0 THEN 'It will rain.' WHEN 1 THEN 'Dry' ELSE 'Quoted text' END AS answer,
k % 4 = 0 AS known, CASE WHEN k % 2 = 0 THEN CAST(k AS VARCHAR) END AS device_id, k % 3 <> 2 AS aligned FROM e""")
def text_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First words, dates, forum postings, answers, devices, ids and board names."""
    k = ID.cast("string")
    day = F.when(ID % 5 == 0, "13/45/2020 x").otherwise(F.concat_ws("/", F.lpad((ID % 12 + 1).cast("string"), 2, "0"), (ID % 28 + 1).cast("string"), (2020 + ID % 3).cast("string")))
    line = F.when(ID % 3 == 0, "Acme | Dev | Berlin").when(ID % 3 == 1, "Acme | Dev |").otherwise("hello")
    answer = F.when(ID % 3 == 0, " 1. It will rain. Then stop.").when(ID % 3 == 1, "- Dry").otherwise("“Quoted text”")
    name = F.when(ID % 3 == 0, "Acme Climate").when(ID % 3 == 1, "Acme-Climate Ltd").otherwise("Other")
    return numbers(spark, sf_dir).select(
        ID.alias("k"), T.first_word(F.lit("White Stork")).alias("first"), T.us_date(F.concat(day, F.lit(" 10:00:00 AM"))).alias("day"),
        T.looks_like_posting(line, F.when(ID % 2 == 0, "see https://x.example")).alias("posting"), T.clean_answer(answer).alias("answer"),
        A.from_device(F.when(ID % 4 == 0, "My GARMIN Edge"), ["garmin", "wahoo"]).alias("known"), A.external_id(F.when(ID % 2 == 0, F.concat(F.lit("garmin_ping_"), k)).otherwise(k), "garmin_ping_").alias("device_id"),
        T.slug_aligns(F.lit("acmeclimate"), name).alias("aligned"),
    )


@query("""WITH s AS (SELECT s_suppkey AS k FROM supplier) SELECT k, concat_ws(', ', 'acmeenergy' || k, 'acme-energy-' || k, 'acmeenergy' || k || 'gmbh', 'acme-energy-' || k || '-gmbh', 'acme') AS slugs FROM s""")
def board_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that a company's board may have, best first."""
    name = F.concat(F.lit("Acme Energy "), F.col("s_suppkey").cast("string"), F.lit(" GmbH"))
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.array_join(T.slug_candidates(name), ", ").alias("slugs"))


_PLACES = ("Remote (EU)", "United States (Remote)", "Lisbon (Remote)", "London, UK", "UK", "Berlin, Germany", "", "Remote - Canada")
_HEADS = ("We build tools.", "Must be legally based in France. Apply.", "You are authorized to work in the U.S. and live there.", "Work from anywhere.", "Not eligible for visa sponsorship; core hours EU time.")
#: By hand: regions, remote within a region, anywhere.
_PLACE_FACTS = "[(['EU'], FALSE), (['United States'], TRUE), (['Lisbon'], TRUE), ([], FALSE), (['United Kingdom'], FALSE), (['Germany'], FALSE), ([], FALSE), (['Canada'], TRUE)]"
_HEAD_FACTS = "[([], [], FALSE), (['France'], ['Must be based in specific location'], FALSE), (['United States'], ['Must be authorized to work in the United States'], FALSE), ([], [], TRUE), ([], ['No visa sponsorship'], FALSE)]"


@query(f"""WITH f AS (SELECT c_custkey AS k, {_PLACE_FACTS}[c_custkey % 8 + 1] AS p, {_HEAD_FACTS}[c_custkey % 5 + 1] AS h FROM customer), g AS (SELECT k, list_concat(p[1], list_filter(h[1], lambda x: NOT list_contains(p[1], x))) AS regions, h[2] AS signals, p[2] AS within, h[3] AS anywhere FROM f),
v AS (SELECT *, CASE WHEN list_has_any(signals, ['Must be authorized to work in the United States']) THEN FALSE WHEN anywhere AND NOT within THEN TRUE WHEN len(regions) > 0 THEN list_has_any(regions, ['EU', 'Europe', 'Germany', 'France', 'Poland', 'Spain', 'Netherlands', 'Ireland', 'United Kingdom']) ELSE TRUE END AS fit FROM g)
SELECT k, array_to_string(regions, '; ') AS regions, array_to_string(signals, '; ') AS signals, within, anywhere, fit, k % 3 = 0 AND fit AS remote_ok,
array_to_string(list_slice(CASE WHEN k % 3 = 0 AND NOT fit THEN list_prepend('Hire region incompatible with acceptable regions (EU)', ['a', 'b', 'c', 'd', 'e']) ELSE ['a', 'b', 'c', 'd', 'e'] END, 1, 5), '; ') AS notes FROM v""")
def location_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stated regions, signals and remote scope of a posting, its fit to accepted regions, and the guard."""
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("k") % len(values) + 1).cast("int"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    c = c.withColumn("c", P.constraints(F.lit("Engineer"), pick(_PLACES), pick(_HEADS))).withColumn("fit", P.region_fit(F.col("c"), ["EU"]))
    ok, notes = P.location_guard(F.col("k") % 3 == 0, F.array(*map(F.lit, "abcde")), F.col("fit"), ["EU"])
    return c.select("k", F.array_join("c.regions", "; ").alias("regions"), F.array_join("c.signals", "; ").alias("signals"), F.col("c.remote_within").alias("within"), "c.anywhere", "fit", ok.alias("remote_ok"), F.array_join(notes, "; ").alias("notes"))


# --- activities and climate --------------------------------------------------------------------------


@query("""SELECT event_id AS activity_id, 'Run ' || event_id AS name, CASE WHEN event_id % 2 = 0 THEN 'Run' ELSE 'Ride' END AS sport_type, CASE WHEN event_id % 4 > 0 THEN CAST(event_id % 3600 AS DOUBLE) END AS moving_time, event_id % 3 = 0 AS trainer, CASE WHEN event_id % 5 = 0 THEN CAST(event_id AS VARCHAR) END AS device_activity_id
FROM events WHERE event_id % 11 <> 0""")
def activity_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One typed row per document; malformed ones are left out."""
    k = ID.cast("string")
    doc = F.to_json(F.struct(
        ID.alias("id"), F.concat(F.lit("Run "), k).alias("name"), F.when(ID % 2 == 0, "Run").alias("sport_type"), F.lit("Ride").alias("type"),
        F.when(ID % 4 > 0, (ID % 3600).cast("string")).otherwise("n/a").alias("moving_time"), F.when(ID % 3 == 0, True).alias("trainer"),
        F.when(ID % 5 == 0, F.concat(F.lit("garmin_ping_"), k)).otherwise(k).alias("external_id"),
    ))
    docs = numbers(spark, sf_dir).select(F.when(ID % 11 == 0, F.substring(doc, 1, 9)).otherwise(doc).alias("payload"))
    return A.activity_rows(docs).select("activity_id", "name", "sport_type", "moving_time", "trainer", "device_activity_id")


@query("""WITH s AS (SELECT user_id, value AS w, 100.0 + event_id % 40 AS hr, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events), h AS (SELECT user_id, avg(w / greatest(hr, 1)) FILTER (i < n // 2) AS a, avg(w / greatest(hr, 1)) FILTER (i >= n // 2) AS b FROM s GROUP BY 1)
SELECT user_id, round(CASE WHEN a > 0 THEN b / a - 1 END, 6) AS decoupling FROM h""")
def stream_decoupling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parallel arrays as samples; output per heartbeat, second half against first."""
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value", (100.0 + ID % 40).cast("double").alias("hr"))
    arrays = e.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value", "hr"))).alias("s"))
    docs = arrays.select("user_id", F.to_json(F.struct(F.transform("s", lambda x: x["value"]).alias("watts"), F.transform("s", lambda x: x["hr"]).alias("heartrate"))).alias("doc"))
    samples = A.stream_samples(docs, "user_id", "doc", ["watts", "heartrate"])
    return A.decoupling(samples, ["user_id"], "t", "watts", "heartrate").select("user_id", F.round("decoupling", 6).alias("decoupling"))


@query(f"""WITH {RD_SQL} SELECT region, date, round((sm1 + 2 * sm2 + 4 * ndvi) / 7, 9) AS upper, round((2 * ndvi + 18 * sm1 + sm2) / 21, 9) AS lower, CASE WHEN ndvi < 0.25 AND hotspots * 4 < 5 THEN 'desert' WHEN hotspots * 4 > 20 OR (ndvi > 0.4 AND hotspots * 4 > 10) THEN 'vegetated' ELSE 'semi_arid' END AS kind FROM rd""")
def soil_and_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth-weighted soil bands, and the type of a region."""
    a, b, n = F.col("sm1"), F.col("sm2"), F.col("ndvi")
    upper, lower = A.soil_bands([a, b, n, a, b])
    return region_days(spark, sf_dir).select("region", "date", F.round(upper, 9).alias("upper"), F.round(lower, 9).alias("lower"), L.region_type(n, F.col("hotspots") * 4).alias("kind"))


@query(f"""WITH {RD_SQL}, w AS (SELECT region, date, precipitation > 60 AS wet FROM rd), s AS (SELECT *, max(CASE WHEN wet THEN date END) OVER (PARTITION BY region ORDER BY date) AS last FROM w)
SELECT region, date, CAST(month(date) AS INTEGER) AS month, CAST(dayofyear(date) AS INTEGER) AS day_of_year, CAST(date - last AS BIGINT) AS dry FROM s""")
def calendar_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Month, day of the year, and days since rain."""
    d = L.temporal_metadata(region_days(spark, sf_dir).withColumn("precipitation", F.col("precipitation") - 59))
    return d.select("region", "date", "month", "day_of_year", F.col("days_since_precip").cast("long").alias("dry"))


@query(f"""WITH {RD_SQL} SELECT region, date, round(sum(precipitation) OVER w, 4) AS rain, round(sum(discharge) OVER w, 4) AS flow, round(avg((sm1 + sm2) / 2) OVER (PARTITION BY region ORDER BY date ROWS 20 PRECEDING), 9) AS soil FROM rd WINDOW w AS (PARTITION BY region ORDER BY date ROWS 29 PRECEDING)""")
def landslide_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rolling sums and means that landslide rules read."""
    d = L.landslide_features(region_days(spark, sf_dir).withColumn("discharge_p95", F.lit(1e9)))
    return d.select("region", "date", F.round("precip_30", 4).alias("rain"), F.round("discharge_30", 4).alias("flow"), F.round("soil_21", 9).alias("soil"))


_DAYS, _MIDDLES = "[31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31]", "[15, 45, 74, 105, 135, 162, 198, 228, 258, 288, 318, 344]"


@query(f"""WITH n AS (SELECT n_nationkey AS k, n_nationkey * 2.0 AS lat FROM nation), m AS (SELECT k, lat, i, greatest(10.0 * sin(i / 2.0) + k % 7, 0) AS t FROM n, (SELECT unnest(generate_series(1, 12)) AS i)), h AS (SELECT k, sum(pow(t / 5, 1.514)) AS h FROM m GROUP BY 1),
x AS (SELECT m.*, h, 6.75e-7 * pow(h, 3) - 7.71e-5 * pow(h, 2) + 1.792e-2 * h + 0.49239 AS e, 24 / pi() * acos(greatest(-1, least(1, -tan(radians(lat)) * tan(0.409 * sin(2 * pi() * {_MIDDLES}[i] / 365 - 1.39))))) AS hours FROM m JOIN h USING (k))
SELECT k, round(sum(CASE WHEN h > 0 AND t > 0 THEN 16 * hours / 12 * {_DAYS}[i] / 30 * pow(10 * t / h, e) ELSE 0 END), 6) AS pet FROM x GROUP BY 1""")
def evapotranspiration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annual potential evapotranspiration from twelve mean temperatures and a latitude."""
    k = F.col("n_nationkey")
    monthly = F.transform(F.sequence(F.lit(1), F.lit(12)), lambda i: 10.0 * F.sin(i / 2.0) + k % 7)
    return table(spark, sf_dir, "nation").select(k.alias("k"), F.round(K.thornthwaite(monthly, k * 2.0), 6).alias("pet"))


@query(f"""WITH {RD_SQL}, x AS (SELECT precipitation AS a, precipitation * 2 + 1 AS b, discharge AS c, -discharge AS d, ndvi AS e FROM rd) SELECT unnest(list_filter([CASE WHEN abs(corr(a, b)) > 0.9 THEN 'b' END, CASE WHEN greatest(abs(corr(a, c)), abs(corr(b, c))) > 0.9 THEN 'c' END,
CASE WHEN greatest(abs(corr(a, d)), abs(corr(b, d)), abs(corr(c, d))) > 0.9 THEN 'd' END, CASE WHEN greatest(abs(corr(a, e)), abs(corr(b, e)), abs(corr(c, e)), abs(corr(d, e))) > 0.9 THEN 'e' END], lambda x: x IS NOT NULL)) AS dropped FROM x""")
def correlated_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Later features of pairs that correlate too much."""
    d = region_days(spark, sf_dir).select(F.col("precipitation").alias("a"), (F.col("precipitation") * 2 + 1).alias("b"), F.col("discharge").alias("c"), (-F.col("discharge")).alias("d"), F.col("ndvi").alias("e"))
    return spark.createDataFrame([(c,) for c in stats.correlated_to_drop(d, list("abcde"))], "dropped string")


# --- streams -----------------------------------------------------------------------------------------


@query("""WITH d AS (SELECT user_id, value, CAST(unnest(generate_series(CAST(ts AS DATE) + 1, CAST(ts AS DATE) + 7, INTERVAL 1 DAY)) AS DATE) AS day FROM events)
SELECT user_id, day, round(sum(value), 4) AS total, max(value) AS high FROM d WHERE day <= (SELECT max(ts) FROM events) - INTERVAL 2 DAY GROUP BY 1, 2""")
def stream_sliding_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven days, one day apart, as the watermark closes them."""
    out = _through(spark, S.sliding_week(_events(spark, sf_dir), ["user_id"], "ts", "value"))
    return out.select("user_id", "day", F.round("total", 4).alias("total"), "high")


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM e)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", CAST(count(*) AS BIGINT) AS n FROM s GROUP BY user_id, g HAVING max(ts) + INTERVAL 6 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 2 DAY""")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user without a gap of six hours, as the watermark closes them."""
    out = _through(spark, S.sessions(_events(spark, sf_dir), ["user_id"], "ts", "6 hours"))
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")
