"""Window and aggregate queries over daily series of events, orders and line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import kernels as K
from tessera.operators import stats as S
from tessera.operators import windows as W

from .climatology import DAILY_SQL, nation_days
from .registry import query, table

UD_SQL = """ud AS (SELECT user_id, CAST(ts AS DATE) AS day, round(sum(value), 4) AS v, count(*) AS n FROM events GROUP BY 1, 2)"""
LD_SQL = """ld AS (SELECT l_returnflag AS flag, CAST(l_shipdate AS DATE) AS day, round(sum(l_quantity), 2) AS q, count(*) AS n FROM lineitem GROUP BY 1, 2)"""


def user_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.round(F.sum("value"), 4).alias("v"), F.count("*").alias("n"))


def flag_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem")
    return x.groupBy(F.col("l_returnflag").alias("flag"), F.to_date("l_shipdate").alias("day")).agg(F.round(F.sum("l_quantity"), 2).alias("q"), F.count("*").alias("n"))


@query(f"""WITH {UD_SQL} SELECT user_id, day, round(avg(v) OVER w, 6) AS mean3, CAST(count_if(v >= 50) OVER w AS BIGINT) AS high3, CAST(count(CASE WHEN n > 1 THEN 1 END) OVER w AS BIGINT) AS busy3,
CAST(row_number() OVER (PARTITION BY user_id ORDER BY day) AS BIGINT) AS day_idx FROM ud WINDOW w AS (PARTITION BY user_id ORDER BY day ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""")
def rolling3_mean_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, k = user_days(spark, sf_dir), ["user_id"]
    return d.select(
        "user_id", "day", F.round(W.rolling(F.col("v"), F.avg, k, "day", 3), 6).alias("mean3"), W.rolling_count_if(F.col("v") >= 50, k, "day", 3).alias("high3"),
        F.count(F.when(F.col("n") > 1, 1)).over(W.ordered(k, "day").rowsBetween(-2, 0)).alias("busy3"), F.row_number().over(W.ordered(k, "day")).cast("long").alias("day_idx"),
    )


@query("""WITH d AS (SELECT DISTINCT c.c_nationkey AS nation, CAST(o.o_orderdate AS DATE) AS day FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey),
r AS (SELECT *, row_number() OVER (PARTITION BY nation ORDER BY day) AS rn, count(*) OVER (PARTITION BY nation) AS n FROM d),
c AS (SELECT *, CASE WHEN n <= 4 THEN 1 WHEN n % 3 = 1 THEN (n - 1) / 3.0 ELSE ceil(n / 3.0) END AS chunks FROM r)
SELECT CAST(nation AS BIGINT) AS nation, day, CAST(CASE WHEN n <= 4 THEN 1 ELSE ceil(rn / ceil(n / chunks)) END AS BIGINT) AS chunk FROM c""")
def balanced_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunked(nation_days(spark, sf_dir))


def _chunked(d: DataFrame) -> DataFrame:
    d = d.select(F.col("nation").cast("long").alias("nation"), "day")
    return d.withColumn("chunk", W.balanced_chunk(["nation"], "day"))


@query("""SELECT event_id, value >= avg(value) OVER (PARTITION BY user_id) + stddev_samp(value) OVER (PARTITION BY user_id) AS warm FROM events""")
def threshold_mean_plus_sd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", W.above_mean_plus_sd(F.col("value"), ["user_id"]).alias("warm"))


_LEVELS = f"""{UD_SQL}, lv AS (SELECT user_id, day, CASE WHEN v >= 90 THEN 3 WHEN v >= 60 THEN 2 WHEN v >= 30 THEN 1 ELSE 0 END AS score FROM ud)"""


def user_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("v")
    return user_days(spark, sf_dir).select("user_id", "day", F.when(v >= 90, 3).when(v >= 60, 2).when(v >= 30, 1).otherwise(0).alias("score"))


def alert_status(score, before):
    return (
        F.when((score >= 2) & (F.coalesce(before, F.lit(0)) < 2), "raised").when((score < 2) & (before >= 2), "removed")
        .when((score >= 2) & (before >= 2), "remains").otherwise("none")
    )


@query(f"""WITH {_LEVELS}, lg AS (SELECT *, lag(score) OVER (PARTITION BY user_id ORDER BY day) AS prev FROM lv)
SELECT user_id, day, CAST(score AS BIGINT) AS score, CAST(prev AS BIGINT) AS prev, CASE WHEN score >= 2 AND coalesce(prev, 0) < 2 THEN 'raised' WHEN score < 2 AND prev >= 2 THEN 'removed' WHEN score >= 2 AND prev >= 2 THEN 'remains' ELSE 'none' END AS status,
concat('score ', score, ' on ', day, CASE WHEN prev IS NULL THEN '' ELSE concat(', was ', prev) END) AS note
FROM lg WHERE day = (SELECT max(day) FROM lv)""")
def lag_alert_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alert state of the latest day, from the score before it."""
    levels = user_levels(spark, sf_dir)
    lagged = levels.withColumn("prev", F.lag("score").over(W.ordered(["user_id"], "day")))
    last = levels.agg(F.max("day").alias("day"))
    s, p = F.col("score"), F.col("prev")
    note = F.concat(F.lit("score "), s, F.lit(" on "), F.col("day").cast("string"), F.when(p.isNull(), "").otherwise(F.concat(F.lit(", was "), p)))
    return lagged.join(F.broadcast(last), "day", "left_semi").select("user_id", "day", s.cast("long").alias("score"), p.cast("long").alias("prev"), alert_status(s, p).alias("status"), note.alias("note"))


@query(f"""WITH {_LEVELS}, lg AS (SELECT *, lag(score) OVER (PARTITION BY user_id ORDER BY day) AS prev FROM lv),
ch AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day DESC) AS rn FROM lg WHERE prev IS NOT NULL AND prev <> score)
SELECT user_id, day, CAST(prev AS BIGINT) AS prev, CAST(score AS BIGINT) AS score, CASE WHEN score > prev THEN 'Up' WHEN score < prev THEN 'Down' ELSE 'Stable' END AS trend FROM ch WHERE rn <= 8""")
def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last eight changes of each entity."""
    lagged = user_levels(spark, sf_dir).withColumn("prev", F.lag("score").over(W.ordered(["user_id"], "day")))
    changes = W.latest_per_key(lagged.filter("prev <> score"), ["user_id"], F.desc("day"), n=8)
    return changes.select("user_id", "day", F.col("prev").cast("long"), F.col("score").cast("long"), K.trend_label(F.col("prev"), F.col("score")).alias("trend"))


@query("""SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""")
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.latest_per_key(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts"), ["user_id"], F.desc("ts"), F.desc("event_id")).select("user_id", "event_id", "event_type")


@query(f"""WITH {LD_SQL} SELECT flag, day, round(max(q) OVER (PARTITION BY flag ORDER BY day ROWS 2 PRECEDING), 2) AS max3, round(sum(q) OVER (PARTITION BY flag ORDER BY day ROWS 6 PRECEDING), 2) AS sum7,
round(avg(q) OVER (PARTITION BY flag ORDER BY day ROWS 13 PRECEDING), 6) AS mean14, round(sum(q) OVER (PARTITION BY flag ORDER BY day ROWS 29 PRECEDING), 2) AS sum30 FROM ld""")
def rolling_multi_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, q, k = flag_days(spark, sf_dir), F.col("q"), (["flag"], "day")
    return d.select("flag", "day", F.round(W.rolling(q, F.max, *k, 3), 2).alias("max3"), F.round(W.rolling(q, F.sum, *k, 7), 2).alias("sum7"), F.round(W.rolling(q, F.avg, *k, 14), 6).alias("mean14"), F.round(W.rolling(q, F.sum, *k, 30), 2).alias("sum30"))


@query(f"""WITH {LD_SQL}, x AS (SELECT *, CAST(row_number() OVER (PARTITION BY flag ORDER BY day) AS DOUBLE) AS x FROM ld)
SELECT flag, day, CASE WHEN count(q) OVER w >= 3 THEN round((sum(x * q) OVER w - sum(x) OVER w * sum(q) OVER w / count(*) OVER w) / nullif(sum(x * x) OVER w - sum(x) OVER w * sum(x) OVER w / count(*) OVER w, 0), 4) END AS slope
FROM x WINDOW w AS (PARTITION BY flag ORDER BY day ROWS 29 PRECEDING)""")
def rolling_slope_30(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = W.rolling_slope(flag_days(spark, sf_dir), "q", "slope", ["flag"], "day", 30, 3)
    return d.select("flag", "day", F.round("slope", 4).alias("slope"))


@query(f"""WITH {LD_SQL}, v AS (SELECT flag, day, CASE WHEN n % 2 = 0 THEN q END AS q FROM ld)
SELECT flag, day, CASE WHEN count(q) OVER w >= 15 THEN round(sum(q) OVER w, 2) END AS sum30 FROM v WINDOW w AS (PARTITION BY flag ORDER BY day ROWS 29 PRECEDING)""")
def rolling_min_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = flag_days(spark, sf_dir).withColumn("q", F.when(F.col("n") % 2 == 0, F.col("q")))
    return d.select("flag", "day", F.round(W.rolling(F.col("q"), F.sum, ["flag"], "day", 30, 15), 2).alias("sum30"))


@query(f"""WITH {UD_SQL}, s AS (SELECT user_id, day, CASE WHEN n > 2 THEN v END AS v FROM ud)
SELECT user_id, day, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN 16 PRECEDING AND CURRENT ROW) AS filled FROM s""")
def ffill_limit16(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = user_days(spark, sf_dir).withColumn("v", F.when(F.col("n") > 2, F.col("v")))
    return d.select("user_id", "day", W.forward_fill(F.col("v"), ["user_id"], "day", 16).alias("filled"))


@query(f"""WITH {UD_SQL}, b AS (SELECT user_id, min(day) AS a, max(day) AS z FROM ud GROUP BY 1), g AS (SELECT user_id, CAST(unnest(generate_series(a, z, INTERVAL 1 DAY)) AS DATE) AS day FROM b)
SELECT g.user_id, g.day, last_value(ud.v IGNORE NULLS) OVER (PARTITION BY g.user_id ORDER BY g.day ROWS BETWEEN 16 PRECEDING AND CURRENT ROW) AS filled FROM g LEFT JOIN ud ON g.user_id = ud.user_id AND g.day = ud.day""")
def densify_ffill(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = W.densify(user_days(spark, sf_dir), ["user_id"], "day")
    return d.select("user_id", "day", W.forward_fill(F.col("v"), ["user_id"], "day", 16).alias("filled"))


@query(f"""WITH {UD_SQL} SELECT user_id, day, CAST(day - max(CASE WHEN v > 80 THEN day END) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS since FROM ud""")
def days_since_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    return user_days(spark, sf_dir).select("user_id", "day", W.days_since(F.col("v") > 80, ["user_id"], "day").cast("long").alias("since"))


@query(f"""WITH {UD_SQL}, i AS (SELECT *, sum(CASE WHEN v > 40 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY day) AS g FROM ud)
SELECT user_id, day, CASE WHEN v > 40 THEN CAST(sum(CASE WHEN v > 40 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, g ORDER BY day) AS BIGINT) ELSE 0 END AS streak FROM i""")
def streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.streak(user_days(spark, sf_dir), F.col("v") > 40, ["user_id"], "day", "streak").select("user_id", "day", "streak")


@query(f"""WITH {UD_SQL} SELECT user_id, day, coalesce(max(CASE WHEN v > 90 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY day RANGE BETWEEN INTERVAL 3 DAY PRECEDING AND INTERVAL 3 DAY FOLLOWING), 0) = 1 AS near3,
coalesce(max(CASE WHEN v > 90 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY day RANGE BETWEEN INTERVAL 5 DAY PRECEDING AND INTERVAL 5 DAY FOLLOWING), 0) = 1 AS near5 FROM ud""")
def range_3_5_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    hot = F.when(F.col("v") > 90, 1).otherwise(0)
    near = lambda n: W.within_days(hot, F.max, ["user_id"], "day", n, n) == 1
    return user_days(spark, sf_dir).select("user_id", "day", near(3).alias("near3"), near(5).alias("near5"))


@query(f"""WITH {LD_SQL}, u AS (SELECT *, q > lag(q) OVER (PARTITION BY flag ORDER BY day) AS up FROM ld), i AS (SELECT *, sum(CASE WHEN up THEN 0 ELSE 1 END) OVER (PARTITION BY flag ORDER BY day) AS g FROM u)
SELECT flag, day, CASE WHEN up THEN CAST(sum(CASE WHEN up THEN 1 ELSE 0 END) OVER (PARTITION BY flag, g ORDER BY day) AS BIGINT) ELSE 0 END AS rising FROM i""")
def rising_streak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.rising_streak(flag_days(spark, sf_dir), "q", ["flag"], "day", "rising").select("flag", "day", "rising")


@query(f"""WITH {LD_SQL} SELECT flag, day, round(avg(q) OVER (PARTITION BY flag ORDER BY day ROWS 6 PRECEDING) - avg(q) OVER (PARTITION BY flag ORDER BY day ROWS 29 PRECEDING), 6) AS drift FROM ld""")
def tail_drift_7_30(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flag_days(spark, sf_dir).select("flag", "day", F.round(W.tail_drift(F.col("q"), ["flag"], "day", 7, 30), 6).alias("drift"))


@query(f"""WITH {UD_SQL}, l AS (SELECT user_id, list(v ORDER BY day) AS vs FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day DESC) AS rn FROM ud) WHERE rn <= 60 GROUP BY 1)
SELECT user_id, round(list_reduce(vs, lambda a, x: a + (2.0 / 43) * (x - a)), 6) AS chronic, round(list_reduce(list_slice(vs, -14, -1), lambda a, x: a + (2.0 / 8) * (x - a)), 6) AS acute FROM l""")
def ewma_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chronic (42 days, last 60 rows) and acute (7 days, last 14 rows) load."""
    d = user_days(spark, sf_dir)
    chronic = W.ewma(d, ["user_id"], "day", "v", 42, 60).withColumnRenamed("ewma", "c")
    acute = W.ewma(d, ["user_id"], "day", "v", 7, 14).withColumnRenamed("ewma", "a")
    return chronic.join(acute, "user_id").select("user_id", F.round("c", 6).alias("chronic"), F.round("a", 6).alias("acute"))


@query("""WITH f AS (SELECT user_id, CASE WHEN value >= 80 THEN 2 WHEN value >= 60 THEN 1 WHEN value <= 10 THEN -2 WHEN value <= 25 THEN -1 ELSE 0 END AS f FROM events)
SELECT user_id, round(avg(f), 6) AS mean, round(sum(exp(0.7 * abs(f)) * f) / nullif(sum(exp(0.7 * abs(f))), 0), 6) AS peak FROM f GROUP BY 1""")
def peak_emphasis_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    f = table(spark, sf_dir, "events").select("user_id", F.when(v >= 80, 2).when(v >= 60, 1).when(v <= 10, -2).when(v <= 25, -1).otherwise(0).alias("f"))
    return f.groupBy("user_id").agg(F.round(F.avg("f"), 6).alias("mean"), F.round(K.peak_emphasis_mean(F.col("f")), 6).alias("peak"))


_CLIM = f"""{LD_SQL}, c AS (SELECT flag, month(day) AS m, quantile_cont(q, 0.2) AS p20, quantile_cont(q, 0.8) AS p80, quantile_cont(q, 0.95) AS p95 FROM ld GROUP BY 1, 2)"""


@query(f"""WITH {_CLIM} SELECT flag, CAST(m AS BIGINT) AS month, round(p20, 4) AS q_p20, round(p80, 4) AS q_p80, round(p95, 4) AS q_p95 FROM c""")
def monthly_percentile_climatology(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = flag_days(spark, sf_dir).withColumn("month", F.month("day").cast("long"))
    c = S.climatology(d, ["flag", "month"], ["q"])
    return c.select("flag", "month", *[F.round(x, 4).alias(x) for x in ("q_p20", "q_p80", "q_p95")])


@query(f"""WITH {_CLIM} SELECT ld.flag, ld.day, coalesce(ld.q < c.p20, false) AS low, coalesce(ld.q > c.p80, false) AS high, coalesce(ld.q > c.p95, false) AS extreme FROM ld LEFT JOIN c ON ld.flag = c.flag AND month(ld.day) = c.m""")
def anomaly_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = flag_days(spark, sf_dir).withColumn("month", F.month("day"))
    c = S.climatology(d, ["flag", "month"], ["q"])
    yes = lambda x: F.coalesce(x, F.lit(False))
    q = F.col("q")
    return d.join(c, ["flag", "month"], "left").select("flag", "day", yes(q < F.col("q_p20")).alias("low"), yes(q > F.col("q_p80")).alias("high"), yes(q > F.col("q_p95")).alias("extreme"))


@query("""SELECT CAST(ts AS DATE) AS day, round(max(CASE WHEN event_type = 'click' THEN value END), 6) AS click, round(max(CASE WHEN event_type = 'view' THEN value END), 6) AS view, round(max(CASE WHEN event_type = 'purchase' THEN value END), 6) AS purchase FROM events GROUP BY 1""")
def pivot_conditional_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).pivot("event_type", ["click", "view", "purchase"]).agg(F.max("value"))
    return p.select("day", *[F.round(c, 6).alias(c) for c in ("click", "view", "purchase")])


@query("""SELECT user_id, CAST(ts AS DATE) AS day, round(min(value), 6) AS low, round(max(value), 6) AS high, round(avg(value), 6) AS mean, round(sum(value), 4) AS total, CAST(count(DISTINCT hour(ts)) AS BIGINT) AS hours FROM events GROUP BY 1, 2""")
def hourly_to_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = "value"
    return table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(
        F.round(F.min(v), 6).alias("low"), F.round(F.max(v), 6).alias("high"), F.round(F.avg(v), 6).alias("mean"), F.round(F.sum(v), 4).alias("total"), F.countDistinct(F.hour("ts")).alias("hours")
    )


@query("""SELECT event_type, CAST((CAST(ts AS DATE) - DATE '2024-01-01') // 16 AS BIGINT) AS bucket, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2""")
def bucket_16d(spark: SparkSession, sf_dir: str) -> DataFrame:
    bucket = F.floor(F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")) / 16)
    return table(spark, sf_dir, "events").groupBy("event_type", bucket.alias("bucket")).agg(F.round(F.avg("value"), 6).alias("mean"))


_OC = "oc AS (SELECT c.c_nationkey AS nation, o.o_totalprice AS y, c.c_acctbal AS x FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey)"


def balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).select(F.col("c_nationkey").cast("long").alias("nation"), F.col("o_totalprice").alias("y"), F.col("c_acctbal").alias("x"))


@query(f"""WITH {_OC} SELECT CAST(nation AS BIGINT) AS nation, CAST(count(*) AS BIGINT) AS n, round(corr(x, y), 6) AS r, CASE WHEN count(*) >= 700 THEN 'established' WHEN count(*) >= 500 THEN 'emerging' ELSE 'insufficient' END AS tier FROM oc GROUP BY 1""")
def corr_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r, tier = S.correlation_tier(F.col("x"), F.col("y"), ((700, "established"), (500, "emerging")))
    return balances(spark, sf_dir).groupBy("nation").agg(n, r, tier).withColumn("r", F.round("r", 6))


@query(f"""WITH {_OC}, q AS (SELECT nation, round(quantile_cont(x, 0.33), 9) AS a, round(quantile_cont(x, 0.66), 9) AS b FROM oc GROUP BY 1)
SELECT CAST(oc.nation AS BIGINT) AS nation, round(avg(CASE WHEN x <= a THEN y END), 7) AS low_mean, round(avg(CASE WHEN x >= b THEN y END), 7) AS high_mean, round(avg(CASE WHEN x >= b THEN y END) - avg(CASE WHEN x <= a THEN y END), 7) AS contrast FROM oc JOIN q ON oc.nation = q.nation GROUP BY 1""")
def tercile_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = S.tercile_contrast(balances(spark, sf_dir), ["nation"], "x", "y")
    return t.select("nation", *[F.round(c, 7).alias(c) for c in ("low_mean", "high_mean", "contrast")])


@query(f"""WITH {_OC}, r AS (SELECT nation, x, y, rank() OVER (PARTITION BY nation ORDER BY x) + (count(*) OVER (PARTITION BY nation, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY nation ORDER BY y) + (count(*) OVER (PARTITION BY nation, y) - 1) / 2.0 AS ry FROM oc)
SELECT CAST(nation AS BIGINT) AS nation, CAST(count(*) AS BIGINT) AS n, round(corr(rx, ry), 6) AS spearman, round(corr(x, y), 6) AS pearson FROM r GROUP BY 1""")
def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = S.spearman(balances(spark, sf_dir), ["nation"], "x", "y")
    return s.select("nation", "n", F.round("spearman", 6).alias("spearman"), F.round("pearson", 6).alias("pearson"))


@query("""WITH m AS (SELECT user_id, (hour(ts) * 60 + minute(ts)) * 2 * pi() / 1440 AS t FROM events),
a AS (SELECT user_id, avg(sin(t)) AS s, avg(cos(t)) AS c FROM m GROUP BY 1)
SELECT user_id, round(atan2(s, c) * 1440 / (2 * pi()) + CASE WHEN atan2(s, c) < 0 THEN 1440 ELSE 0 END, 3) AS mean_minute, round(sqrt(-2 * ln(sqrt(s * s + c * c))) * 1440 / (2 * pi()), 3) AS sd_minutes FROM a""")
def circular_mean_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "events").select("user_id", (F.hour("ts") * 60 + F.minute("ts")).alias("m"))
    return m.groupBy("user_id").agg(F.round(S.circular_mean(F.col("m")), 3).alias("mean_minute"), F.round(S.circular_sd(F.col("m")), 3).alias("sd_minutes"))


_HOLES = "h AS (SELECT event_id, user_id, CASE WHEN event_id % 5 <> 0 THEN value END AS a, CASE WHEN event_id % 3 <> 0 THEN value * 2 END AS b FROM events)"


def holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "user_id", F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("a"), F.when(F.col("event_id") % 3 != 0, F.col("value") * 2).alias("b"))


@query(f"""WITH {_HOLES}, m AS (SELECT user_id, quantile_cont(a, 0.5) AS ma, quantile_cont(b, 0.5) AS mb FROM h GROUP BY 1) SELECT event_id, round(coalesce(a, ma), 6) AS a, round(coalesce(b, mb), 6) AS b FROM h JOIN m ON h.user_id = m.user_id""")
def median_impute(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = S.median_impute(holes(spark, sf_dir), ["user_id"], ["a", "b"])
    return m.select("event_id", F.round("a", 6).alias("a"), F.round("b", 6).alias("b"))


@query(f"""WITH {_HOLES} SELECT event_id, a, b FROM h WHERE (CASE WHEN a IS NULL THEN 1 ELSE 0 END + CASE WHEN b IS NULL THEN 1 ELSE 0 END) / 2.0 <= 0.5""")
def missing_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return holes(spark, sf_dir).filter(S.missing_ratio(["a", "b"]) <= 0.5).select("event_id", "a", "b")


@query("""SELECT event_type, round(avg(value), 6) AS mean, CASE WHEN count(value) >= 3 THEN round(quantile_cont(value, 0.25), 6) END AS p25, CASE WHEN count(value) >= 3 THEN round(quantile_cont(value, 0.75), 6) END AS p75, round(min(value), 6) AS low, round(max(value), 6) AS high FROM events GROUP BY 1""")
def window_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "events").groupBy("event_type").agg(*S.window_stats(F.col("value")))
    return g.select("event_type", *[F.round(c, 6).alias(c) for c in ("mean", "p25", "p75", "low", "high")])


@query(f"""WITH {UD_SQL} SELECT user_id, day, v = max(v) OVER w AS is_max, v = min(v) OVER w AS is_min FROM ud WINDOW w AS (PARTITION BY user_id ORDER BY day RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW)""")
def extreme_in_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("v")
    return user_days(spark, sf_dir).select("user_id", "day", W.extreme_today(v, F.max, ["user_id"], "day").alias("is_max"), W.extreme_today(v, F.min, ["user_id"], "day").alias("is_min"))


@query(f"""WITH {UD_SQL}, i AS (SELECT *, sum(CASE WHEN v < 60 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY day) AS g FROM ud),
r AS (SELECT user_id, day, CASE WHEN v < 60 THEN sum(CASE WHEN v < 60 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, g ORDER BY day) ELSE 0 END AS run FROM i)
SELECT user_id, min(day) AS settled_at FROM r WHERE run >= 3 GROUP BY 1""")
def settle_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.first_run(user_days(spark, sf_dir), F.col("v") < 60, ["user_id"], "day", 3).select("user_id", "settled_at")


@query(f"""WITH {DAILY_SQL}, y AS (SELECT nation, year(day) AS y, sum(total) AS t FROM daily GROUP BY 1, 2)
SELECT CAST(nation AS BIGINT) AS nation, round(avg(t), 2) AS mean, round(stddev_samp(t), 2) AS sd, CAST(count(*) AS BIGINT) AS years FROM y GROUP BY 1 HAVING count(*) > 1""")
def two_level_aggregation(spark: SparkSession, sf_dir: str) -> DataFrame:
    years = nation_days(spark, sf_dir).groupBy(F.col("nation").cast("long").alias("nation"), F.year("day").alias("y")).agg(F.sum("total").alias("t"))
    return years.groupBy("nation").agg(F.round(F.avg("t"), 2).alias("mean"), F.round(F.stddev_samp("t"), 2).alias("sd"), F.count("*").alias("years")).filter("years > 1")


@query("""SELECT p_brand, CAST(quantile_disc(p_size, 0.75) AS BIGINT) AS p75, CAST(quantile_disc(p_size, 0.5) AS BIGINT) AS median FROM part GROUP BY 1""")
def discrete_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "part").createOrReplaceTempView("_tessera_part")
    return spark.sql("""SELECT p_brand, CAST(percentile_disc(0.75) WITHIN GROUP (ORDER BY p_size) AS BIGINT) AS p75, CAST(percentile_disc(0.5) WITHIN GROUP (ORDER BY p_size) AS BIGINT) AS median FROM _tessera_part GROUP BY 1""")


@query(f"""WITH {UD_SQL} SELECT user_id, round(100.0 * avg(CASE WHEN v <= t THEN 1 ELSE 0 END), 6) AS rank_today FROM ud JOIN (SELECT user_id AS u, arg_max(v, day) AS t FROM ud GROUP BY 1) ON user_id = u GROUP BY 1""")
def percentile_rank_today(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = user_days(spark, sf_dir)
    t = d.groupBy("user_id").agg(F.max_by("v", "day").alias("t"))
    return d.join(t, "user_id").groupBy("user_id").agg(F.round(S.percentile_rank(F.col("v"), F.col("t")), 6).alias("rank_today"))


@query(f"""WITH {UD_SQL} SELECT user_id, CAST(count(*) AS BIGINT) AS days, round(regr_slope(v, x), 6) AS slope FROM (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY day) AS DOUBLE) AS x FROM ud) GROUP BY 1""")
def linear_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = user_days(spark, sf_dir).withColumn("x", F.row_number().over(Window.partitionBy("user_id").orderBy("day")).cast("double"))
    return d.groupBy("user_id").agg(F.count("*").alias("days"), F.round(F.regr_slope("v", "x"), 6).alias("slope"))
