"""Hazard features, labels and alerts, over line items as a region-day frame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import labels as L
from tessera.operators.stats import climatology

from .registry import query, table

# Whole cents and pieces, so that sums are exact in any order and both engines hold the same doubles.
RD_SQL = """rd AS (SELECT l_returnflag AS region, CAST(l_shipdate AS DATE) AS date, CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS precipitation,
CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) AS discharge, CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS DOUBLE) AS sm1,
CAST(sum(CAST(round(l_tax * 100) AS BIGINT)) AS DOUBLE) AS sm2, CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) / count(*) / 50 AS ndvi,
CAST(count_if(l_discount > 0.095 AND l_quantity > 48) AS BIGINT) AS hotspots FROM lineitem GROUP BY 1, 2)"""
CL_SQL = """cl AS (SELECT region, month(date) AS m, quantile_cont(ndvi, 0.2) AS n20, quantile_cont(sm1, 0.2) AS a20, quantile_cont(sm2, 0.2) AS b20, quantile_cont(discharge, 0.8) AS d80, quantile_cont(discharge, 0.95) AS d95, quantile_cont(precipitation, 0.8) AS p80 FROM rd GROUP BY 1, 2)"""


def region_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, n = table(spark, sf_dir, "lineitem"), F.count(F.lit(1))
    cents = lambda c: F.sum(F.round(F.col(c) * 100).cast("long")).cast("double")
    whole = F.sum(F.col("l_quantity").cast("long")).cast("double")
    return x.groupBy(F.col("l_returnflag").alias("region"), F.to_date("l_shipdate").alias("date")).agg(
        whole.alias("precipitation"), cents("l_extendedprice").alias("discharge"), cents("l_discount").alias("sm1"), cents("l_tax").alias("sm2"), (whole / n / 50).alias("ndvi"),
        F.count_if((F.col("l_discount") > 0.095) & (F.col("l_quantity") > 48)).alias("hotspots"),
    )


def with_climatology(df: DataFrame) -> DataFrame:
    df = df.withColumn("month", F.month("date"))
    return df.join(climatology(df, ["region", "month"], ["ndvi", "sm1", "sm2", "discharge", "precipitation"]), ["region", "month"], "left")


@query(f"""WITH {RD_SQL}, h AS (SELECT region, date, hotspots, max(CASE WHEN hotspots > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY region ORDER BY date RANGE BETWEEN INTERVAL 3 DAY PRECEDING AND INTERVAL 3 DAY FOLLOWING) AS a,
max(CASE WHEN hotspots > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY region ORDER BY date RANGE BETWEEN INTERVAL 5 DAY PRECEDING AND INTERVAL 5 DAY FOLLOWING) AS b FROM rd)
SELECT region, date, CAST(CASE WHEN hotspots > 0 THEN 3 WHEN a = 1 THEN 2 WHEN b = 1 THEN 1 ELSE 0 END AS BIGINT) AS label FROM h""")
def fire_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return region_days(spark, sf_dir).select("region", "date", L.fire_label(F.col("hotspots")).cast("long").alias("label"))


@query(f"""WITH {RD_SQL}, {CL_SQL}, z AS (SELECT rd.*, n20, a20, b20, round((precipitation - avg(precipitation) OVER (PARTITION BY rd.region)) / stddev_samp(precipitation) OVER (PARTITION BY rd.region), 6) AS s FROM rd JOIN cl ON rd.region = cl.region AND month(date) = m),
f AS (SELECT region, date, s, ndvi < n20 AS v, (sm1 < a20 OR sm2 < b20) AS w FROM z)
SELECT region, date, CAST(CASE WHEN s < -1.4 AND (v OR w) THEN 3 WHEN (v AND w) OR (s < -0.95 AND s >= -1.4 AND w) THEN 2 WHEN (s < -0.7 AND (v OR w)) THEN 1 ELSE 0 END AS BIGINT) AS label FROM f""")
def drought_rule_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule table over a plain standard score in place of the index."""
    from pyspark.sql import Window

    d, w = with_climatology(region_days(spark, sf_dir)), Window.partitionBy("region")
    p = F.col("precipitation")
    d = d.withColumn("s", F.round((p - F.avg(p).over(w)) / F.stddev_samp(p).over(w), 6))
    dry = (F.col("sm1") < F.col("sm1_p20")) | (F.col("sm2") < F.col("sm2_p20"))
    return d.select("region", "date", L.drought_label(F.col("s"), F.col("ndvi") < F.col("ndvi_p20"), dry).cast("long").alias("label"))


_EV = "ev AS (SELECT DISTINCT region, date AS e FROM rd WHERE precipitation > 250)"


@query(f"""WITH {RD_SQL}, {CL_SQL}, {_EV}, x AS (SELECT rd.*, d80, d95, p80, max(discharge) OVER (PARTITION BY rd.region ORDER BY date RANGE BETWEEN INTERVAL 2 DAY PRECEDING AND INTERVAL 2 DAY FOLLOWING) AS near FROM rd JOIN cl ON rd.region = cl.region AND month(date) = m),
e AS (SELECT x.region AS r, x.date AS dt, min(abs(x.date - e)) AS d FROM x JOIN ev ON x.region = ev.region AND abs(x.date - e) <= 2 GROUP BY 1, 2),
l AS (SELECT x.region, x.date, d, CASE WHEN discharge > d95 THEN 3 WHEN near > d95 THEN 2 WHEN discharge > d80 AND precipitation > p80 THEN 1 ELSE 0 END AS proxy FROM x LEFT JOIN e ON r = region AND dt = date)
SELECT region, date, CAST(CASE WHEN d = 0 THEN 3 WHEN d <= 2 THEN 2 ELSE proxy END AS BIGINT) AS label, CAST(CASE WHEN d IS NOT NULL THEN 1.0 WHEN proxy > 0 THEN 0.5 ELSE 1.0 END AS DOUBLE) AS confidence FROM l""")
def flood_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = with_climatology(region_days(spark, sf_dir))
    events = d.filter("precipitation > 250").select("region", F.col("date").alias("event_date"))
    return L.flood_labels(d, events).select("region", "date", F.col("flood_label").cast("long").alias("label"), F.col("flood_confidence").alias("confidence"))


@query(f"""WITH {RD_SQL}, {CL_SQL}, {_EV}, x AS (SELECT rd.*, d95, round(sum(precipitation) OVER w30, 2) AS p30, round(sum(discharge) OVER w30, 2) AS q30, round(avg((sm1 + sm2) / 2) OVER (PARTITION BY rd.region ORDER BY date ROWS 20 PRECEDING), 8) AS s21 FROM rd JOIN cl ON rd.region = cl.region AND month(date) = m WINDOW w30 AS (PARTITION BY rd.region ORDER BY date ROWS 29 PRECEDING)),
c AS (SELECT region AS cr, month(date) AS cm, quantile_cont(p30, 0.99) AS p, quantile_cont(q30, 0.99) AS q, quantile_cont(s21, 0.9) AS s FROM x GROUP BY 1, 2),
e AS (SELECT x.region AS r, x.date AS dt, min(abs(x.date - e)) AS d FROM x JOIN ev ON x.region = ev.region AND abs(x.date - e) <= 14 GROUP BY 1, 2),
l AS (SELECT region, date, d, CASE WHEN (p30 > p AND q30 > q) OR (q30 > q AND s21 > s) THEN 2 WHEN p30 > p OR q30 > q THEN 1 ELSE 0 END AS proxy FROM x JOIN c ON region = cr AND month(date) = cm LEFT JOIN e ON r = region AND dt = date)
SELECT region, date, CAST(CASE WHEN d = 0 THEN 2 WHEN d <= 7 THEN 2 WHEN d <= 14 THEN 1 ELSE proxy END AS BIGINT) AS label, CAST(CASE WHEN d IS NOT NULL THEN 1.0 WHEN proxy > 0 THEN 0.7 ELSE 1.0 END AS DOUBLE) AS confidence FROM l""")
def landslide_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = with_climatology(region_days(spark, sf_dir))
    events = d.filter("precipitation > 250").select("region", F.col("date").alias("event_date"))
    out = L.landslide_labels(d, events)
    return out.select("region", "date", F.col("landslide_label").cast("long").alias("label"), F.col("landslide_confidence").alias("confidence"))


@query()
def spi30(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standardised precipitation index over 30 rows of each region."""
    return L.spi30(region_days(spark, sf_dir)).select("region", "date", F.round("spi30", 6).alias("spi30"))


@query()
def risk_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rolling features, index, calendar and anomaly flags in one plan."""
    d = region_days(spark, sf_dir)
    clim = L.monthly_climatology(d, ["precipitation", "discharge", "sm1", "sm2", "ndvi", "hotspots"])
    return d.transform(L.temporal_features).transform(L.spi30).transform(L.temporal_metadata).transform(lambda x: L.anomalies(x, clim))


@query()
def rf_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forest on fire labels, with calibrated class thresholds."""
    from pyspark.ml.functions import vector_to_array

    d = L.temporal_features(region_days(spark, sf_dir)).withColumn("label", L.fire_label(F.col("hotspots")).cast("double")).na.fill(0.0)
    split = L.ordered_split(d)
    features = ["precip_7d_sum", "precip_30d_sum", "sm1_14d_mean", "discharge_7d_mean", "hotspot_7d_sum"]
    model = L.train_forest(split.filter("train"), features, "label", trees=10, depth=5)
    scored = model.transform(split.filter("not train")).select("region", "date", "label", vector_to_array("probability").alias("p"))
    two, three = L.calibrate_thresholds(scored.filter(F.year("date") % 2 == 0), (0.3, 0.5, 0.7))
    return scored.select("region", "date", "label", L.threshold_class(F.col("p"), two, three).cast("long").alias("predicted"))


LASSO = ["precip_7d_sum", "precip_30d_sum", "sm1_14d_mean", "discharge_7d_mean"]


@query()
def lasso_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coefficients of each region's vegetation index, cross-validated over five consecutive folds."""
    d = L.temporal_features(region_days(spark, sf_dir))
    return L.lasso_per_group(d, "region", LASSO, "ndvi", ["date"], block=F.year("date"))


_N = len(LASSO)


@query(
    f"""WITH {RD_SQL}, f AS (SELECT region, date, ndvi AS x{_N}, sum(precipitation) OVER (PARTITION BY region ORDER BY date ROWS 6 PRECEDING) AS x0, sum(precipitation) OVER (PARTITION BY region ORDER BY date ROWS 29 PRECEDING) AS x1,
avg(sm1) OVER (PARTITION BY region ORDER BY date ROWS 13 PRECEDING) AS x2, avg(discharge) OVER (PARTITION BY region ORDER BY date ROWS 6 PRECEDING) AS x3 FROM rd),
c AS (SELECT region, {', '.join(f'x{i} - avg(x{i}) OVER (PARTITION BY region) AS x{i}' for i in range(_N + 1))}, (row_number() OVER (PARTITION BY region ORDER BY date) - 1) * 5 // count(*) OVER (PARTITION BY region) AS fold FROM f),
s AS (SELECT region, fold, count(*) AS n, {', '.join(f'sum(x{a} * x{b}) AS s{a}{b}' for a in range(_N + 1) for b in range(a, _N + 1))} FROM c GROUP BY 1, 2)
"""
    + " UNION ALL ".join(f"SELECT region, CAST(fold AS BIGINT) AS fold, n, '{a}{b}' AS product, printf('%.5e', s{a}{b}) AS total FROM s" for a in range(_N + 1) for b in range(a, _N + 1))
)
def lasso_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the lasso needs of each region and fold: sums of products, to six digits."""
    d = L.temporal_features(region_days(spark, sf_dir))
    s = L.fold_sums(d, "region", LASSO, "ndvi", ["date"], block=F.year("date"))
    cells = [F.struct(F.lit(f"{a}{b}").alias("product"), (F.get("xx", F.lit(a * _N + b)) if b < _N else F.get("xy", F.lit(a)) if a < _N else F.col("yy")).alias("v")) for a in range(_N + 1) for b in range(a, _N + 1)]
    return s.select("region", "fold", "n", F.explode(F.array(*cells)).alias("c")).select("region", "fold", "n", "c.product", F.format_string("%.5e", "c.v").alias("total"))


@query("""SELECT CAST(n_nationkey AS BIGINT) AS n, CAST(n_regionkey = 0 AS TINYINT) AS region_0, CAST(n_regionkey = 1 AS TINYINT) AS region_1, CAST(n_regionkey = 9 AS TINYINT) AS region_9 FROM nation""")
def one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("n"), F.col("n_regionkey").cast("string").alias("region"))
    return L.one_hot(n, "region", ["0", "1", "9"]).drop("region")


@query(f"""WITH {RD_SQL}, m AS (SELECT region, year(date) AS y, month(date) AS m, sum(precipitation) AS p FROM rd GROUP BY 1, 2, 3), a AS (SELECT region, y, sum(p) AS t FROM m GROUP BY 1, 2)
SELECT m.region, CAST(m.y AS BIGINT) AS year, round(sum(abs(p - t / 12)) / max(t), 6) AS seasonality, round(sum(-(p / t) * ln(p / t)), 6) AS entropy FROM m JOIN a ON m.region = a.region AND m.y = a.y GROUP BY 1, 2""")
def seasonality_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.functions.kernels import entropy, seasonality

    m = region_days(spark, sf_dir).groupBy("region", F.year("date").cast("long").alias("year"), F.month("date").alias("m")).agg(F.sum("precipitation").alias("p"))
    y = m.groupBy("region", "year").agg(F.collect_list("p").alias("p"))
    return y.select("region", "year", F.round(seasonality(F.col("p")), 6).alias("seasonality"), F.round(entropy(F.col("p")), 6).alias("entropy"))


@query(f"""WITH {RD_SQL}, e AS (SELECT region, year(date) AS y FROM rd WHERE hotspots > 0 UNION SELECT region, year(date) FROM rd WHERE precipitation > 250), s AS (SELECT max(year(date)) - min(year(date)) + 1 AS span FROM rd)
SELECT region, CAST(count(*) AS BIGINT) AS event_years, CAST(round(max(span) / CAST(count(*) AS DOUBLE), 6) AS DOUBLE) AS interval_years FROM e, s GROUP BY 1""")
def recurrence_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = region_days(spark, sf_dir).withColumn("y", F.year("date"))
    years = d.filter("hotspots > 0").select("region", "y").union(d.filter("precipitation > 250").select("region", "y")).distinct()
    span = d.agg((F.max("y") - F.min("y") + 1).alias("span"))
    counts = years.groupBy("region").agg(F.count("*").alias("event_years"))
    return counts.join(F.broadcast(span)).select("region", "event_years", F.round(F.col("span") / F.col("event_years"), 6).alias("interval_years"))


@query()
def weather_outlooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of eight-date sums and maxima against scaled monthly anchors, as JSON."""
    from tessera.operators.rules import outlooks

    d = region_days(spark, sf_dir).withColumn("temperature", F.col("ndvi") * 50)
    anchors = L.monthly_climatology(d, ["precipitation", "temperature", "discharge"])
    return outlooks(d, anchors).select("region", "date", F.to_json("outlook").alias("outlook"))


@query(f"""WITH {RD_SQL}, s AS (SELECT region, date, precipitation > 100 AS a, discharge > 40000 AS b, hotspots AS c FROM rd) SELECT region, date, CASE WHEN c > 0 AND c >= a::INT AND c >= b::INT THEN CASE WHEN a::INT = c THEN 'flood' ELSE 'fire' END WHEN a THEN 'flood' WHEN b THEN 'drought' ELSE 'flood' END AS focus FROM s""")
def hazard_focus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Highest score with an explicit order of ties."""
    from tessera.operators.rules import argmax_with_ties

    d = region_days(spark, sf_dir)
    return d.select("region", "date", argmax_with_ties({"flood": (F.col("precipitation") > 100).cast("int"), "fire": F.col("hotspots"), "drought": (F.col("discharge") > 40000).cast("int")}).alias("focus"))


@query(f"""WITH {RD_SQL}, d AS (SELECT region, year(date) AS y, month(date) AS m, precipitation AS p, ndvi * 50 - 12 AS t FROM rd), ys AS (SELECT region, y, sum(p) AS p, avg(t) AS t, count(CASE WHEN t < 0 THEN 1 END) AS f FROM d GROUP BY 1, 2),
ms AS (SELECT region, m, sum(p) AS p, avg(t) AS t FROM d GROUP BY 1, 2), a AS (SELECT region, avg(p) AS p, avg(t) AS t, coalesce(avg(CASE WHEN f > 0 THEN f END), 0) AS f FROM ys GROUP BY 1), b AS (SELECT region, stddev_samp(t) AS s, sum(p) AS w FROM ms GROUP BY 1),
c AS (SELECT ms.region, sum(abs(ms.p - w / 12)) / max(w) AS x FROM ms JOIN b USING (region) GROUP BY 1)
SELECT region, round(p, 4) AS mean_annual_precip, round(t, 6) AS mean_annual_temp, round(f, 6) AS frost_days_per_year, round(s, 6) AS temperature_seasonality, round(x, 6) AS precip_seasonality FROM a JOIN b USING (region) JOIN c USING (region)""")
def climate_descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.operators.activities import climate_descriptors as describe

    d = describe(region_days(spark, sf_dir).withColumn("temperature", F.col("ndvi") * 50 - 12), "region")
    return d.select("region", F.round("mean_annual_precip", 4).alias("mean_annual_precip"), *[F.round(c, 6).alias(c) for c in ("mean_annual_temp", "frost_days_per_year", "temperature_seasonality", "precip_seasonality")])
