"""Splits, thresholds, indices and outlooks over region days, with the SQL of their values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import kernels as K
from tessera.operators import labels as L
from tessera.operators import rules as R

from .registry import ORACLES, query, table
from .risk import RD_SQL, region_days


@query(f"""WITH {RD_SQL}, n AS (SELECT region, date, row_number() OVER (ORDER BY region, date) - 1 AS i, count(*) OVER () AS n FROM rd) SELECT region, date, i < 0.8 * n AS train FROM n""")
def ordered_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four fifths of the rows in order of region and day."""
    return L.ordered_split(region_days(spark, sf_dir)).select("region", "date", "train")


_SCORED = f"{RD_SQL}, s AS (SELECT region, date, dayofyear(date) AS k, [(dayofyear(date) % 5) / 10.0, (dayofyear(date) % 7) / 10.0, (dayofyear(date) % 4) / 5.0, (dayofyear(date) % 9) / 12.0] AS p, CAST(dayofyear(date) % 4 AS BIGINT) AS label FROM rd)"


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.dayofyear("date")
    part = lambda n, d: (k % n) / F.lit(float(d))
    return region_days(spark, sf_dir).select("region", "date", F.array(part(5, 10), part(7, 10), part(4, 5), part(9, 12)).alias("p"), (k % 4).cast("long").alias("label"))


_CLASS = "CASE WHEN p[4] >= {b} THEN 3 WHEN p[3] >= {a} THEN 2 ELSE list_position(p, list_max(p)) - 1 END"


@query(f"""WITH {_SCORED} SELECT region, date, CAST({_CLASS.format(a=0.4, b=0.5)} AS BIGINT) AS class FROM s""")
def threshold_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severe classes where their probability reaches a threshold, else the most likely one."""
    return _scored(spark, sf_dir).select("region", "date", L.threshold_class(F.col("p"), 0.4, 0.5).cast("long").alias("class"))


@query(f"""WITH {_SCORED}, g AS (SELECT unnest([0.2, 0.4, 0.6])::DOUBLE AS t), q AS (SELECT x.t AS a, y.t AS b FROM g x, g y), c AS (SELECT a, b, label, {_CLASS.format(a='a', b='b')} AS said FROM s, q),
m AS (SELECT a, b, 0.5 * avg((said = label)::INT) + 0.5 * avg((said >= 2)::INT) FILTER (label >= 2) AS score FROM c GROUP BY 1, 2) SELECT a AS level_2, b AS level_3 FROM m ORDER BY round(score, 9) DESC, a, b LIMIT 1""")
def calibrated_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pair of a grid with the best mean of accuracy and recall of severe classes."""
    return spark.createDataFrame([L.calibrate_thresholds(_scored(spark, sf_dir), (0.2, 0.4, 0.6))], "level_2 double, level_3 double")


#: Metric, share of its scale and its name in the outlook.
_METRICS = (("rain", "precipitation", 7.0, "precipitation_7d_sum_mm"), ("heat", "temperature", 1.0, "temperature_7d_max_C"), ("flow", "discharge", 7.0, "river_discharge_7d_sum_m3s"))
_PERCENT = """CASE WHEN v <= a AND a <= 0 THEN 20 WHEN v <= a THEN 20 * v / a WHEN v >= c THEN 95 + 5 * least(1, (v - c) / greatest(c - b, 1e-9) * 0.5) WHEN v < b THEN 20 + (v - a) / (b - a) * 60 ELSE 80 + (v - b) / (c - b) * 15 END"""


@query(
    f"""WITH {RD_SQL}, d AS (SELECT region, date, month(date) AS m, precipitation, ndvi * 50 AS temperature, discharge FROM rd),
q AS (SELECT region, m, {', '.join(f"quantile_cont({c}, {p / 100}) AS {c}_{p}" for _, c, _, _ in _METRICS for p in (20, 80, 95))} FROM d GROUP BY 1, 2),
w AS (SELECT d.*, sum(precipitation) OVER w AS rain, max(temperature) OVER w AS heat, sum(discharge) OVER w AS flow FROM d WINDOW w AS (PARTITION BY region ORDER BY date RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND CURRENT ROW)),
l AS ({' UNION ALL '.join(f"SELECT region, date, '{n}' AS metric, {v} AS v, {c}_20 * {s} AS a, {c}_80 * {s} AS b, {c}_95 * {s} AS c FROM w JOIN q USING (region, m)" for v, c, s, n in _METRICS)})
SELECT region, date, metric, round(v, 4) AS value, round(greatest(0, least(100, {_PERCENT})), 1) AS percentile FROM l"""
)
def outlook_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outlook metrics of eight dates against scaled monthly anchors, one row per metric."""
    d = region_days(spark, sf_dir).withColumn("temperature", F.col("ndvi") * 50)
    out = R.outlooks(d, L.monthly_climatology(d, ["precipitation", "temperature", "discharge"]))
    long = out.select("region", "date", F.explode("outlook").alias("metric", "o"))
    return long.select("region", "date", "metric", F.round(F.col("o.value"), 4).alias("value"), F.col("o.percentile_approx").alias("percentile"))


@query("""WITH e AS (SELECT event_id, event_id % 30 / 10.0 - 1 AS a, event_id % 20 / 10.0 - 1 AS b, event_id % 25 / 10.0 - 1 AS c, event_id % 7 / 4.0 AS w FROM events), t AS (SELECT *, 0.40 * -ln(exp(-a) + exp(-b)) + 0.15 * least(c, 1.5) + 0.10 * greatest(w, 0) + 0.15 * greatest(a, 0) + 0.10 * greatest(b, 0) + 0.10 * c AS th FROM e),
k AS (SELECT *, pow(greatest(1e-6, 1 / (1 + exp(-1.1 * th)) * 1 / (1 + exp(-1.1 * b)) * exp(-pow((c - 0.5) / 1.1, 2))), 1.0 / 3) AS core FROM t)
SELECT event_id, round(4 * (0.6 * core + 0.4 / (1 + exp(-1.1 * w)) - 0.5), 6) AS presence, a * 10 + 12 BETWEEN 15 AND 25 AND c + 1 < 2 AND b * 10 + 5 >= greatest(5, CASE WHEN event_id % 3 > 0 THEN w * 4 ELSE 5 END) AS optimal FROM k""")
def insect_kernels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Presence of insects from ten scores, and days that suit them."""
    i = F.col("event_id")
    a, b, c, w = F.round(i % 30 / 10.0 - 1, 1), F.round(i % 20 / 10.0 - 1, 1), F.round(i % 25 / 10.0 - 1, 1), i % 7 / 4.0
    parts = {"tmin": a, "tmean": b, "tmax": c, "warm10": w, "warm15": a, "warm20": b, "warm_anomaly": c, "srad": b, "precip": c, "optimal": w}
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.round(K.insect_presence(parts), 6).alias("presence"), K.optimal_insect_day(F.round(a * 10 + 12, 6), F.round(c + 1, 6), F.round(b * 10 + 5, 6), F.when(i % 3 > 0, w * 4)).alias("optimal"))


#: Coefficients of a published rational approximation of the normal quantile; one Newton step makes it exact.
_QA = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_QB = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
_QC = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_QD = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)


def _horner(coefficients: tuple, x: str) -> str:
    out = repr(coefficients[0])
    for c in coefficients[1:]:
        out = f"({out} * {x} + {c!r})"
    return f"CAST({out} AS DOUBLE)"


def _tail(p: str) -> str:
    q = f"sqrt(-2 * ln({p}))"
    return f"{_horner(_QC, q)} / {_horner(_QD, q)}"


SPI_SQL = f"""{RD_SQL}, w AS (SELECT region, date, CASE WHEN count(*) OVER w >= 15 THEN sum(precipitation) OVER w END AS x FROM rd WINDOW w AS (PARTITION BY region ORDER BY date ROWS 29 PRECEDING)),
m AS (SELECT region, avg(x) FILTER (x > 0) AS mean, var_samp(x) FILTER (x > 0) AS var, avg((x = 0)::INT) AS zero FROM w WHERE x IS NOT NULL GROUP BY 1),
g AS (SELECT region, date, x, zero, mean * mean / var AS a, x * mean / var AS t FROM w JOIN m USING (region)),
c AS (SELECT region, date, CASE WHEN x > 0 THEN zero + (1 - zero) * list_sum(list_transform(range(0, 700), lambda n: exp((a + n) * ln(t) - t - lgamma(a + n + 1)))) WHEN x = 0 THEN zero END AS p FROM g),
k AS (SELECT region, date, CASE WHEN p IS NOT NULL THEN greatest(1e-6, least(1 - 1e-6, p)) END AS p FROM c),
z AS (SELECT *, CASE WHEN p < 0.02425 THEN {_tail('p')} WHEN p > 1 - 0.02425 THEN -({_tail('(1 - p)')}) ELSE {_horner(_QA, '((p - 0.5) * (p - 0.5))')} * (p - 0.5) / {_horner(_QB, '((p - 0.5) * (p - 0.5))')} END AS z FROM k),
f AS (SELECT *, exp(-z * z / 2) / sqrt(2 * pi()) AS d, sign(z) * list_sum(list_transform(range(0, 120), lambda n: exp((2 * n + 1) * ln(greatest(abs(z), 1e-300)) - (n + 1) * ln(2) - lgamma(n + 1.5) + ln(pi()) / 2))) AS s FROM z),
spi AS (SELECT region, date, z - (0.5 + d * s - p) / d AS spi FROM f)"""


ORACLES["spi30"] = f"WITH {SPI_SQL} SELECT region, date, round(spi, 6) AS spi30 FROM spi"


@query(f"""WITH {SPI_SQL} SELECT region, date, round(spi, 5) AS spi, CAST(CASE WHEN spi < -1.4 THEN 3 WHEN spi < -0.95 THEN 2 WHEN spi < -0.7 THEN 1 ELSE 0 END AS BIGINT) AS dry FROM spi""")
def spi_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The standardised precipitation index and its classes."""
    s = L.spi30(region_days(spark, sf_dir)).select("region", "date", F.col("spi30").alias("s"))
    dry = F.when(F.col("s") < -1.4, 3).when(F.col("s") < -0.95, 2).when(F.col("s") < -0.7, 1).otherwise(0)
    return s.select("region", "date", F.round("s", 5).alias("spi"), dry.cast("long").alias("dry"))


_HISTORY = SPI_SQL.replace("w AS (SELECT region, date, CASE", "w AS (SELECT region, date, own, CASE", 1).replace("g AS (SELECT region, date, x,", "g AS (SELECT region, date, own, x,", 1).replace("c AS (SELECT region, date, CASE WHEN x > 0", "c AS (SELECT region, date, own, CASE WHEN x > 0", 1)
_HISTORY = _HISTORY.replace("k AS (SELECT region, date, CASE", "k AS (SELECT region, date, own, CASE", 1).replace("spi AS (SELECT region, date, z", "spi AS (SELECT region, date, own, z", 1).replace(
    "w AS (SELECT region, date, own,", "both_ AS (SELECT region, date, CASE WHEN date >= DATE '1997-01-01' AND day(date) % 4 = 0 THEN NULL WHEN date >= DATE '1997-01-01' THEN precipitation END AS recent, CASE WHEN date < DATE '1997-03-01' THEN precipitation * 2 END AS past, date >= DATE '1997-01-01' AS own FROM rd), hd AS (SELECT region, date, own, coalesce(recent, past) AS precipitation FROM both_), w AS (SELECT region, date, own,", 1
).replace("CASE WHEN count(*) OVER w >= 15 THEN sum(precipitation) OVER w END AS x FROM rd", "CASE WHEN count(precipitation) OVER w >= 15 THEN sum(precipitation) OVER w END AS x FROM hd", 1)


@query(f"WITH {_HISTORY} SELECT region, date, round(spi, 5) AS spi30 FROM spi WHERE own")
def spi_with_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recent days, some of them empty, against a series of their own and the years before, which also fills what they lack."""
    d = region_days(spark, sf_dir)
    recent = d.filter("date >= '1997-01-01'").withColumn("precipitation", F.when(F.dayofmonth("date") % 4 != 0, F.col("precipitation")))
    past = d.filter("date < '1997-03-01'").select("region", "date", (F.col("precipitation") * 2).alias("precipitation"))
    return L.spi30(recent, past).select("region", "date", F.round("spi30", 5).alias("spi30"))


_SIGHT = """s AS (SELECT c_custkey AS k, 'bird_' || c_nationkey AS common_name, DATE '2001-04-01' + CAST(c_custkey % 97 - 20 AS INTEGER) AS first, 'S' || c_custkey AS sub, c_custkey % 3 = 0 AS reviewed, c_custkey % 9 AS count FROM customer),
o AS (SELECT 'bird_' || (o_custkey % 25) AS common_name, 'S' || o_custkey AS sub, DATE '2001-02-01' + CAST(o_orderkey % 60 AS INTEGER) AS d FROM orders)"""


@query(f"""WITH {_SIGHT}, y AS (SELECT *, dayofyear(make_date(2000, month(first), day(first))) AS doy FROM s), m AS (SELECT common_name, quantile_cont(doy, 0.5) AS med FROM (SELECT DISTINCT common_name, doy FROM y) GROUP BY 1),
j AS (SELECT y.k, any_value(y.doy) AS doy, any_value(m.med) AS med, any_value(y.reviewed) AS reviewed, any_value(y.count) AS c, count(o.sub) AS n, count_if(o.sub = y.sub) AS own FROM y JOIN m USING (common_name)
LEFT JOIN o ON o.common_name = y.common_name AND o.d < y.first AND o.d >= y.first - INTERVAL 1 MONTH GROUP BY y.k)
SELECT k, CASE WHEN doy >= med - 30 THEN 'normal' WHEN n = 0 AND reviewed AND c >= 5 THEN 'confirmed_early' WHEN n = 0 THEN 'possible_early' WHEN own > 0 AND n > 1 THEN 'probable_overwintering' WHEN own > 0 THEN 'possible_overwintering' ELSE 'unknown' END AS status FROM j""")
def early_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First sightings long before the species' median day, judged by earlier sightings."""
    from tessera.plans.migration import early_arrivals as judge

    k = F.col("c_custkey")
    bird = lambda n: F.concat(F.lit("bird_"), n.cast("string"))
    s = table(spark, sf_dir, "customer").select(
        k.alias("k"), bird(F.col("c_nationkey")).alias("common_name"), bird(F.col("c_nationkey")).alias("species_code"), F.date_add(F.lit("2001-04-01").cast("date"), (k % 97 - 20).cast("int")).alias("observation_date"),
        F.concat(F.lit("S"), k.cast("string")).alias("submission_id"), (k % 3 == 0).alias("is_reviewed"), (k % 9).alias("count"), F.lit("unknown").alias("status"),
    )
    o = table(spark, sf_dir, "orders").select(bird(F.col("o_custkey") % 25).alias("species_code"), F.concat(F.lit("S"), F.col("o_custkey").cast("string")).alias("submission_id"), F.date_add(F.lit("2001-02-01").cast("date"), (F.col("o_orderkey") % 60).cast("int")).alias("observation_date"))
    return judge(s, o).select("k", "status")
