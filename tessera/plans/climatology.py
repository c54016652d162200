"""Flagship: a day against the climatology of its prior years."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.kernels import delta, ratio, z_flag, z_value
from tessera.operators.windows import rolling

from .registry import query, table

DAILY_SQL = """
daily AS (
  SELECT c.c_nationkey AS nation, CAST(o.o_orderdate AS DATE) AS day, sum(o.o_totalprice) AS total, count(*) AS n
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY 1, 2)"""


def nation_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice", F.to_date("o_orderdate").alias("day"))
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"))
    joined = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy("nation", "day").agg(F.sum("o_totalprice").alias("total"), F.count("*").alias("n"))


@query(
    f"""
WITH {DAILY_SQL},
rolled AS (
  SELECT *, avg(total) OVER (PARTITION BY nation ORDER BY day ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS r,
         year(day) AS y, (dayofyear(day) - 1) // 30 AS bucket FROM daily),
yearly AS (SELECT nation, bucket, y, avg(r) AS m FROM rolled GROUP BY 1, 2, 3),
clim AS (SELECT nation, bucket, avg(m) AS mean, stddev_samp(m) AS sd FROM yearly WHERE y < 2001 GROUP BY 1, 2),
j AS (SELECT x.nation, x.day, x.n, x.r, c.mean, c.sd, (x.r - c.mean) / nullif(c.sd, 0) AS z
      FROM rolled x JOIN clim c ON x.nation = c.nation AND x.bucket = c.bucket WHERE x.y = 2001)
SELECT CAST(nation AS BIGINT) AS nation, day, CAST(n AS BIGINT) AS n, round(r, 7) AS rolled, round(mean, 7) AS mean, round(sd, 7) AS sd,
       round(r / nullif(mean, 0), 6) AS ratio, round(r - mean, 7) AS delta, round(z, 6) AS z,
       CAST(CASE WHEN sd IS NULL THEN NULL WHEN sd = 0 THEN 0.0 WHEN abs(z) >= 2 THEN 2.0 * sign(z) WHEN abs(z) >= 1 THEN 1.0 * sign(z) ELSE 0.0 END AS DOUBLE) AS flag
FROM j"""
)
def climatology_zflag_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-row rolling means of the last year against the 30-day buckets of all earlier years."""
    days = nation_days(spark, sf_dir)
    rolled = days.withColumn("r", rolling(F.col("total"), F.avg, ["nation"], "day", 3))
    rolled = rolled.withColumn("y", F.year("day")).withColumn("bucket", F.floor((F.dayofyear("day") - 1) / 30))
    yearly = rolled.filter("y < 2001").groupBy("nation", "bucket", "y").agg(F.avg("r").alias("m"))
    history = yearly.groupBy("nation", "bucket").agg(F.avg("m").alias("mean"), F.stddev_samp("m").alias("sd"))
    both = rolled.filter("y = 2001").join(history, ["nation", "bucket"])
    r, mean, sd = F.col("r"), F.col("mean"), F.col("sd")
    z = z_value(r, mean, sd)
    return both.select(
        F.col("nation").cast("long"), "day", "n", F.round(r, 7).alias("rolled"), F.round(mean, 7).alias("mean"), F.round(sd, 7).alias("sd"),
        F.round(ratio(r, mean), 6).alias("ratio"), F.round(delta(r, mean), 7).alias("delta"), F.round(z, 6).alias("z"), z_flag(z, sd).alias("flag"),
    )
