"""Streaming jobs run over all events that are there, with the batch result as their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources import buckets
from tessera.sources.scratch import folder as _folder
from tessera.streaming import jobs as S

from .registry import query

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.source(spark, f"{sf_dir}/[e]vents.parquet", SCHEMA)  # a pattern, so that a single file will do


def _through(spark: SparkSession, df: DataFrame, mode: str = "append") -> DataFrame:
    out = _folder(spark)
    S.run_available(df, f"{out}/data", f"{out}/checkpoint", mode)
    return spark.read.schema(df.schema).parquet(f"{out}/data")


@query("""SELECT user_id, CAST(ts AS DATE) AS day, round(sum(value), 4) AS total, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1, 2 HAVING CAST(ts AS DATE) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 2 DAY""")
def stream_daily_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days that the watermark has closed."""
    return _through(spark, S.daily_totals(_events(spark, sf_dir), ["user_id"], "ts", "value")).select("user_id", "day", F.round("total", 4).alias("total"), "n")


@query("""SELECT event_type, date_trunc('hour', ts) AS hour, round(avg(value), 9) AS mean, round(max(value), 6) AS high FROM events GROUP BY 1, 2 HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 2 DAY""")
def stream_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _through(spark, S.hourly_means(_events(spark, sf_dir), ["event_type"], "ts", "value"))
    return out.select("event_type", F.col("hour").cast("timestamp_ntz").alias("hour"), F.round("mean", 9).alias("mean"), F.round("high", 6).alias("high"))


@query("""SELECT DISTINCT event_id, user_id FROM events""")
def stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event delivered twice, kept once."""
    e = _events(spark, sf_dir)
    twice = e.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    return _through(spark, S.once(twice, ["event_id"], "ts")).select("event_id", "user_id")


@query("""SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""")
def stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest event of each user by an upsert sink."""
    out = _folder(spark)
    e = _events(spark, sf_dir).select("user_id", "event_id", "value", F.struct("ts", "event_id").alias("at"))
    S.run_batches(e, S.upsert_sink(f"{out}/table", ["user_id"], "at", 16), f"{out}/checkpoint")
    return buckets.read(spark, f"{out}/table").select("user_id", "event_id", "value")


@query("""SELECT user_id, round(list_reduce(list(value ORDER BY ts, event_id), lambda a, x: a + (2.0 / 8) * (x - a)), 6) AS ewma FROM events GROUP BY 1""")
def stream_ewma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stateful recursion, upserted per user."""
    out = _folder(spark)
    e = _events(spark, sf_dir).withColumn("o", F.date_format("ts", "yyyyMMddHHmmss.SSSSSS").cast("string"))
    e = e.withColumn("o", F.concat("o", F.lpad(F.col("event_id").cast("string"), 12, "0")))
    state = S.ewma(e, "user_id", "o", "value", 7)
    S.run_batches(state, S.upsert_sink(f"{out}/table", ["user_id"], n=16), f"{out}/checkpoint", "update")
    return buckets.read(spark, f"{out}/table").select("user_id", F.round("ewma", 6).alias("ewma"))


@query("""SELECT event_id, event_type FROM events""")
def stream_idempotent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows sent by two queries, appended once."""
    out = _folder(spark)
    e = _events(spark, sf_dir).select("event_id", "event_type")
    for run in ("a", "b"):
        S.run_batches(e, S.once_sink(f"{out}/table", ["event_id"], 16), f"{out}/checkpoint-{run}")
    return buckets.read(spark, f"{out}/table")
