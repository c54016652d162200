"""Recorded activities and daily device data: rows from vendor JSON, streams, soil layers, climate descriptors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import kernels as K

#: Source name and target name of the activity row.
FIELDS = (
    ("name", "name"), ("start_date", "start_date"), ("start_date_local", "start_date_local"), ("moving_time", "moving_time"), ("elapsed_time", "elapsed_time"), ("distance", "distance"),
    ("total_elevation_gain", "elevation_gain"), ("average_heartrate", "avg_hr"), ("max_heartrate", "max_hr"), ("average_speed", "avg_speed"), ("max_speed", "max_speed"), ("average_cadence", "avg_cadence"),
    ("average_watts", "avg_watts"), ("weighted_average_watts", "weighted_avg_watts"), ("kilojoules", "kilojoules"), ("suffer_score", "suffer_score"), ("calories", "calories"), ("device_name", "device_name"), ("gear_id", "gear_id"),
)
NUMBERS = ("moving_time", "elapsed_time", "distance", "elevation_gain", "avg_hr", "max_hr", "avg_speed", "max_speed", "avg_cadence", "avg_watts", "weighted_avg_watts", "kilojoules", "suffer_score", "calories")


def activity_rows(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """One typed row per activity document; malformed documents are left out."""
    names = [f"{s} string" for s, _ in FIELDS] + ["id long", "sport_type string", "type string", "trainer boolean", "external_id string"]
    j = payloads.withColumn("_j", F.from_json(column, ", ".join(names))).filter("_j.id is not null")
    typed = [(F.col(f"_j.{s}").try_cast("double") if t in NUMBERS else F.col(f"_j.{s}")).alias(t) for s, t in FIELDS]
    ext = F.col("_j.external_id")
    return j.select(F.col("_j.id").alias("activity_id"), F.coalesce("_j.sport_type", "_j.type").alias("sport_type"), *typed, F.coalesce("_j.trainer", F.lit(False)).alias("trainer"), ext.alias("external_id"), external_id(ext, "garmin_ping_").alias("device_activity_id"))


def external_id(value: Column, prefix: str) -> Column:
    """Last part of an id that starts with the prefix, else NULL."""
    return F.when(value.startswith(prefix), F.element_at(F.split(value, "_"), -1))


def from_device(name: Column, known: Sequence[str]) -> Column:
    low = F.lower(F.coalesce(name, F.lit("")))
    return F.exists(F.array(*map(F.lit, known)), lambda d: low.contains(d)) if known else F.lit(False)


def stream_samples(df: DataFrame, key: str, column: str, fields: Sequence[str]) -> DataFrame:
    """Parallel arrays of a JSON document as one row per sample: key, t, fields."""
    schema = ", ".join(f"{f} array<double>" for f in fields)
    zipped = df.withColumn("_s", F.from_json(column, schema)).select(key, F.posexplode(F.arrays_zip(*[F.col(f"_s.{f}").alias(f) for f in fields])).alias("t", "_v"))
    return zipped.select(key, "t", *[F.col("_v")[f].alias(f) for f in fields])


def decoupling(samples: DataFrame, keys: Sequence[str], order: str, output: str, rate: str) -> DataFrame:
    """Change of output per heartbeat from the first to the second half of an activity."""
    from pyspark.sql import Window

    from .windows import ordered

    at, n = F.row_number().over(ordered(keys, order)) - 1, F.count(F.lit(1)).over(Window.partitionBy(*keys))
    s = samples.withColumn("_first", at < F.floor(n / 2)).withColumn("_r", F.col(output) / F.greatest(F.col(rate), F.lit(1.0)))
    a, b = F.avg(F.when(F.col("_first"), F.col("_r"))), F.avg(F.when(~F.col("_first"), F.col("_r")))
    return s.groupBy(*keys).agg(F.when(a > 0, b / a - 1).alias("decoupling"))


def recharge_efficiency(charged: Column, sleep_minutes: Column) -> Column:
    return K.safe_divide(charged, F.nullif(sleep_minutes, F.lit(0.0)) / 60)


def recovery_source(nightly: Column, proxy: Column, can_nightly: bool, can_proxy: bool = True) -> Column:
    """nightly, proxy or none: what the device can do and the day has."""
    return F.when(F.lit(can_nightly) & nightly.isNotNull(), "nightly").when(F.lit(can_proxy) & proxy.isNotNull(), "proxy").otherwise("none")


def soil_bands(layers: Sequence[Column]) -> tuple[Column, Column]:
    """Depth-weighted means of five layers (0-1, 1-3, 3-9, 9-27, 27-81 cm) for 0-7 and 7-28 cm."""
    a, b, c, d, e = layers
    return (a + 2 * b + 4 * c) / 7, (2 * c + 18 * d + e) / 21


def climate_descriptors(df: DataFrame, key: str, latitude: str | None = None) -> DataFrame:
    """Long-term facts of each region from (date, precipitation, temperature): totals, seasonality, frost, aridity."""
    d = df.withColumns({"_y": F.year("date"), "_m": F.month("date")})
    keep = [F.first(latitude).alias("_lat")] if latitude else []
    years = d.groupBy(key, "_y").agg(F.sum("precipitation").alias("p"), F.avg("temperature").alias("t"), F.count_if(F.col("temperature") < 0).alias("f"), *keep)
    frost = F.coalesce(F.avg(F.when(F.col("f") > 0, F.col("f"))), F.lit(0.0))
    by_year = years.groupBy(key).agg(F.avg("p").alias("mean_annual_precip"), F.avg("t").alias("mean_annual_temp"), frost.alias("frost_days_per_year"), *([F.first("_lat").alias("_lat")] if latitude else []))
    months = d.groupBy(key, "_m").agg(F.sum("precipitation").alias("p"), F.avg("temperature").alias("t"))
    by_month = months.groupBy(key).agg(F.stddev_samp("t").alias("temperature_seasonality"), F.array_sort(F.collect_list(F.struct("_m", "p", "t"))).alias("_x"))
    j = by_year.join(by_month, key)
    rain, warmth = F.transform("_x", lambda x: x["p"]), F.transform("_x", lambda x: x["t"])
    out = j.withColumn("precip_seasonality", F.when(F.size("_x") == 12, K.seasonality(rain)))
    if latitude:
        out = out.withColumn("aridity_index", F.when(F.size("_x") == 12, K.aridity(F.col("mean_annual_precip"), K.thornthwaite(warmth, F.col("_lat"))))).drop("_lat")
    return out.drop("_x")
