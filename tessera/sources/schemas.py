"""Declared schemas, and conforming any frame to one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SCHEMAS = {
    "migration_locations": "bird string, location_name string, country string, type string, order_nr int, lat double, lon double, weather_check_start long, weather_check_end long, migration_direction_arrival long, migration_direction_departure long",
    "first_sightings": "common_name string, year int, observation_date timestamp, status string, species_code string, submission_id string, count long, latitude double, longitude double, is_valid boolean, is_reviewed boolean",
    "spring_weather": "bird string, location_name string, date date, arrival_year int, effective_year int, year_offset int, temperature_2m_max double, temperature_2m_min double, temperature_2m_mean double, precipitation_sum double, precipitation_hours double, rain_sum double, snowfall_sum double, sunshine_duration double, wind_speed_10m_max double, wind_gusts_10m_max double, wind_direction_10m_dominant double, shortwave_radiation_sum double, et0_fao_evapotranspiration double, weather_code double",
    "region_days": "region string, date date, temperature double, precipitation double, sm1 double, sm2 double, ndvi double, discharge double, hotspots double, frp double",
    "regions": "region string, parent_region string, country string, centroid_lat double, centroid_lon double, lon_min double, lat_min double, lon_max double, lat_max double",
    "events": "event_id string, date date, region string, latitude double, longitude double, fatality_count long",
    "evaluations": "assessment_id string, date date, region string, disaster_type string, ml_prediction int, risk_score int, risk_level string, risk_changed boolean, recent_outlook string, forecast_outlook string, rolling_diagnostics string, created_at timestamp",
    "outlook": "metrics map<string,struct<percentile_approx:double,value:double,unit:string>>",
    "heart_rate": "date date, rhr double, avg_hr double, min_hr double, max_hr double, samples_json string",
    "sleep": "date date, sleep_start timestamp, sleep_end timestamp, sleep_minutes double, deep_minutes double, light_minutes double, rem_minutes double, awake_minutes double, sleep_score double, sleep_stress double",
    "stress": "date date, avg_stress double, rest_pct double, high_pct double, samples_json string",
    "activities": "activity_id long, name string, sport_type string, start_date timestamp, moving_time long, avg_hr double, suffer_score double, weighted_avg_watts double, trainer boolean, device_name string",
    "streams": "time array<double>, heartrate array<double>, watts array<double>, velocity_smooth array<double>",
    "jobs": "source string, ats_slug string, source_job_id string, company_name string, title string, url string, location_text string, is_remote boolean, salary_text string, description_text string, posted_at timestamp, content_hash string, first_seen timestamp, last_seen timestamp, last_changed timestamp, gate_reason string, role_score double, mission_score double, fit_score double, combined_score double, canonical_job_id string",
    "companies": "company_name string, job_board_url string, mission_category string, discovery_source string, ats_type string, ats_slug string, ats_region string, careers_url string",
    "payloads": "fetched_at timestamp, ingest_batch_id string, ats_type string, ats_slug string, http_status int, payload string",
}


def schema_of(name: str) -> StructType:
    return StructType.fromDDL(SCHEMAS[name])


def conform(df: DataFrame, schema: str | StructType) -> DataFrame:
    """The schema's columns in order: cast where possible, NULL where missing or malformed; NaN becomes NULL."""
    fields = (schema_of(schema) if isinstance(schema, str) else schema).fields
    kinds = dict(df.dtypes)

    def column(f):
        if f.name not in kinds:
            return F.lit(None).cast(f.dataType).alias(f.name)
        c = F.col(f"`{f.name}`")
        c = F.when(~F.isnan(c), c) if kinds[f.name] in ("double", "float") else c
        return (c if f.dataType.simpleString() == kinds[f.name] else c.try_cast(f.dataType)).alias(f.name)

    return df.select(*map(column, fields))


def violations(df: DataFrame, not_null: list[str] = (), unique: list[str] = ()) -> dict[str, int]:
    """Counts of rows against the declared constraints, in one pass (and one more for uniqueness)."""
    out = {}
    if not_null:
        row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in not_null]).first()
        out = {f"{c} is null": row[c] for c in not_null}
    if unique:
        out["duplicates"] = df.groupBy(*unique).count().filter("count > 1").agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    return out
