"""Migration-weather marts: windows, ten-year climatology, flags, condensed scores, feature pivot.

Each mart is a function of DataFrames, driven by lists of metrics, so the whole chain is one
logical plan. The queries map orders to sightings and line items to weather.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import kernels as K
from tessera.functions.text import slug
from tessera.operators import windows as W
from tessera.operators.joins import full_combine
from tessera.sources.scratch import stored

from .registry import query, table

ENTITY = ["bird", "arrival_year", "location_name"]
DAILY = ["daily_mean", "rainfall_intensity", "sunshine_duration_minutes", "aligned_wind"]
COUNTS = {"num_days_aligned_wind_5_plus": "p_aligned_wind_5_plus", "num_days_rain_10mm_plus": "p_rain_10mm_plus", "num_days_moderate_rain": "p_moderate_rain"}
INSECT = ["tmean", "tmin", "tmax", "precip", "srad"]
WARM = ["warm10", "warm15", "warm20", "warm_anomaly", "optimal_insect_day"]


# --- staging -------------------------------------------------------------------------------------------


def locations(seed: DataFrame) -> DataFrame:
    """Accent-free keys and the first word of the type."""
    return seed.withColumns({"location_name": slug(F.col("location_name")), "country": F.lower(F.replace("country", F.lit(" "), F.lit("_"))), "location_type": F.get(F.split(F.lower("type"), " "), F.lit(0))}).drop("type")


def legs(places: DataFrame) -> DataFrame:
    """A stop with two headings becomes two legs that share its window; only the first has an insect start."""
    both = F.col("migration_direction_arrival") != F.col("migration_direction_departure")
    half = F.ceil((F.col("weather_check_start") - F.col("weather_check_end") + 1) / 2)
    keep = ["location_name", "bird", "location_type", "order_nr"]
    first = places.select(*keep, F.col("weather_check_start").cast("long"), F.when(both, F.col("weather_check_start") - half + 1).otherwise(F.col("weather_check_end")).cast("long").alias("weather_check_end"), (F.col("weather_check_start") + 14).cast("long").alias("insect_check_start"), F.col("migration_direction_arrival").alias("migration_direction"))
    second = places.filter(both).select(*keep, (F.col("weather_check_start") - half).cast("long").alias("weather_check_start"), F.col("weather_check_end").cast("long"), F.lit(None).cast("long").alias("insect_check_start"), F.col("migration_direction_departure").alias("migration_direction"))
    return first.unionByName(second)


def arrival_periods(sightings: DataFrame, stops: DataFrame) -> DataFrame:
    """One row per day before an arrival at each stop, in chunks of three or four days."""
    s = sightings.select(F.replace(F.lower("common_name"), F.lit(" "), F.lit("_")).alias("bird"), F.col("year").alias("arrival_year"), F.to_date("observation_date").alias("_d"), F.col("status").alias("arrival_status"))
    j = s.join(stops, "bird")
    back = lambda c: F.date_sub("_d", F.col(c).cast("int"))
    start, end = back("weather_check_start"), back("weather_check_end")
    first = F.coalesce(back("insect_check_start"), start)
    days = F.when(first <= end, F.sequence(first, end))  # a window that ends before it starts has no days
    rows = j.withColumn("_s", start).withColumn("weather_date", F.explode(days)).withColumn("insect_relevant_date", F.col("weather_date") < F.col("_s"))
    chunk = W.balanced_chunk([*ENTITY, "insect_relevant_date"], "weather_date")
    kind = F.when(F.col("insect_relevant_date"), "insect").otherwise("weather")
    rows = rows.withColumn("chunk_id", F.concat_ws("_", "bird", "arrival_year", "location_name", kind, chunk))
    return rows.select(*ENTITY, "location_type", "migration_direction", "arrival_status", "weather_date", "insect_relevant_date", "chunk_id")


def historical_periods(periods: DataFrame, years: int = 10) -> DataFrame:
    return W.year_shifts(periods, "weather_date", "arrival_year", years)


# --- core ----------------------------------------------------------------------------------------------


def base_rolling(periods: DataFrame, weather: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Daily metrics of the weather days, their three-row means and counts, and the day's place in its chunk."""
    keys, order = [*ENTITY, *extra], "weather_date"
    w = weather.withColumnRenamed("date", "weather_date")
    j = periods.filter(~F.col("insect_relevant_date")).join(w, ["bird", "weather_date", "location_name"], "left")
    j = j.select(
        *keys, "weather_date", "chunk_id", ((F.col("temperature_2m_max") + F.col("temperature_2m_min")) / 2).alias("daily_mean"),
        K.rain_intensity(F.col("precipitation_sum"), F.col("precipitation_hours")).alias("rainfall_intensity"), (F.col("sunshine_duration") / 60).alias("sunshine_duration_minutes"),
        K.aligned_wind(F.col("wind_speed_10m_max"), F.col("wind_direction_10m_dominant"), F.col("migration_direction")).alias("aligned_wind"), (F.col("precipitation_sum") >= 10).alias("rain_10mm_plus_day"),
    )
    rolled = {f"{m}_rolling": W.rolling(F.col(m), F.avg, keys, order, 3) for m in DAILY}
    rolled |= {f"{n}_rolling": W.rolling_count_if(c, keys, order, 3) for n, c in zip(COUNTS, _count_tests(), strict=True)}
    return j.withColumns(rolled).withColumn("day_idx", F.row_number().over(W.ordered([*keys, "chunk_id"], order)))


def _count_tests() -> list[Column]:
    return [F.col("aligned_wind") >= 5, F.col("rain_10mm_plus_day"), F.col("rainfall_intensity") >= 1]


def totals(base: DataFrame, keys: Sequence[str], suffix: str) -> DataFrame:
    """Means of the daily metrics and counts of days by the keys."""
    return base.groupBy(*keys).agg(*[F.avg(m).alias(f"{m}{suffix}") for m in DAILY], *[F.count_if(c).alias(f"{n}{suffix}") for n, c in zip(COUNTS, _count_tests(), strict=True)])


def over_years(yearly: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Mean and sample deviation across years: `<metric>_10yr_avg`, `<metric>_10yr_sd`."""
    return yearly.groupBy(*keys).agg(*[f(m).alias(f"{m}_10yr_{s}") for m in metrics for f, s in ((F.avg, "avg"), (F.stddev_samp, "sd"))])


def compare(now: DataFrame, history: DataFrame, keys: Sequence[str], metrics: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """ratio, delta, z and flag of each metric; the deviations ride along, so one join does."""
    j = now.join(history, list(keys))
    out: list[Column] = []
    for m in metrics:
        x, mean, sd = F.col(m), F.col(f"{m}_10yr_avg"), F.col(f"{m}_10yr_sd")
        z = K.z_value(x, mean, sd)
        out += [x.alias(f"{m}_arrival"), mean.alias(f"{m}_hist"), K.ratio(x, mean).alias(f"{m}_ratio"), K.delta(x, mean).alias(f"{m}_delta"), z.alias(f"{m}_z"), K.z_flag(z, sd).alias(f"{m}_flag")]
    return j.select(*keys, *[c for c in keep if c not in keys], *out)


def flags_of(compared: DataFrame) -> DataFrame:
    return compared.select([c for c in compared.columns if not c.endswith(("_arrival", "_hist", "_ratio", "_delta", "_z"))])


def daily_marts(base: DataFrame, history: DataFrame) -> DataFrame:
    """Daily flags of rolling means and shares of the three-day counts."""
    metrics = [f"{m}_rolling" for m in DAILY] + list(COUNTS.values())
    share = {p: F.col(f"{n}_rolling") / 3 for n, p in COUNTS.items()}
    keys = [*ENTITY, "chunk_id", "day_idx"]
    return compare(base.withColumns(share), over_years(history.withColumns(share), keys, metrics), keys, metrics, ["weather_date"])


# --- scores --------------------------------------------------------------------------------------------


def half_peak(flag: str) -> Column:
    """Half the mean flag and half its peak-emphasis mean."""
    return 0.5 * F.avg(flag) + 0.5 * K.peak_emphasis_mean(F.col(flag))


SCORES = {"temp_score": ("daily_mean", 1, "slow"), "sun_score": ("sunshine_duration_minutes", 1, "slow"), "wind_alignment_score": ("aligned_wind", 1, "fast"), "aligned_wind_5plus_score": ("num_days_aligned_wind_5_plus", 1, "fast"), "rain_intensity_score": ("rainfall_intensity", -1, "fast"), "rain_10mm_plus_score": ("num_days_rain_10mm_plus", -1, "fast"), "moderate_rain_score": ("num_days_moderate_rain", -1, "fast")}
WEIGHTS = {"slow": (0.50, 0.30, 0.20), "fast": (0.30, 0.35, 0.35)}


def condensed(daily: DataFrame, chunk: DataFrame, period: DataFrame) -> DataFrame:
    """Period, chunk and daily scores in one: chunks weigh by their days, and a missing grain makes a score NULL."""
    metrics = [*DAILY, *COUNTS]
    name = {m: f"{m}_rolling_flag" if m in DAILY else f"{COUNTS[m]}_flag" for m in metrics}
    d = daily.groupBy(*ENTITY).agg(*[half_peak(name[m]).alias(f"d_{m}") for m in metrics])
    joined = daily.select(*ENTITY, "chunk_id").join(chunk, "chunk_id")
    c = joined.groupBy(*ENTITY).agg(*[half_peak(f"{m}_flag").alias(f"c_{m}") for m in metrics])
    p = period.groupBy(*ENTITY).agg(*[F.avg(f"{m}_flag").alias(f"p_{m}") for m in metrics])
    scores = [K.blend([(w, sign * F.col(f"{g}_{m}")) for w, g in zip(WEIGHTS[kind], "pcd", strict=True)]).alias(s) for s, (m, sign, kind) in SCORES.items()]
    return full_combine([d, c, p], ENTITY).select(*ENTITY, *scores)


def insect_base(periods: DataFrame, weather: DataFrame, extra: Sequence[str] = (), by_bird: bool = True) -> DataFrame:
    """Warm, anomalous and optimal days. Without `by_bird` the weather of all species at a place joins (a known fan-out)."""
    keys, on = [*ENTITY, *extra], ["weather_date", "location_name", *(["bird"] if by_bird else [])]
    w = weather.withColumnRenamed("date", "weather_date")
    w = w.select(*on, F.col("temperature_2m_mean").alias("tmean"), F.col("temperature_2m_min").alias("tmin"), F.col("temperature_2m_max").alias("tmax"), F.col("precipitation_sum").alias("precip"), F.col("shortwave_radiation_sum").alias("srad"))
    j = periods.select(*keys, "weather_date", "chunk_id").join(w, on, "left")
    p75 = j.filter("srad is not null").groupBy(*keys).agg(F.expr("percentile_disc(0.75) within group (order by srad)").alias("p75_srad"))
    j = j.join(p75, keys, "left")
    t = F.col("tmean")
    j = j.withColumns({"warm10": t >= 10, "warm15": t >= 15, "warm20": t >= 20, "warm_anomaly": W.above_mean_plus_sd(t, keys), "optimal_insect_day": K.optimal_insect_day(t, F.col("precip"), F.col("srad"), F.col("p75_srad"))}).drop("p75_srad")
    chunk = [*keys, "chunk_id"]
    rolled = {f"{m}_rolling": W.rolling(F.col(m), F.avg, chunk, "weather_date", 3) for m in INSECT}
    rolled |= {f"{m}_rolling": W.rolling_count_if(F.col(m), chunk, "weather_date", 3) / 3 for m in WARM}
    return j.withColumns(rolled).withColumn("day_idx", F.row_number().over(W.ordered(chunk, "weather_date")))


def insect_totals(base: DataFrame, keys: Sequence[str]) -> DataFrame:
    mean = [F.avg(m).alias(f"{m}_avg") for m in INSECT if m != "precip"]
    return base.groupBy(*keys).agg(*mean, F.sum("precip").alias("precip_total"), *[F.count_if(F.col(m)).alias(f"{m.replace('_day', '')}_days") for m in WARM])


INSECT_CHUNK = {"tmean": "tmean_avg", "tmin": "tmin_avg", "tmax": "tmax_avg", "precip": "precip_total", "srad": "srad_avg", "warm10": "warm10_days", "warm15": "warm15_days", "warm20": "warm20_days", "warm_anomaly": "warm_anomaly_days", "optimal": "optimal_insect_days"}
#: Weights of chunk and daily scores; rain is inverted.
INSECT_WEIGHTS = {"tmean": (0.6, 0.4), "tmin": (0.6, 0.4), "tmax": (0.6, 0.4), "precip": (-0.5, -0.5), "srad": (0.5, 0.5), "warm10": (0.5, 0.5), "warm15": (0.5, 0.5), "warm20": (0.5, 0.5), "warm_anomaly": (0.6, 0.4), "optimal": (0.6, 0.4)}


def insect_scores(daily: DataFrame, chunk: DataFrame) -> DataFrame:
    """Ten condensed scores and the presence score in [-2, 2]."""
    flag = {m: f"{'optimal_insect_day' if m == 'optimal' else m}_rolling_flag" for m in INSECT_CHUNK}
    d = daily.groupBy(*ENTITY).agg(*[half_peak(flag[m]).alias(f"d_{m}") for m in INSECT_CHUNK])
    c = daily.select(*ENTITY, "chunk_id").join(chunk, "chunk_id").groupBy(*ENTITY).agg(*[half_peak(f"{c}_flag").alias(f"c_{m}") for m, c in INSECT_CHUNK.items()])
    j = d.join(c, ENTITY, "full").select(*ENTITY, *[(a * F.col(f"c_{m}") + b * F.col(f"d_{m}")).alias(m) for m, (a, b) in INSECT_WEIGHTS.items()])
    return j.withColumn("insect_presence_score", K.insect_presence({m: F.col(m) for m in INSECT_CHUNK}))


def extended(unified: DataFrame, sightings: DataFrame, places: DataFrame, only_normal: bool = False) -> DataFrame:
    """Scores with the sighting's day, the species' median day and the arrival z-score."""
    f = sightings.select(F.replace(F.lower("common_name"), F.lit(" "), F.lit("_")).alias("bird"), F.col("year").alias("arrival_year"), "status", F.to_date("observation_date").alias("first_sighting_date"))
    if only_normal:
        f = f.filter("status = 'normal'")
    f = f.withColumn("actual_day_of_year", F.dayofyear("first_sighting_date"))
    s = f.groupBy("bird").agg(F.expr("percentile_disc(0.5) within group (order by actual_day_of_year)").alias("median_day_of_year"), F.stddev_samp("actual_day_of_year").alias("_sd"))
    j = unified.join(f, ["bird", "arrival_year"]).join(s, "bird").join(places.select("bird", "location_name", "location_type", F.col("order_nr").alias("location_order_nr")), ["bird", "location_name"])
    median = F.date_add(F.make_date(F.year("first_sighting_date"), F.lit(1), F.lit(1)), (F.col("median_day_of_year") - 1).cast("int"))
    return j.withColumn("median_sighting_date_adjusted", median).withColumn("arrival_z_score", K.arrival_z(F.col("actual_day_of_year"), F.col("median_day_of_year"), F.col("_sd"))).drop("_sd")


FEATURES = [*SCORES, "insect_presence_score"]
SITES = {1: "winter", 2: "stop1", 3: "stop2", 4: "arrival"}


def year_features(ext: DataFrame) -> DataFrame:
    """One row per species and year: eight scores at each of four sites."""
    wide = [F.max(F.when(F.col("location_order_nr") == n, F.col(f))).alias(f"{s}_{f.replace('presence_', '')}") for n, s in SITES.items() for f in FEATURES]
    return ext.groupBy("bird", "arrival_year").agg(F.max("arrival_z_score").alias("arrival_z_score"), *wide)


def early_arrivals(sightings: DataFrame, earlier: DataFrame) -> DataFrame:
    """Status of each first sighting: more than thirty days before the species' median day is early, then by earlier sightings.

    earlier: (species_code, submission_id, observation_date); those in the month before count, per sighting.
    """
    day = F.dayofyear(F.make_date(F.lit(2000), F.month("observation_date"), F.day("observation_date")))
    # Equal sightings are one row, and each of them meets the earlier ones.
    s = sightings.groupBy(*sightings.columns).agg(F.count(F.lit(1)).alias("_times")).withColumns({"_doy": day, "_first": F.to_date("observation_date")})
    median = s.select("common_name", "_doy").distinct().groupBy("common_name").agg(F.percentile("_doy", 0.5).alias("_median"))
    before = earlier.filter("submission_id is not null").select("species_code", "submission_id", F.to_date("observation_date").alias("_d"))
    month = F.explode(F.sequence(F.add_months("_first", -1), F.date_sub("_first", 1))).alias("_d")
    # A sighting meets the days of its month with their counts, and the earlier rows of its own submission only.
    daily = before.groupBy("species_code", "_d").agg(F.count(F.lit(1)).alias("_k"))
    counts = s.select("species_code", "_first").distinct().select("*", month).join(daily, ["species_code", "_d"]).groupBy("species_code", "_first").agg(F.sum("_k").alias("_k"))
    own = ["species_code", "submission_id", "_first"]
    near = (F.col("_d") < F.col("_first")) & (F.col("_d") >= F.add_months("_first", -1))
    same = s.select(*own).distinct().join(before.distinct(), ["species_code", "submission_id"]).filter(near).select(*own).distinct().withColumn("_own", F.lit(1))
    g = s.join(median, "common_name").join(counts, ["species_code", "_first"], "left").join(same, own, "left")
    g = g.withColumns({"_n": F.coalesce(F.col("_k") * F.col("_times"), F.lit(0)), "_own": F.coalesce("_own", F.lit(0))})
    enough = F.col("count") >= F.when(F.col("common_name") == "white_stork", 2).otherwise(5)
    status = (
        F.when(F.col("_doy") >= F.col("_median") - 30, "normal").when((F.col("_n") == 0) & F.col("is_reviewed") & enough, "confirmed_early").when(F.col("_n") == 0, "possible_early")
        .when((F.col("_own") > 0) & (F.col("_n") > 1), "probable_overwintering").when(F.col("_own") > 0, "possible_overwintering").otherwise(F.col("status"))
    )
    return g.withColumn("status", status).select(*sightings.columns)


class Marts:
    """Every mart by name, planned when it is first asked for; tables that several marts read go through `keep`."""

    def __init__(self, sightings: DataFrame, seed: DataFrame, weather: DataFrame, keep: Callable[[DataFrame], DataFrame]):
        self.sightings, self.seed, self.weather, self.keep = sightings, seed, weather, keep

    def __getitem__(self, name: str) -> DataFrame:
        return getattr(self, name)

    @cached_property
    def locations(self) -> DataFrame:
        return locations(self.seed)

    @cached_property
    def periods(self) -> DataFrame:
        return self.keep(arrival_periods(self.sightings, legs(self.locations)))

    @cached_property
    def historical_periods(self) -> DataFrame:
        return historical_periods(self.periods)

    @cached_property
    def base_rolling(self) -> DataFrame:
        return self.keep(base_rolling(self.periods, self.weather))

    @cached_property
    def historical_base_rolling(self) -> DataFrame:
        return self.keep(base_rolling(self.historical_periods, self.weather, ["effective_year"]))

    def _grain(self, keys: list[str]) -> DataFrame:
        metrics = [*DAILY, *COUNTS]
        yearly = totals(self.historical_base_rolling, [*keys, "effective_year"], "")
        return compare(totals(self.base_rolling, keys, ""), over_years(yearly, keys, metrics), keys, metrics)

    @cached_property
    def comparison_chunk(self) -> DataFrame:
        return self._grain(["chunk_id"])

    @cached_property
    def comparison_period(self) -> DataFrame:
        return self._grain(ENTITY)

    @cached_property
    def comparison_daily(self) -> DataFrame:
        return self.keep(daily_marts(self.base_rolling, self.historical_base_rolling))

    @cached_property
    def condensed(self) -> DataFrame:
        return condensed(flags_of(self.comparison_daily), flags_of(self.comparison_chunk), flags_of(self.comparison_period))

    @cached_property
    def insect_rolling(self) -> DataFrame:
        return self.keep(insect_base(self.periods, self.weather, by_bird=False))

    @cached_property
    def historical_insect_rolling(self) -> DataFrame:
        return self.keep(insect_base(self.historical_periods, self.weather, ["effective_year"]))

    @cached_property
    def insect_comparison_daily(self) -> DataFrame:
        keys, rolled = [*ENTITY, "chunk_id", "day_idx"], [f"{m}_rolling" for m in [*INSECT, *WARM]]
        return compare(self.insect_rolling, over_years(self.historical_insect_rolling, keys, rolled), keys, rolled, ["weather_date"])

    @cached_property
    def insect_comparison_chunk(self) -> DataFrame:
        metrics = list(INSECT_CHUNK.values())
        past = over_years(insect_totals(self.historical_insect_rolling, ["chunk_id", "effective_year"]), ["chunk_id"], metrics)
        return compare(insect_totals(self.insect_rolling, ["chunk_id"]), past, ["chunk_id"], metrics)

    @cached_property
    def insect_scores(self) -> DataFrame:
        return insect_scores(flags_of(self.insect_comparison_daily), flags_of(self.insect_comparison_chunk))

    @cached_property
    def unified(self) -> DataFrame:
        return self.condensed.join(self.insect_scores.select(*ENTITY, "insect_presence_score"), ENTITY, "left")

    @cached_property
    def extended_all(self) -> DataFrame:
        return extended(self.unified, self.sightings, self.locations)

    @cached_property
    def extended_confirmed(self) -> DataFrame:
        return extended(self.unified, self.sightings, self.locations, True)

    @cached_property
    def features_all(self) -> DataFrame:
        return year_features(self.extended_all)

    @cached_property
    def features_confirmed(self) -> DataFrame:
        return year_features(self.extended_confirmed)


def build(sightings: DataFrame, seed: DataFrame, weather: DataFrame, keep: Callable[[DataFrame], DataFrame] = stored) -> Marts:
    return Marts(sightings, seed, weather, keep)


# --- over the driver's tables --------------------------------------------------------------------------


#: Temperature, sunshine, rain and wind of a day from its sales: divisor, modulus and unit.
SPREAD = {"q": (1, 30_011, 997), "p": (7, 50_021, 991), "d": (11, 12_007, 983), "t": (13, 8_009, 977)}


def inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Return flags as species at four sites each, their sightings by year, and weather of the sites from ship days, the same for all species."""
    x = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("flag"), F.to_date("l_shipdate").alias("date"), "l_extendedprice")
    # Remainders of a day's sales, spread by primes: no value lies on a threshold, on a whole deviation or on the edge of rounding.
    cents = x.groupBy("date").agg(F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("c"))
    day = cents.select("date", *[(F.expr(f"c div {step} % {most}").cast("double") / unit).alias(name) for name, (step, most, unit) in SPREAD.items()])
    sites = spark.range(1, 5).select(F.col("id").cast("int").alias("n"))
    bird = F.concat(F.lit("Bird "), F.col("flag"))
    key = F.lower(F.replace(bird, F.lit(" "), F.lit("_")))
    flags = x.select("flag").distinct()  # a row for each of three flags
    weather = day.join(F.broadcast(sites)).join(F.broadcast(flags)).select(
        key.alias("bird"), F.concat(F.lit("site_"), F.col("n")).alias("location_name"), "date", (F.col("q") / 2 + F.col("n")).alias("temperature_2m_mean"), (F.col("q") / 2 - 3).alias("temperature_2m_min"),
        (F.col("q") / 2 + 6).alias("temperature_2m_max"), F.col("d").alias("precipitation_sum"), (F.col("n") * 2.0).alias("precipitation_hours"), (F.col("p") * 60).alias("sunshine_duration"),
        (F.col("t") + F.col("n") + 0.0003).alias("wind_speed_10m_max"), (F.col("p") * 5).alias("wind_direction_10m_dominant"), (F.col("p") / 4).alias("shortwave_radiation_sum"),
    )
    seed = x.select("flag").distinct().join(F.broadcast(sites)).select(
        key.alias("bird"), F.concat(F.lit("Site "), F.col("n")).alias("location_name"), F.lit("Some Land").alias("country"), F.lit("Stopover site").alias("type"), F.col("n").alias("order_nr"),
        (F.col("n") * 5 + 20).cast("long").alias("weather_check_start"), (F.col("n") * 5).cast("long").alias("weather_check_end"), (F.col("n") * 40).cast("long").alias("migration_direction_arrival"),
        F.when(F.col("n") == 2, 10).otherwise(F.col("n") * 40).cast("long").alias("migration_direction_departure"),
    )
    years = spark.range(1999, 2002).select(F.col("id").cast("int").alias("year"))
    sightings = x.select("flag").distinct().join(F.broadcast(years)).select(
        bird.alias("common_name"), "year", F.date_add(F.make_date(F.col("year"), F.lit(5), F.lit(1)), F.ascii("flag") % 20 + F.col("year") % 7).alias("observation_date"), F.lit("normal").alias("status"),
    )
    return sightings, seed, weather


def _sql_inputs() -> str:
    return f"""flags AS (SELECT DISTINCT l_returnflag AS flag FROM lineitem), cents AS (SELECT CAST(l_shipdate AS DATE) AS date, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS c FROM lineitem GROUP BY 1),
day AS (SELECT date, {', '.join(f"CAST(c // {step} % {most} AS DOUBLE) / {unit} AS {name}" for name, (step, most, unit) in SPREAD.items())} FROM cents),
sites AS (SELECT CAST(unnest([1, 2, 3, 4]) AS INTEGER) AS n), weather AS (SELECT lower(concat('bird_', flag)) AS bird, concat('site_', n) AS location_name, date, (q / 2 - 3 + q / 2 + 6) / 2 AS daily_mean, coalesce(d / nullif(n * 2.0, 0), 0) AS rain, p AS sun, t + n + 0.0003 AS speed, p * 5 AS direction, d >= 10 AS rain10, q / 2 + n AS tmean, q / 2 - 3 AS tmin, q / 2 + 6 AS tmax, d AS precip, p / 4 AS srad FROM day, sites, flags),
legs AS (SELECT DISTINCT lower(concat('bird_', flag)) AS bird, concat('site_', n) AS location_name, n * 5 + 20 AS a, CASE WHEN n = 2 THEN n * 5 + 20 - 11 + 1 ELSE n * 5 END AS b, n * 5 + 34 AS i, n * 40 AS h FROM flags, sites UNION ALL SELECT DISTINCT lower(concat('bird_', flag)), 'site_2', 30 - 11, 10, NULL, 10 FROM flags),
seen AS (SELECT DISTINCT lower(concat('bird_', flag)) AS bird, y AS arrival_year, make_date(y, 5, 1) + CAST(ascii(flag) % 20 + y % 7 AS INTEGER) AS obs FROM flags, (SELECT unnest([1999, 2000, 2001]) AS y)),
al AS (SELECT *, CAST(unnest(generate_series(obs - CAST(coalesce(i, a) AS INTEGER), obs - CAST(b AS INTEGER), INTERVAL 1 DAY)) AS DATE) AS wd, obs - CAST(a AS INTEGER) AS ws FROM seen JOIN legs USING (bird)),
nm AS (SELECT *, wd < ws AS ins, row_number() OVER (PARTITION BY bird, arrival_year, location_name, wd < ws ORDER BY wd) AS rn, count(*) OVER (PARTITION BY bird, arrival_year, location_name, wd < ws) AS n FROM al),
per AS (SELECT bird, arrival_year, location_name, h, wd, ins, concat_ws('_', bird, arrival_year, location_name, CASE WHEN ins THEN 'insect' ELSE 'weather' END, CAST(CASE WHEN n <= 4 THEN 1 ELSE ceil(rn / ceil(n / CASE WHEN n % 3 = 1 THEN (n - 1) / 3.0 ELSE ceil(n / 3.0) END)) END AS BIGINT)) AS chunk_id FROM nm),
hist AS (SELECT bird, arrival_year, location_name, h, CAST(wd - to_years(CAST(k AS INTEGER)) AS DATE) AS wd, ins, chunk_id, arrival_year - k AS ey FROM per, (SELECT unnest(generate_series(1, 10)) AS k)),
nb AS (SELECT p.bird, p.arrival_year, p.location_name, p.wd, p.chunk_id, daily_mean, coalesce(rain, 0) AS rain, sun, speed * cos((direction - h) * pi() / 180) AS wind, rain10 FROM per p LEFT JOIN weather w ON p.bird = w.bird AND p.wd = w.date AND p.location_name = w.location_name WHERE NOT ins),
hb AS (SELECT p.bird, p.arrival_year, p.location_name, p.wd, p.chunk_id, ey, daily_mean, coalesce(rain, 0) AS rain, sun, speed * cos((direction - h) * pi() / 180) AS wind, rain10 FROM hist p LEFT JOIN weather w ON p.bird = w.bird AND p.wd = w.date AND p.location_name = w.location_name WHERE NOT ins)"""


_PERIOD = """SELECT bird, arrival_year, location_name{ey}, avg(daily_mean) AS m1, avg(rain) AS m2, avg(sun) AS m3, avg(wind) AS m4, CAST(count(CASE WHEN wind >= 5 THEN 1 END) AS DOUBLE) AS m5, CAST(count(CASE WHEN rain10 THEN 1 END) AS DOUBLE) AS m6, CAST(count(CASE WHEN rain >= 1 THEN 1 END) AS DOUBLE) AS m7 FROM {t} GROUP BY ALL"""
_OUT = list(zip([*DAILY, *COUNTS], [f"m{i}" for i in range(1, 8)], strict=True))


@query(
    f"""WITH {_sql_inputs()}, np AS ({_PERIOD.format(ey='', t='nb')}), hy AS ({_PERIOD.format(ey=', ey', t='hb')}),
hp AS (SELECT bird, arrival_year, location_name, {', '.join(f'avg({m}) AS {m}_a, stddev_samp({m}) AS {m}_s' for _, m in _OUT)} FROM hy GROUP BY ALL)
SELECT np.bird, CAST(np.arrival_year AS BIGINT) AS arrival_year, np.location_name, {', '.join(f"round({m} - {m}_a, 5) AS {n}_delta, CASE WHEN {m}_s < 1e-9 THEN 0.0 ELSE round(({m} - {m}_a) / {m}_s, 5) END AS {n}_z" for n, m in _OUT)} FROM np JOIN hp USING (bird, arrival_year, location_name)"""
)
def migration_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Period grain: arrival window against the same window of the ten years before."""
    p = build(*inputs(spark, sf_dir))["comparison_period"]
    j = []
    for m in [*DAILY, *COUNTS]:
        j += [F.round(f"{m}_delta", 5).alias(f"{m}_delta"), F.round(F.coalesce(f"{m}_z", F.when(F.col(f"{m}_flag") == 0, 0.0)), 5).alias(f"{m}_z")]
    return p.select("bird", F.col("arrival_year").cast("long").alias("arrival_year"), "location_name", *j)


@query(f"""WITH {_sql_inputs()} SELECT bird, CAST(arrival_year AS BIGINT) AS arrival_year, location_name, wd AS weather_date, ins AS insect_relevant_date, chunk_id FROM per""")
def migration_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Staging: expanded days in balanced chunks, both legs of a two-heading stop."""
    p = build(*inputs(spark, sf_dir))["periods"]
    return p.select("bird", F.col("arrival_year").cast("long").alias("arrival_year"), "location_name", "weather_date", "insect_relevant_date", "chunk_id")


@query(
    f"""WITH {_sql_inputs()}, np AS ({_PERIOD.format(ey=', chunk_id', t='nb')}), hy AS ({_PERIOD.format(ey=', chunk_id, ey', t='hb')}),
hp AS (SELECT chunk_id, {', '.join(f'avg({m}) AS {m}_a, stddev_samp({m}) AS {m}_s' for _, m in _OUT)} FROM hy GROUP BY ALL)
SELECT np.chunk_id, {', '.join(f"round({m} - {m}_a, 5) AS {n}_delta, CASE WHEN {m}_s IS NULL THEN NULL WHEN {m}_s < 1e-9 THEN 0.0 ELSE coalesce(round(({m} - {m}_a) / {m}_s, 5), 0.0) END AS {n}_z" for n, m in _OUT)} FROM np JOIN hp USING (chunk_id)"""
)
def migration_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk grain: three or four days against the same days of the ten years before."""
    c = build(*inputs(spark, sf_dir))["comparison_chunk"]
    return c.select("chunk_id", *_deltas([*DAILY, *COUNTS]))


def _deltas(metrics: Sequence[str], digits: int = 5) -> list[Column]:
    out = []
    for m in metrics:
        out += [F.round(f"{m}_delta", digits).alias(f"{m}_delta"), F.round(F.coalesce(f"{m}_z", F.when(F.col(f"{m}_flag") == 0, 0.0)), digits).alias(f"{m}_z")]
    return out


_ROLLED = list(zip([*(f"{m}_rolling" for m in DAILY), *COUNTS.values()], [f"m{i}" for i in range(1, 8)], strict=True))
_DAY = """SELECT bird, arrival_year, location_name, chunk_id{ey}, wd, row_number() OVER (PARTITION BY bird, arrival_year, location_name, chunk_id{ey} ORDER BY wd) AS di, avg(daily_mean) OVER w AS m1, avg(rain) OVER w AS m2, avg(sun) OVER w AS m3, avg(wind) OVER w AS m4,
count(CASE WHEN wind >= 5 THEN 1 END) OVER w / 3.0::DOUBLE AS m5, count(CASE WHEN rain10 THEN 1 END) OVER w / 3.0::DOUBLE AS m6, count(CASE WHEN rain >= 1 THEN 1 END) OVER w / 3.0::DOUBLE AS m7 FROM {t} WINDOW w AS (PARTITION BY bird, arrival_year, location_name{ey} ORDER BY wd ROWS 2 PRECEDING)"""


@query(
    f"""WITH {_sql_inputs()}, np AS ({_DAY.format(ey='', t='nb')}), hy AS ({_DAY.format(ey=', ey', t='hb')}),
hp AS (SELECT bird, arrival_year, location_name, chunk_id, di, {', '.join(f'avg({m}) AS {m}_a, stddev_samp({m}) AS {m}_s' for _, m in _ROLLED)} FROM hy GROUP BY ALL)
SELECT chunk_id, di AS day_idx, np.wd AS weather_date, {', '.join(f"round({m} - {m}_a, 6) AS {n}_delta, CASE WHEN {m}_s IS NULL THEN NULL WHEN {m}_s < 1e-9 THEN 0.0 ELSE coalesce(round(({m} - {m}_a) / {m}_s, 6), 0.0) END AS {n}_z" for n, m in _ROLLED)} FROM np JOIN hp USING (bird, arrival_year, location_name, chunk_id, di)"""
)
def migration_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily grain: three-day means and shares against the same place in the window of the ten years before."""
    d = build(*inputs(spark, sf_dir))["comparison_daily"]
    return d.select("chunk_id", F.col("day_idx").cast("long").alias("day_idx"), "weather_date", *_deltas([n for n, _ in _ROLLED], 6))


# --- the marts that join the grains --------------------------------------------------------------------


def _flag_sql(x: str, mean: str, sd: str) -> str:
    z = f"(({x} - {mean}) / nullif({sd}, 0))"
    return f"CASE WHEN {sd} IS NULL THEN NULL WHEN {sd} = 0 THEN 0.0 WHEN abs({z}) >= 2 THEN 2.0 * sign({z}) WHEN abs({z}) >= 1 THEN sign({z}) ELSE 0.0 END"


def _half_peak_sql(f: str) -> str:
    return f"0.5 * avg({f}) + 0.5 * sum(exp(0.7 * abs({f})) * {f}) / nullif(sum(exp(0.7 * abs({f}))), 0)"


def _flags_sql(name: str, now: str, past: str, keys: Sequence[str], metrics: Sequence[str]) -> str:
    """`<name>`: the flags of a grain; past has the keys and a year."""
    on = ", ".join(keys)
    over = ", ".join(f"avg({m}) AS {m}_a, stddev_samp({m}) AS {m}_s" for m in metrics)
    return f"{name} AS (SELECT {', '.join(f'n.{k}' for k in keys)}, {', '.join(_flag_sql(f'n.{m}', f'{m}_a', f'{m}_s') + f' AS {m}' for m in metrics)} FROM {now} n JOIN (SELECT {on}, {over} FROM {past} GROUP BY {on}) USING ({on}))"


_SEVEN, _ENTITY = [m for _, m in _OUT], "bird, arrival_year, location_name"
_CONDENSED = ",\n".join(
    [
        _sql_inputs(), f"pn AS ({_PERIOD.format(ey='', t='nb')})", f"py AS ({_PERIOD.format(ey=', ey', t='hb')})", _flags_sql("pf", "pn", "py", ENTITY, _SEVEN),
        f"cn AS ({_PERIOD.format(ey=', chunk_id', t='nb')})", f"cy AS ({_PERIOD.format(ey=', chunk_id, ey', t='hb')})", _flags_sql("cf", "cn", "cy", ["chunk_id"], _SEVEN),
        f"dn AS ({_DAY.format(ey='', t='nb')})", f"dy AS ({_DAY.format(ey=', ey', t='hb')})", _flags_sql("df", "dn", "dy", [*ENTITY, "chunk_id", "di"], _SEVEN),
        f"d AS (SELECT {_ENTITY}, {', '.join(f'{_half_peak_sql(m)} AS d_{m}' for m in _SEVEN)} FROM df GROUP BY ALL)",
        f"c AS (SELECT {_ENTITY}, {', '.join(f'{_half_peak_sql(f'cf.{m}')} AS c_{m}' for m in _SEVEN)} FROM df JOIN cf USING (chunk_id) GROUP BY ALL)",
        f"p AS (SELECT {_ENTITY}, {', '.join(f'avg({m}) AS p_{m}' for m in _SEVEN)} FROM pf GROUP BY ALL)",
        f"con AS (SELECT {_ENTITY}, " + ", ".join(
            f"({' + '.join(f'{w} * {sign} * {g}_{dict(_OUT)[m]}' for w, g in zip(WEIGHTS[kind], 'pcd', strict=True))}) / {sum(WEIGHTS[kind])} AS {score}" for score, (m, sign, kind) in SCORES.items()
        ) + f" FROM d FULL JOIN c USING ({_ENTITY}) FULL JOIN p USING ({_ENTITY}))",
    ]
)


@query(f"WITH {_CONDENSED} SELECT bird, CAST(arrival_year AS BIGINT) AS arrival_year, location_name, {', '.join(f'round({s}, 6) AS {s}' for s in SCORES)} FROM con")
def migration_condensed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven scores of each stop and year, from the flags of its period, chunks and days."""
    c = build(*inputs(spark, sf_dir))["condensed"]
    return c.select("bird", F.col("arrival_year").cast("long").alias("arrival_year"), "location_name", *[F.round(s, 6).alias(s) for s in SCORES])


def _insect_sql(name: str, rows: str, year: str) -> str:
    """`<name>`: warm, anomalous and optimal days with their three-row means."""
    keys = f"{_ENTITY}{year}"
    rolled = [f"avg({m}) OVER w AS r_{m}" for m in INSECT] + [f"count(CASE WHEN {m} THEN 1 END) OVER w / 3.0::DOUBLE AS r_{m}" for m in WARM]
    return f"""{name}_q AS (SELECT {keys}, quantile_disc(srad, 0.75) AS q FROM {rows} WHERE srad IS NOT NULL GROUP BY ALL),
{name}_b AS (SELECT *, tmean >= 10 AS warm10, tmean >= 15 AS warm15, tmean >= 20 AS warm20, tmean >= avg(tmean) OVER k + stddev_samp(tmean) OVER k AS warm_anomaly,
tmean BETWEEN 15 AND 25 AND precip < 2 AND srad >= greatest(5, coalesce(q, 5)) AS optimal_insect_day FROM {rows} LEFT JOIN {name}_q USING ({keys}) WINDOW k AS (PARTITION BY {keys})),
{name} AS (SELECT *, row_number() OVER (PARTITION BY {keys}, chunk_id ORDER BY wd) AS di, {', '.join(rolled)} FROM {name}_b WINDOW w AS (PARTITION BY {keys}, chunk_id ORDER BY wd ROWS 2 PRECEDING))"""


def _insect_chunks_sql(name: str, rows: str, keys: str) -> str:
    means = ", ".join(f"avg({m}) AS {m}_avg" for m in INSECT if m != "precip")
    return f"{name} AS (SELECT {keys}, {means}, sum(precip) AS precip_total, {', '.join(f'count(CASE WHEN {m} THEN 1 END)::DOUBLE AS {m.replace("_day", "")}_days' for m in WARM)} FROM {rows} GROUP BY {keys})"


_TEN = list(INSECT_CHUNK)
_DAILY_NAME = {m: f"r_{'optimal_insect_day' if m == 'optimal' else m}" for m in _TEN}
_SQL_LOGISTIC = "(1 / (1 + exp(-1.1 * ({}))))"
_INSECTS = ",\n".join(
    [
        "ni AS (SELECT p.bird, p.arrival_year, p.location_name, p.wd, p.chunk_id, tmean, tmin, tmax, precip, srad FROM per p LEFT JOIN weather w ON p.wd = w.date AND p.location_name = w.location_name)",
        "hi AS (SELECT p.bird, p.arrival_year, p.location_name, p.wd, p.chunk_id, ey, tmean, tmin, tmax, precip, srad FROM hist p LEFT JOIN weather w ON p.wd = w.date AND p.location_name = w.location_name AND p.bird = w.bird)",
        _insect_sql("ir", "ni", ""), _insect_sql("hr", "hi", ", ey"), _flags_sql("idf", "ir", "hr", [*ENTITY, "chunk_id", "di"], list(_DAILY_NAME.values())),
        _insect_chunks_sql("icn", "ir", "chunk_id"), _insect_chunks_sql("icy", "hr", "chunk_id, ey"), _flags_sql("icf", "icn", "icy", ["chunk_id"], list(INSECT_CHUNK.values())),
        f"idd AS (SELECT {_ENTITY}, {', '.join(f'{_half_peak_sql(_DAILY_NAME[m])} AS d_{m}' for m in _TEN)} FROM idf GROUP BY ALL)",
        f"icc AS (SELECT {_ENTITY}, {', '.join(f'{_half_peak_sql(f'icf.{c}')} AS c_{m}' for m, c in INSECT_CHUNK.items())} FROM idf JOIN icf USING (chunk_id) GROUP BY ALL)",
        f"iss AS (SELECT {_ENTITY}, {', '.join(f'{a} * c_{m} + {b} * d_{m} AS {m}' for m, (a, b) in INSECT_WEIGHTS.items())} FROM idd FULL JOIN icc USING ({_ENTITY}))",
        "ist AS (SELECT *, 0.40 * -ln(exp(-tmin) + exp(-tmean)) + CASE WHEN tmax IS NULL THEN NULL ELSE 0.15 * least(tmax, 1.5) END + " + " + ".join(f"CASE WHEN {m} IS NULL THEN NULL ELSE {k} * greatest({m}, 0) END" for m, k in (("warm10", 0.10), ("warm15", 0.15), ("warm20", 0.10))) + " + 0.10 * warm_anomaly AS thermal FROM iss)",
        f"isp AS (SELECT *, CASE WHEN thermal IS NULL OR srad IS NULL OR precip IS NULL THEN NULL ELSE 4 * (0.6 * pow(greatest(1e-6, {_SQL_LOGISTIC.format('thermal')} * {_SQL_LOGISTIC.format('srad')} * exp(-pow((precip - 0.5) / 1.1, 2))), 1.0 / 3) + 0.4 * {_SQL_LOGISTIC.format('optimal')} - 0.5) END AS insect_presence_score FROM ist)",
    ]
)


@query(f"WITH {_sql_inputs()},\n{_INSECTS} SELECT bird, CAST(arrival_year AS BIGINT) AS arrival_year, location_name, {', '.join(f'round({m}, 6) AS {m}' for m in [*_TEN, 'insect_presence_score'])} FROM isp")
def migration_insects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten insect scores of each stop and year and the presence score, from the flags of chunks and days."""
    i = build(*inputs(spark, sf_dir))["insect_scores"]
    return i.select("bird", F.col("arrival_year").cast("long").alias("arrival_year"), "location_name", *[F.round(m, 6).alias(m) for m in [*_TEN, "insect_presence_score"]])


_YEARS = ", ".join(f"round(max(CASE WHEN n = {n} THEN {f} END), 6) AS {s}_{f.replace('presence_', '')}" for n, s in SITES.items() for f in FEATURES)


@query(
    f"""WITH {_CONDENSED},\n{_INSECTS}, u AS (SELECT con.*, insect_presence_score, CAST(split_part(location_name, '_', 2) AS INTEGER) AS n FROM con LEFT JOIN isp USING ({_ENTITY})),
f AS (SELECT bird, arrival_year, dayofyear(obs) AS doy FROM seen), m AS (SELECT bird, quantile_disc(doy, 0.5) AS median, stddev_samp(doy) AS sd FROM f GROUP BY 1)
SELECT bird, CAST(arrival_year AS BIGINT) AS arrival_year, round(max(CASE WHEN sd > 0 THEN (doy - median) / sd END), 6) AS arrival_z_score, {_YEARS} FROM u JOIN f USING (bird, arrival_year) JOIN m USING (bird) GROUP BY 1, 2"""
)
def migration_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole chain: one row per species and year with thirty-two features."""
    f = build(*inputs(spark, sf_dir))["features_all"]
    names = [c for c in f.columns if c not in ("bird", "arrival_year")]
    return f.select("bird", F.col("arrival_year").cast("long").alias("arrival_year"), *[F.round(c, 6).alias(c) for c in names])
