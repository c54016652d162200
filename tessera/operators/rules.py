"""Gates, masks, directions, clearances, summaries and the remaining detectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import kernels as K

from .wellness import _finding, magnitude
from .windows import latest_per_key, ordered, rolling

no = lambda c: F.coalesce(c, F.lit(False))

#: Metric, sign of a good change, neutral band.
DIRECTIONS = (
    ("rhr_bpm", -1, 1.0),
    ("sleep_minutes", 1, 20.0),
    ("deep_sleep_minutes", 1, 8.0),
    ("rem_minutes", 1, 10.0),
    ("awake_minutes", -1, 8.0),
    ("sleep_score", 1, 5.0),
    ("sleep_stress", -1, 4.0),
    ("sleep_rr", -1, 0.5),
    ("waking_rr_brpm", -1, 0.5),
    ("avg_stress", -1, 4.0),
    ("high_stress_pct", -1, 3.0),
    ("body_battery_high", 1, 5.0),
    ("body_battery_low", 1, 5.0),
    ("hrv_rmssd_ms", 1, 0.0),
    ("hrv_proxy_nocturnal", 1, 0.0),
    ("bb_recharge_efficiency", 1, 0.05),
)
#: Metrics that a hard session explains, and metrics that accumulate over the day.
EXPLAINABLE = ("rhr_bpm", "hrv_proxy_nocturnal", "hrv_rmssd_ms", "body_battery_high", "body_battery_low", "bb_recharge_efficiency")
INTRADAY = ("steps", "avg_stress", "high_stress_pct", "body_battery_high", "body_battery_low")


def direction(metric: Column, delta: Column, baseline: Column) -> Column:
    """positive, neutral or negative; steps by their share of a baseline of at least 1000."""
    share = K.safe_divide(delta, baseline)
    steps = F.when(no(baseline >= 1000) & (share > 0.1), "positive").when(no(baseline >= 1000) & (share < -0.1), "negative").otherwise("neutral")
    out = F.when(metric == "steps", steps).otherwise("neutral")
    for name, sign, band in DIRECTIONS:
        out = F.when(metric == name, F.when(delta * sign > band, "positive").when(delta * sign < -band, "negative").otherwise("neutral")).otherwise(out)
    return F.when(delta.isNotNull(), out)


def explained_magnitude(metric: Column, size: Column, delta: Column, level: Column, rhr_bump: Column) -> Column:
    """The magnitude, or NULL where recent training explains the deviation."""
    tired = no(level != "none") & no(size != "noise")
    heart = (metric == "rhr_bpm") & no((delta > 0) & (delta <= F.coalesce(rhr_bump, F.lit(0.0)) + 3))
    variability = metric.isin("hrv_proxy_nocturnal", "hrv_rmssd_ms") & size.isin("mild", "significant") & (delta.isNull() | (delta <= 0))
    mild = metric.isin(*EXPLAINABLE) & level.isin("moderate", "high") & (size == "mild")
    return F.when(~no(tired & (heart | variability | mild)), size)


def metric_confidence(metric: Column, today: Column, baseline: Column, size: Column, implausible_sleep: Column) -> Column:
    low = (
        today.isNull() | ((metric == "sleep_minutes") & no(implausible_sleep)) | (no((today == 0) & (baseline > 0)) & metric.isin("sleep_minutes", "deep_sleep_minutes", "rem_minutes", "light_minutes"))
        | ((metric == "rhr_bpm") & no((today < 30) | (today > 120))) | (metric.isin("waking_rr_brpm", "sleep_rr") & no((today < 6) | (today > 30))) | (size.isNull() & baseline.isNull())
    )
    return F.when(low, "low").when(metric == "hrv_proxy_nocturnal", "medium").otherwise("high")


def mask_unable(metric: Column, value: Column, able: dict[str, bool]) -> Column:
    """NULL for metrics that the device cannot measure."""
    bad = [m for m, ok in able.items() if not ok]
    return F.when(~metric.isin(*bad), value) if bad else value


def mask_partial(metric: Column, value: Column, complete: Column) -> Column:
    """Accumulating metrics of a day that is not over are NULL."""
    return F.when(complete | ~metric.isin(*INTRADAY), value)


def nocturnal_index(samples: DataFrame, keys: Sequence[str], at: str, rate: str) -> DataFrame:
    """Of the samples in the sleep window: -0.5 min + 2 max(0, mean of the first sixth - min); NULL below three."""
    s = samples.filter(F.col(rate) > 0).withColumn("_i", F.row_number().over(ordered(keys, at))).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    first = F.avg(F.when(F.col("_i") <= F.greatest(F.lit(1), F.floor(F.col("_n") / 6)), F.col(rate)))
    low = F.min(rate)
    return s.groupBy(*keys).agg(F.when(F.max("_n") >= 3, -0.5 * low + 2 * F.greatest(F.lit(0.0), first - low)).alias("nocturnal_index"))


def clearance(c: dict[str, Column], threshold_hr: int | None = None) -> Column:
    """struct(floor, session, hours, cap) for a green, rested day; NULL otherwise. c: state, illness, fatigue, since_hard, recovery, cognitive, load_ratio, hard_days."""
    clear = no(c["state"] == "green") & ~no(c["illness"]) & (F.coalesce(c["fatigue"], F.lit("none")) == "none") & ~no(c["since_hard"] < 3) & no(c["recovery"].isin("high", "mid"))
    hard = no(c["load_ratio"] < 1.3) & no(c["recovery"] == "high") & no(c["cognitive"].isin("high", "mid"))
    cap = lambda less: F.lit(None if threshold_hr is None else threshold_hr - less).cast("int")
    plan = lambda floor, kind, hours, less: F.struct(F.lit(floor).alias("floor"), F.lit(kind).alias("session"), F.lit(hours).alias("hours"), cap(less).alias("cap"))
    return F.when(clear & hard & (c["hard_days"] >= 2), plan("hard_ok", "tempo", "1.5", 10)).when(clear & hard, plan("hard_ok", "endurance_z2", "2-3", 15)).when(clear, plan("normal", "endurance_z2", "1.5", 15))


def is_hard_day(tss: Column, effort: Column, minutes: Column) -> Column:
    """Hard by effective stress above 100, by effort alone, or by an hour of intensity."""
    t, e, m = (F.coalesce(x, F.lit(0.0)) for x in (tss, effort, minutes))
    return (K.effective_tss(t, e) > 100) | (m >= 60)


def training_week(acts: DataFrame, keys: Sequence[str], day: str, target: Column, digits: int = 1, effort_alone: bool = True) -> DataFrame:
    """Seven days in one row: minutes, stress, sport mix, hardest session, hard days, days since rest and since a hard day.

    acts: day, minutes, tss, effort, sport, name. Without `effort_alone` a day without stress is not hard.
    """
    a = acts.filter((F.col(day) > F.date_sub(target, 7)) & (F.col(day) <= target))
    sports = a.groupBy(*keys, "sport").agg(F.round(F.sum("minutes"), digits).alias("m")).groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("sport", "m")))).alias("sport_mix"))
    daily = a.groupBy(*keys, day).agg(F.sum("tss").alias("t"), F.max("effort").alias("e")).withColumn("hard", is_hard_day(F.col("t"), F.col("e"), F.lit(0.0)) & (F.lit(effort_alone) | (F.coalesce("t", F.lit(0.0)) > 0)))
    hard = daily.groupBy(*keys).agg(F.count_if("hard").alias("hard_days"), F.datediff(target, F.max(F.when(F.col("hard"), F.col(day)))).alias("days_since_hard"))
    total = a.groupBy(*keys).agg(F.round(F.sum("minutes"), digits).alias("total_minutes"), F.round(F.sum("tss"), digits).alias("total_tss"), F.max_by("name", F.struct("tss", "name")).alias("hardest"))
    return total.join(sports, list(keys)).join(hard, list(keys)).join(days_since_rest(acts, keys, day, target), list(keys), "left").na.fill(0, ["days_since_rest"])


def days_since_rest(acts: DataFrame, keys: Sequence[str], day: str, target: Column, cap: int = 14) -> DataFrame:
    """Consecutive trained days back from the day before the target."""
    d = acts.select(*keys, day).distinct().filter((F.col(day) < target) & (F.col(day) >= F.date_sub(target, cap)))
    back = F.datediff(target, F.col(day)) - F.row_number().over(ordered(keys, F.desc(day)))
    return d.withColumn("_b", back).groupBy(*keys).agg(F.least(F.count_if(F.col("_b") == 0), F.lit(cap)).alias("days_since_rest"))


def argmax_with_ties(scores: dict[str, Column]) -> Column:
    """Name of the highest score; of ties the one listed first; missing scores count as 0."""
    n = len(scores)
    best = F.greatest(*[F.struct(F.coalesce(s, F.lit(0)).cast("double").alias("s"), F.lit(n - i).alias("t"), F.lit(k).alias("k")) for i, (k, s) in enumerate(scores.items())])
    return best["k"]


def needs_scoring(scored_at: Column, changed_at: Column, flags: Sequence[Column], posted: Column, seen: Column, now: Column, max_age_days: int | None) -> Column:
    """Never scored, changed since, or a flag missing; and not older than the limit."""
    missing = F.lit(False)
    for f in flags:
        missing = missing | f.isNull()
    due = scored_at.isNull() | no(changed_at > scored_at) | missing
    return due if max_age_days is None else due & (F.coalesce(posted, seen) >= now - F.expr(f"interval {max_age_days} days"))


def worth_narrating(score: Column, before: Column) -> Column:
    return no(score != before) & (no(score >= 2) | no(before >= 2))


def cached_verdicts(jobs: DataFrame, verdicts: DataFrame, key: str = "employer") -> tuple[DataFrame, DataFrame]:
    """(jobs of accepted employers, employers that still need a verdict), by normalised name."""
    from tessera.functions.text import squeeze

    j = jobs.withColumn("_k", squeeze(F.col(key)))
    v = verdicts.select(squeeze(F.col(key)).alias("_k"), "accepted").dropDuplicates(["_k"])
    passed = j.join(v.filter("accepted"), "_k", "left_semi").drop("_k")
    return passed, j.select("_k").distinct().join(v, "_k", "left_anti").withColumnRenamed("_k", key)


def approve(df: DataFrame, score: str, least: float) -> DataFrame:
    """Adds `approved`; a score that is no number counts as 0."""
    return df.withColumn("approved", F.coalesce(F.col(score).try_cast("double"), F.lit(0.0)) >= least)


def score_summary(df: DataFrame, score: str, least: float, key: str, most: int = 20) -> DataFrame:
    """total, approved, rejected and mean of the scores, beside the lowest rejected (place, key, score), `most` rows at most."""
    s = approve(df, score, least).withColumn("score", F.coalesce(F.col(score).try_cast("double"), F.lit(0.0)))
    whole = s.agg(F.count(F.lit(1)).alias("total"), F.count_if("approved").alias("approved"), F.count_if(~F.col("approved")).alias("rejected"), F.round(F.avg("score"), 1).alias("mean"))
    lowest = s.filter("not approved").orderBy("score", key).limit(most).select(F.row_number().over(Window.orderBy("score", key)).cast("long").alias("place"), key, "score")
    return whole.join(F.broadcast(lowest), F.lit(True), "left")  # one row against a few


def career_links(pages: DataFrame, most: int = 12) -> DataFrame:
    """Links of a page that look like careers pages, the most promising first: (page_id, url, score)."""
    from tessera.functions.text import parse_board_url

    links = pages.select("page_id", "url", F.explode(F.regexp_extract_all("html", F.lit(r'(?is)<a\b[^>]*\bhref="([^"#][^"]*)"[^>]*>(?:.*?)</a>'), F.lit(1))).alias("href"))
    links = links.filter(~F.lower("href").rlike("^(mailto|tel|javascript):"))
    root = F.regexp_extract("url", r"^([a-z]+://[^/?#]+)", 1)
    full = F.when(F.col("href").rlike("^[a-z]+://"), F.col("href")).when(F.col("href").startswith("/"), F.concat(root, "href")).otherwise(F.concat(root, F.lit("/"), "href"))
    host = lambda c: F.regexp_replace(F.lower(F.regexp_extract(c, r"^[a-z]+://([^/?#:]+)", 1)), r"^www\.", "")
    links = links.withColumn("link", full)
    same = (host(F.col("link")) == host(F.col("url"))) | host(F.col("link")).endswith(F.concat(F.lit("."), host(F.col("url"))))
    word = F.col("link").rlike(r"(?i)career|jobs?\b|join-?us|vacanc|work-with-us|hiring")
    score = F.when(parse_board_url(F.col("link"))[0].isNotNull(), 100).otherwise(0) + F.when(word, 40).otherwise(0) + F.when(same, 10).otherwise(0)
    ranked = links.select("page_id", F.regexp_replace("link", "/+$", "").alias("link"), score.alias("score")).filter("score > 0").dropDuplicates(["page_id", "link"])
    return latest_per_key(ranked, ["page_id"], F.desc("score"), F.asc("link"), n=most)


def outlooks(days: DataFrame, anchors: DataFrame, keys: Sequence[str] = ("region",)) -> DataFrame:
    """Recent outlook of each region-day as map<metric, struct(percentile_approx, value)>: a "7-day" slice spans eight dates.

    days: date, precipitation, temperature, discharge. anchors: region, month, <metric>_p20/_p80/_p95, of daily values.
    """
    week = Window.partitionBy(*keys).orderBy(F.unix_date("date")).rangeBetween(-7, 0)
    d = days.withColumns({"rain_7": F.sum("precipitation").over(week), "heat_7": F.max("temperature").over(week), "flow_7": F.sum("discharge").over(week), "month": F.month("date")}).join(anchors, [*keys, "month"], "left")

    def entry(value: str, metric: str, scale: float, unit: str) -> Column:
        p = K.anchor_percentile(F.col(value), [(q, F.col(f"{metric}_p{q}") * scale) for q in (20, 80, 95)])
        return F.struct(F.round(p, 1).alias("percentile_approx"), F.col(value).alias("value"), F.lit(unit).alias("unit"))

    parts = {"precipitation_7d_sum_mm": entry("rain_7", "precipitation", 7.0, "mm"), "temperature_7d_max_C": entry("heat_7", "temperature", 1.0, "°C"), "river_discharge_7d_sum_m3s": entry("flow_7", "discharge", 7.0, "m3/s")}
    whole = F.create_map(*[x for k, v in parts.items() for x in (F.lit(k), v)])
    return d.select(*keys, "date", F.map_filter(whole, lambda k, v: v["percentile_approx"].isNotNull()).alias("outlook"))


# --- detectors -----------------------------------------------------------------------------------------


def detect_positive(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The first of four good signs. df: proxy_pct, rem_direction, rem_magnitude, rem_max, rhr_direction, rhr_min, recovery_band, recovery_direction."""
    good = no(F.col("rem_direction") == "positive")
    salience = (
        F.when(no(F.col("proxy_pct") >= 75) & good & no(F.col("rem_magnitude").isin("mild", "significant", "strong")), 68)
        .when(no((F.col("recovery_direction") == "improving") & (F.col("recovery_band") == "high")), 65).when(good & no(F.col("rem_max")), 60).when(no(F.col("rhr_direction") == "positive") & no(F.col("rhr_min")), 58)
    )
    return _finding(df.withColumn("_s", salience).filter(F.col("_s").isNotNull()), keys, "positive_reinforcement", F.col("_s"), rule=F.col("_s"))


def detect_work_stress(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A high day before, by work or by exercise. df: avg, vs_baseline, magnitude, peak_by_exercise."""
    hit = df.filter(no(F.col("magnitude").isin("mild", "significant", "strong")) | no(F.col("vs_baseline") >= 6))
    sport = no(F.col("peak_by_exercise"))
    named = _finding(hit, keys, "x", F.when(sport, 70).otherwise(78), avg=F.col("avg"), by_exercise=sport)
    return named.withColumn("id", F.when(F.col("supporting")["by_exercise"] == "true", "yesterday_exercise_stress").otherwise("yesterday_work_stress"))


def detect_rising_stress(df: DataFrame, keys: Sequence[str], day: str, value: str) -> DataFrame:
    """Seven against thirty rows up by 4 with a run of two rises, or by 6; of at least fourteen rows."""
    from .windows import rising_streak

    n = F.count(F.lit(1)).over(ordered(keys, day).rowsBetween(-29, 0))
    drift = rolling(F.col(value), F.avg, keys, day, 7) - rolling(F.col(value), F.avg, keys, day, 30)
    d = latest_per_key(rising_streak(df.withColumns({"_n": n, "_d": drift}), value, keys, day, "_run"), keys, F.desc(day))
    hit = d.filter((F.col("_n") >= 14) & (F.col("_d") >= 4) & ((F.col("_run") >= 2) | (F.col("_d") >= 6)))
    return _finding(hit, keys, "stress_trend_rising", F.lit(62), drift=F.round("_d", 6), run=F.col("_run"))


def detect_stress_timing(df: DataFrame, keys: Sequence[str], day: str) -> DataFrame:
    """Work hours dominate the last seven days: 3 above the rest, in four comparisons. df: morning, work, evening."""
    last = latest_per_key(df, keys, F.desc(day), n=7)
    above = lambda c: F.count_if(F.col("work") > F.coalesce(c, F.lit(0.0)))
    others = (F.coalesce(F.sum("morning"), F.lit(0.0)) + F.coalesce(F.sum("evening"), F.lit(0.0))) / (F.count("morning") + F.count("evening"))
    g = last.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("work").alias("w"), F.when(F.count("morning") + F.count("evening") > 0, others).alias("o"), (above("morning") + above("evening")).alias("d"))
    return _finding(g.filter((F.col("n") >= 5) & (F.col("w") > F.col("o") + 3) & (F.col("d") >= 4)), keys, "stress_timing_pattern", F.lit(58), work=F.round("w", 1), others=F.round("o", 1))


def detect_poor_recovery(df: DataFrame, keys: Sequence[str], day: str, rest: str) -> DataFrame:
    """Rest share of seven rows below the norm less 3, or below 15."""
    n = F.count(F.lit(1)).over(ordered(keys, day).rowsBetween(-29, 0))
    d = latest_per_key(df.withColumns({"_n": n, "_r": rolling(F.col(rest), F.avg, keys, day, 7), "_b": rolling(F.col(rest), F.avg, keys, day, 30)}), keys, F.desc(day))
    return _finding(d.filter((F.col("_n") >= 14) & ((F.col("_r") < F.col("_b") - 3) | (F.col("_r") < 15))), keys, "stress_poor_daytime_recovery", F.lit(55), rest=F.round("_r", 1), norm=F.round("_b", 1))


def long_findings(long: DataFrame) -> DataFrame:
    """metric, delta, baseline rows with their magnitude and direction, one select."""
    return long.withColumns({"magnitude": magnitude(F.col("metric"), F.col("delta")), "direction": direction(F.col("metric"), F.col("delta"), F.col("baseline"))})
