"""Daily wellness rules as columns: baselines, magnitudes, load, fatigue, states and detectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import kernels as K

from .stats import correlation_tier, tercile_contrast
from .windows import ewma, latest_per_key, ordered, within_days

#: Metric, direction of concern (+1 up, -1 down), thresholds of mild, significant and strong.
MAGNITUDES = (
    ("rhr_bpm", 1, 2.0, 5.0, 8.0),
    ("sleep_minutes", -1, -25.0, -50.0, -90.0),
    ("deep_sleep_minutes", -1, -10.0, -25.0, -40.0),
    ("rem_minutes", -1, -10.0, -25.0, -40.0),
    ("light_minutes", -1, -15.0, -30.0, -50.0),
    ("awake_minutes", 1, 10.0, 25.0, 45.0),
    ("sleep_score", -1, -7.0, -15.0, -25.0),
    ("sleep_stress", 1, 5.0, 12.0, 20.0),
    ("sleep_rr", 1, 0.7, 1.5, 2.5),
    ("waking_rr_brpm", 1, 0.7, 1.5, 2.5),
    ("bb_recharge_efficiency", -1, -0.05, -0.12, -0.2),
    ("avg_stress", 1, 5.0, 12.0, 20.0),
    ("high_stress_pct", 1, 3.0, 8.0, 15.0),
    ("body_battery_high", -1, -8.0, -18.0, -30.0),
    ("body_battery_low", -1, -8.0, -15.0, -25.0),
)
#: Recency weights of seven nights, oldest first.
NIGHT_WEIGHTS = (0.06, 0.09, 0.12, 0.15, 0.18, 0.20, 0.20)


def magnitude(metric: Column, delta: Column) -> Column:
    """noise, mild, significant or strong, by the metric's thresholds; NULL for unknown metrics or deltas."""
    out = F.lit(None).cast("string")
    for name, sign, a, b, c in MAGNITUDES:
        d = delta * sign
        beyond = (lambda t: d >= t * sign)
        rung = F.when(beyond(c), "strong").when(beyond(b), "significant").when(beyond(a), "mild").otherwise("noise")
        out = F.when((metric == name) & delta.isNotNull(), rung).otherwise(out)
    return out


def steps_magnitude(delta: Column, baseline: Column) -> Column:
    r = K.safe_divide(delta, baseline)
    low = delta.isNull() | baseline.isNull() | (baseline < 1000)
    return F.when(low | (r > -0.2), "noise").when(r > -0.4, "mild").when(r > -0.6, "significant").otherwise("strong")


def effective_delta(delta: Column, p25: Column, p75: Column, resolution: float) -> Column:
    """NULL where the usual spread is below the device's resolution and the change below twice of it."""
    return F.when(~F.coalesce((F.abs(p75 - p25) < resolution) & (F.abs(delta) < 2 * resolution), F.lit(False)), delta)


def tier_of_tss(tss: Column, minutes: Column) -> Column:
    return F.when(tss > 130, "very_hard").when(tss > 100, "hard").when((tss > 65) | (minutes >= 45), "moderate").otherwise("easy")


def tier_of_effort(effort: Column) -> Column:
    return F.when(effort >= 130, "very_hard").when(effort >= 100, "hard").when(effort >= 50, "moderate").otherwise("easy")


def intensity_label(tss: Column, effort: Column, minutes: Column, trained=True) -> Column:
    t, e, m = (F.coalesce(x, F.lit(0.0)) for x in (tss, effort, minutes))
    tier = tier_of_tss(K.effective_tss(t, e), m)
    tier = F.when((e <= 0) & (m >= 45) & (tier == "easy"), "moderate").otherwise(tier)
    return F.when(~K.lit(trained), "rest").when((t <= 0) & (e > 0), tier_of_effort(e)).otherwise(tier)


def cached_untrusted(seconds: Column, watts: Column, effort: Column, cached: Column, source: Column) -> Column:
    """Power stress that is far too small for a long ride's watts or effort."""
    t = F.coalesce(cached, F.lit(0.0))
    small = (F.coalesce(watts >= 120, F.lit(False)) & (t < 25)) | ((F.coalesce(effort, F.lit(0.0)) >= 80) & (t < 40))
    return F.coalesce(source == "power", F.lit(False)) & (F.coalesce(seconds, F.lit(0)) >= 1800) & small


def activity_stress(c: dict[str, Column], ftp: float, threshold_hr: float) -> Column:
    """struct(tss, source): a trusted cache, power, effort, heart rate, else none. c: seconds, watts, effort, heart_rate, cached, source, power."""
    source = F.coalesce(c["source"], F.lit("cached"))
    trusted = c["cached"].isNotNull() & ~cached_untrusted(c["seconds"], c["watts"], c["effort"], c["cached"], source)
    pair = lambda t, s: F.struct(t.cast("double").alias("tss"), K.lit(s).alias("source"))
    return (
        F.when(trusted, pair(c["cached"], source)).when(c["power"].isNotNull(), pair(K.tss_from_power(c["power"], c["seconds"], F.lit(float(ftp))), "power"))
        .when(F.coalesce(c["effort"], F.lit(0.0)) != 0, pair(c["effort"], "suffer_score"))
        .when(c["heart_rate"].isNotNull(), pair(K.tss_from_heart_rate(c["heart_rate"], c["seconds"], F.lit(float(threshold_hr))), "hr")).otherwise(pair(F.lit(0.0), "none"))
    )


def normalized_power(samples: DataFrame, keys: Sequence[str], order: str = "t", watts: str = "watts") -> DataFrame:
    """Fourth-power mean of 30-sample rolling means (15 at least); NULL below 30 samples."""
    w = ordered(keys, order).rowsBetween(-29, 0)
    roll = F.when(F.count(watts).over(w) >= 15, F.avg(watts).over(w))
    rolled = samples.withColumn("_r", roll).groupBy(*keys).agg(F.avg(F.pow("_r", F.lit(4.0))).alias("_m"), F.count(F.lit(1)).alias("_n"))
    return rolled.select(*keys, F.when(F.col("_n") >= 30, F.pow("_m", F.lit(0.25))).alias("normalized_power"))


def half_drift(samples: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """Relative change of the mean from the first to the second half; NULL below 60 samples."""
    at = F.row_number().over(ordered(keys, order)) - 1
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    half = samples.withColumn("_first", at < F.floor(n / 2)).withColumn("_n", n)
    a, b = F.avg(F.when(F.col("_first"), F.col(value))), F.avg(F.when(~F.col("_first"), F.col(value)))
    return half.groupBy(*keys).agg(F.when(F.max("_n") >= 60, K.safe_divide(b - a, F.nullif(a, F.lit(0.0)))).alias("drift"))


def load_metrics(daily: DataFrame, keys: Sequence[str], day: str, tss: str) -> DataFrame:
    """atl, ctl, load_ratio, monotony and strain from the last 14, 60 and 7 days that have a value."""
    atl = ewma(daily, keys, day, tss, 7, 14).withColumnRenamed("ewma", "_a")
    ctl = ewma(daily, keys, day, tss, 42, 60).withColumnRenamed("ewma", "_c")
    week = latest_per_key(daily, keys, F.desc(day), n=7).groupBy(*keys).agg(F.avg(tss).alias("_m"), F.stddev_samp(tss).alias("_s"), F.sum(tss).alias("_t"))
    mono = F.when(F.col("_s") > 0, F.col("_m") / F.col("_s")).otherwise(0.0)
    out = atl.join(ctl, list(keys)).join(week, list(keys))
    ratio = F.when(F.col("_c") > 0, F.col("_a") / F.col("_c")).otherwise(0.0)
    return out.select(*keys, F.round("_a", 1).alias("atl"), F.round("_c", 1).alias("ctl"), F.round(ratio, 2).alias("load_ratio"), F.round(mono, 2).alias("monotony"), F.round(F.col("_t") * mono, 1).alias("strain"))


def sleep_debt(nights: DataFrame, keys: Sequence[str], target: Column, typical: Column, day: str = "date", minutes: str = "sleep_minutes") -> DataFrame:
    """Signed balance of the seven nights to the target, recency-weighted if all are there, with its status."""
    rows = nights.filter((F.col(minutes) > 0) & (F.col(day) >= F.date_sub(target, 6)) & (F.col(day) <= target))
    d = F.round(F.col(minutes) - typical).cast("long")
    rows = rows.withColumn("_d", d).withColumn("_i", F.row_number().over(ordered(keys, day)))
    weights = F.element_at(F.array(*map(F.lit, NIGHT_WEIGHTS)), F.col("_i"))
    sums = rows.groupBy(*keys).agg(
        F.sum("_d").alias("balance"), F.count(F.lit(1)).alias("nights"), F.count_if(F.col("_d") < 0).alias("short"), (F.sum(F.col("_d") * weights) / sum(NIGHT_WEIGHTS)).alias("_w"),
        F.max(F.when(F.col(day) == target, F.col("_d"))).alias("last_night"),
    )
    judged = F.when(F.col("nights") == 7, F.round("_w")).otherwise(F.col("balance"))
    status = F.when(judged >= 60, "surplus").when(judged > -60, "on_track").when(judged > -150, "mild_deficit").otherwise("notable_deficit")
    last = F.coalesce("last_night", F.lit(0))
    surfaced = (last <= -90) | (status == "notable_deficit") | ((status == "mild_deficit") & (last < -30))
    return sums.select(*keys, "balance", "short", last.alias("last_night"), status.alias("status"), surfaced.alias("surfaced"))


def z_of(value: Column, window) -> Column:
    """z of a value against the values of a frame: five at least, and some spread."""
    x = value
    sd = F.stddev_samp(x).over(window)
    return F.when((F.count(x).over(window) >= 5) & (sd > 0), (x - F.avg(x).over(window)) / sd)


def sleep_quality(deep_z: Column, rem_z: Column, efficiency_z: Column) -> Column:
    parts = [(0.40, deep_z), (0.35, rem_z), (0.25, efficiency_z)]
    weight = sum((F.when(z.isNotNull(), w).otherwise(0.0) for w, z in parts), F.lit(0.0))
    return F.round(F.try_divide(sum((F.coalesce(z * w, F.lit(0.0)) for w, z in parts), F.lit(0.0)), F.nullif(weight, F.lit(0.0))), 3)


def fatigue(label: Column, effective: Column, delayed_mild_only: Column) -> Column:
    """struct(level, rhr_bump, proxy_dip) of the day after a session."""
    hard = label.isin("hard", "very_hard") | (effective > 100)
    moderate = (label == "moderate") | ((effective > 65) & (effective <= 100))
    high = (label == "very_hard") | (effective > 120)
    out = lambda level, bump, dip: F.struct(F.lit(level).alias("level"), F.lit(bump).alias("rhr_bump"), F.lit(dip).alias("proxy_dip"))
    return (
        F.when(~F.coalesce(hard | moderate, F.lit(False)), out("none", 0.0, 0.0)).when(delayed_mild_only, out("mild", 1.0, 0.15))
        .when(hard & high, out("high", 4.0, 0.6)).when(hard, out("moderate", 2.5, 0.35)).otherwise(out("mild", 1.5, 0.2))
    )


def illness_watch(rhr_z: Column, proxy_z: Column, waking_z: Column, sleep_rr_z: Column, fatigue_level: Column) -> Column:
    """low, moderate or elevated where resting rate, respiration and the proxy agree and training does not explain it."""
    no = lambda c: F.coalesce(c, F.lit(False))
    gate = ~no(fatigue_level.isin("moderate", "high")) & no(rhr_z >= 1) & (no(waking_z >= 1) | no(sleep_rr_z >= 1)) & no(proxy_z <= -0.75)
    strength = F.greatest(rhr_z, F.coalesce(waking_z, F.lit(0.0)), F.coalesce(sleep_rr_z, F.lit(0.0)), F.abs(proxy_z))
    return F.when(gate & (strength >= 2), "elevated").when(gate & (strength >= 1.5), "moderate").when(gate, "low")


def patterns(flags: Column, load_ratio: Column, ctl: Column, fatigue_level: Column, hrv_ok: Column, ctl_floor: float = 30) -> Column:
    has = lambda f: F.array_contains(flags, f)
    tired = F.coalesce(fatigue_level.isin("moderate", "high"), F.lit(False))
    found = {
        "pre_illness_signal": ~tired & has("rhr_elevated_7d") & (has("waking_rr_up") | has("sleep_rr_up")) & (has("sleep_fragmented") | has("body_battery_low")),
        "overreaching": has("load_ratio_high") & (has("rhr_elevated_7d") | has("sleep_short")) & (ctl >= ctl_floor),
        "burnout_accumulation": has("days_since_rest_long") & has("monotony_rising") & has("stress_high_5d"),
        "healthy_adaptation": (F.size(flags) == 0) & (ctl >= ctl_floor) & load_ratio.between(0.8, 1.2) & hrv_ok,
    }
    return F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in found.items()]), lambda x: x.isNotNull())


def health_state(c: dict[str, Column], ctl_floor: float = 30) -> Column:
    """red, yellow or green. c: strong, significant, mild (counts), illness, load_ratio, ctl, patterns, hrv, fatigue, short_sleep, since_rest."""
    tired = F.coalesce(c["fatigue"].isin("moderate", "high"), F.lit(False)) & ~c["illness"]
    risks = F.array_intersect(c["patterns"], F.array(*map(F.lit, ("pre_illness_signal", "overreaching", "burnout_accumulation"))))
    risks = F.when(tired, F.array_remove(risks, "pre_illness_signal")).otherwise(risks)
    overreach = (c["load_ratio"] >= 1.3) & (c["ctl"] >= ctl_floor)
    low_hrv = F.coalesce(c["hrv"].isin("low", "poor"), F.lit(False))
    red = (c["strong"] >= 1) | (c["significant"] >= 2) | c["illness"] | overreach | (F.size(risks) > 0) | (low_hrv & ~tired)
    yellow = (c["significant"] == 1) | (c["mild"] >= 2) | F.coalesce(c["hrv"].isin("unbalanced", "low", "poor"), F.lit(False)) | ((c["load_ratio"] >= 1.2) & (c["load_ratio"] < 1.3) & (c["ctl"] >= ctl_floor)) | (c["since_rest"] >= 7)
    softened = tired & ~overreach & ~c["short_sleep"]
    return F.when(red & softened, "yellow").when(red, "red").when(yellow, "yellow").otherwise("green")


def stress_day(samples: DataFrame, keys: Sequence[str], ts: str, level: str, bands: dict[str, tuple[int, int]], every_minutes: int = 2, least: int = 6, order: str | None = None) -> DataFrame:
    """One row per day: mean of each band of hours, peak hour window, its mean, high minutes and rest share.

    Levels are added in the order of a unique column (`ts` by default), so that a sum's last digit does not
    depend on how the rows are dealt; a mean is scaled before it is rounded, so that such a digit decides no tie.
    """
    order = order or ts
    s = samples.filter(F.col(level) >= 0).withColumn("_h", F.hour(ts))
    last = lambda keys: ordered(keys, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = {name: F.when(K.in_band(F.col("_h"), a, b), F.col(level)) for name, (a, b) in bands.items()}
    s = s.withColumns({f"_{name}": F.sum(v).over(last(keys)) for name, v in inside.items()}).withColumn("_s", F.sum(level).over(last([*keys, "_h"])))
    hours = s.groupBy(*keys, "_h").agg((F.max_by("_s", order) / F.count(F.lit(1))).alias("_m"))
    peak = hours.groupBy(*keys).agg(F.max(F.struct("_m", (-F.col("_h")).alias("n"))).alias("p"))
    tenth = lambda v: F.round(v * 10) / 10
    means = [tenth(F.max(F.struct(order, f"_{name}"))[f"_{name}"] / F.nullif(F.count(v), F.lit(0))).alias(name) for name, v in inside.items()]
    rest = tenth(F.avg(F.when(F.col(level) <= 25, 100.0).otherwise(0.0)))
    base = s.groupBy(*keys).agg(*means, (F.count_if(F.col(level) >= 50) * every_minutes).alias("high_minutes"), rest.alias("rest_pct"), F.count(F.lit(1)).alias("_n"))
    hour = -F.col("p.n")
    window = F.format_string("%02d:00–%02d:00", hour, (hour + 3) % 24)
    return base.filter(F.col("_n") >= least).join(peak, list(keys)).select(*keys, *bands, window.alias("peak_window"), F.round("p._m").cast("long").alias("peak_value"), "high_minutes", "rest_pct")


def trajectory(df: DataFrame, keys: Sequence[str], day: str, score: str, higher_is_better: bool = True) -> DataFrame:
    """Change over two days, slope of seven, place among thirty days, and a direction."""
    from .windows import rolling_slope

    before = within_days(F.col(score), F.max, keys, day, 2, -2)
    df = rolling_slope(df.withColumn("delta_2d", F.col(score) - before), score, "slope_7d", keys, day, 7, 3)
    w = Window.partitionBy(*keys)
    cuts = F.percentile(score, F.array(F.lit(0.33), F.lit(0.66))).over(w)
    s = F.round(F.col("slope_7d") * (1 if higher_is_better else -1), 9)  # no slope of half a point passes by its last digit
    band = F.when(F.col(score) <= cuts[0], "low").when(F.col(score) >= cuts[1], "high").otherwise("middle")
    return df.withColumns({"band": band, "direction": F.when(s > 0.5, "improving").when(s < -0.5, "declining").otherwise("steady")})


# --- detectors: each gives rows (keys, id, salience, supporting) ----------------------------------------

FINDING = "id string, salience double, supporting map<string,string>"


def _finding(df: DataFrame, keys: Sequence[str], name: str, salience: Column, **facts: Column) -> DataFrame:
    pairs = [x for k, v in facts.items() for x in (F.lit(k), v.cast("string"))]
    return df.select(*keys, F.lit(name).alias("id"), salience.cast("double").alias("salience"), F.create_map(*pairs).alias("supporting"))


def detect_short_sleep(long: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Strong negative sleep, unless the value is not trusted. long: metric, delta, confidence."""
    hit = long.filter((F.col("metric") == "sleep_minutes") & (magnitude(F.col("metric"), F.col("delta")) == "strong") & (F.coalesce("confidence", F.lit("high")) != "low"))
    return _finding(hit, keys, "severe_short_sleep", F.lit(88), delta=F.col("delta"))


def detect_sleep_debt(debt: DataFrame, keys: Sequence[str]) -> DataFrame:
    return _finding(debt.filter("surfaced"), keys, "sleep_debt", F.least(F.lit(100.0), 50 + F.abs("balance") / 4), balance=F.col("balance"), status=F.col("status"))


def detect_fatigue(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    level = F.col("fatigue.level")
    return _finding(df.filter(level != "none"), keys, "training_fatigue", K.case_map(level, {"mild": 55, "moderate": 72, "high": 78}), level=level)


def detect_illness(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    s = F.col("illness")
    return _finding(df.filter(s.isNotNull()), keys, "illness_watch", K.case_map(s, {"low": 70, "moderate": 85, "elevated": 95}), severity=s)


def detect_drift(df: DataFrame, keys: Sequence[str], day: str, value: str, threshold: float) -> DataFrame:
    """Mean of the last 7 rows against the last 30, at each key's last day."""
    from .windows import tail_drift

    last = latest_per_key(df.withColumn("_drift", tail_drift(F.col(value), keys, day, 7, 30)), keys, F.desc(day))
    return _finding(last.filter(F.abs("_drift") >= threshold), keys, "baseline_drift", F.least(F.lit(90.0), 50 + 10 * F.abs("_drift") / threshold), drift=F.round("_drift", 6))


def detect_streak(df: DataFrame, keys: Sequence[str], day: str, value: str, least: int, move: float) -> DataFrame:
    """A rise of `least` rows or more up to the last day that moved far enough."""
    from .windows import rising_streak

    s = rising_streak(df, value, keys, day, "_run")
    s = latest_per_key(s.withColumn("_from", F.lag(value, least).over(ordered(keys, day))), keys, F.desc(day))
    moved = F.col(value) - F.col("_from")
    return _finding(s.filter((F.col("_run") >= least) & (moved >= move)), keys, "metric_streak", F.least(F.lit(80.0), 50 + 5 * F.col("_run")), run=F.col("_run"), move=F.round(moved, 6))


def detect_irregular_bedtime(df: DataFrame, keys: Sequence[str], minute: str, least_sd: float = 60) -> DataFrame:
    from .stats import circular_sd

    sd = df.groupBy(*keys).agg(circular_sd(F.col(minute)).alias("_sd"))
    return _finding(sd.filter(F.col("_sd") >= least_sd), keys, "circadian_irregularity", F.least(F.lit(85.0), 40 + F.col("_sd") / 4), sd=F.round("_sd", 3))


def detect_link(df: DataFrame, keys: Sequence[str], x: str, y: str, name: str, sign: int, least: int = 20, strength: float = 0.3) -> DataFrame:
    """A correlation of the expected sign, with the difference between the outer thirds."""
    r = df.groupBy(*keys).agg(*correlation_tier(F.col(x), F.col(y)))
    t = tercile_contrast(df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()), keys, x, y)
    hit = r.join(t, list(keys)).filter((F.col("n") >= least) & (F.col("r") * sign >= strength))
    return _finding(hit, keys, name, 50 + 40 * F.abs("r"), r=F.round("r", 6), contrast=F.round("contrast", 6), n=F.col("n"))


def recovery_lag(df: DataFrame, keys: Sequence[str], day: str, hard: Column, value: str, lags: Sequence[int] = (1, 2)) -> DataFrame:
    """(keys, lag, bump): of the lags after a hard day, the one with the largest mean value over the usual one; the shorter of ties."""
    usual = df.groupBy(*keys).agg(F.avg(value).alias("_usual"))
    shifted = df.filter(hard).select(*keys, F.explode(F.array(*map(F.lit, lags))).alias("lag"), F.col(day).alias("_d")).withColumn(day, F.date_add("_d", F.col("lag")))
    bumps = shifted.join(df.select(*keys, day, value), [*keys, day]).groupBy(*keys, "lag").agg(F.avg(value).alias("_v"))
    bumps = bumps.join(usual, list(keys)).withColumn("bump", F.col("_v") - F.col("_usual"))
    return latest_per_key(bumps, keys, F.desc("bump"), F.asc("lag")).select(*keys, "lag", "bump")


def diagnostics(df: DataFrame, keys: Sequence[str], x: str, y: str, name: str, least: int = 20) -> DataFrame:
    """One row per detector and key, whether it fired or not."""
    r = df.groupBy(*keys).agg(*correlation_tier(F.col(x), F.col(y)))
    reason = F.when(F.col("n") < least, "too_few").when(F.col("r").isNull(), "undefined").when(F.abs("r") < 0.3, "weak").otherwise("passed")
    return r.select(*keys, F.lit(name).alias("detector"), "n", "r", (reason == "passed").alias("passed"), reason.alias("reason"))


def rank_findings(findings: DataFrame, keys: Sequence[str], confidence: str | None = None, recent: Sequence[str] = (), threshold: float = 45, most: int = 3) -> DataFrame:
    """Salience times confidence times novelty: up to `most` at the threshold or above, else the best one."""
    novelty = F.when(F.col("id").isin(*recent), 0.6).otherwise(1.0) if recent else F.lit(1.0)
    trust = K.case_map(F.col(confidence), {"high": 1.0, "medium": 0.8, "low": 0.5}, 1.0) if confidence else F.lit(1.0)
    f = findings.withColumn("rank_score", F.col("salience") * novelty * trust)
    f = latest_per_key(f, keys, F.desc("rank_score"), F.asc("id"), n=most).withColumn("_best", F.row_number().over(ordered(keys, [F.desc("rank_score"), F.asc("id")])))
    return f.filter((F.col("rank_score") >= threshold) | (F.col("_best") == 1)).drop("_best")
