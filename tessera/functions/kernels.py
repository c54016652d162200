"""Column kernels: every function takes and returns Columns and stays inside code generation."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F


def lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


# --- safe arithmetic and comparison with climatologies -------------------------------------------------


def safe_divide(a, b) -> Column:
    """NULL where the divisor is 0 or NULL."""
    return F.try_divide(lit(a), lit(b))


def z_value(x, mean, sd) -> Column:
    return safe_divide(lit(x) - lit(mean), F.nullif(lit(sd), F.lit(0.0)))


def z_flag(z, sd) -> Column:
    """NULL without a deviation, 0 if it is 0, else the sign times 2, 1 or 0 by |z|."""
    z, sd = lit(z), lit(sd)
    return (
        F.when(sd.isNull(), F.lit(None).cast("double")).when(sd == 0, 0.0)
        .when(F.abs(z) >= 2, 2.0 * F.signum(z)).when(F.abs(z) >= 1, F.signum(z)).otherwise(0.0)
    )


def ratio(x, mean) -> Column:
    return safe_divide(x, mean)


def delta(x, mean) -> Column:
    return lit(x) - lit(mean)


def strict_least(*cols) -> Column:
    """NULL if any argument is NULL (Spark's own skips NULLs)."""
    cols = [lit(c) for c in cols]
    return F.when(reduce(lambda a, b: a | b, [c.isNull() for c in cols]), None).otherwise(F.least(*cols))


def strict_greatest(*cols) -> Column:
    cols = [lit(c) for c in cols]
    return F.when(reduce(lambda a, b: a | b, [c.isNull() for c in cols]), None).otherwise(F.greatest(*cols))


def clamp(x, low: float, high: float) -> Column:
    return strict_least(strict_greatest(x, F.lit(low)), F.lit(high))


# --- weather -------------------------------------------------------------------------------------------


def aligned_wind(speed, direction, heading) -> Column:
    """Component of the wind along a heading, degrees."""
    return lit(speed) * F.cos((lit(direction) - lit(heading)) * math.pi / 180)


def rain_intensity(total, hours) -> Column:
    return F.coalesce(safe_divide(total, hours), F.lit(0.0))


def optimal_insect_day(tmean, precip, radiation, p75) -> Column:
    return lit(tmean).between(15, 25) & (lit(precip) < 2) & (lit(radiation) >= F.greatest(F.lit(5.0), F.coalesce(lit(p75), F.lit(5.0))))


def peak_emphasis_mean(x, k: float = 0.7) -> Column:
    """Aggregate: mean weighted by exp(k |x|)."""
    weight = F.exp(k * F.abs(lit(x)))
    return F.try_divide(F.sum(weight * lit(x)), F.sum(weight))


def blend(parts: Sequence[tuple[float, Column]]) -> Column:
    """Weighted blend; any NULL part makes it NULL, weights or not."""
    return F.try_divide(reduce(add, [w * p for w, p in parts]), reduce(add, [w * F.when(p.isNotNull(), 1).otherwise(0) for w, p in parts]))


def soft_min(a, b) -> Column:
    return -F.ln(F.exp(-lit(a)) + F.exp(-lit(b)))


def logistic(x, k: float = 1.1) -> Column:
    return 1.0 / (1.0 + F.exp(-k * lit(x)))


def insect_presence(c: Mapping[str, Column]) -> Column:
    """Latent thermal score, radiation, moisture preference and optimal days to one score in [-2, 2]."""
    thermal = (
        0.40 * soft_min(c["tmin"], c["tmean"]) + 0.15 * strict_least(c["tmax"], 1.5) + 0.10 * strict_greatest(c["warm10"], 0.0)
        + 0.15 * strict_greatest(c["warm15"], 0.0) + 0.10 * strict_greatest(c["warm20"], 0.0) + 0.10 * c["warm_anomaly"]
    )
    moisture = F.exp(-F.pow((c["precip"] - 0.5) / 1.1, F.lit(2.0)))
    core = F.pow(strict_greatest(1e-6, logistic(thermal) * logistic(c["srad"]) * moisture), F.lit(1 / 3))
    return 4.0 * (0.6 * core + 0.4 * logistic(c["optimal"]) - 0.5)


def arrival_z(day, median, sd) -> Column:
    return F.when(lit(sd) > 0, (lit(day) - lit(median)) / lit(sd))


# --- wellness ------------------------------------------------------------------------------------------


def score_from_z(z, invert: bool = False) -> Column:
    """50 at the baseline, 17.5 points a deviation, within 0 and 100."""
    return clamp(50 + 17.5 * (-lit(z) if invert else lit(z)), 0.0, 100.0)


def weighted_mean(parts: Sequence[tuple[Column, float]], empty: float = 50.0) -> Column:
    """Mean of the parts that are there, weights renormalised; `empty` if none is."""
    total = reduce(add, [F.coalesce(x * w, F.lit(0.0)) for x, w in parts])
    weight = reduce(add, [F.when(x.isNotNull(), w).otherwise(0.0) for x, w in parts])
    return F.coalesce(F.try_divide(total, F.nullif(weight, F.lit(0.0))), F.lit(empty))


def tss_from_power(power, seconds, ftp) -> Column:
    """Training stress of a ride: an hour at threshold power is 100."""
    factor = safe_divide(power, ftp)
    return safe_divide(lit(seconds) * lit(power) * factor, lit(ftp) * 3600) * 100


def tss_from_heart_rate(rate, seconds, threshold) -> Column:
    return lit(seconds) / 3600 * F.pow(safe_divide(rate, threshold), F.lit(2.0)) * 100


def effective_tss(tss, effort) -> Column:
    """Stress, capped by the effort once that reaches 50; the effort alone if there is no stress."""
    tss, effort = F.coalesce(lit(tss), F.lit(0.0)), F.coalesce(lit(effort), F.lit(0.0))
    return F.when(tss <= 0, effort).when(effort < 50, tss).otherwise(F.least(tss, effort))


def duration_text(minutes, signed: bool = False) -> Column:
    """`Xh Ym`, minutes alone below an hour."""
    m = F.round(lit(minutes)).cast("long")
    size = F.abs(m)
    body = F.when(size >= 60, F.format_string("%dh %dm", F.floor(size / 60), size % 60)).otherwise(F.format_string("%dm", size))
    sign = F.when(m < 0, "-").otherwise("+" if signed else "")
    return F.when(m.isNotNull(), F.concat(sign, body))


def in_band(t, start, end) -> Column:
    """start <= t < end, over midnight where start is after end."""
    t, start, end = lit(t), lit(start), lit(end)
    return F.when(start <= end, (t >= start) & (t < end)).otherwise((t >= start) | (t < end))


# --- percentiles of anchors and outlooks ---------------------------------------------------------------


def anchor_percentile(value, anchors: Sequence[tuple[float, Column]]) -> Column:
    """Percentile between the known anchors by linear interpolation; NULL with fewer than two.

    Below the lowest it falls in proportion to the value (or stays, if that anchor is not
    positive); above the highest it rises half as fast as the last step would take it to 100.
    """
    value = lit(value).cast("double")
    pairs = F.array(*[F.struct(a.cast("double").alias("v"), F.lit(float(p)).alias("p")) for p, a in anchors])
    known = F.array_sort(F.filter(pairs, lambda x: x["v"].isNotNull()))
    first, last, before = F.get(known, F.lit(0)), F.element_at(known, -1), F.get(known, F.size(known) - 2)
    low = F.element_at(F.filter(known, lambda x: x["v"] <= value), -1)
    high = F.get(F.filter(known, lambda x: x["v"] > value), F.lit(0))
    span = F.greatest(last["v"] - before["v"], F.lit(1e-9))
    percent = (
        F.when((value <= first["v"]) & (first["v"] <= 0), first["p"])
        .when(value <= first["v"], F.try_divide(first["p"] * value, first["v"]))
        .when(value >= last["v"], last["p"] + (100 - last["p"]) * F.least(F.lit(1.0), (value - last["v"]) / span * 0.5))
        .otherwise(low["p"] + (value - low["v"]) / (high["v"] - low["v"]) * (high["p"] - low["p"]))
    )
    return F.when((F.size(known) >= 2) & value.isNotNull(), clamp(percent, 0.0, 100.0))


def outlook_trend(recent, forecast, fallback="stable", step: float = 3.0) -> Column:
    """recent, forecast: map<metric, percentile>. Mean change of the shared metrics beyond `step` either way."""
    both = F.map_filter(F.map_zip_with(recent, forecast, lambda k, a, b: b - a), lambda k, v: v.isNotNull())
    values = F.map_values(both)
    mean = F.try_divide(F.aggregate(values, F.lit(0.0), lambda s, v: s + v), F.size(values))
    return F.when(mean > step, "worsening").when(mean < -step, "improving").when(mean.isNotNull(), "stable").otherwise(lit(fallback))


def percentile_deltas(before, after, most: int = 8) -> Column:
    """map<metric, change> of the shared metrics, at most `most` keys in order of name."""
    both = F.map_filter(F.map_zip_with(before, after, lambda k, a, b: b - a), lambda k, v: v.isNotNull())
    return F.map_from_entries(F.slice(F.array_sort(F.map_entries(both)), 1, most))


def risk_label(score) -> Column:
    return F.element_at(F.array(*map(F.lit, ("Low", "Moderate", "High", "Very High"))), F.when(lit(score).between(0, 3), lit(score).cast("int") + 1))


def trend_label(previous, current) -> Column:
    return F.when(lit(current) < lit(previous), "Down").when(lit(current) > lit(previous), "Up").otherwise("Stable")


# --- postings ------------------------------------------------------------------------------------------


def combined_score(role, mission, fit) -> Column:
    return 0.4 * lit(role) + 0.35 * lit(mission) + 0.25 * lit(fit)


def fit_of_regions(stated: Column, acceptable: Column, allow_unspecified: bool = False) -> Column:
    """TRUE, FALSE or NULL: stated regions against acceptable ones; none stated is NULL unless allowed."""
    none = F.size(F.coalesce(stated, F.array().cast("array<string>"))) == 0
    return F.when(none, F.lit(True) if allow_unspecified else F.lit(None).cast("boolean")).otherwise(F.arrays_overlap(stated, acceptable))


# --- climate indices -----------------------------------------------------------------------------------


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def seasonality(monthly: Column) -> Column:
    """Walsh-Lawler: absolute departures of monthly totals from their mean, over the annual total."""
    year = total(monthly)
    return F.try_divide(F.aggregate(monthly, F.lit(0.0), lambda s, x: s + F.abs(x - year / 12)), F.nullif(year, F.lit(0.0)))


def entropy(shares: Column) -> Column:
    """Shannon entropy of non-negative amounts."""
    whole = total(shares)
    return F.aggregate(shares, F.lit(0.0), lambda s, x: s + F.when((x > 0) & (whole > 0), -(x / whole) * F.ln(x / whole)).otherwise(0.0))


def aridity(precipitation, evapotranspiration) -> Column:
    return safe_divide(evapotranspiration, F.nullif(lit(precipitation), F.lit(0.0)))


def thornthwaite(monthly_temperature: Column, latitude) -> Column:
    """Annual potential evapotranspiration in mm from twelve mean temperatures and a latitude."""
    warm = F.transform(monthly_temperature, lambda t: F.greatest(t, F.lit(0.0)))
    heat = F.aggregate(warm, F.lit(0.0), lambda s, t: s + F.pow(t / 5, F.lit(1.514)))
    exponent = 6.75e-7 * F.pow(heat, F.lit(3.0)) - 7.71e-5 * F.pow(heat, F.lit(2.0)) + 1.792e-2 * heat + 0.49239
    phi = F.radians(lit(latitude))

    def month(t: Column, i: Column) -> Column:
        days = F.element_at(F.array(*map(F.lit, (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31))), i + 1)
        middle = F.element_at(F.array(*map(F.lit, (15, 45, 74, 105, 135, 162, 198, 228, 258, 288, 318, 344))), i + 1)
        declination = F.lit(0.409) * F.sin(2 * math.pi * middle / 365 - 1.39)
        hours = 24 / math.pi * F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), -F.tan(phi) * F.tan(declination))))
        return F.when((heat > 0) & (t > 0), 16 * hours / 12 * days / 30 * F.pow(10 * t / heat, exponent)).otherwise(0.0)

    return F.aggregate(F.transform(warm, month), F.lit(0.0), lambda s, x: s + x)


def case_map(value, table: Mapping, default=None) -> Column:
    """A constant map as one chain of comparisons."""
    out = F.lit(None) if default is None else F.lit(default)
    for k, v in reversed(list(table.items())):
        out = F.when(lit(value) == k, F.lit(v)).otherwise(out)
    return out
