"""Grouped statistics beyond the built-in aggregates."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.kernels import lit


def climatology(df: DataFrame, keys: Sequence[str], metrics: Sequence[str], quantiles=(0.2, 0.8, 0.95)) -> DataFrame:
    """Interpolated quantiles of every metric per key, in one pass: `<metric>_p20` and so on."""
    aggs = [F.percentile(F.col(m), F.array(*map(F.lit, quantiles))).alias(f"_{m}") for m in metrics]
    grouped = df.groupBy(*keys).agg(*aggs)
    return grouped.select(*keys, *[F.col(f"_{m}")[i].alias(f"{m}_p{round(q * 100):02d}") for m in metrics for i, q in enumerate(quantiles)])


#: Items that a sketch keeps at the lowest level; its rank error is then below SKETCH_ERROR.
SKETCH_K, SKETCH_ERROR = 400, 0.01


def sketches(df: DataFrame, keys: Sequence[str], metrics: Sequence[str], k: int = SKETCH_K) -> DataFrame:
    """A mergeable quantile sketch of each metric per key (`<metric>_sketch`): bounded, whatever a key's rows. Combined before the shuffle."""
    return df.groupBy(*keys).agg(*[F.kll_sketch_agg_double(F.col(m).cast("double"), F.lit(k)).alias(f"{m}_sketch") for m in metrics])


def merge_sketches(tables: Sequence[DataFrame], keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Stored sketches and those of new days as one per key, without the rows they were made of."""
    both = reduce(DataFrame.unionByName, tables)
    return both.groupBy(*keys).agg(*[F.kll_merge_agg_double(f"{m}_sketch").alias(f"{m}_sketch") for m in metrics])


def sketched_climatology(table: DataFrame, keys: Sequence[str], metrics: Sequence[str], quantiles=(0.2, 0.8, 0.95)) -> DataFrame:
    """`<metric>_p20` and so on from sketches: a value of the data whose rank is at most SKETCH_ERROR off; and `<metric>_n`."""
    out = []
    for m in metrics:
        s = F.col(f"{m}_sketch")
        out.append(F.kll_sketch_get_n_double(s).alias(f"{m}_n"))
        out += [F.when(F.kll_sketch_get_n_double(s) > 0, F.kll_sketch_get_quantile_double(s, F.lit(q))).alias(f"{m}_p{round(q * 100):02d}") for q in quantiles]
    return table.select(*keys, *out)


def circular_mean(minutes: Column, period: float = 1440.0) -> Column:
    """Aggregate: mean time of day in minutes."""
    angle = lit(minutes) * (2 * math.pi / period)
    return F.pmod(F.atan2(F.avg(F.sin(angle)), F.avg(F.cos(angle))) * (period / (2 * math.pi)), F.lit(period))


def circular_sd(minutes: Column, period: float = 1440.0) -> Column:
    angle = lit(minutes) * (2 * math.pi / period)
    length = F.hypot(F.avg(F.sin(angle)), F.avg(F.cos(angle)))
    return F.sqrt(-2 * F.ln(F.least(F.lit(1.0), length))) * (period / (2 * math.pi))


def correlation_tier(x: Column, y: Column, tiers=((30, "established"), (20, "emerging"))) -> list[Column]:
    """Aggregates r and tier over pairs that are both there; r is NULL where undefined."""
    both = x.isNotNull() & y.isNotNull()
    n = F.count_if(both)
    r = F.corr(F.when(both, x.cast("double")), F.when(both, y.cast("double")))
    tier = F.lit("insufficient")
    for least, name in sorted(tiers):
        tier = F.when(n >= least, name).otherwise(tier)
    return [n.cast("long").alias("n"), F.when(~F.isnan(r), r).alias("r"), tier.alias("tier")]


def average_rank(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Ranks where ties share their mean rank."""
    rank = F.rank().over(Window.partitionBy(*keys).orderBy(value))
    ties = F.count(F.lit(1)).over(Window.partitionBy(*keys, value))
    return df.withColumn(name, rank + (ties - 1) / 2.0)


def spearman(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    pairs = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = average_rank(average_rank(pairs, keys, x, "_rx"), keys, y, "_ry")
    return ranked.groupBy(*keys).agg(F.count(F.lit(1)).cast("long").alias("n"), F.corr("_rx", "_ry").alias("spearman"), F.corr(F.col(x).cast("double"), F.col(y).cast("double")).alias("pearson"))


def tercile_contrast(df: DataFrame, keys: Sequence[str], x: str, y: str, low: float = 0.33, high: float = 0.66) -> DataFrame:
    """Mean of y where x is in its lower and in its upper third, and their difference."""
    cut = F.percentile(x, F.array(F.lit(low), F.lit(high)))
    cuts = df.groupBy(*keys).agg(F.transform(cut, lambda c: F.round(c, 9)).alias("_c"))  # a cut that falls on a value takes it
    joined = df.join(cuts, list(keys))
    bottom = F.avg(F.when(F.col(x) <= F.col("_c")[0], F.col(y)))
    top = F.avg(F.when(F.col(x) >= F.col("_c")[1], F.col(y)))
    return joined.groupBy(*keys).agg(bottom.alias("low_mean"), top.alias("high_mean"), (top - bottom).alias("contrast"))


def median_impute(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """NULLs take the median of their key."""
    medians = df.groupBy(*keys).agg(*[F.percentile(c, 0.5).alias(f"_m_{c}") for c in columns])
    out = df.join(medians, list(keys), "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.col(f"_m_{c}")) for c in columns}).drop(*[f"_m_{c}" for c in columns])


def missing_ratio(columns: Sequence[str]) -> Column:
    return sum((F.col(c).isNull().cast("int") for c in columns), F.lit(0)) / len(columns)


def window_stats(value: Column, least: int = 3) -> list[Column]:
    """Aggregates mean, quartiles (of at least `least` values) and range."""
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.75)))
    enough = F.count(value) >= least
    return [F.avg(value).alias("mean"), F.when(enough, q[0]).alias("p25"), F.when(enough, q[1]).alias("p75"), F.min(value).alias("low"), F.max(value).alias("high")]


def percentile_rank(value: Column, today: Column) -> Column:
    """Aggregate: percent of values at or below today's."""
    return F.avg((value <= today).cast("int")) * 100


def correlated_to_drop(df: DataFrame, columns: Sequence[str], threshold: float = 0.9) -> list[str]:
    """Later columns of pairs whose |r| exceeds the threshold, greedily; one aggregation, columns^2 numbers."""
    pairs = [(a, b) for i, b in enumerate(columns) for a in columns[:i]]
    row = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{i}") for i, (a, b) in enumerate(pairs)]).first()
    drop: list[str] = []
    for i, (_, b) in enumerate(pairs):
        if row[i] is not None and abs(row[i]) > threshold and b not in drop:
            drop.append(b)
    return drop


def classification_report(df: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    """Per class: support, precision, recall, f1; from one count per (label, prediction)."""
    counts = df.groupBy(label, predicted).agg(F.count(F.lit(1)).alias("n"))
    classes = counts.select(F.col(label).alias("class")).union(counts.select(F.col(predicted).alias("class"))).distinct()
    sums = classes.join(counts, (F.col("class") == F.col(label)) | (F.col("class") == F.col(predicted)), "left").groupBy("class").agg(
        F.sum(F.when(F.col(label) == F.col("class"), F.col("n")).otherwise(0)).alias("support"),
        F.sum(F.when(F.col(predicted) == F.col("class"), F.col("n")).otherwise(0)).alias("_said"),
        F.sum(F.when((F.col(label) == F.col("class")) & (F.col(predicted) == F.col("class")), F.col("n")).otherwise(0)).alias("_hit"),
    )
    p, r = F.coalesce(F.try_divide("_hit", "_said"), F.lit(0.0)), F.coalesce(F.try_divide("_hit", "support"), F.lit(0.0))
    return sums.select("class", "support", p.alias("precision"), r.alias("recall"), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1"))
