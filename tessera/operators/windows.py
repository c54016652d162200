"""Window builders. Frames are per entity; one Window spec per order lets Spark sort once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordered(keys: Sequence[str], order):
    return Window.partitionBy(*keys).orderBy(*([order] if isinstance(order, (str, Column)) else order))


def rolling(value: Column, how, keys: Sequence[str], order, rows: int, least: int = 1) -> Column:
    """how() over the last `rows` rows; NULL with fewer than `least` values."""
    w = ordered(keys, order).rowsBetween(1 - rows, 0)
    out = how(value).over(w)
    return out if least <= 1 else F.when(F.count(value).over(w) >= least, out)


def rolling_count_if(condition: Column, keys: Sequence[str], order, rows: int) -> Column:
    return F.count_if(condition).over(ordered(keys, order).rowsBetween(1 - rows, 0))


def balanced_chunk(keys: Sequence[str], order) -> Column:
    """Chunks of three or four rows: up to four rows are one; a remainder of one makes one chunk fewer."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    rn = F.row_number().over(ordered(keys, order))
    chunks = F.when(n % 3 == 1, (n - 1) / 3).otherwise(F.ceil(n / 3))
    return F.when(n <= 4, 1).otherwise(F.ceil(rn / F.ceil(n / chunks))).cast("long")


def above_mean_plus_sd(value: Column, keys: Sequence[str]) -> Column:
    w = Window.partitionBy(*keys)
    return value >= F.avg(value).over(w) + F.stddev_samp(value).over(w)


def latest_per_key(df: DataFrame, keys: Sequence[str], *order: Column, n: int = 1) -> DataFrame:
    """The first n rows of each key in the given order (Spark prunes them before the shuffle)."""
    return df.withColumn("_rn", F.row_number().over(ordered(keys, list(order)))).filter(F.col("_rn") <= n).drop("_rn")


def rolling_slope(df: DataFrame, value: str, name: str, keys: Sequence[str], order, rows: int, least: int) -> DataFrame:
    """Least-squares slope against the row number, over the last rows; NULL with fewer values."""
    w = ordered(keys, order)
    df = df.withColumn("_x", F.row_number().over(w).cast("double"))
    frame = w.rowsBetween(1 - rows, 0)
    slope = F.regr_slope(F.col(value), F.col("_x")).over(frame)
    return df.withColumn(name, F.when(F.count(value).over(frame) >= least, slope)).drop("_x")


def forward_fill(value: Column, keys: Sequence[str], order, limit: int) -> Column:
    return F.last(value, ignorenulls=True).over(ordered(keys, order).rowsBetween(-limit, 0))


def densify(df: DataFrame, keys: Sequence[str], day: str) -> DataFrame:
    """One row per key and calendar day between its first and last."""
    spans = df.groupBy(*keys).agg(F.min(day).alias("_a"), F.max(day).alias("_b"))
    days = spans.select(*keys, F.explode(F.sequence("_a", "_b")).alias(day))
    return days.join(df, [*keys, day], "left")


def days_since(event: Column, keys: Sequence[str], day: str) -> Column:
    last = F.max(F.when(event, F.col(day))).over(ordered(keys, day).rowsBetween(Window.unboundedPreceding, 0))
    return F.datediff(F.col(day), last)


def streak(df: DataFrame, condition: Column, keys: Sequence[str], order: str, name: str) -> DataFrame:
    """Length of the run of true rows that ends at each row; 0 where the condition is not true."""
    yes = F.coalesce(condition, F.lit(False))
    island = F.sum(F.when(yes, 0).otherwise(1)).over(ordered(keys, order).rowsBetween(Window.unboundedPreceding, 0))
    df = df.withColumn("_yes", yes).withColumn("_island", island)
    length = F.sum(F.col("_yes").cast("long")).over(ordered([*keys, "_island"], order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn(name, F.when(F.col("_yes"), length).otherwise(F.lit(0)).cast("long")).drop("_yes", "_island")


def rising_streak(df: DataFrame, value: str, keys: Sequence[str], order: str, name: str) -> DataFrame:
    """How many rows back each value has been rising without a break."""
    rises = F.col(value) > F.lag(value).over(ordered(keys, order))
    return streak(df.withColumn("_up", rises), F.col("_up"), keys, order, name).drop("_up")


def within_days(value: Column, how, keys: Sequence[str], day: str, before: int, after: int) -> Column:
    """how() over calendar days around each row."""
    w = Window.partitionBy(*keys).orderBy(F.unix_date(F.col(day))).rangeBetween(-before, after)
    return how(value).over(w)


def tail_drift(value: Column, keys: Sequence[str], order: str, short: int, long: int) -> Column:
    """Aggregate-free: mean of the last `short` rows less mean of the last `long`, at each row."""
    return rolling(value, F.avg, keys, order, short) - rolling(value, F.avg, keys, order, long)


def ewma_fold(pairs: Column, tau_days: float) -> Column:
    """Exponential mean of an array<struct<d, x>> in order of d, seeded with the first value."""
    alpha = 2.0 / (tau_days + 1)
    values = F.transform(F.array_sort(pairs), lambda p: p["x"].cast("double"))
    return F.aggregate(values, F.lit(None).cast("double"), lambda acc, x: F.when(acc.isNull(), x).otherwise(acc + alpha * (x - acc)))


def ewma(df: DataFrame, keys: Sequence[str], order: str, value: str, tau_days: float, rows: int | None = None) -> DataFrame:
    """One value per key: the recursion over all its rows (`ewma_scan`), or over its last `rows`."""
    if not rows:
        return ewma_scan(df, keys, order, value, tau_days)
    df = latest_per_key(df, keys, F.desc(order), n=rows)
    return df.groupBy(*keys).agg(ewma_fold(F.collect_list(F.struct(F.col(order).alias("d"), F.col(value).alias("x"))), tau_days).alias("ewma"))


def ewma_scan(df: DataFrame, keys: Sequence[str], order: str, value: str, tau_days: float, partitions: int | None = None) -> DataFrame:
    """The recursion over all rows of each key as a parallel scan: (keys, ewma). Rows without a value are left out.

    Rows are range-partitioned by key and order, so a key with all rows runs in every task. A
    step is the map acc -> (1 - alpha) * acc + alpha * x; the rows of a key in a partition
    compose to one map (a, b), which is a weighted sum, and the maps of a key, one for each
    partition it reaches, are applied in order to its first value. Equal orders must not repeat within a key.
    """
    keep = 1 - 2.0 / (tau_days + 1)
    rows = df.select(*keys, F.col(order).alias("_o"), F.col(value).cast("double").alias("_x")).filter("_x is not null")
    ends = [*[F.col(k) for k in keys], F.col("_o")]
    placed = (rows.repartitionByRange(partitions, *ends) if partitions else rows.repartitionByRange(*ends)).withColumn("_part", F.spark_partition_id())
    block = Window.partitionBy("_part", *keys).orderBy(F.desc("_o"))
    weighed = placed.withColumn("_w", F.lit(1 - keep) * F.pow(F.lit(keep), F.row_number().over(block) - 1))
    maps = weighed.groupBy("_part", *keys).agg(F.min("_o").alias("_o"), F.min_by("_x", "_o").alias("_first"), F.pow(F.lit(keep), F.count(F.lit(1))).alias("a"), F.sum(F.col("_w") * F.col("_x")).alias("b"))
    chain = F.array_sort(F.collect_list(F.struct("_o", "_first", "a", "b")))  # at most a map for each partition
    return maps.groupBy(*keys).agg(F.aggregate(chain, F.get(chain, F.lit(0))["_first"], lambda acc, m: m["a"] * acc + m["b"]).alias("ewma"))


def year_shifts(df: DataFrame, day: str, year: str, years: int) -> DataFrame:
    """Copies of the rows moved 1..years back; 29 February becomes the 28th. One scan."""
    moved = df.withColumn("offset", F.explode(F.sequence(F.lit(1), F.lit(years))))
    return moved.withColumn(day, F.add_months(F.col(day), -12 * F.col("offset"))).withColumn("effective_year", F.col(year) - F.col("offset"))


def extreme_today(value: Column, how, keys: Sequence[str], day: str, days: int = 7) -> Column:
    return value == within_days(value, how, keys, day, days - 1, 0)


def first_run(df: DataFrame, condition: Column, keys: Sequence[str], order: str, least: int) -> DataFrame:
    """(keys, start, length) of the first run of at least `least` true rows."""
    marked = streak(df, condition, keys, order, "_run").filter(F.col("_run") >= least)
    return marked.groupBy(*keys).agg(F.min(F.struct(F.col(order).alias("at"), F.col("_run").alias("run"))).alias("s")).select(*keys, F.col("s.at").alias("settled_at"), F.col("s.run").alias("run"))

