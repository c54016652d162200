"""Join shapes beyond the plain equi-join. All reduce to equi-joins on derived keys. Boxes and nearest sites are in `spatial`."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def priority_merge(first: DataFrame, second: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Full outer: the first side wins, the second fills its NULLs and missing keys."""
    a, b = first.select(*keys, *columns), second.select(*keys, *[F.col(c).alias(f"_s_{c}") for c in columns])
    return a.join(b, list(keys), "full").select(*keys, *[F.coalesce(c, f"_s_{c}").alias(c) for c in columns])


def override_merge(base: DataFrame, recent: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    return priority_merge(recent, base, keys, columns)


def left_ladder(spine: DataFrame, sides: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Left joins on the same keys; one shuffle of the spine serves them all."""
    return reduce(lambda a, b: a.join(b, list(keys), "left"), sides, spine)


def full_combine(frames: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Chained full outer joins whose keys are coalesced."""
    return reduce(lambda a, b: a.join(b, list(keys), "full"), frames)


def event_within(df: DataFrame, events: DataFrame, keys: Sequence[str], day: str, event_day: str, days: int, name: str = "event_distance") -> DataFrame:
    """Least distance in days to an event of the key, within +-days; NULL if there is none.

    The event spreads over its 2 * days + 1 dates, so the join is on (key, day): a bounded
    fan-out and no range comparison.
    """
    near = events.select(*keys, F.col(event_day).alias("_e")).distinct()
    near = near.withColumn("_o", F.explode(F.sequence(F.lit(-days), F.lit(days)))).withColumn(day, F.date_add("_e", F.col("_o")))
    nearest = near.groupBy(*keys, day).agg(F.min(F.abs("_o")).alias(name))
    return df.join(nearest, [*keys, day], "left")


def lagged(df: DataFrame, other: DataFrame, keys: Sequence[str], day: str, lags: Sequence[int]) -> DataFrame:
    """Rows of df with the row of `other` that lies `lag` days later, one per lag."""
    out = df.withColumn("lag", F.explode(F.array(*map(F.lit, lags)))).withColumn("_d", F.date_add(day, F.col("lag")))
    right = other.withColumnRenamed(day, "_d")
    return out.join(right, [*keys, "_d"]).drop("_d")


def overlap_minutes(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    seconds = F.unix_timestamp(F.least(a_end, b_end)) - F.unix_timestamp(F.greatest(a_start, b_start))
    return F.greatest(F.lit(0.0), seconds / 60.0)


def interval_overlap(a: DataFrame, b: DataFrame, keys: Sequence[str], a_span: tuple[str, str], b_span: tuple[str, str]) -> DataFrame:
    """Pairs of one key whose intervals overlap, with the minutes; keys should be narrow (entity and day)."""
    joined = a.join(b, list(keys))
    minutes = overlap_minutes(*(F.col(c) for c in (*a_span, *b_span)))
    return joined.withColumn("overlap_minutes", minutes).filter("overlap_minutes > 0")


def as_of(df: DataFrame, history: DataFrame, keys: Sequence[str], day: str, value: str, name: str) -> DataFrame:
    """The last known value at or before each row: one union and one window, no range join."""
    from pyspark.sql import Window

    both = df.withColumn("_row", F.lit(1)).withColumn("_v", F.lit(None).cast(dict(history.dtypes)[value])).unionByName(
        history.select(*keys, day, F.col(value).alias("_v"), F.lit(0).alias("_row")), allowMissingColumns=True
    )
    w = Window.partitionBy(*keys).orderBy(day, "_row").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(name, F.last("_v", ignorenulls=True).over(w)).filter("_row = 1").drop("_row", "_v")
