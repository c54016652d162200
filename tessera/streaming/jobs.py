"""Streaming forms of the incremental jobs. Every function takes a streaming DataFrame with an event time."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.sources import buckets

LATE = "2 days"


def source(spark: SparkSession, path: str, schema: str, time: str = "ts", files_per_batch: int | None = None) -> DataFrame:
    """Files as they arrive; offsets live in the query's checkpoint, which is the high-water mark."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path).withColumn(time, F.col(time).cast("timestamp"))


def daily_totals(df: DataFrame, keys: Sequence[str], time: str, value: str, late: str = LATE) -> DataFrame:
    """Tumbling days; in append mode a day comes out once, when no late row can change it (partial days are masked)."""
    w = F.window(time, "1 day")
    g = df.withWatermark(time, late).groupBy(*keys, w).agg(F.sum(value).alias("total"), F.count(F.lit(1)).alias("n"))
    return g.select(*keys, F.to_date("window.start").alias("day"), "total", "n")


def hourly_means(df: DataFrame, keys: Sequence[str], time: str, value: str, late: str = LATE) -> DataFrame:
    g = df.withWatermark(time, late).groupBy(*keys, F.window(time, "1 hour")).agg(F.avg(value).alias("mean"), F.max(value).alias("high"))
    return g.select(*keys, F.col("window.start").alias("hour"), "mean", "high")


def sliding_week(df: DataFrame, keys: Sequence[str], time: str, value: str, late: str = LATE) -> DataFrame:
    """Seven days, one day apart."""
    g = df.withWatermark(time, late).groupBy(*keys, F.window(time, "7 days", "1 day")).agg(F.sum(value).alias("total"), F.max(value).alias("high"))
    return g.select(*keys, F.to_date(F.col("window.end")).alias("day"), "total", "high")


def once(df: DataFrame, keys: Sequence[str], time: str, late: str = "3 days") -> DataFrame:
    """Overlapping deliveries: each key once within the watermark."""
    return df.withWatermark(time, late).dropDuplicatesWithinWatermark([*keys])


def sessions(df: DataFrame, keys: Sequence[str], time: str, gap: str = "30 minutes", late: str = LATE) -> DataFrame:
    g = df.withWatermark(time, late).groupBy(*keys, F.session_window(time, gap)).agg(F.count(F.lit(1)).alias("n"))
    return g.select(*keys, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def ewma(df: DataFrame, key: str, order: str, value: str, tau_days: float) -> DataFrame:
    """The recursion as state: one number per key, updated in order of each batch (update mode)."""
    alpha = 2.0 / (tau_days + 1)
    kind = dict(df.dtypes)[key]

    def run(name: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        acc = state.get[0] if state.exists else None
        for x in pd.concat(list(parts)).sort_values(order)[value]:
            acc = float(x) if acc is None else acc + alpha * (float(x) - acc)
        if acc is not None:
            state.update((acc,))
            yield pd.DataFrame({key: [name[0]], "ewma": [acc]})

    return df.select(key, order, value).groupBy(key).applyInPandasWithState(run, f"{key} {kind}, ewma double", "acc double", "update", GroupStateTimeout.NoTimeout)


# --- sinks ---------------------------------------------------------------------------------------------


def upsert_sink(path: str, keys: Sequence[str], order: str | None = None, n: int = buckets.BUCKETS) -> Callable[[DataFrame, int], None]:
    """foreachBatch: the newest row of each key wins; only buckets that the batch touches are rewritten, and a batch that runs again changes nothing."""

    def run(batch: DataFrame, number: int) -> None:
        buckets.upsert(batch, path, keys, order, n)

    return run


def once_sink(path: str, keys: Sequence[str], n: int = buckets.BUCKETS) -> Callable[[DataFrame, int], None]:
    """foreachBatch: appends only keys that are not there yet; only the keys of touched buckets are read."""

    def run(batch: DataFrame, number: int) -> None:
        buckets.insert_new(batch, path, keys, n)

    return run


def run_available(df: DataFrame, out: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Everything that is there now, into parquet, then stop."""
    q = df.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def run_batches(df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    q = df.writeStream.foreachBatch(sink).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q
