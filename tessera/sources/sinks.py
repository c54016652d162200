"""Sinks: append, truncate, partitioned and clustered tables, line JSON, CSV, digests. Upserts are in `buckets`, restartable batches in `committed`."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .schemas import conform


def save(df: DataFrame, path: str, mode: str = "append", schema: str | None = None) -> None:
    """Append or overwrite; with a schema the columns are coerced first."""
    (conform(df, schema) if schema else df).write.mode(mode).parquet(path)


def read_merged(spark: SparkSession, path: str) -> DataFrame:
    """A table whose columns were added over time; missing ones read as NULL."""
    return spark.read.option("mergeSchema", "true").parquet(path)


def save_clustered(df: DataFrame, path: str, day: str, cluster: Sequence[str], mode: str = "append", files_per_day: int = 1) -> None:
    """Partitioned by day and sorted by the cluster columns, so that footers prune.

    Rows of a day spread over `files_per_day` tasks by a hash of the cluster columns: a hot day is not one task.
    """
    salt = F.pmod(F.xxhash64(*cluster), F.lit(files_per_day))
    ready = df.withColumn("_day", F.to_date(day)).withColumn("_salt", salt).repartition("_day", "_salt").sortWithinPartitions("_day", *cluster)
    ready.drop("_salt").write.mode(mode).partitionBy("_day").parquet(path)


def replace_days(df: DataFrame, path: str, day: str) -> None:
    """The days in df replace those of the table, by dynamic partition overwrite; running it again changes nothing."""
    ready = df.withColumn("_day", F.to_date(day)).hint("rebalance", "_day")  # one file a day, more for a large one
    ready.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_day").parquet(path)


def with_retry(write: Callable[[], None], tries: int = 5, first_wait: float = 1.0, quota_wait: float = 60.0, sleep=time.sleep) -> int:
    """For sinks outside Spark: exponential waits, longer on quota errors. Returns the attempts it took."""
    for n in range(1, tries + 1):
        try:
            write()
            return n
        except Exception as e:  # any sink error is worth another try, the last is raised
            if n == tries:
                raise
            wait = first_wait * 2 ** (n - 1)
            sleep(max(wait, quota_wait) if "quota" in str(e).lower() or "rate" in str(e).lower() else wait)
    return tries


def send_batches(df: DataFrame, send: Callable[[str, pa.RecordBatch], None], tries: int = 5, first_wait: float = 1.0, quota_wait: float = 60.0, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """Sends rows to a sink outside Spark, batch by batch from the tasks, each with its own retries: (batch, rows, attempts).

    A batch has the same name whenever its task runs again, so a sink that replaces by name holds each row once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for number, b in enumerate(batches):
            name = f"{part:05d}-{number:05d}"
            attempts = with_retry(lambda b=b, name=name: send(name, b), tries, first_wait, quota_wait, sleep)
            yield pa.RecordBatch.from_pydict({"batch": [name], "rows": pa.array([len(b)], pa.int64()), "attempts": pa.array([attempts], pa.int32())})

    return df.mapInArrow(run, "batch string, rows long, attempts int")


def archive_payloads(df: DataFrame, path: str) -> None:
    """Raw payloads with batch id and HTTP facts, by day of fetching."""
    save_clustered(conform(df, "payloads"), path, "fetched_at", ["ats_type", "ats_slug"])


def line_json(df: DataFrame, path: str, fields: Sequence[str]) -> None:
    """Selected fields by dotted path, one JSON object a line."""
    df.select(*[F.col(f).alias(f) for f in fields]).write.mode("overwrite").json(path)


def audit_csv(df: DataFrame, path: str, columns: Sequence[str], score: str, least: float) -> None:
    """Fixed columns with a yes/no verdict; a score that is no number counts as 0."""
    s = F.coalesce(F.col(score).try_cast("double"), F.lit(0.0))
    df.select(*columns, F.when(s >= least, "yes").otherwise("no").alias("approved")).write.mode("overwrite").option("header", True).csv(path)


def markdown_digests(postings: DataFrame, stats: DataFrame, day: str, reader: str, section: str, sections: Sequence[str], order: Sequence[Column], most: int = 50) -> DataFrame:
    """(reader, text): a digest for each reader, with its best `most` postings of each section and a footer on the health of the sources.

    postings: reader, section, title, company_name, score, url. stats: fetched, passed, health, source, a row for each source.
    Only the rows that a digest shows are gathered; all digests are made in one job.
    """
    place = F.row_number().over(Window.partitionBy(reader, section).orderBy(*order))
    line = F.concat(F.lit("- **"), F.col("title"), F.lit("** at "), F.col("company_name"), F.lit(" ("), F.format_string("%.1f", F.col("score").cast("double")), F.lit(") "), F.col("url"))
    best = postings.withColumn("_p", place).filter(F.col("_p") <= most).withColumn("_line", line)
    lists = [F.array_sort(F.collect_list(F.when(F.col(section) == s, F.struct("_p", "_line")))).alias(f"_s{i}") for i, s in enumerate(sections)]
    held = best.groupBy(reader).agg(*lists)
    bad = F.array_join(F.array_sort(F.collect_list(F.when(F.col("health") != "ok", F.col("source")))), ", ")
    foot = stats.agg(F.coalesce(F.sum("fetched"), F.lit(0)).alias("_fetched"), F.coalesce(F.sum("passed"), F.lit(0)).alias("_passed"), F.when(bad == "", "none").otherwise(bad).alias("_bad"))
    parts = [F.lit(f"# Digest {day}")]
    for i, s in enumerate(sections):
        shown = F.transform(f"_s{i}", lambda x: x["_line"])
        parts += [F.concat(F.lit(f"\n\n## {s} ("), F.size(shown), F.lit(")")), F.when(F.size(shown) > 0, F.concat(F.lit("\n"), F.array_join(shown, "\n"))).otherwise("")]
    parts.append(F.concat(F.lit("\n\n_Fetched "), F.col("_fetched"), F.lit(", passed "), F.col("_passed"), F.lit("; check: "), F.col("_bad"), F.lit("_\n")))
    return held.join(F.broadcast(foot), how="cross").select(reader, F.concat(*parts).alias("text"))  # one row of totals
