"""Tables that are upserted: rows lie in partitions by a hash of their key, and an upsert rewrites only the buckets it touches.

The partition column carries the number of buckets in its name, so a table is never
read or written with another one. An upsert reads the touched buckets (partition pruning),
takes the newest row of each key in one aggregation with partial sums, and replaces those
partitions by dynamic overwrite; files of all other buckets stay as they are. Running a
batch again gives the same rows. Spark writes to a staging folder and swaps buckets
when the job is done; a driver lost in the middle of the swap leaves the batch to be run again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _names(spark: SparkSession, path: str) -> list[str]:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def bucket_column(buckets: int) -> str:
    return f"_bucket_of_{buckets}"


def bucket_of(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _rows(spark: SparkSession, path: str) -> DataFrame:
    """All columns, the bucket among them; columns that were added later are NULL in older files."""
    return spark.read.option("mergeSchema", "true").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the table."""
    df = _rows(spark, path)
    return df.drop(*(c for c in df.columns if c.startswith("_bucket_of_")))


def newest(df: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """One row of each key, the one with the greatest order: an aggregate, so a hot key is combined before the shuffle."""
    row = F.max_by(F.struct(*df.columns), order).alias("_row")
    return df.groupBy(*[F.col(k).alias(f"_key_{k}") for k in keys]).agg(row).select("_row.*")


def upsert(df: DataFrame, path: str, keys: Sequence[str], order: str | None = None, buckets: int = BUCKETS) -> list[int]:
    """Rows of df replace those of their keys, unless the stored one is newer by `order`. Returns the buckets it rewrote.

    Within df the greatest order wins, any row of equals; null keys are a key. Null orders are the oldest.
    """
    spark, name = df.sparkSession, bucket_column(buckets)
    there = [n for n in _names(spark, path) if n.startswith("_bucket_of_")]
    if any(not n.startswith(f"{name}=") for n in there):
        raise ValueError(f"{path} has another number of buckets than {buckets}")
    rank = F.struct(*([F.col(order).isNotNull(), F.col(order)] if order else []), F.col("_fresh"))
    fresh = df.withColumns({name: bucket_of(keys, buckets), "_fresh": F.lit(True)})
    touched = sorted(r[0] for r in fresh.select(name).distinct().collect())  # at most as many as there are buckets
    if not touched:
        return []
    rows = fresh
    if there:
        old = _rows(spark, path).filter(F.col(name).isin(touched)).withColumn("_fresh", F.lit(False))
        rows = old.unionByName(fresh, allowMissingColumns=True)
    rows = newest(rows, keys, rank).drop("_fresh").hint("rebalance", name)  # one file a bucket, more for a large one
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(name).parquet(path)
    return touched


def insert_new(df: DataFrame, path: str, keys: Sequence[str], buckets: int = BUCKETS) -> None:
    """Appends rows whose key is not there yet; only the keys of touched buckets are read. Null keys are keys."""
    spark, name = df.sparkSession, bucket_column(buckets)
    fresh = df.withColumn(name, bucket_of(keys, buckets)).dropDuplicates(list(keys))
    if [n for n in _names(spark, path) if n.startswith("_bucket_of_")]:
        touched = [r[0] for r in df.select(bucket_of(keys, buckets)).distinct().collect()]
        old = _rows(spark, path).filter(F.col(name).isin(touched)).select(*[F.col(k).alias(f"_key_{k}") for k in keys])
        same = F.lit(True)
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
        fresh = fresh.join(old, same, "left_anti")
    fresh.hint("rebalance", name).write.mode("append").partitionBy(name).parquet(path)
