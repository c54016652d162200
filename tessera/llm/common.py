"""Scratch tables, size-checked broadcasts and row keys for the operators here."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes up to which a side may be broadcast or collected; beyond it the join shuffles.
BROADCAST_BYTES = 16 << 20
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset, a local master (tests) gets a temporary one; a cluster is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", folder)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    whole = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    # With its scheme, so that Python tasks open the same store as Spark.
    return (f"file://{whole[5:]}" if whole.startswith("file:/") and not whole.startswith("file://") else whole).rstrip("/")


_made: list[str] = []


def new_folder(spark: SparkSession, name: str) -> str:
    _made.append(f"{shared_folder(spark)}/tessera-{name}-{uuid.uuid4().hex}")
    return _made[-1]


def drop_scratch(spark: SparkSession) -> int:
    """Deletes the scratch tables made so far; only once the results that read them are stored."""
    done = 0
    while _made:
        path = spark._jvm.org.apache.hadoop.fs.Path(_made.pop())
        done += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return done


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder, read again: cuts lineage and outlives executors."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")  # nothing reads these shuffles again
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def bytes_of(table: DataFrame) -> int:
    """Bytes of a written table's rows in memory, about: what its strings, binaries and arrays hold, and 8 for any other value."""

    def width(name: str, kind: str) -> Column:
        if kind in ("string", "binary"):
            return F.coalesce(F.octet_length(name), F.lit(0)) + 8
        if kind.startswith("array"):
            return F.coalesce(F.size(name), F.lit(0)) * 8 + 8
        return F.lit(8)

    whole = F.lit(8)
    for name, kind in table.dtypes:
        whole = whole + width(name, kind)
    return table.agg(F.sum(whole.cast("long"))).first()[0] or 0


def small_side(table: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A broadcast hint if the written table has at most `limit` bytes, else the table as it is."""
    return F.broadcast(table) if bytes_of(table) <= limit else table


def running(df: DataFrame, name: str, order: list, sums: dict[str, Column]) -> DataFrame:
    """The rows with sums over all rows before each in the order (unique keys), whatever their number.

    Rows are range-partitioned; windows run inside partitions, and what earlier partitions
    hold is added from one row per partition.
    """
    keys = [f"_o{i}" for i in range(len(order))]
    placed = df.withColumns({k: F.col(c) if isinstance(c, str) else c for k, c in zip(keys, order, strict=True)})
    placed = placed.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_part", F.spark_partition_id())
    placed = written(placed.withColumns({f"_s{i}": c for i, c in enumerate(sums.values())}), name)
    totals = placed.groupBy("_part").agg(*(F.sum(f"_s{i}").alias(f"_t{i}") for i in range(len(sums))))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_part", *(F.coalesce(F.sum(f"_t{i}").over(earlier), F.lit(0)).alias(f"_b{i}") for i in range(len(sums))))
    own = Window.partitionBy("_part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    found = [(F.col(f"_b{i}") + F.coalesce(F.sum(f"_s{i}").over(own), F.lit(0))).alias(c) for i, c in enumerate(sums)]
    return placed.join(F.broadcast(starts), "_part").select(*df.columns, *found)


def text_of(name: str = "text") -> Column:
    """Whole text; null is empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of runs without 0x20 and 0x09-0x0D, by built-in functions."""
    dots = F.regexp_replace(text, r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+", ".")
    return F.when(text.rlike(r"[^\x20\x09-\x0D]"), F.length(dots)).otherwise(F.lit(0)).cast("long")
