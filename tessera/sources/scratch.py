"""Tables in the folder that driver and executors share: what cuts a lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """A new path below spark.checkpoint.dir; where that is unset, a local master (tests) gets a temporary one, a cluster is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:  # only tests and single machines go without
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tessera-stream-")
    return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """The rows as a written table: executors may be lost, and nothing stays in their storage."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
