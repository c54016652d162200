"""Exact deduplication by progressive refinement.

Level 1 groups by byte length, level 2 groups what shares a length by a hash of
the first characters, level 3 reads whole texts only of groups that survive both.
Each level pre-aggregates on the map side, so a group that holds a third of all
rows is one row per task; no text is shuffled.

Defined results: null text counts as empty; equal texts keep the row with the
largest id (null ids lose; all null: keep_id is null); rows that repeat one id and
text are listings of one document, and share its answer; an empty table gives no
rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_side, text_of, written

PREFIX_CHARS = 64


def _keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = text_of(text_col)
    return df.select(F.col(id_col).alias("_id"), text.alias("_text"), F.octet_length(text).alias("_len"))


def duplicate_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """One row per text that occurs more than once: _len, text_sha256, keep_id, group_size, n_keep."""
    rows = _keyed(df, id_col, text_col)
    lengths = written(rows.groupBy("_len").count().filter("count > 1").select("_len"), "lengths")
    head = F.xxhash64(F.substring("_text", 1, prefix_chars))
    of_length = rows.join(small_side(lengths), "_len", "left_semi")
    surviving = written(of_length.groupBy("_len", head.alias("_head")).count().filter("count > 1").select("_len", "_head"), "heads")
    full = (
        rows.withColumn("_head", head)
        .join(small_side(surviving), ["_len", "_head"], "left_semi")
        .groupBy("_len", F.sha2("_text", 256).alias("text_sha256"), "_id")
        .agg(F.count("*").alias("n"))
    )
    return (
        full.groupBy("_len", "text_sha256")
        .agg(F.max("_id").alias("keep_id"), F.sum("n").alias("group_size"), F.coalesce(F.max_by("n", "_id"), F.sum("n")).alias("n_keep"))
        .filter("group_size > 1")
    )


def label_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, keep_id, group_size, kept and text_sha256 of every row."""
    groups = written(duplicate_groups(df, id_col, text_col).select("_len", "text_sha256", "keep_id", "group_size"), "copies")
    rows = _keyed(df, id_col, text_col).select("_id", "_len", F.sha2("_text", 256).alias("text_sha256"))
    alone = F.col("group_size").isNull()
    return rows.join(small_side(groups), ["_len", "text_sha256"], "left").select(
        F.col("_id").alias(id_col),
        F.when(alone, F.col("_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | F.col("_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        "text_sha256",
    )


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with their columns: one per text."""
    groups = written(duplicate_groups(df, id_col, text_col), "copies").select(
        F.col("_len").alias("_glen"), F.col("text_sha256").alias("_gsha"), F.col("keep_id").alias("_keep"), F.col("n_keep").alias("_n")
    )
    text = text_of(text_col)
    # Only rows whose length a duplicate group has are hashed and compared.
    joined = df.join(small_side(groups), (F.octet_length(text) == F.col("_glen")) & (F.sha2(text, 256) == F.col("_gsha")), "left")
    stays = joined.filter(F.col("_gsha").isNull() | F.col(id_col).eqNullSafe(F.col("_keep")))
    single = stays.filter(F.coalesce("_n", F.lit(1)) == 1).select(*df.columns)
    if groups.filter("_n > 1").isEmpty():
        return single
    repeated = stays.filter("_n > 1").dropDuplicates(["_gsha"]).select(*df.columns)
    return single.unionByName(repeated)
