"""Sources: tables, CSV with or without a preamble, JSON documents, RSS, HTML blobs, preferences, pages of an API."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import date, timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from tessera.functions.text import parse_board_url

from .schemas import SCHEMAS, conform


def parquet(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return conform(df, schema) if schema else df


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=SCHEMAS.get(schema, schema), mode="PERMISSIVE")


def csv_after(spark: SparkSession, path: str, header_starts: str, schema: str) -> DataFrame:
    """CSV files whose header comes after some lines: what precedes it is dropped.

    Files are read whole, one row each, since only then lines have an order; such exports are small.
    """
    lines = F.split("value", r"\r?\n")
    files = spark.read.text(path, wholetext=True).withColumn("_l", lines)
    head = F.array_position(F.transform("_l", lambda x: x.startswith(header_starts)), True)
    body = files.filter(head > 0).withColumn("line", F.explode(F.slice("_l", head + 1, F.size("_l")))).filter(F.trim("line") != "")
    return body.select(F.from_csv("line", schema).alias("r")).select("r.*")


def companies(spark: SparkSession, path: str) -> DataFrame:
    """Registry rows with a name and an address; kind and slug from the address where they are missing."""
    df = csv(spark, path, "companies").filter((F.trim(F.coalesce("company_name", F.lit(""))) != "") & (F.trim(F.coalesce("job_board_url", F.lit(""))) != ""))
    kind, slug = parse_board_url(F.col("job_board_url"))
    return df.withColumns({"ats_type": F.coalesce(F.nullif("ats_type", F.lit("")), kind), "ats_slug": F.coalesce(F.nullif("ats_slug", F.lit("")), slug)})


def first_filled(*sources: Callable[[], DataFrame]) -> DataFrame:
    """The first source that has a row, else the last."""
    for make in sources[:-1]:
        df = make()
        if not df.isEmpty():
            return df
    return sources[-1]()


def json_items(payloads: DataFrame, column: str, schema: str, items: str) -> DataFrame:
    """One row per element of the array `items` in JSON documents; malformed documents give none."""
    parsed = payloads.withColumn("_j", F.from_json(column, schema))
    return parsed.withColumn("_i", F.explode(F.col(f"_j.{items}"))).drop("_j").select("*", "_i.*").drop("_i", column)


def rss_items(payloads: DataFrame, column: str, schema: str = "title string, link string, guid string, pubDate string, description string") -> DataFrame:
    """Items of RSS documents by the built-in XML parser."""
    whole = f"channel struct<item:array<struct<{', '.join(p.strip().replace(' ', ':', 1) for p in schema.split(','))}>>>"
    parsed = payloads.withColumn("_x", F.from_xml(F.col(column), F.lit(whole)))
    return parsed.withColumn("_i", F.explode("_x.channel.item")).drop("_x").select("*", "_i.*").drop("_i", column)


def script_json(html: Column, script_id: str, schema: str) -> Column:
    """The JSON of a script element by its id."""
    blob = F.regexp_extract(html, rf'(?s)<script[^>]*\bid="{script_id}"[^>]*>(.*?)</script>', 1)
    return F.from_json(F.nullif(blob, F.lit("")), schema)


def preferences(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return preferences_of(f.read())


def leaves(node: dict, path: str = "") -> Iterator[tuple[str, str]]:
    """(dotted name, text) of each value of a tree; lists are comma-joined."""
    for key, value in node.items():
        if isinstance(value, dict):
            yield from leaves(value, f"{path}{key}.")
        else:
            yield path + key, ",".join(map(str, value)) if isinstance(value, list) else str(value).lower() if isinstance(value, bool) or value is None else str(value)


def preference_rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, name, value) of each document of preferences in a column; NULL and blank ones have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [(i, *leaf) for i, text in zip(pdf["_id"], pdf["_text"], strict=True) for leaf in leaves(preferences_of(text or ""))]
            yield pd.DataFrame(found, columns=["_id", "name", "value"])

    rows = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return rows.mapInPandas(run, f"_id {dict(rows.dtypes)['_id']}, name string, value string").withColumnRenamed("_id", id_col)


def preferences_of(text: str) -> dict:
    """A small `key: value` tree with lists, by indentation; no other part of YAML."""
    root: dict = {}
    stack: list[tuple[int, dict | list]] = [(-1, root)]
    rows = [line.rstrip() for line in text.splitlines() if line.strip() and not line.lstrip().startswith("#")]
    value = lambda s: {"true": True, "false": False, "null": None, "": None}.get(s, float(s) if s.replace(".", "", 1).lstrip("-").isdigit() and "." in s else int(s) if s.lstrip("-").isdigit() else s.strip("\"'"))
    for i, row in enumerate(rows):
        depth, text = len(row) - len(row.lstrip()), row.strip()
        while stack[-1][0] >= depth and not (text.startswith("- ") and isinstance(stack[-1][1], list) and stack[-1][0] == depth):
            stack.pop()
        holder = stack[-1][1]
        if text.startswith("- "):
            holder.append(value(text[2:].strip()))
            continue
        key, _, rest = text.partition(":")
        if rest.strip():
            holder[key] = value(rest.strip())
            continue
        following = rows[i + 1].strip() if i + 1 < len(rows) else ""
        child: dict | list = [] if following.startswith("- ") else {}
        holder[key] = child
        stack.append((len(rows[i + 1]) - len(rows[i + 1].lstrip()) if isinstance(child, list) else depth, child))
    return root


# --- incremental reading -------------------------------------------------------------------------------


def latest_day(df: DataFrame, column: str = "date") -> date | None:
    """Newest day of a table; parquet statistics make this a footer read."""
    return df.agg(F.max(F.to_date(column))).first()[0]


def fetch_range(latest: date | None, safe: date, lookback_days: int, least_days: int = 0) -> tuple[date, date] | None:
    """Days to fetch: from the day after the newest (or the look-back) up to the safe day; None if fresh."""
    start = latest + timedelta(days=1) if latest else safe - timedelta(days=lookback_days)
    if least_days:
        start = min(start, safe - timedelta(days=least_days))
    return (start, safe) if start <= safe else None


def unseen(df: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys the sink does not have yet."""
    return df.join(done.select(*keys).distinct(), keys, "left_anti")


def densified_request(spans: DataFrame, start: str, end: str, day: str = "date") -> DataFrame:
    """One row per key and day of each requested range; a range that ends before it starts has none."""
    s, e = F.col(start), F.col(end)
    return spans.withColumn(day, F.explode(F.when(s <= e, F.sequence(s, e))))


class PagedSource(DataSource):
    """A cursor-paged collection as a Spark data source: one partition per stream of pages.

    options: `pages`, a callable path "module:function" (stream, cursor) -> (rows, next cursor or None);
    `streams`, comma-separated names; `ddl`, the row schema.
    """

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return self.options["ddl"]

    def reader(self, schema: StructType) -> PagedReader:
        return PagedReader(self.options)


class PagedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(x) for x in self.options["streams"].split(",")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        from importlib import import_module

        module, _, name = self.options["pages"].partition(":")
        pages, cursor = getattr(import_module(module), name), None
        while True:
            rows, cursor = pages(partition.value, cursor)
            yield from map(tuple, rows)
            if cursor is None:
                return
