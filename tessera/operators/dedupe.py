"""De-duplication, upserts and table maintenance on parquet."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .windows import latest_per_key


def keep_best(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """One row per key, the first in the given order; give a tie column to make it stable."""
    return latest_per_key(df, keys, *order)


def upsert(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Source rows replace target rows of the same key, and new keys are added (source: one row per key)."""
    return target.join(source.select(*keys), list(keys), "left_anti").unionByName(source.select(*target.columns))


def upsert_changed(target: DataFrame, source: DataFrame, keys: Sequence[str], hash_col: str, content: Sequence[str], scores: Sequence[str], seen: str = "last_seen", changed: str = "last_changed", fill: Sequence[str] = ()) -> DataFrame:
    """Change-aware upsert: another hash overwrites the content and clears the scores, the same hash only touches.

    `fill` columns keep the old value if there is one. Adds `changed_now`.
    """
    old, new = target.alias("o"), source.alias("n")
    on = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
    present, incoming = F.col(f"o.{hash_col}").isNotNull(), F.col(f"n.{hash_col}").isNotNull()
    differs = present & incoming & (F.col(f"o.{hash_col}") != F.col(f"n.{hash_col}"))
    fresh = ~present & incoming

    def value(c: str) -> Column:
        o = F.col(f"o.{c}")
        n = F.col(f"n.{c}") if c in source.columns else F.lit(None).cast(dict(target.dtypes)[c])
        if c in keys:
            return F.coalesce(o, n)
        if c in scores:
            return F.when(differs | fresh, F.lit(None).cast(dict(target.dtypes)[c])).otherwise(o)
        if c in fill:
            return F.coalesce(o, n)
        if c == seen:
            return F.coalesce(n, o)
        if c == changed:
            return F.when(differs | fresh, F.col(f"n.{seen}")).otherwise(o)
        if c in content or c == hash_col:
            return F.when(differs | fresh, n).otherwise(o)
        return F.coalesce(o, n)

    joined = old.join(new, on, "full")
    return joined.select(*[value(c).alias(c) for c in target.columns], (differs | fresh).alias("changed_now"))


def update_only(target: DataFrame, source: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Matching rows take the source's values where it has them; nothing is added."""
    right = source.select(*keys, *[F.col(c).alias(f"_u_{c}") for c in columns])
    out = target.join(right, list(keys), "left")
    return out.withColumns({c: F.coalesce(f"_u_{c}", c) for c in columns}).select(*target.columns)


def insert_new(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    fresh = source.dropDuplicates(list(keys)).join(target.select(*keys), list(keys), "left_anti")
    return target.unionByName(fresh.select(*target.columns))


def replace_days(target: DataFrame, batch: DataFrame, day: str) -> DataFrame:
    """Rows of the days in the batch go, the batch comes."""
    return target.join(batch.select(day).distinct(), day, "left_anti").unionByName(batch.select(*target.columns))


def delete_keys(target: DataFrame, allowed: DataFrame, keys: Sequence[str]) -> DataFrame:
    return target.join(allowed.select(*keys).distinct(), list(keys), "left_semi")


def missing_keys(expected: DataFrame, actual: DataFrame, keys: Sequence[str]) -> DataFrame:
    return expected.select(*keys).distinct().join(actual.select(*keys), list(keys), "left_anti")


def merge_fields(df: DataFrame, keys: Sequence[str], first: Sequence[str], joined: Sequence[str], order: str) -> DataFrame:
    """One row per key: the first value that is not empty of `first`, the distinct values of `joined` with + between."""
    w = [F.min(F.when(F.col(c).isNotNull() & (F.col(c) != ""), F.struct(F.col(order), F.col(c)))).getField(c).alias(c) for c in first]
    j = [F.array_join(F.array_sort(F.collect_set(c)), "+").alias(c) for c in joined]
    return df.groupBy(*keys).agg(*w, *j)


def merge_duplicates(df: DataFrame, key: str, priority: Column, url: str, order: str) -> DataFrame:
    """The row of best priority of each key, with the other rows' urls in `other_urls`."""
    urls = df.groupBy(F.col(key).alias("_key")).agg(F.collect_set(url).alias("_urls"))
    best = keep_best(df, [key], priority, order).join(urls, F.col(key).eqNullSafe(F.col("_key")))
    return best.withColumn("other_urls", F.array_sort(F.array_except("_urls", F.array(url)))).drop("_key", "_urls")


def mine_employers(pool: DataFrame, postings: DataFrame, source: str, order: str) -> DataFrame:
    """The pool (company_name, discovery_source, ats_type, ats_slug, probed) and the employers of postings that it lacks.

    Names are equal without case and outer blanks; of postings of one employer the first in order
    counts. Empty names and "unknown" are none. The board is looked for in the posting's address and text.
    """
    from tessera.functions.text import parse_board_url

    name = F.trim("company_name")
    kind, slug = parse_board_url(F.concat_ws(" ", "url", "description_text"))
    named = postings.filter(name.isNotNull() & ~F.lower(name).isin("", "unknown")).withColumn("_key", F.lower(name))
    fresh = named.join(pool.select(F.lower(name).alias("_key")).distinct(), "_key", "left_anti")
    fresh = latest_per_key(fresh.withColumns({"_kind": kind, "_slug": slug}), ["_key"], F.asc(order))
    found = fresh.select(name.alias("company_name"), F.lit(source).alias("discovery_source"), F.col("_kind").alias("ats_type"), F.col("_slug").alias("ats_slug"), F.lit(False).alias("probed"))
    return pool.unionByName(found)


def collect_sources(sources: dict[str, Callable[[], DataFrame]], enabled: Sequence[str]) -> DataFrame:
    """(company_name, discovery_source) of the enabled sources, in their given order; one row per employer names all of its sources."""
    wanted = {e.strip().lower() for e in enabled}
    parts = [make().select("company_name", F.lit(name).alias("discovery_source"), F.lit(i).alias("_i")) for i, (name, make) in enumerate(sources.items()) if name in wanted]
    if not parts:
        raise ValueError(f"none of {sorted(wanted)} is a source")
    found = reduce(DataFrame.unionByName, parts).filter(F.trim("company_name") != "")
    grouped = found.groupBy(F.lower(F.trim("company_name")).alias("_key")).agg(F.min_by("company_name", "_i").alias("company_name"), F.array_sort(F.collect_set("discovery_source")).alias("_s"))
    return grouped.select("company_name", F.array_join("_s", "+").alias("discovery_source"))
