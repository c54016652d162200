"""Names, boxes and grids of regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import strip_accents

from .spatial import box_join, nearest_site

#: Administrative suffixes.
SUFFIXES = ("regency", "county", "department", "cercle", "municipality", "ward")


def plain_name(name: Column) -> Column:
    """Lower case, underscores as spaces, administrative suffix and accents off."""
    x = F.trim(F.lower(F.replace(F.coalesce(name, F.lit("")), F.lit("_"), F.lit(" "))))
    return strip_accents(F.trim(F.regexp_replace(x, rf"\s+(?:{'|'.join(SUFFIXES)})$", "")))


def parent_of(region: Column) -> Column:
    """Name before the numbered part of a sub-region id."""
    return F.regexp_replace(region, r"(?:_(?:sub|part|cell)?_?\d+)+$", "")


def without_complete(name: Column) -> Column:
    """`X_Complete` is X; `Some County` and `Some_County` keep their kind, municipalities, regencies and wards lose it."""
    x = F.regexp_replace(F.regexp_replace(name, r"_Complete$", ""), r"\s+", "_")
    return F.regexp_replace(x, r"_(?:Municipality|Regency|Ward)$", "")


def split_area(df: DataFrame, area: str, target: float, least: float, depth: int = 10) -> DataFrame:
    """Halve the longer side until the area is at most the target: rows of (region, lon_min, lat_min, lon_max, lat_max, part).

    Halving is uniform, so the number of cuts along each side follows from the area and the shape at once.
    """
    levels = F.least(F.lit(depth), F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(F.col(area) / target, F.lit(1.0)))))).cast("int")
    levels = F.when(F.col(area) / F.pow(F.lit(2.0), levels) < least, F.greatest(levels - 1, F.lit(0))).otherwise(levels)
    w, h = F.col("lon_max") - F.col("lon_min"), F.col("lat_max") - F.col("lat_min")
    step = lambda acc, _: F.when(acc["w"] >= acc["h"], F.struct((acc["w"] / 2).alias("w"), acc["h"].alias("h"))).otherwise(F.struct(acc["w"].alias("w"), (acc["h"] / 2).alias("h")))
    cell = F.when(levels > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(levels, F.lit(1))), F.struct(w.cast("double").alias("w"), h.cast("double").alias("h")), step)).otherwise(F.struct(w.cast("double").alias("w"), h.cast("double").alias("h")))
    d = df.withColumn("_c", cell).withColumns({"_nx": F.round(w / F.col("_c.w")).cast("int"), "_ny": F.round(h / F.col("_c.h")).cast("int")})
    d = d.withColumn("_x", F.explode(F.sequence(F.lit(0), F.col("_nx") - 1))).withColumn("_y", F.explode(F.sequence(F.lit(0), F.col("_ny") - 1)))
    x0, y0 = F.col("lon_min") + F.col("_x") * F.col("_c.w"), F.col("lat_min") + F.col("_y") * F.col("_c.h")
    return d.select("region", x0.alias("lon_min"), y0.alias("lat_min"), (x0 + F.col("_c.w")).alias("lon_max"), (y0 + F.col("_c.h")).alias("lat_max"), (F.col("_x") * F.col("_ny") + F.col("_y") + 1).alias("part"))


def grid_means(cells: DataFrame, regions: DataFrame, value: str) -> DataFrame:
    """Mean of the grid cells in each region's box, per date; a box without a cell takes the cell nearest its centre."""
    bounds = ("lon_min", "lat_min", "lon_max", "lat_max")
    inside = box_join(cells, regions, "lon", "lat", bounds, strict=False).groupBy("region", "date").agg(F.avg(value).alias(value))
    empty = regions.join(inside.select("region").distinct(), "region", "left_anti")
    sites = cells.select("lon", "lat").distinct().withColumn("site", F.concat_ws(",", "lon", "lat"))
    near = nearest_site(empty, sites, "centroid_lon", "centroid_lat", "site", "lon", "lat")
    keyed = cells.withColumn("nearest", F.concat_ws(",", "lon", "lat"))
    return inside.unionByName(near.select("region", "nearest").join(keyed, "nearest").groupBy("region", "date").agg(F.avg(value).alias(value)))


def region_issues(df: DataFrame) -> DataFrame:
    """An array of the rules that a region's row breaks."""
    rules = {
        "no_name": F.trim(F.coalesce("region", F.lit(""))) == "", "lon_order": F.col("lon_min") >= F.col("lon_max"), "lat_order": F.col("lat_min") >= F.col("lat_max"),
        "out_of_range": (F.abs("lon_min") > 180) | (F.abs("lon_max") > 180) | (F.abs("lat_min") > 90) | (F.abs("lat_max") > 90),
        "centre_outside": ~(F.col("centroid_lon").between(F.col("lon_min"), F.col("lon_max")) & F.col("centroid_lat").between(F.col("lat_min"), F.col("lat_max"))),
    }
    return df.withColumn("issues", F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()]), lambda x: x.isNotNull()))


def coverage(expected: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Expected against stored rows per key, with the share."""
    e = expected.groupBy(key).agg(F.count(F.lit(1)).alias("expected"))
    s = stored.groupBy(key).agg(F.count(F.lit(1)).alias("stored"))
    return e.join(s, key, "left").na.fill(0, ["stored"]).withColumn("share", F.col("stored") / F.col("expected"))


def sparkline(values: Column, width: float, height: float) -> Column:
    """`x,y x,y ...` of the values that are there, scaled to the box."""
    low, high = F.array_min(values), F.array_max(values)
    step = width / F.greatest(F.size(values) - 1, F.lit(1))
    y = lambda v: height - F.coalesce(F.try_divide(v - low, high - low), F.lit(0.5)) * height
    points = F.transform(values, lambda v, i: F.when(v.isNotNull(), F.concat_ws(",", F.round(i * step, 1), F.round(y(v), 1))))
    return F.array_join(points, " ")


def repeated_within(df: DataFrame, parent: str, name: str) -> DataFrame:
    """(parent, name, n) of names that a parent has more than once."""
    return df.groupBy(parent, name).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def years_of(df: DataFrame, key: str, day: str) -> DataFrame:
    """(key, years): the years that are there, in order."""
    return df.select(key, F.year(F.to_date(day)).alias("_y")).distinct().groupBy(key).agg(F.array_sort(F.collect_list("_y")).alias("years"))
