"""Joins of points with boxes and sites by cells whose sides are powers of two, so that scaling a coordinate is exact."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Finest cells of boxes: 2 ** -30 of a unit.
FINEST = 30
#: Sites in a cell that is not divided further.
LEAF_SITES = 32
#: Boxes in one cell above which the points of its level are dealt to so many parts, each with all boxes of the cell.
CROWDED, PARTS = 256, 64


def _cell(v: Column, level: Column | int) -> Column:
    return F.floor(v * F.pow(F.lit(2.0), F.lit(level) if isinstance(level, int) else level)).cast("long")


def box_level(width: Column, height: Column) -> Column:
    """The level whose cells are the smallest that are no smaller than the box: it meets at most two of them each way."""
    side = F.greatest(width, height)
    e = F.ceil(F.log2(side))
    e = F.when(F.pow(F.lit(2.0), e) < side, e + 1).otherwise(e)
    return F.when(side > 0, F.least(F.lit(FINEST), -e)).otherwise(F.lit(FINEST)).cast("int")


def box_cells(boxes: DataFrame, bounds: tuple[str, str, str, str]) -> DataFrame:
    """Boxes with the cells of their own level that they meet (`_l`, `_cx`, `_cy`), at most four each; empty boxes have none."""
    x0, y0, x1, y1 = (F.col(c).cast("double") for c in bounds)
    own = boxes.filter((x0 <= x1) & (y0 <= y1)).withColumn("_l", box_level(x1 - x0, y1 - y0))
    span = lambda a, b: F.explode(F.sequence(_cell(a, F.col("_l")), _cell(b, F.col("_l"))))
    return own.withColumn("_cx", span(x0, x1)).withColumn("_cy", span(y0, y1))


def box_join(points: DataFrame, boxes: DataFrame, x: str, y: str, bounds: tuple[str, str, str, str], strict: bool = True) -> DataFrame:
    """Pairs of a point and a box (x_min, y_min, x_max, y_max) that holds it; boxes of every size in one equi-join.

    A box lies in the few cells of its own level, a point probes one cell of each level that
    occurs (at most one for each power of two between the smallest and the largest box).
    Wide boxes share a few cells; there the points of a cell go to many tasks.
    """
    grid = box_cells(boxes, bounds)
    most = grid.groupBy("_l", "_cx", "_cy").count().groupBy("_l").agg(F.max("count")).collect()  # one row for each size, some tens
    levels, crowded = sorted(r[0] for r in most), [r[0] for r in most if r[1] > CROWDED]
    parts = F.when(F.col("_l").isin(crowded), PARTS).otherwise(1)
    x0, y0, x1, y1 = (F.col(c) for c in bounds)
    inside = (F.col(x) > x0) & (F.col(x) < x1) & (F.col(y) > y0) & (F.col(y) < y1) if strict else F.col(x).between(x0, x1) & F.col(y).between(y0, y1)
    placed = points.withColumn("_l", F.explode(F.array(*map(F.lit, levels)).cast("array<int>")))
    placed = placed.withColumns({"_cx": _cell(F.col(x).cast("double"), F.col("_l")), "_cy": _cell(F.col(y).cast("double"), F.col("_l"))})
    placed = placed.withColumn("_p", F.pmod(F.xxhash64(x, y), parts).cast("int"))
    grid = grid.withColumn("_p", F.explode(F.sequence(F.lit(0), parts - 1)))
    return placed.join(grid, ["_l", "_cx", "_cy", "_p"]).filter(inside).drop("_l", "_cx", "_cy", "_p")


def first_box(points: DataFrame, boxes: DataFrame, point_id: str, x: str, y: str, bounds: tuple[str, str, str, str], box_id: str) -> DataFrame:
    """Each point with the least box id that strictly holds it, or NULL."""
    hit = box_join(points, boxes, x, y, bounds).groupBy(point_id).agg(F.min(box_id).alias(box_id))
    return points.join(hit, point_id, "left")


# --- nearest sites -------------------------------------------------------------------------------------


def _cells(sites: DataFrame, level: int) -> DataFrame:
    """Occupied cells of a level, each with one of its sites and their number."""
    at = sites.withColumns({"_cx": _cell(F.col("_sx"), level), "_cy": _cell(F.col("_sy"), level)})
    return at.groupBy("_cx", "_cy").agg(F.min_by(F.struct("_sx", "_sy"), "_id").alias("_rep"), F.count(F.lit(1)).alias("_n"))


def _square(dx: Column, dy: Column) -> Column:
    return dx * dx + dy * dy


def _beyond(v: Column, cell: Column, level: int) -> Column:
    """How far a coordinate lies outside a cell."""
    low = cell.cast("double") * F.lit(2.0**-level)
    return F.greatest(low - v, v - (low + F.lit(2.0**-level)), F.lit(0.0))


def _levels(sites: DataFrame) -> tuple[int, int]:
    """(a level at which at most 25 cells are occupied, the finest that tells doubles apart)."""
    low_x, high_x, low_y, high_y = sites.agg(F.min("_sx"), F.max("_sx"), F.min("_sy"), F.max("_sy")).first()
    extent, most = max(high_x - low_x, high_y - low_y), max(abs(v) for v in (low_x, high_x, low_y, high_y))
    finest = 52 - math.frexp(max(most, 2.0**-900))[1]
    return min(2 - math.frexp(extent)[1] if extent > 0 else finest, finest), finest


def _deepest(sites: DataFrame, level: int, finest: int) -> int:
    """The first level, two at a time, at which no cell holds many sites."""
    while level < finest and (_cells(sites, level).agg(F.max("_n")).first()[0] or 0) > LEAF_SITES:
        level = min(level + 2, finest)
    return level


def nearest_site(points: DataFrame, sites: DataFrame, x: str, y: str, site_id: str, site_x: str, site_y: str) -> DataFrame:
    """Adds nearest and distance2: the site at the least squared distance (of equals the least id); NULL without sites or coordinates.

    Cells are searched from coarse to fine. A cell's site bounds the distance from above, its
    sides bound it from below; cells that lie further off than the best bound of a point go,
    the rest are divided, until they hold few sites, which are then compared. A ring of the
    search therefore ends where its distance exceeds the best found, whatever the density, and
    no task holds all sites. Points at one place are searched once.
    """
    s = sites.select(F.col(site_x).cast("double").alias("_sx"), F.col(site_y).cast("double").alias("_sy"), F.col(site_id).alias("_id"))
    s = s.filter((F.abs("_sx") < float("inf")) & (F.abs("_sy") < float("inf")) & F.col("_id").isNotNull()).groupBy("_sx", "_sy").agg(F.min("_id").alias("_id"))
    p = points.select(F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).filter((F.abs("_x") < float("inf")) & (F.abs("_y") < float("inf"))).distinct()
    kind = dict(s.dtypes)["_id"]
    if s.limit(1).count() == 0:
        return points.withColumns({"nearest": F.lit(None).cast(kind), "distance2": F.lit(None).cast("double")})
    top, finest = _levels(s)
    leaf = _deepest(s, top, finest)
    held = _cells(s, top).agg(F.collect_list(F.struct("_cx", "_cy", "_rep")).alias("_top"))  # at most 25
    low = lambda c, level: _square(_beyond(F.col("_x"), c["_cx"], level), _beyond(F.col("_y"), c["_cy"], level))
    high = lambda rep: _square(F.col("_x") - rep["_sx"], F.col("_y") - rep["_sy"])
    found = p.join(F.broadcast(held)).withColumn("_best", F.array_min(F.transform("_top", lambda c: high(c["_rep"]))))
    found = found.withColumn("_c", F.explode(F.filter("_top", lambda c: low(c, top) <= F.col("_best")))).select("_x", "_y", "_best", F.col("_c._cx").alias("_px"), F.col("_c._cy").alias("_py"))
    level, own = top, Window.partitionBy("_x", "_y")
    while level < leaf:
        below = min(level + 2, leaf)
        up = F.lit(1 << (below - level))
        child = _cells(s, below).select(F.floor(F.col("_cx") / up).alias("_px"), F.floor(F.col("_cy") / up).alias("_py"), "_cx", "_cy", "_rep")
        found = found.join(child, ["_px", "_py"]).withColumn("_best", F.min(F.least("_best", high(F.col("_rep")))).over(own))
        near = _square(_beyond(F.col("_x"), F.col("_cx"), below), _beyond(F.col("_y"), F.col("_cy"), below))
        found = found.filter(near <= F.col("_best")).select("_x", "_y", "_best", F.col("_cx").alias("_px"), F.col("_cy").alias("_py"))
        level = below
    placed = s.withColumns({"_px": _cell(F.col("_sx"), leaf), "_py": _cell(F.col("_sy"), leaf)})
    far = _square(F.col("_x") - F.col("_sx"), F.col("_y") - F.col("_sy"))
    best = found.join(placed, ["_px", "_py"]).groupBy("_x", "_y").agg(F.min(F.struct(far.alias("d"), F.col("_id").alias("id"))).alias("_b"))
    best = best.select("_x", "_y", F.col("_b.id").alias("nearest"), F.col("_b.d").alias("distance2"))
    same = (F.col(x).cast("double") == F.col("_x")) & (F.col(y).cast("double") == F.col("_y"))
    return points.join(best, same, "left").drop("_x", "_y")
