"""Hazard features, labels and predictions of region-day frames (region, date, measures)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.special import gamma_cdf, normal_quantile

from .joins import event_within
from .stats import climatology
from .windows import days_since, rolling, streak, within_days

KEYS = ["region"]
ROLLS = (
    ("precip_3d_max", "precipitation", F.max, 3), ("precip_7d_sum", "precipitation", F.sum, 7), ("precip_14d_sum", "precipitation", F.sum, 14), ("precip_30d_sum", "precipitation", F.sum, 30),
    ("temp_7d_mean", "temperature", F.avg, 7), ("temp_7d_max", "temperature", F.max, 7), ("sm1_14d_mean", "sm1", F.avg, 14), ("sm2_14d_mean", "sm2", F.avg, 14),
    ("discharge_3d_max", "discharge", F.max, 3), ("discharge_7d_mean", "discharge", F.avg, 7), ("hotspot_7d_sum", "hotspots", F.sum, 7), ("frp_7d_mean", "frp", F.avg, 7),
)


def yes(condition: Column) -> Column:
    """A comparison with NULL is false."""
    return F.coalesce(condition, F.lit(False))


def temporal_features(df: DataFrame) -> DataFrame:
    """Rolling maxima, sums and means of the measures that are there, over rows of a region."""
    return df.withColumns({name: rolling(F.col(c), how, KEYS, "date", n) for name, c, how, n in ROLLS if c in df.columns})


def temporal_metadata(df: DataFrame) -> DataFrame:
    return df.withColumns({"month": F.month("date"), "day_of_year": F.dayofyear("date"), "days_since_precip": days_since(F.col("precipitation") > 1.0, KEYS, "date")})


def anomalies(df: DataFrame, clim: DataFrame) -> DataFrame:
    """Flags against the monthly percentiles; either soil layer counts; NULL compares false."""
    j = df.join(clim, ["region", "month"], "left")
    c = set(j.columns)
    tests = {
        "temp_above_p80": ("temperature", ">", "p80"), "temp_above_p95": ("temperature", ">", "p95"), "precip_below_p20": ("precipitation", "<", "p20"),
        "discharge_above_p95": ("discharge", ">", "p95"), "ndvi_below_p20": ("ndvi", "<", "p20"), "high_hotspot": ("hotspots", ">", "p95"), "high_frp": ("frp", ">", "p95"),
    }
    out = {n: yes(F.col(m) > F.col(f"{m}_{p}") if op == ">" else F.col(m) < F.col(f"{m}_{p}")) for n, (m, op, p) in tests.items() if m in c and f"{m}_{p}" in c}
    soils = [s for s in ("sm1", "sm2") if s in c]
    if soils:
        out["sm_below_p20"] = sum_or([yes(F.col(s) < F.col(f"{s}_p20")) for s in soils])
        out["sm_above_p80"] = sum_or([yes(F.col(s) > F.col(f"{s}_p80")) for s in soils])
    if "hotspots" in c:
        out["has_hotspots"] = yes(F.col("hotspots") > 0)
    return j.withColumns(out)


def sum_or(conditions: Sequence[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def monthly_climatology(df: DataFrame, metrics: Sequence[str]) -> DataFrame:
    return climatology(df.withColumn("month", F.month("date")), ["region", "month"], metrics)


def spi30(df: DataFrame, history: DataFrame | None = None, scale: int = 30) -> DataFrame:
    """Adds spi30: rolling sums of a region, a gamma distribution by moments with a mass at zero, the normal quantile.

    A history (region, date, precipitation) calibrates it: it fills dates that df lacks or
    has no value for, and is dropped again. Sums need half their rows. Where the positive sums
    do not vary, the value is the plain standard score. Built-in functions only.
    """
    own = df.select("region", "date", "precipitation", F.lit(True).alias("_own"))
    rows = own
    if history is not None:
        past = history.select("region", "date", F.col("precipitation").alias("_past"))
        rows = own.join(past, ["region", "date"], "full").select("region", "date", F.coalesce("precipitation", "_past").alias("precipitation"), F.coalesce("_own", F.lit(False)).alias("_own"))
    rows = rows.select("region", "date", "_own", rolling(F.col("precipitation"), F.sum, KEYS, "date", scale, scale // 2).cast("double").alias("_x"))
    rows = rows.withColumn("_x", F.when(~F.isnan("_x"), F.col("_x")))
    x = F.col("_x")
    moments = rows.groupBy("region").agg(
        F.avg(F.when(x > 0, x)).alias("_mean"), F.var_samp(F.when(x > 0, x)).alias("_var"), F.avg((x == 0).cast("double")).alias("_zero"), F.avg(x).alias("_all"), F.stddev_samp(x).alias("_sd")
    )
    j = rows.filter("_own").join(moments, "region").withColumn("_p", F.when(x > 0, F.col("_zero") + (1 - F.col("_zero")) * gamma_cdf(x * F.col("_mean") / F.col("_var"), F.col("_mean") ** 2 / F.col("_var"))).otherwise(F.col("_zero")))
    plain = (x - F.col("_all")) / (F.col("_sd") + 1e-6)
    value = F.when(x.isNull() | F.col("_mean").isNull(), None).when(F.col("_var") > 0, normal_quantile(F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col("_p"))))).otherwise(plain)
    return df.join(j.select("region", "date", value.alias("spi30")), ["region", "date"], "left")


def fire_label(hotspots: Column) -> Column:
    """3 on a day with hotspots, 2 within three days of one, 1 within five, else 0."""
    hot = F.when(hotspots > 0, 1).otherwise(0)
    near = lambda n: within_days(hot, F.max, KEYS, "date", n, n) == 1
    return F.when(hot == 1, 3).when(near(3), 2).when(near(5), 1).otherwise(0)


def drought_label(spi: Column, ndvi_low: Column, soil_low: Column) -> Column:
    ndvi_low, soil_low = yes(ndvi_low), yes(soil_low)
    severe, moderate, mild = yes(spi < -1.4), yes((spi < -0.95) & (spi >= -1.4)), yes(spi < -0.7)
    return (
        F.when(severe & (soil_low | ndvi_low), 3).when((ndvi_low & soil_low) | (moderate & soil_low), 2)
        .when((mild & (ndvi_low | soil_low)) | (moderate & ndvi_low & ~soil_low), 1).otherwise(0)
    )


def flood_labels(df: DataFrame, events: DataFrame) -> DataFrame:
    """flood_label and flood_confidence: events within two days first, else the discharge proxy at half confidence."""
    near = event_within(df, events, KEYS, "date", "event_date", 2, "_d")
    q, p95, p80 = F.col("discharge"), F.col("discharge_p95"), F.col("discharge_p80")
    around = within_days(q, F.max, KEYS, "date", 2, 2) > p95
    proxy = F.when(yes(q > p95), 3).when(q.isNotNull() & yes(around), 2).when(yes((q > p80) & (F.col("precipitation") > F.col("precipitation_p80"))), 1).otherwise(0)
    label = F.when(F.col("_d") == 0, 3).when(F.col("_d") <= 2, 2).otherwise(proxy)
    confidence = F.when(F.col("_d").isNotNull(), 1.0).when(proxy > 0, 0.5).otherwise(1.0)
    return near.withColumns({"flood_label": label, "flood_confidence": confidence}).drop("_d")


def landslide_features(df: DataFrame) -> DataFrame:
    soil = (F.col("sm1") + F.col("sm2")) / 2
    df = df.withColumns({"precip_30": rolling(F.col("precipitation"), F.sum, KEYS, "date", 30), "discharge_30": rolling(F.col("discharge"), F.sum, KEYS, "date", 30), "soil_21": rolling(soil, F.avg, KEYS, "date", 21)})
    return streak(df, F.col("discharge") > F.col("discharge_p95"), KEYS, "date", "discharge_run")


def landslide_labels(df: DataFrame, events: DataFrame) -> DataFrame:
    """landslide_label (0..2) and confidence: events by day, week, fortnight; else five proxy factors."""
    f = landslide_features(df).withColumn("_m", F.month("date"))
    cuts = f.groupBy("region", "_m").agg(F.percentile("precip_30", 0.99).alias("_p"), F.percentile("discharge_30", 0.99).alias("_q"), F.percentile("soil_21", 0.9).alias("_s"))
    f = event_within(f.join(cuts, ["region", "_m"]), events, KEYS, "date", "event_date", 14, "_d")
    rain, flow, soil = yes(F.col("precip_30") > F.col("_p")), yes(F.col("discharge_30") > F.col("_q")), yes(F.col("soil_21") > F.col("_s"))
    steep = yes(F.col("slope") > 20) if "slope" in df.columns else F.lit(False)
    proxy = F.when(rain & flow & soil & (F.col("discharge_run") >= 5) & steep, 3).when((rain & flow) | (flow & soil), 2).when(rain | flow, 1).otherwise(0)
    d = F.col("_d")
    label = F.when(d == 0, 3).when(d <= 7, 2).when(d <= 14, 1).otherwise(proxy)
    confidence = F.when(d.isNotNull(), 1.0).when(proxy > 0, 0.7).otherwise(1.0)
    return f.withColumns({"landslide_label": F.least(label, F.lit(2)), "landslide_confidence": confidence}).drop("_m", "_p", "_q", "_s", "_d")


def threshold_class(probabilities: Column, level_2: float, level_3: float | None) -> Column:
    """3 or 2 where their probability reaches its threshold, else the most likely class (the first of ties)."""
    best = F.array_position(probabilities, F.array_max(probabilities)) - 1
    out = F.when(F.coalesce(F.get(probabilities, F.lit(2)) >= level_2, F.lit(False)), 2).otherwise(best)
    return out if level_3 is None else F.when(F.coalesce(F.get(probabilities, F.lit(3)) >= level_3, F.lit(False)), 3).otherwise(out)


def calibrate_thresholds(scored: DataFrame, grid: Sequence[float], probabilities: str = "p", label: str = "label", weight_macro: float = 0.5) -> tuple[float, float]:
    """The pair (level 2, level 3) of the grid with the best mean of accuracy and recall of severe classes: one pass."""
    pairs = [(a, b) for a in grid for b in grid]
    hits = []
    for i, (a, b) in enumerate(pairs):
        said = threshold_class(F.col(probabilities), a, b)
        severe = F.col(label) >= 2
        hits += [F.avg((said == F.col(label)).cast("double")).alias(f"a{i}"), F.avg(F.when(severe, (said >= 2).cast("double"))).alias(f"r{i}")]
    row = scored.agg(*hits).first()
    best = max(range(len(pairs)), key=lambda i: ((1 - weight_macro) * (row[f"a{i}"] or 0) + weight_macro * (row[f"r{i}"] or 0), -i))
    return pairs[best]


def ordered_split(df: DataFrame, share: float = 0.8, order: Sequence[str] = ("region", "date")) -> DataFrame:
    """`train` for the first share of rows in the order: places within the first column, after the rows of those before it."""
    first, *rest = order
    counts = df.groupBy(first).agg(F.count(F.lit(1)).alias("_n"))  # a row per region
    before = F.coalesce(F.sum("_n").over(Window.orderBy(first).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(F.col(first).alias("_first"), before.alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("_total"))
    place = F.row_number().over(Window.partitionBy(first).orderBy(*rest)) - 1
    placed = df.withColumn("_place", place).join(starts, F.col(first).eqNullSafe(F.col("_first")))
    return placed.withColumn("train", F.col("_before") + F.col("_place") < share * F.col("_total")).drop("_place", "_first", "_before", "_total")


def train_forest(df: DataFrame, features: Sequence[str], label: str, weight: str | None = None, trees: int = 200, depth: int = 20, seed: int = 42):
    """A Spark ML forest; class weights are balanced and multiply the row weights."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    counts = {r[0]: r[1] for r in df.groupBy(label).count().collect()}  # one row per class
    total = sum(counts.values())
    balance = F.lit(0.0)
    for k, n in counts.items():
        balance = F.when(F.col(label) == k, total / (len(counts) * n)).otherwise(balance)
    rows = df.withColumn("_w", balance * (F.col(weight) if weight else F.lit(1.0)))
    forest = RandomForestClassifier(labelCol=label, featuresCol="_x", weightCol="_w", numTrees=trees, maxDepth=depth, seed=seed)
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="_x", handleInvalid="keep"), forest]).fit(rows)


def fold_sums(df: DataFrame, group: str, features: Sequence[str], target: str, order: Sequence[str], folds: int = 5, block: Column | None = None) -> DataFrame:
    """(group, fold, n, xx, xy, yy): sums of products of the features and the target, less their means in the group; xx row by row.

    Folds are consecutive in the order. A row's place is its place in its block plus the rows of
    earlier blocks, so a group with a third of all rows is sorted in as many tasks as it has blocks
    (`block` must not fall in the order). Rows with a NULL or NaN are left out.
    """
    whole = F.lit(True)
    for c in [*features, target]:
        whole = whole & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    rows = df.filter(whole).select(F.col(group).alias("_g"), (F.lit(0) if block is None else block).alias("_b"), *order, *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate([*features, target])])
    n = len(features)
    values = [f"_x{i}" for i in range(n + 1)]
    blocks = rows.groupBy("_g", "_b").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy("_g")
    blocks = blocks.select("_g", "_b", F.coalesce(F.sum("_n").over(w.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_n").over(w).alias("_all"))
    means = rows.groupBy("_g").agg(*[F.avg(v).alias(f"_m{v}") for v in values])
    place = F.row_number().over(Window.partitionBy("_g", "_b").orderBy(*order)) - 1
    j = rows.withColumn("_p", place).join(blocks, ["_g", "_b"]).join(means, "_g").withColumns({v: F.col(v) - F.col(f"_m{v}") for v in values})
    fold = F.floor((F.col("_before") + F.col("_p")) * folds / F.col("_all")).cast("long").alias("fold")
    times = lambda a, b: F.sum(F.col(f"_x{a}") * F.col(f"_x{b}"))
    xx = F.array(*[times(min(a, b), max(a, b)) for a in range(n) for b in range(n)]).alias("xx")
    sums = [F.count(F.lit(1)).alias("n"), xx, F.array(*[times(a, n) for a in range(n)]).alias("xy"), times(n, n).alias("yy")]
    return j.groupBy(F.col("_g").alias(group), fold).agg(*sums)


def lasso_path(n: np.ndarray, xx: np.ndarray, xy: np.ndarray, yy: np.ndarray, steps: int) -> np.ndarray:
    """Coefficients on standardised features with the penalty of least error over the folds, from the sums of each fold."""

    def descend(count: float, products: np.ndarray, with_y: np.ndarray, penalty: float) -> np.ndarray:
        w, gram, target = np.zeros(len(with_y)), products / count, with_y / count
        for _ in range(200):
            old = w.copy()
            for j in range(len(w)):
                if gram[j, j] > 0:
                    r = target[j] - gram[j] @ w + gram[j, j] * w[j]
                    w[j] = np.sign(r) * max(abs(r) - penalty, 0) / gram[j, j]
            if np.abs(w - old).max() < 1e-8:
                break
        return w

    total = n.sum()
    sd = np.sqrt(np.diagonal(xx.sum(0)) / total)
    sd = np.where(sd > 0, sd, 1)
    xx, xy = xx / np.outer(sd, sd), xy / sd
    all_xx, all_xy = xx.sum(0), xy.sum(0)
    most = max(np.abs(all_xy).max() / total, 1e-12)

    def error(penalty: float) -> float:
        lost = []
        for k in range(len(n)):
            w = descend(total - n[k], all_xx - xx[k], all_xy - xy[k], penalty)
            lost.append((yy[k] - 2 * w @ xy[k] + w @ xx[k] @ w) / n[k])
        return float(np.mean(lost))

    grid = most * np.logspace(0, -3, steps)
    return descend(total, all_xx, all_xy, grid[int(np.argmin([error(a) for a in grid]))])


def lasso_per_group(df: DataFrame, group: str, features: Sequence[str], target: str, order: Sequence[str], folds: int = 5, steps: int = 30, block: Column | None = None) -> DataFrame:
    """Cross-validated lasso of each group on standardised features: (group, feature, coefficient).

    Spark sums products per group and fold; what a task descends on is `folds` small matrices of a
    group, whatever its rows. Groups with fewer than two rows a fold have none.
    """
    size = len(features)
    sums = fold_sums(df, group, features, target, order, folds, block)
    held = sums.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("fold", "n", "xx", "xy", "yy"))).alias("folds")).filter(F.aggregate("folds", F.lit(0).cast("long"), lambda a, f: a + f["n"]) >= 2 * folds)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, parts in zip(pdf[group], pdf["folds"], strict=True):
                n, yy = (np.array([p[c] for p in parts], float) for c in ("n", "yy"))
                xx = np.array([np.array(p["xx"], float) for p in parts]).reshape(-1, size, size)
                xy = np.array([np.array(p["xy"], float) for p in parts])
                yield pd.DataFrame({group: [name] * size, "feature": list(features), "coefficient": lasso_path(n, xx, xy, yy, steps)})

    return held.mapInPandas(run, f"{group} {dict(df.dtypes)[group]}, feature string, coefficient double")


def one_hot(df: DataFrame, column: str, categories: Sequence[str]) -> DataFrame:
    """Stable columns `<column>_<category>`: missing categories are 0."""
    return df.withColumns({f"{column}_{c}": yes(F.col(column) == c).cast("tinyint") for c in categories})


def region_type(ndvi: Column, density: Column) -> Column:
    n, d = F.coalesce(ndvi, F.lit(0.3)), F.coalesce(density, F.lit(0.0))
    return F.when((n < 0.25) & (d < 5), "desert").when((d > 20) | ((n > 0.4) & (d > 10)), "vegetated").otherwise("semi_arid")


