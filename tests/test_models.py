from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tessera.operators import labels as L
from tessera.operators import placement as P


def test_forest_learns_a_rare_class(spark):
    """Balanced weights: a class of one row in ten is found where the features tell it apart."""
    rows = [(float(i % 10 == 0), float(i % 10 == 0) * 5 + (i % 7) / 7, float(i % 3)) for i in range(300)]
    df = spark.createDataFrame(rows, "label double, a double, b double")
    model = L.train_forest(df, ["a", "b"], "label", trees=5, depth=3)
    scored = model.transform(df).select("label", vector_to_array("probability").alias("p"))
    assert scored.filter(F.col("label") != F.when(F.col("p")[1] > 0.5, 1.0).otherwise(0.0)).count() == 0


def test_split_takes_the_first_rows_in_order(spark):
    day = date(2024, 1, 1)
    df = spark.createDataFrame([(r, day + timedelta(i)) for r, n in (("a", 7), ("b", 2), ("c", 11)) for i in range(n)], "region string, date date").repartition(5)
    got = L.ordered_split(df, 0.5).orderBy("region", "date").collect()
    assert [r.train for r in got] == [True] * 10 + [False] * 10
    assert L.ordered_split(df.limit(0)).count() == 0


def test_places_of_britain_and_the_states(one):
    """A single separator before or after the abbreviation, as the fixed pattern has it."""
    regions = lambda place: one(P.constraints(F.lit(""), F.lit(place), F.lit("")))["regions"]
    assert regions("UK") == regions("London UK") == regions("uk based") == ["United Kingdom"]
    assert regions("London, UK") == regions("ukulele") == []
    assert regions("U.S.") == regions("us") == regions("U. S. only") == regions("USA") == ["United States"]
    assert regions("bus") == [] and regions("EU time zones") == [] and regions("EU") == ["EU"]
    assert regions("Porto (Remote)") == ["Porto"]


def test_guard(one):
    guard = lambda ok, notes, fit: [one(x) for x in P.location_guard(F.lit(ok), F.array(*map(F.lit, notes)), F.lit(fit), ["EU", "Canada"])]
    note = "Hire region incompatible with acceptable regions (EU, Canada)"
    assert guard(True, "abcde", False) == [False, [note, *"abcd"]]
    assert guard(True, [note, "a"], False) == [False, [note, "a"]]
    assert guard(False, "ab", False) == [False, ["a", "b"]] and guard(True, "ab", None) == [True, ["a", "b"]] and guard(True, "ab", True) == [True, ["a", "b"]]


def test_lasso_from_sums_equals_a_plain_version(spark):
    """Coordinate descent on the rows themselves, fold by fold, gives the same coefficients."""
    rng = np.random.default_rng(2)
    rows, want = [], {}
    for g, n in (("a", 61), ("b", 200), ("few", 9)):
        x = rng.normal(size=(n, 3)) * [1, 10, 0.1] + [5, -3, 0]
        y = 2 * x[:, 0] - 0.1 * x[:, 1] + rng.normal(size=n)
        rows += [(g, i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y, strict=True))]
        if n >= 10:
            want[g] = _plain_lasso((x - x.mean(0)) / x.std(0), y - y.mean())
    df = spark.createDataFrame([*rows, ("a", 1000, None, 1.0, 1.0, 1.0)], "g string, t int, x double, y double, z double, v double").repartition(7)
    for block in (None, F.floor(F.col("t") / 20)):
        got = {}
        for r in L.lasso_per_group(df, "g", ["x", "y", "z"], "v", ["t"], block=block).collect():
            got.setdefault(r.g, {})[r.feature] = r.coefficient
        assert got.keys() == want.keys()
        for g, w in want.items():
            assert [got[g][c] for c in "xyz"] == pytest.approx(w, abs=1e-6)


def _plain_lasso(x, y, folds=5, steps=30):
    def descend(x, y, a):
        w = np.zeros(x.shape[1])
        for _ in range(200):
            old = w.copy()
            for j in range(len(w)):
                r = x[:, j] @ (y - x @ w + x[:, j] * w[j]) / len(y)
                w[j] = np.sign(r) * max(abs(r) - a, 0) / (x[:, j] @ x[:, j] / len(y))
            if np.abs(w - old).max() < 1e-8:
                break
        return w

    part = np.arange(len(y)) * folds // len(y)
    grid = np.abs(x.T @ y).max() / len(y) * np.logspace(0, -3, steps)
    loss = [np.mean([np.mean((y[part == k] - x[part == k] @ descend(x[part != k], y[part != k], a)) ** 2) for k in range(folds)]) for a in grid]
    return descend(x, y, grid[int(np.argmin(loss))])
