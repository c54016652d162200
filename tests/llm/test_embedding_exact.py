import numpy as np
import pytest

from tessera.llm import embedding_dedup


@pytest.fixture(scope="module")
def planted():
    """One label of random vectors, with isolated pairs just above the threshold."""
    rng = np.random.default_rng(11)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    a = unit(rng.standard_normal((6000, 64)))
    z = rng.standard_normal((600, 64))
    z = unit(z - (z * a[:600]).sum(1, keepdims=True) * a[:600])
    return np.concatenate([a, 0.931 * a[:600] + np.sqrt(1 - 0.931**2) * z])


@pytest.mark.parametrize("exact_block", [embedding_dedup.EXACT_BLOCK, 700])
def test_isolated_pairs_are_all_found(spark, planted, exact_block):
    rows = [(i, v.tolist(), 1) for i, v in enumerate(planted)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(df, exact_block=exact_block).collect()}
    linked = planted @ planted.T >= embedding_dedup.THRESHOLD * np.outer(np.linalg.norm(planted, axis=1), np.linalg.norm(planted, axis=1))
    assert linked.sum() == len(planted) + 1200
    least = linked.argmax(1)
    assert got == {i: (int(linked[i].sum()) - 1, int(least[i]), bool(least[i] == i)) for i in range(len(planted))}


def test_clusters_are_pruned(spark):
    """Far clusters never meet; a point between two near ones unites them, whatever the passes found."""
    rng = np.random.default_rng(3)
    centres = np.eye(16)[:8]
    x = np.concatenate([c + 0.02 * rng.standard_normal((300, 16)) for c in centres])
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(df, passes=1, window=1, exact_block=100).collect()}
    assert got == {i: (299, i // 300 * 300) for i in range(len(x))}


def test_extreme_magnitudes(spark):
    """Squares that underflow or overflow are scaled first."""
    rows = [(1, [1e-200, 0.0]), (2, [2e-200, 0.0]), (3, [1e200, 1e190]), (4, [3e300, 0.0]), (5, [0.0, 1e-320]), (6, [0.0, -1e300])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(df).collect()}
    assert got == {1: (3, 1), 2: (3, 1), 3: (3, 1), 4: (3, 1), 5: (0, 5), 6: (0, 6)}


def test_chained_component(spark):
    """Points along an arc link to their neighbours only: most lie outside the core, and blocks that are far are left out."""
    angles = np.linspace(0, np.pi * 1.5, 700)
    x = np.stack([np.cos(angles), np.sin(angles), np.zeros(len(angles))], 1)
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    linked = x @ x.T >= embedding_dedup.THRESHOLD
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(df, block=40).collect()}
    assert got == {i: (int(linked[i].sum()) - 1, 0) for i in range(len(x))}
