"""op11: runs against a plain version, as kernels, as operator and as query."""

import random

import numpy as np
import pytest
from reference import WORD, all_runs, periodic
from pyspark.sql import functions as F

from tessera.llm import periodic_runs
from tessera.llm.queries import op11_periodic_runs


def _many(rng):
    docs = []
    for _ in range(rng.randint(0, 6)):
        n, k = rng.choice([0, 1, 5, 11, 12, 13, 30, 60, 150]), rng.randint(1, 4)
        d = [rng.randrange(k) for _ in range(n)]
        if n and rng.random() < 0.5:
            p = rng.randint(1, n)
            d = [d[i % p] for i in range(n)]
            if rng.random() < 0.5:
                d[rng.randrange(n)] = 9
        docs.append(d)
    return docs


@pytest.mark.parametrize("cells", [1 << 20, 50])
def test_kernel(monkeypatch, cells):
    monkeypatch.setattr(periodic_runs, "CELLS", cells)
    rng = random.Random(3)
    for _ in range(400):
        docs = _many(rng)
        at = np.cumsum([0, *map(len, docs)])
        got = periodic_runs.runs_of(np.array([x for d in docs for x in d], np.uint64), at, least := rng.choice([12, 12, 3]))
        want = [(s + a, length, p) for a, d in zip(at, docs) for s, length, p in all_runs(d, least)]
        assert list(zip(*(x.tolist() for x in got), strict=True)) == want


def test_skipped_grid_points_cost_little():
    """Half a million equal words, and nested runs, in seconds: later octaves skip what lies in known runs."""
    n = 500_000
    for w, runs in ((np.zeros(n), 1), (np.arange(n) % 7, 1), (np.tile(np.r_[np.zeros(12), 1], n // 130), n // 130 + 1)):
        assert len(periodic_runs.runs_of(w.astype(np.uint64), np.array([0, len(w)]))[0]) == runs


def _rows(df):
    return sorted(tuple(r)[:8] for r in df.collect())


def test_query(spark, sf_dir, documents):
    want = sorted((r.doc_id, *periodic(r.doc_id, r.text)) for r in documents.collect() if len(r.text or "") < 30_000)
    ids = {w[0] for w in want}
    assert [r for r in _rows(op11_periodic_runs(spark, sf_dir)) if r[0] in ids] == want


def test_edges(spark, tmp_path, edge, edge_rows, nothing):
    rows = [*edge_rows, (22, "a b c d " * 3), (23, "a b c d " * 2 + "a b c"), (24, "é 中 " * 9 + "end")]
    spark.createDataFrame(rows + rows[9:11], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert _rows(op11_periodic_runs(spark, str(tmp_path))) == sorted((i, *periodic(i, t)) for i, t in rows + rows[9:11])
    assert op11_periodic_runs(spark, str(tmp_path)).filter("runs_sha256 is null or collapsed_sha256 is null").count() == 0
    assert periodic_runs.find_runs(edge).count() == len(edge_rows)
    assert periodic_runs.find_runs(nothing).collect() == []
    odd = periodic_runs.find_runs(spark.createDataFrame([(None, "x y " * 8), (None, None)], "doc_id long, text string"))
    assert sorted((r.doc_id, r.n_words, len(r.runs), bytes(r.collapsed)) for r in odd.collect()) == [(None, 0, 0, b""), (None, 16, 1, b"x y")]


def test_tandem(spark):
    df = spark.createDataFrame([(1, " ".join(map(str, range(40))))], "doc_id long, text string")
    row = periodic_runs.find_runs(df, tandem=(F.lit(4), F.lit(6))).first()
    assert [tuple(r) for r in row.runs] == [(4, 36, 6)] and WORD.findall(bytes(row.collapsed).decode()) == [str(i) for i in range(10)]
