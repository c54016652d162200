"""op12: codebooks, codes and errors against a plain version; the search against all distances."""

import random

import numpy as np
import pytest
from reference import codes

from tessera.llm import vector_codes
from tessera.llm.queries import op12_vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int"


def test_search():
    rng = np.random.default_rng(0)
    for _ in range(150):
        n, k, d, most = rng.integers(1, 700), rng.integers(1, 40), rng.integers(1, 40), rng.choice([2, 50, 1 << 24])
        x, book = rng.integers(-most, most, (n, d)), rng.integers(-most, most, (k, d))
        every = ((x[:, None] - book[None]) ** 2).sum(2)
        code, error = vector_codes.nearest(x, book)
        assert (code == every.argmin(1)).all() and (error == every.min(1)).all()


def test_entries_are_dropped(monkeypatch):
    """Far entries are gone once their distance passes the best: few are carried to the last dimensions."""
    seen = []
    first_least = vector_codes._first_least
    monkeypatch.setattr(vector_codes, "_first_least", lambda row, value, n: seen.append(len(row)) or first_least(row, value, n))
    rng = np.random.default_rng(1)
    book = rng.integers(-1000, 1000, (256, 32))
    vector_codes.nearest(book[:100] + rng.integers(-5, 5, (100, 32)), book)
    assert max(seen) <= 110


def _got(df):
    rows = df.collect()
    assert len({r.codebooks_sha256 for r in rows}) <= 1
    return {r.vec_id: (r.code, r.error, r.label_error) for r in rows}, rows[0].codebooks_sha256 if rows else None


def _query(spark, tmp_path, rows, name="t"):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/{name}/embeddings.parquet")
    return op12_vector_codes(spark, f"{tmp_path}/{name}")


def test_query(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, [float(np.float32(rng.gauss(i % 7, 1))) for _ in range(8)], rng.choice([1, 2, None])) for i in range(700)]
    rows += [(1000, None, 1), (1001, [1.0] * 7 + [None], 1), (1002, [float("nan")] * 8, 1), (1003, [float("-inf")] + [0.0] * 7, 2)]
    assert _got(_query(spark, tmp_path, rows)) == codes(rows)


def test_few_rows_ties_and_repeats(spark, tmp_path):
    rows = [(3, [0.5] * 4, None), (1, [0.5] * 4, 5), (2, [-0.3, 0.0, 0.0, 9.0], None)]
    assert _got(_query(spark, tmp_path, rows, "few")) == codes(rows)
    again = _query(spark, tmp_path, rows + rows + [(None, [1.0] * 4, 5)], "again").collect()
    assert len(again) == 7 and {r.error for r in again} == {0}
    assert _query(spark, tmp_path, [], "none").collect() == [] and _query(spark, tmp_path, [(1, None, 1)], "null").collect() == []
    assert _query(spark, tmp_path, [(1, [], 1)], "flat").first().code == "00000000"


def test_extra_columns(spark):
    df = spark.createDataFrame([(i, [i / 9] * 4, i % 2, i, "x") for i in range(20)], "vec_id long, embedding array<double>, label int, error long, code string")
    rows, books = vector_codes.compress(df)
    assert rows.columns == ["vec_id", "label", "code", "error", "label_error"] and rows.count() == 20 and books.shape == (4, 20, 1)


@pytest.mark.parametrize("rows", [[(1, [1.0] * 4, 1), (2, [1.0] * 8, 1)], [(1, [1.0] * 6, 1)], [(1, [1e30] * 4, 1)], [(1, [1e8] * 4, 1)]])
def test_what_has_no_codes_is_an_error(spark, tmp_path, rows):
    with pytest.raises(Exception, match="one length|too large"):
        _query(spark, tmp_path, rows).collect()
