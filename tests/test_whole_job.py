"""Queries over whole tables: a row for every row that belongs to the job."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
import __spark_entry__ as entry
from tessera.operators import dedupe
from tools.compare import rows_of


@pytest.mark.parametrize(
    ("name", "count"),
    [
        ("canonical_key", "SELECT count(*) FROM orders"),
        ("truncate_sentences", "SELECT count(*) FROM documents"),
        ("year_shift_union", "SELECT 10 * count(*) FROM orders"),
        ("merge_duplicates", "SELECT count(DISTINCT p_brand) FROM part"),
        ("employer_footprint", "SELECT count(DISTINCT p_brand) FROM part"),
        ("balanced_chunks", "SELECT count(*) FROM (SELECT DISTINCT c_nationkey, CAST(o_orderdate AS DATE) FROM orders JOIN customer ON o_custkey = c_custkey)"),
    ],
)
def test_whole_table(spark, sf_dir, name, count):
    db = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        db.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = entry.queries()[name](spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    cur = db.execute(entry.oracle_sql()[name])
    assert got == rows_of([c[0] for c in cur.description], cur.fetchall())
    assert len(got[1]) == db.execute(count).fetchone()[0]


def test_merge_duplicates_collects_once_per_key(spark):
    rows = [("a", 1, "u1", 1), ("a", 0, "u2", 2), ("a", 0, "u3", 3), (None, 0, "u4", 4), (None, 1, "u5", 5), ("b", 0, None, 6), ("b", 1, "u7", 7)]
    df = spark.createDataFrame(rows, "k string, p int, url string, id int")
    out = dedupe.merge_duplicates(df, "k", df.p, "url", "id")
    assert {(r.k, r.id): r.other_urls for r in out.collect()} == {("a", 2): ["u1", "u3"], (None, 4): ["u5"], ("b", 6): ["u7"]}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.split("\n") if "collect_set" in x and "windowspec" in x]
