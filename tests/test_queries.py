"""Every query with SQL against DuckDB on the smallest tables."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
import __spark_entry__ as entry
from tools.compare import rows_of

ORACLES = entry.oracle_sql()
PLAIN = [n for n in entry.queries() if not n.startswith("op") and n != "pipeline"]


@pytest.fixture(scope="module")
def db(sf_dir):
    c = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", PLAIN)
def test_query(spark, sf_dir, db, name):
    df = entry.queries()[name](spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    if name in ORACLES:
        cur = db.execute(ORACLES[name])
        assert got == rows_of([c[0] for c in cur.description], cur.fetchall())
    else:
        assert got[0]


def test_entry(spark):
    assert entry.entry(spark).columns
