"""The epoch source, the committing sink, bucketed tables and state with a lifetime."""

import os
import random
import subprocess
import sys
from datetime import datetime, timedelta
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tessera.operators import windows as W
from tessera.sources import buckets, committed
from tessera.streaming import epochs, lifetimes
from tessera.streaming import jobs as S

SCHEMA = "id long, ts timestamp_ntz, v double"
START = datetime(2024, 1, 1)


def _rows(first, last):
    return pa.table({"id": list(range(first, last)), "ts": pa.array([START + timedelta(hours=i) for i in range(first, last)], pa.timestamp("us")), "v": [float(i % 7) for i in range(first, last)]})


def _write(path, name, table, **options):
    path.mkdir(parents=True, exist_ok=True)
    pq.write_table(table, path / name, row_group_size=50, **options)


# --- the source ----------------------------------------------------------------------------------------


def test_two_runs_give_each_row_once(spark, tmp_path):
    src, sunk = tmp_path / "src", []

    def run():
        q = S.run_batches(epochs.source(spark, str(src), SCHEMA, "ts"), lambda b, n: sunk.extend(r.id for r in b.collect()), str(tmp_path / "cp"))
        assert q.exception() is None

    _write(src, "a.parquet", _rows(0, 200))
    run()
    assert sorted(sunk) == list(range(200))
    _write(src, "b.parquet", _rows(200, 260), write_statistics=False)
    run()
    run()
    assert sorted(sunk) == list(range(260))


def test_a_broken_batch_is_delivered_again(spark, tmp_path):
    src, got, broken = tmp_path / "src", [], [True]
    _write(src, "a.parquet", _rows(0, 120))

    def sink(batch, number):
        if broken[0]:
            raise RuntimeError("lost")
        got.extend(r.id for r in batch.collect())

    run = lambda: S.run_batches(epochs.source(spark, str(src), SCHEMA, "ts"), sink, str(tmp_path / "cp"))
    with pytest.raises(Exception, match="lost"):
        run()
    broken[0] = False
    run()
    assert sorted(got) == list(range(120))


def test_only_row_groups_in_the_range_are_read(tmp_path):
    _write(tmp_path / "src", "a.parquet", _rows(0, 200))
    r = epochs.EpochReader({"path": str(tmp_path / "src"), "time": "ts"}, ["id"])
    hour = 3_600_000_000
    at = epochs.micros(START)
    assert r.latestOffset() == {"epoch": at + 199 * hour + 1}
    parts = r.partitions({"epoch": at + 60 * hour}, {"epoch": at + 110 * hour})
    assert [p.group for p in parts] == [1, 2]
    assert [x for p in parts for b in r.read(p) for x in b.column("id").to_pylist()] == list(range(60, 110))
    r.back = 20 * hour
    assert [p.group for p in r.partitions({"epoch": at + 60 * hour}, {"epoch": at + 110 * hour})] == [0, 1, 2]
    assert epochs.EpochReader({"path": str(tmp_path / "none"), "time": "ts", "start": "5"}, []).latestOffset() == {"epoch": 5}


def test_late_rows_come_with_a_look_back_and_are_skipped_by_key(spark, tmp_path):
    src, table, state = tmp_path / "src", str(tmp_path / "table"), str(tmp_path / "state")
    for number, rows in enumerate((_rows(0, 90), pa.concat_tables([_rows(60, 130), _rows(0, 5)]))):
        _write(src, f"{number}.parquet", rows)
        start = epochs.stored_epoch(spark, state, "x")
        stream = epochs.source(spark, str(src), SCHEMA, "ts", start, lookback=0) if not number else epochs.source(spark, str(src), SCHEMA, "ts", start - 40 * 3_600_000_000)
        S.run_batches(stream, epochs.sync_sink(table, state, "x", ["id"], "ts", n=4), str(tmp_path / f"cp{number}"))
    assert sorted(r.id for r in buckets.read(spark, table).collect()) == list(range(130))
    assert epochs.stored_epoch(spark, state, "x") == epochs.micros(START + timedelta(hours=129)) + 1 and epochs.stored_epoch(spark, state, "y") == 0


# --- the committing sink -------------------------------------------------------------------------------


def test_last_wins_in_a_buffer():
    t = pa.table({"k": [1, None, 1, 2, None], "v": [1, 2, 3, 4, 5]})
    assert committed.last_wins(t, ["k"]).to_pylist() == [{"k": 1, "v": 3}, {"k": 2, "v": 4}, {"k": None, "v": 5}]
    assert committed.last_wins(t, []).num_rows == 5


@pytest.mark.parametrize("buffer", [1, 7, 10_000])
def test_flushes_keep_the_latest(spark, tmp_path, buffer):
    rng = random.Random(buffer)
    rows = [(rng.randrange(9), i, f"v{i}") for i in range(300)] + [(None, 300, "n")]
    df, path = spark.createDataFrame(rows, "k long, n long, v string"), str(tmp_path / "t")
    for part in (df.filter("n < 150"), df.filter("n >= 150")):
        committed.flush_latest(part, path, ["k"], ["n"], buffer)
    want = {k: v for k, _, v in rows}
    assert {r.k: r.v for r in committed.latest(spark, path, ["k"]).collect()} == want


def test_nothing_shows_before_a_commit(spark, tmp_path):
    path = tmp_path / "t"
    bad = spark.range(0, 40, 1, 20).withColumn("x", F.when(F.col("id") == 38, F.raise_error(F.lit("broke"))).otherwise(F.lit("y")))
    with pytest.raises(Exception, match="broke"):
        committed.save(bad, str(path))
    assert committed.read(spark, str(path)) is None and committed.read(spark, str(path), "id long").count() == 0
    with pytest.raises(Exception, match="broke"):
        committed.save(bad, str(path), keep_finished=True)
    kept = {r.id for r in committed.read(spark, str(path)).collect()}
    assert kept and kept.isdisjoint({38, 39})
    left = committed.process_missing(spark.range(40), str(path), ["id"], lambda k: k.withColumn("x", F.lit("z")))
    assert left == 40 - len(kept)
    assert sorted(r.id for r in committed.read(spark, str(path)).collect()) == list(range(40))


RETRY = """
import os, sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession, functions as F
from tessera.sources import committed
spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").getOrCreate()

@F.udf("long")
def once(i):
    mark = {path!r} + "-failed"
    if i == 35 and not os.path.exists(mark):
        open(mark, "w").close()
        raise RuntimeError("first attempt")
    return i

committed.save(spark.range(0, 80, 1, 4).select(once("id").alias("id")), {path!r}, buffer_rows=5)
print("ROWS", sorted(r.id for r in committed.read(spark, {path!r}).collect()) == list(range(80)), os.path.exists({path!r} + "-failed"))
"""


def test_a_task_that_fails_once_leaves_no_duplicate_and_no_gap(tmp_path):
    code = RETRY.format(repo=str(Path(__file__).resolve().parent.parent), path=str(tmp_path / "t"))
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300, env=os.environ | {"PYSPARK_PYTHON": sys.executable}, check=False)
    assert "ROWS True True" in out.stdout, out.stderr[-2000:]
    (tmp_path / "t" / "data" / "left-by-a-failed-attempt.parquet").write_bytes(b"broken")
    assert "left" not in "".join(committed._manifests(str(tmp_path / "t")))


# --- bucketed tables -----------------------------------------------------------------------------------


def _files(path):
    return {p.parent.name: p.name for p in Path(path).glob("_bucket_of_*/*.parquet")}


def test_untouched_buckets_keep_their_files(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.range(400).select("id", F.lit("a").alias("v"), F.lit(1).alias("at"))
    assert buckets.upsert(df, path, ["id"], "at", 8) == list(range(8))
    before = _files(path)
    touched = buckets.upsert(spark.createDataFrame([(7, "b", 2), (7, "c", 3), (9, "old", 0), (1000, "new", 1)], df.schema), path, ["id"], "at", 8)
    after = _files(path)
    assert {k for k in before if before[k] != after[k]} == {f"_bucket_of_8={b}" for b in touched} and len(touched) <= 3
    rows = {r.id: r.v for r in buckets.read(spark, path).collect()}
    assert len(rows) == 401 and (rows[7], rows[9], rows[1000], rows[8]) == ("c", "a", "new", "a")
    assert buckets.upsert(df.limit(0), path, ["id"], "at", 8) == []
    with pytest.raises(ValueError, match="number of buckets"):
        buckets.upsert(df, path, ["id"], "at", 16)


def test_upserts_equal_a_dictionary(spark, tmp_path):
    rng, path, want = random.Random(5), str(tmp_path / "t"), {}
    for batch in range(4):
        rows = [(rng.choice([None, *range(12)]), rng.randrange(1000), batch) for _ in range(30)]
        for k, at, v in rows:
            if k not in want or at > want[k][0]:
                want[k] = (at, v)
        rows = list({(k, at): (k, at, v) for k, at, v in rows}.values())
        buckets.upsert(spark.createDataFrame(rows, "k long, at long, v long"), path, ["k"], "at", 4)
    got = {r.k: r.at for r in buckets.read(spark, path).collect()}
    assert got == {k: at for k, (at, _) in want.items()}


def test_new_columns_and_new_keys(spark, tmp_path):
    path = str(tmp_path / "t")
    buckets.upsert(spark.createDataFrame([(1, "a"), (None, "n")], "k long, v string"), path, ["k"], buckets=2)
    buckets.upsert(spark.createDataFrame([(2, "b", 5)], "k long, v string, w int"), path, ["k"], buckets=2)
    assert {(r.k, r.v, r.w) for r in buckets.read(spark, path).collect()} == {(1, "a", None), (None, "n", None), (2, "b", 5)}
    buckets.insert_new(spark.createDataFrame([(1, "z"), (None, "z"), (3, "c"), (3, "c")], "k long, v string"), path, ["k"], 2)
    assert {(r.k, r.v) for r in buckets.read(spark, path).collect()} == {(1, "a"), (None, "n"), (2, "b"), (3, "c")}


# --- state that ends -----------------------------------------------------------------------------------


def _streamed(spark, tmp_path, parts, job, schema, mode="append"):
    """The job over files that arrive one a run, from one checkpoint."""
    lifetimes.use_rocks(spark)
    got = []
    for n, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        S.run_batches(job(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))), lambda b, i: got.extend(tuple(r) for r in b.collect()), str(tmp_path / "cp"), mode)
    return got


EVENTS = "k long, ts timestamp, n long, v double"


def test_settle_runs_equal_the_batch(spark, tmp_path):
    rng = random.Random(8)
    rows = [(rng.randrange(5), START + timedelta(minutes=i), i, rng.choice([1.0, 2.0, 9.0, None])) for i in range(200)]
    job = lambda df: lifetimes.settle_runs(df, "k", "ts", "n", F.col("v") < 5, 4, "1 hour")
    got = _streamed(spark, tmp_path, [rows[:70], rows[70:75], rows[75:]], job, EVENTS)
    want = W.first_run(spark.createDataFrame(rows, EVENTS), F.col("v") < 5, ["k"], "ts", 4)
    assert {(k, at) for k, at, _ in got} == {(r.k, r.settled_at) for r in want.collect()} and len(got) == len({k for k, *_ in got})


def test_an_expired_verdict_is_asked_again(spark, tmp_path):
    day = lambda d, k=1: (k, START + timedelta(days=d), d, 0.0)
    parts = [[day(0), day(3), day(9, 2)], [day(9), day(10), day(12, 2)], [day(40), day(41), day(45, 2)]]
    job = lambda df: lifetimes.verdicts_to_ask(df, "k", "ts", "10 days", "1 day")
    got = _streamed(spark, tmp_path, parts, job, EVENTS)
    assert sorted((k, (at - START).days) for k, at in got) == [(1, 0), (1, 10), (1, 40), (2, 9), (2, 45)]


def test_rotation_polls_the_stalest(spark, tmp_path):
    parts = [[("x", m, None) for m in "badc"] + [("x", None, 0), ("y", "only", None)], [("x", None, 1), ("x", "e", None), ("y", None, 1)], [("x", None, 2), ("x", None, 3), ("y", None, 2)]]
    got = _streamed(spark, tmp_path, parts, lambda df: lifetimes.poll_rotation(df, "k", "m", "r", 2), "k string, m string, r long", "update")
    members, polled, want = {}, [], []
    for rows in parts:
        for k, m, _ in rows:
            if m:
                members.setdefault(k, {}).setdefault(m, -1)
        for k, r in sorted({(k, r) for k, m, r in rows if m is None}, key=lambda x: x[1]):
            own = members[k]
            polled = sorted(own, key=lambda m: (own[m], m))[: max(1, len(own) // 2)]
            for m in polled:
                own[m] = r
                want.append((k, r, m))
    assert sorted(got) == sorted(want)
