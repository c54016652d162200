"""Incremental jobs: a source with an epoch, committed and bucketed sinks, state with a lifetime; each over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import stats
from tessera.sources import buckets, committed
from tessera.streaming import epochs, lifetimes
from tessera.streaming import jobs as S

from .registry import query, table
from .streams import _folder

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"
DAY = 86_400_000_000


@query("""SELECT event_id, user_id, event_type, value, (SELECT epoch_us(max(ts)) + 1 FROM events) AS epoch FROM events""")
def incremental_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the first half, a sync, the rest and another delivery of some, a second sync from the stored epoch: each event once."""
    out, e = _folder(spark), table(spark, sf_dir, "events").select(*[c.split()[0] for c in EVENTS.split(", ")])
    middle = e.agg(F.percentile_approx(F.unix_micros(F.col("ts").cast("timestamp")), 0.5)).first()[0]
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    for number, part in enumerate((e.filter(at <= middle), e.filter(at > middle - DAY))):
        part.write.mode("append").parquet(f"{out}/source")
        start = epochs.stored_epoch(spark, f"{out}/state", "events")
        stream = epochs.source(spark, f"{out}/source", EVENTS, "ts", start, lookback=DAY)
        sink = epochs.sync_sink(f"{out}/table", f"{out}/state", "events", ["event_id"], "ts", n=16)
        S.run_batches(stream, sink, f"{out}/checkpoint-{number}")
    epoch = F.lit(epochs.stored_epoch(spark, f"{out}/state", "events")).alias("epoch")
    return buckets.read(spark, f"{out}/table").select("event_id", "user_id", "event_type", "value", epoch)


@query("""WITH days AS (SELECT CAST(unnest(generate_series(DATE '1995-01-01', DATE '1998-12-31', INTERVAL 1 DAY)) AS DATE) AS day),
held AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day, 'orders' AS "table" FROM orders UNION SELECT DISTINCT CAST(l_shipdate AS DATE), 'lineitem' FROM lineitem UNION SELECT DISTINCT CAST(ts AS DATE), 'events' FROM events)
SELECT day, t AS "table" FROM days, (SELECT unnest(['orders', 'lineitem', 'events']) AS t) WHERE (day, t) NOT IN (SELECT (day, "table") FROM held WHERE day <= DATE '1998-12-29')""")
def missing_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of a range that each of three tables lacks, its last two always."""
    o, x, e = (table(spark, sf_dir, t) for t in ("orders", "lineitem", "events"))
    return epochs.missing_parts(spark, "1995-01-01", "1998-12-31", {"orders": (o, "o_orderdate"), "lineitem": (x, "l_shipdate"), "events": (e, "ts")}, again=2)


@query("""SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""")
def buffered_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each user buffered in order and flushed in pieces; the last row of a key in a buffer is written, the last flush of a key is read."""
    out = _folder(spark)
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "value")
    committed.flush_latest(e, out, ["user_id"], ["ts", "event_id"], buffer_rows=500)
    return committed.latest(spark, out, ["user_id"]).select("user_id", "event_id", "value")


@query("""SELECT c_custkey, round(c_acctbal * 2, 2) AS worked FROM customer""")
def committed_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch that breaks half way keeps what its tasks finished; the second run does the rest, and each key is there once."""
    out, c = _folder(spark), table(spark, sf_dir, "customer")
    done = lambda keys: keys.join(c, "c_custkey").select("c_custkey", F.round(F.col("c_acctbal") * 2, 2).alias("worked"))
    broken = lambda keys: done(keys).withColumn("worked", F.when(F.col("c_custkey") == middle, F.raise_error(F.lit("the sink broke"))).otherwise(F.col("worked")))
    middle = c.agg(F.percentile_approx("c_custkey", 0.5)).first()[0]
    try:
        committed.process_missing(c, out, ["c_custkey"], broken, tasks=8)
    except Exception as e:  # the first run is meant to break
        if "the sink broke" not in str(e):
            raise
    committed.process_missing(c, out, ["c_custkey"], done, tasks=8)
    return committed.read(spark, out).select("c_custkey", "worked")


@query("""SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 64 < 3 THEN 'second' ELSE 'first' END AS version FROM orders""")
def bucketed_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders upserted twice: the second batch is newer for some and older for others, and rewrites its buckets alone."""
    out, o = _folder(spark), table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    buckets.upsert(o.withColumns({"version": F.lit("first"), "at": F.lit(2)}), out, ["o_orderkey"], "at")
    again = o.filter("o_orderkey % 64 < 6").withColumns({"version": F.lit("second"), "at": F.when(F.col("o_orderkey") % 64 < 3, 3).otherwise(1)})
    buckets.upsert(again, out, ["o_orderkey"], "at")
    return buckets.read(spark, out).drop("at")


@query("""SELECT user_id % 3 AS grp, CAST(month(ts) AS BIGINT) AS month, q, count(*) AS n, true AS within FROM events, (SELECT unnest([20, 80, 95]) AS q) GROUP BY ALL""")
def sketched_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of two stored and merged sketch tables, each held against the ranks of the rows themselves."""
    out, keys = _folder(spark), ["grp", "month"]
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 3).alias("grp"), F.month("ts").cast("long").alias("month"), F.col("event_id") % 5 < 4, "value")
    e = e.toDF("grp", "month", "old", "value")
    for name, part in (("old", e.filter("old")), ("new", e.filter("not old"))):
        stats.sketches(part, keys, ["value"]).write.parquet(f"{out}/{name}")
    merged = stats.merge_sketches([spark.read.parquet(f"{out}/old"), spark.read.parquet(f"{out}/new")], keys, ["value"])
    found = stats.sketched_climatology(merged, keys, ["value"])
    long = found.select(*keys, F.explode(F.array(*[F.struct(F.lit(q).alias("q"), F.col(f"value_p{q:02d}").alias("v")) for q in (20, 80, 95)])).alias("s"), "value_n").select(*keys, "s.q", "s.v", F.col("value_n").alias("n"))
    ranks = long.join(e, keys).groupBy(*keys, "q", "n").agg((F.count_if(F.col("value") < F.col("v")) / F.col("n")).alias("low"), (F.count_if(F.col("value") <= F.col("v")) / F.col("n")).alias("high"))
    share, room = F.col("q") / 100, stats.SKETCH_ERROR
    return ranks.select(*keys, "q", "n", ((F.col("low") <= share + room) & (F.col("high") >= share - room)).alias("within"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.source(spark, f"{sf_dir}/[e]vents.parquet", EVENTS)


def _stateful(spark: SparkSession, df: DataFrame, mode: str = "append") -> DataFrame:
    lifetimes.use_rocks(spark)
    out = _folder(spark)
    rows: list[str] = []

    def keep(batch: DataFrame, number: int) -> None:
        rows.append(f"{out}/data/{number}")
        batch.write.mode("overwrite").parquet(rows[-1])

    S.run_batches(df, keep, f"{out}/checkpoint", mode)
    return spark.read.schema(df.schema).parquet(*rows)


@query("""WITH i AS (SELECT *, sum(CASE WHEN value < 60 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM events),
r AS (SELECT user_id, ts, value, sum(CASE WHEN value < 60 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, g ORDER BY ts, event_id) AS run FROM i)
SELECT user_id, min(ts) AS settled_at FROM r WHERE run >= 3 AND value < 60 GROUP BY 1""")
def stream_settle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each user's events first stay below 60 three times running, by keyed state."""
    found = _stateful(spark, lifetimes.settle_runs(_events(spark, sf_dir), "user_id", "ts", "event_id", F.col("value") < 60, 3, "30 days"))
    return found.select(F.col("key").alias("user_id"), F.col("settled_at").cast("timestamp_ntz").alias("settled_at"))


@query("""WITH RECURSIVE a AS (SELECT user_id, min(ts) AS asked_at FROM events GROUP BY 1 UNION ALL
SELECT a.user_id, min(e.ts) FROM a JOIN events e ON e.user_id = a.user_id AND e.ts >= a.asked_at + INTERVAL 10 DAY GROUP BY 1) SELECT user_id, asked_at FROM a""")
def stream_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times at which a verdict on a user is asked for: it lives ten days, and the next event after that asks anew."""
    found = _stateful(spark, lifetimes.verdicts_to_ask(_events(spark, sf_dir), "user_id", "ts", "10 days", "30 days"))
    return found.select(F.col("key").alias("user_id"), F.col("asked_at").cast("timestamp_ntz").alias("asked_at"))


@query()
def stream_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven rounds of polls over the suppliers of each nation, a third at a time."""
    out, s = _folder(spark), table(spark, sf_dir, "supplier")
    members = s.select(F.col("s_nationkey").cast("long").alias("nation"), F.lpad(F.col("s_suppkey").cast("string"), 9, "0").alias("member"), F.lit(None).cast("long").alias("round"))
    rounds = members.select("nation").distinct().select("nation", F.lit(None).cast("string").alias("member"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(6).cast("long"))).alias("round"))
    members.unionByName(rounds).write.parquet(f"{out}/in")
    stream = spark.readStream.schema(members.schema).parquet(f"{out}/in")
    return _stateful(spark, lifetimes.poll_rotation(stream, "nation", "member", "round", 3), "update").withColumnRenamed("key", "nation")
