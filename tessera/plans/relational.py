"""Joins, set operations, upserts and top-k over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import dedupe as D
from tessera.operators import joins as J
from tessera.operators import spatial as SP
from tessera.operators import windows as W

from .registry import query, table
from .timeseries import UD_SQL, user_days

long = lambda c: F.col(c).cast("long").alias(c)

_OD = "od AS (SELECT CAST(o_orderdate AS DATE) AS day, round(sum(o_totalprice), 2) AS ordered FROM orders GROUP BY 1), sd AS (SELECT CAST(l_shipdate AS DATE) AS day, round(sum(l_extendedprice), 2) AS shipped FROM lineitem GROUP BY 1)"


def day_totals(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.round(F.sum("o_totalprice"), 2).alias("ordered"))
    s = table(spark, sf_dir, "lineitem").groupBy(F.to_date("l_shipdate").alias("day")).agg(F.round(F.sum("l_extendedprice"), 2).alias("shipped"))
    return o, s


@query(f"""WITH {_OD} SELECT coalesce(od.day, sd.day) AS day, ordered, shipped,
round((0.6 * ordered + 0.4 * shipped) / nullif(CASE WHEN ordered IS NOT NULL THEN 0.6 ELSE 0 END + CASE WHEN shipped IS NOT NULL THEN 0.4 ELSE 0 END, 0), 2) AS blend FROM od FULL JOIN sd ON od.day = sd.day""")
def full_outer_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full outer with coalesced keys; a blend with a missing part is NULL."""
    from tessera.functions.kernels import blend

    return J.full_combine(day_totals(spark, sf_dir), ["day"]).select("day", "ordered", "shipped", F.round(blend([(0.6, F.col("ordered")), (0.4, F.col("shipped"))]), 2).alias("blend"))


@query("""WITH c AS (SELECT o_orderkey, o_totalprice, CASE WHEN o_totalprice > 200000 THEN 2 WHEN o_totalprice > 100000 THEN 1 ELSE 0 END AS f, o_orderstatus FROM orders)
SELECT o_orderstatus AS status, CAST(count(*) AS BIGINT) AS n, round(avg(f), 6) AS mean_flag FROM lineitem JOIN c ON l_orderkey = o_orderkey GROUP BY 1""")
def chunk_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk flags weighted by their number of days: the join's fan-out is kept."""
    p = F.col("o_totalprice")
    c = table(spark, sf_dir, "orders").select("o_orderkey", F.when(p > 200000, 2).when(p > 100000, 1).otherwise(0).alias("f"), F.col("o_orderstatus").alias("status"))
    x = table(spark, sf_dir, "lineitem").select("l_orderkey")
    return x.join(c, x.l_orderkey == c.o_orderkey).groupBy("status").agg(F.count("*").alias("n"), F.round(F.avg("f"), 6).alias("mean_flag"))


@query(f"""WITH {_OD}, a AS (SELECT day, CASE WHEN day(day) % 2 = 0 THEN ordered END AS v FROM od), b AS (SELECT day, shipped AS v FROM sd) SELECT coalesce(a.day, b.day) AS day, coalesce(a.v, b.v) AS v FROM a FULL JOIN b ON a.day = b.day""")
def priority_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, s = day_totals(spark, sf_dir)
    first = o.select("day", F.when(F.day("day") % 2 == 0, F.col("ordered")).alias("v"))
    return J.priority_merge(first, s.withColumnRenamed("shipped", "v"), ["day"], ["v"])


@query(f"""WITH {_OD}, b AS (SELECT day, ordered AS v FROM od), r AS (SELECT day, shipped AS v FROM sd WHERE day >= DATE '2000-01-01') SELECT coalesce(r.day, b.day) AS day, coalesce(r.v, b.v) AS v FROM b FULL JOIN r ON b.day = r.day""")
def override_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, s = day_totals(spark, sf_dir)
    return J.override_merge(o.withColumnRenamed("ordered", "v"), s.withColumnRenamed("shipped", "v").filter("day >= date'2000-01-01'"), ["day"], ["v"])


@query(f"""WITH {UD_SQL}, g AS (SELECT user_id, d.day FROM (SELECT DISTINCT user_id FROM ud), (SELECT CAST(unnest(generate_series(DATE '2024-01-01', DATE '2024-01-30', INTERVAL 1 DAY)) AS DATE) AS day) d)
SELECT g.user_id, g.day FROM g LEFT JOIN ud ON g.user_id = ud.user_id AND g.day = ud.day WHERE ud.user_id IS NULL""")
def anti_missing_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = user_days(spark, sf_dir)
    calendar = d.select("user_id").distinct().withColumn("day", F.explode(F.expr("sequence(date'2024-01-01', date'2024-01-30')")))
    return D.missing_keys(calendar, d, ["user_id", "day"])


@query("""SELECT c_custkey, lower(c_name) AS name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%') AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""")
def semi_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    urgent, open_ = o.filter("o_orderpriority like '1%'"), o.filter("o_orderstatus = 'P'")
    return c.join(urgent, c.c_custkey == urgent.o_custkey, "left_semi").join(open_, F.col("c_custkey") == open_.o_custkey, "left_anti").select("c_custkey", F.lower("c_name").alias("name"))


@query("""SELECT s_nationkey::BIGINT AS nation FROM supplier EXCEPT SELECT c_nationkey::BIGINT FROM customer WHERE c_acctbal > 9000""")
def set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("long").alias("nation"))
    return D.missing_keys(a, table(spark, sf_dir, "customer").filter("c_acctbal > 9000").select(F.col("c_nationkey").cast("long").alias("nation")), ["nation"])


@query(f"""WITH {UD_SQL} SELECT a.user_id, round(corr(a.v, b.v), 6) AS r, CAST(count(*) AS BIGINT) AS n FROM ud a JOIN ud b ON a.user_id = b.user_id AND b.day = a.day + 1 GROUP BY 1 HAVING count(*) >= 10""")
def lag_join_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = user_days(spark, sf_dir)
    pairs = J.lagged(d.select("user_id", "day", "v"), d.select("user_id", "day", F.col("v").alias("next")), ["user_id"], "day", [1])
    return pairs.groupBy("user_id").agg(F.round(F.corr("v", "next"), 6).alias("r"), F.count("*").alias("n")).filter("n >= 10")


@query(f"""WITH {UD_SQL}, base AS (SELECT user_id, avg(v) AS m FROM ud GROUP BY 1), l AS (SELECT e.user_id, k.lag, avg(n.v) AS v FROM ud e, (SELECT unnest([1, 2]) AS lag) k, ud n WHERE e.v > 90 AND n.user_id = e.user_id AND n.day = e.day + k.lag GROUP BY 1, 2)
SELECT l.user_id, CAST(max(lag) FILTER (round(l.v - m, 6) = best) AS BIGINT) AS lag, max(best) AS bump FROM l JOIN base ON l.user_id = base.user_id JOIN (SELECT l.user_id AS u, max(round(l.v - m, 6)) AS best FROM l JOIN base ON l.user_id = base.user_id GROUP BY 1) ON u = l.user_id GROUP BY 1""")
def event_lag_bump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lag of one or two days after a high day with the largest mean rise over the baseline."""
    d = user_days(spark, sf_dir)
    after = J.lagged(d.filter("v > 90").select("user_id", "day"), d.select("user_id", "day", "v"), ["user_id"], "day", [1, 2])
    base = d.groupBy("user_id").agg(F.avg("v").alias("m"))
    bumps = after.groupBy("user_id", "lag").agg(F.avg("v").alias("v")).join(base, "user_id").select("user_id", "lag", F.round(F.col("v") - F.col("m"), 6).alias("bump"))
    return bumps.groupBy("user_id").agg(F.max(F.struct("bump", "lag")).alias("b")).select("user_id", F.col("b.lag").cast("long").alias("lag"), F.col("b.bump").alias("bump"))


@query(f"""WITH {UD_SQL}, e AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events WHERE event_type = 'purchase' AND value > 95)
SELECT ud.user_id, ud.day, CAST(min(abs(ud.day - e.day)) AS BIGINT) AS distance, CASE WHEN min(abs(ud.day - e.day)) = 0 THEN 3 WHEN min(abs(ud.day - e.day)) <= 7 THEN 2 WHEN min(abs(ud.day - e.day)) <= 14 THEN 1 ELSE 0 END::BIGINT AS label
FROM ud LEFT JOIN e ON ud.user_id = e.user_id AND abs(ud.day - e.day) <= 14 GROUP BY 1, 2""")
def event_within_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = user_days(spark, sf_dir).select("user_id", "day")
    e = table(spark, sf_dir, "events").filter("event_type = 'purchase' AND value > 95").select("user_id", F.to_date("ts").alias("event_day"))
    near = J.event_within(d, e, ["user_id"], "day", "event_day", 14, "distance")
    x = F.col("distance")
    return near.select("user_id", "day", long("distance"), F.when(x == 0, 3).when(x <= 7, 2).when(x <= 14, 1).otherwise(0).cast("long").alias("label"))


_SESSIONS = "s AS (SELECT event_id, user_id, CAST(ts AS DATE) AS day, date_trunc('second', ts) AS a, date_trunc('second', ts) + INTERVAL 2 HOUR AS b FROM events WHERE event_type = '{}')"


@query(f"""WITH {_SESSIONS.format('click')}, v AS (SELECT event_id AS other, user_id, CAST(ts AS DATE) AS day, date_trunc('second', ts) AS c, date_trunc('second', ts) + INTERVAL 1 HOUR AS d FROM events WHERE event_type = 'view')
SELECT event_id, other, round(CAST(epoch(least(b, d)) - epoch(greatest(a, c)) AS DOUBLE) / 60.0, 3) AS minutes FROM s JOIN v ON s.user_id = v.user_id AND s.day = v.day WHERE least(b, d) > greatest(a, c)""")
def interval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("ts", F.date_trunc("second", "ts")).withColumn("day", F.to_date("ts"))
    a = e.filter("event_type = 'click'").select("event_id", "user_id", "day", F.col("ts").alias("a"), F.expr("ts + interval 2 hours").alias("b"))
    b = e.filter("event_type = 'view'").select(F.col("event_id").alias("other"), "user_id", "day", F.col("ts").alias("c"), F.expr("ts + interval 1 hour").alias("d"))
    return J.interval_overlap(a, b, ["user_id", "day"], ("a", "b"), ("c", "d")).select("event_id", "other", F.round("overlap_minutes", 3).alias("minutes"))


@query("""WITH p AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings), b AS (SELECT CAST(n_nationkey AS BIGINT) AS box, (n_nationkey % 5) * 0.1 - 0.25 AS x0, (n_nationkey // 5) * 0.1 - 0.25 AS y0 FROM nation)
SELECT vec_id, min(box) AS box FROM p LEFT JOIN b ON x > CAST(x0 AS DOUBLE) AND x < CAST(x0 AS DOUBLE) + 0.15 AND y > CAST(y0 AS DOUBLE) AND y < CAST(y0 AS DOUBLE) + 0.15 GROUP BY 1""")
def bbox_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first box that strictly holds each point."""
    p = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    k = F.col("n_nationkey")
    low = lambda e: (e.cast("decimal(10,1)") * F.lit("0.1").cast("decimal(3,1)") - F.lit("0.25").cast("decimal(4,2)")).cast("double")
    b = table(spark, sf_dir, "nation").select(k.cast("long").alias("box"), low(k % 5).alias("x0"), low(F.floor(k / 5)).alias("y0"))
    b = b.withColumns({"x1": F.col("x0") + 0.15, "y1": F.col("y0") + 0.15})
    return SP.first_box(p, b, "vec_id", "x", "y", ("x0", "y0", "x1", "y1"), "box").select("vec_id", "box")


@query("""WITH p AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings), c AS (SELECT vec_id AS site, x AS sx, y AS sy FROM p WHERE vec_id % 2 = 0)
SELECT vec_id, site AS nearest FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY (x - sx) * (x - sx) + (y - sy) * (y - sy), site) AS rn FROM (SELECT * FROM p WHERE vec_id % 2 = 1), c) WHERE rn = 1""")
def nearest_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest vector with an even id to each with an odd one, in the plane of the first two components."""
    p = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    sites = p.filter("vec_id % 2 = 0").select(F.col("vec_id").alias("site"), F.col("x").alias("sx"), F.col("y").alias("sy"))
    return SP.nearest_site(p.filter("vec_id % 2 = 1"), sites, "x", "y", "site", "sx", "sy").select("vec_id", "nearest")


# Boxes of orders: most are small, some are wide, a few cover everything; from 0.01 to 180 degrees.
_SIDES = "CASE WHEN o_orderkey % 1000 = 0 THEN 180.0 WHEN o_orderkey % 50 = 1 THEN 7.3 WHEN o_orderkey % 3 = 0 THEN 0.4 ELSE 0.01 END"


@query(f"""WITH b AS (SELECT o_orderkey AS box, CAST(o_custkey * 37 % 360 AS DOUBLE) AS x0, CAST(o_orderkey * 11 % 180 AS DOUBLE) AS y0, CAST({_SIDES} AS DOUBLE) AS s FROM orders),
p AS (SELECT c_custkey AS point, c_acctbal / 30.0::DOUBLE AS x, CAST(c_custkey * 7 % 180 AS DOUBLE) + 0.005 AS y FROM customer)
SELECT point, count(*) AS boxes, min(box) AS first FROM p JOIN b ON x >= x0 AND x <= x0 + s AND y >= y0 AND y <= y0 + s GROUP BY 1""")
def boxes_of_every_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many boxes of orders hold the point of a customer."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    side = F.when(k % 1000 == 0, 180.0).when(k % 50 == 1, 7.3).when(k % 3 == 0, 0.4).otherwise(0.01)
    b = o.select(k.alias("box"), (F.col("o_custkey") * 37 % 360).cast("double").alias("x0"), (k * 11 % 180).cast("double").alias("y0"), side.alias("s"))
    b = b.groupBy("x0", "y0", "s").agg(F.count(F.lit(1)).alias("held"), F.min("box").alias("box"))  # equal boxes hold the same points
    b = b.withColumns({"x1": F.col("x0") + F.col("s"), "y1": F.col("y0") + F.col("s")})
    p = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("point"), (F.col("c_acctbal") / 30.0).cast("double").alias("x"), ((F.col("c_custkey") * 7 % 180).cast("double") + 0.005).alias("y"))
    return SP.box_join(p, b, "x", "y", ("x0", "y0", "x1", "y1"), strict=False).groupBy("point").agg(F.sum("held").alias("boxes"), F.min("box").alias("first"))


@query("""SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) - to_years(CAST(k AS INTEGER)) AS DATE) AS day, CAST(year(o_orderdate) - k AS BIGINT) AS effective_year, CAST(k AS BIGINT) AS "offset" FROM orders, (SELECT unnest(generate_series(1, 10)) AS k)""")
def year_shift_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten year-shifted copies from one scan."""
    return _shifted(table(spark, sf_dir, "orders"))


def _shifted(o: DataFrame) -> DataFrame:
    o = o.select("o_orderkey", F.to_date("o_orderdate").alias("day")).withColumn("y", F.year("day"))
    return W.year_shifts(o, "day", "y", 10).select("o_orderkey", "day", long("effective_year"), long("offset"))


@query("""SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""")
def dedupe_keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return D.keep_best(e, ["user_id", "event_type"], F.desc("ts"), F.desc("event_id")).select("user_id", "event_type", "event_id", "value")


@query("""SELECT lang, source, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY n_chars DESC, doc_id) AS rn FROM documents) WHERE rn = 1""")
def dedupe_keep_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("lang", "source", "doc_id", "n_chars")
    return D.keep_best(d, ["lang", "source"], F.desc("n_chars"), F.asc("doc_id"))


_POSTS = """t AS (SELECT doc_id, sha256(text) AS hash, source AS body, CAST(doc_id % 100 AS DOUBLE) AS score, DATE '2024-01-01' AS last_seen, DATE '2024-01-01' AS last_changed FROM documents WHERE doc_id % 4 <> 3),
s AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN sha256(concat(text, '!')) ELSE sha256(text) END AS hash, concat(source, '-new') AS body, DATE '2024-02-01' AS last_seen FROM documents WHERE doc_id % 4 <> 2)"""


@query(f"""WITH {_POSTS}, j AS (SELECT coalesce(t.doc_id, s.doc_id) AS doc_id, t.hash AS th, s.hash AS sh, t.body AS tb, s.body AS sb, t.score, t.last_seen AS tl, s.last_seen AS sl, t.last_changed AS tc, (s.hash IS NOT NULL AND (t.hash IS NULL OR t.hash <> s.hash)) AS c FROM t FULL JOIN s ON t.doc_id = s.doc_id)
SELECT doc_id, CASE WHEN c THEN sh ELSE th END AS hash, CASE WHEN c THEN sb ELSE tb END AS body, CASE WHEN c THEN NULL ELSE score END AS score, coalesce(sl, tl) AS last_seen, CASE WHEN c THEN sl ELSE tc END AS last_changed, c AS changed_now FROM j""")
def upsert_change_aware(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New content clears the scores, the same content is only touched."""
    d = table(spark, sf_dir, "documents")
    jan, feb = F.lit("2024-01-01").cast("date"), F.lit("2024-02-01").cast("date")
    t = d.filter("doc_id % 4 <> 3").select("doc_id", F.sha2("text", 256).alias("hash"), F.col("source").alias("body"), (F.col("doc_id") % 100).cast("double").alias("score"), jan.alias("last_seen"), jan.alias("last_changed"))
    h = F.when(F.col("doc_id") % 5 == 0, F.sha2(F.concat("text", F.lit("!")), 256)).otherwise(F.sha2("text", 256))
    s = d.filter("doc_id % 4 <> 2").select("doc_id", h.alias("hash"), F.concat("source", F.lit("-new")).alias("body"), feb.alias("last_seen"))
    return D.upsert_changed(t, s, ["doc_id"], "hash", ["body"], ["score"])


@query("""SELECT n_nationkey, n_name FROM (SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, CASE WHEN n_nationkey < 10 THEN upper(concat(n_name, '*')) ELSE n_name END AS n_name FROM nation) UNION ALL SELECT 100, 'ATLANTIS'""")
def upsert_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(long("n_nationkey"), "n_name")
    fresh = n.filter("n_nationkey < 10").select("n_nationkey", F.upper(F.concat("n_name", F.lit("*"))).alias("n_name"))
    fresh = fresh.union(spark.createDataFrame([(100, "ATLANTIS")], "n_nationkey long, n_name string"))
    return D.upsert(n, fresh, ["n_nationkey"])


@query(f"""WITH {UD_SQL} SELECT user_id, day, v FROM ud WHERE day < DATE '2024-01-20' UNION ALL SELECT user_id, day, v * 2 AS v FROM ud WHERE day >= DATE '2024-01-20'""")
def replace_by_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = user_days(spark, sf_dir).select("user_id", "day", "v")
    return D.replace_days(d, d.filter("day >= date'2024-01-20'").withColumn("v", F.col("v") * 2), "day")


@query("""SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rn FROM events) WHERE rn = 1""")
def argmax_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = F.max_by(F.struct("event_id", "value"), F.struct("value", -F.col("event_id")))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(best.alias("b")).select("user_id", "b.event_id", "b.value")


@query("""SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders ORDER BY o_totalprice DESC, o_orderpriority, o_orderkey LIMIT 25""")
def topn_multikey(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    return o.orderBy(F.desc("o_totalprice"), "o_orderpriority", "o_orderkey").limit(25)


@query("""SELECT p_brand, p_partkey, side FROM (SELECT p_brand, p_partkey, 'best' AS side, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_size, p_partkey) AS rn FROM part UNION ALL SELECT p_brand, p_partkey, 'worst', row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_size, p_partkey) FROM part) WHERE rn <= 5""")
def pergroup_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    best = W.latest_per_key(p, ["p_brand"], F.desc("p_retailprice"), F.asc("p_size"), F.asc("p_partkey"), n=5).select("p_brand", "p_partkey", F.lit("best").alias("side"))
    worst = W.latest_per_key(p, ["p_brand"], F.asc("p_retailprice"), F.asc("p_size"), F.asc("p_partkey"), n=5).select("p_brand", "p_partkey", F.lit("worst").alias("side"))
    return best.unionByName(worst)


@query("""WITH c AS (SELECT c_custkey, max(CAST(o_orderdate AS DATE)) AS polled FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'P' GROUP BY 1)
SELECT c_custkey, polled FROM c ORDER BY coalesce(polled, DATE '1970-01-01'), c_custkey LIMIT (SELECT greatest(1, count(*) // 3) FROM c)""")
def rotation_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the customers, those polled longest ago first."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'")
    polled = c.join(o, c.c_custkey == o.o_custkey, "left").groupBy("c_custkey").agg(F.max(F.to_date("o_orderdate")).alias("polled"))
    return poll_batch(polled, 3)


def poll_batch(companies: DataFrame, divisor: int, polled: str = "polled", key: str = "c_custkey") -> DataFrame:
    """max(1, n // divisor) rows, never polled first, then the stalest; none of no rows."""
    n = companies.count()
    take = max(1, n // divisor) if n else 0
    return companies.orderBy(F.coalesce(polled, F.lit("1970-01-01").cast("date")), key).limit(take)


@query("""SELECT p_partkey, p_name, p_retailprice FROM part WHERE p_retailprice = (SELECT max(p_retailprice) FROM part)""")
def scalar_subquery_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice")
    return p.join(F.broadcast(p.agg(F.max("p_retailprice").alias("p_retailprice"))), "p_retailprice", "left_semi").select("p_partkey", "p_name", "p_retailprice")


@query("""SELECT r_name AS region, n_name AS nation, CAST(count(DISTINCT o_orderkey) AS BIGINT) AS orders, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE o_orderdate >= DATE '1997-01-01' AND o_orderdate < DATE '1998-01-01' GROUP BY 1, 2""")
def star_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts to dimensions; AQE broadcasts the sides that turn out small."""
    x = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice", "l_discount")
    o = table(spark, sf_dir, "orders").filter((F.col("o_orderdate") >= F.lit("1997-01-01").cast("timestamp_ntz")) & (F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz"))).select("o_orderkey", "o_custkey")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    places = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    joined = x.join(o, x.l_orderkey == o.o_orderkey).join(c, F.col("o_custkey") == c.c_custkey).join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy(F.col("r_name").alias("region"), F.col("n_name").alias("nation")).agg(F.countDistinct("l_orderkey").alias("orders"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("""SELECT l_returnflag AS flag, l_linestatus AS status, round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS charge, round(avg(l_discount), 6) AS disc, CAST(count(*) AS BIGINT) AS n FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY 1, 2 HAVING count(*) > 10""")
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return x.groupBy(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status")).agg(
        F.round(F.sum("l_quantity"), 2).alias("qty"), F.round(F.sum(net * (1 + F.col("l_tax"))), 2).alias("charge"), F.round(F.avg("l_discount"), 6).alias("disc"), F.count("*").alias("n")
    ).filter("n > 10")


@query("""WITH h AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS d, max(o_totalprice) AS p FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2)
SELECT o.o_orderkey, arg_max(h.p, h.d) AS seed FROM (SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS d FROM orders WHERE o_orderstatus <> 'F') o LEFT JOIN h ON o.o_custkey = h.o_custkey AND h.d <= o.d GROUP BY 1""")
def as_of_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last known value at or before each row."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("d"), "o_orderstatus", "o_totalprice")
    history = o.filter("o_orderstatus = 'F'").groupBy("o_custkey", "d").agg(F.max("o_totalprice").alias("p"))
    return J.as_of(o.filter("o_orderstatus <> 'F'").select("o_orderkey", "o_custkey", "d"), history, ["o_custkey"], "d", "p", "seed").select("o_orderkey", "seed")


@query("""SELECT source, lang, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY 1, 2 ORDER BY n DESC, source, lang LIMIT 25""")
def audit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source", "lang").limit(25)


@query("""SELECT lang, string_agg(DISTINCT source, '+' ORDER BY source) AS sources, arg_min(source, doc_id) AS first_source FROM documents GROUP BY 1""")
def merge_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.col("source").alias("first_source"), F.col("source").alias("sources"))
    return D.merge_fields(d, ["lang"], ["first_source"], ["sources"], "doc_id")


@query("""WITH r AS (SELECT p_brand, p_partkey, p_name, row_number() OVER (PARTITION BY p_brand ORDER BY p_size % 3, p_partkey) AS rn FROM part), w AS (SELECT p_brand, p_partkey, p_name FROM r WHERE rn = 1)
SELECT w.p_brand, w.p_partkey, (SELECT string_agg(DISTINCT r.p_name, '|' ORDER BY r.p_name) FROM r WHERE r.p_brand = w.p_brand AND r.p_name <> w.p_name) AS others FROM w""")
def merge_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best source wins, the losers' addresses stay."""
    return _merged(table(spark, sf_dir, "part"))


def _merged(p: DataFrame) -> DataFrame:
    m = D.merge_duplicates(p, "p_brand", F.col("p_size") % 3, "p_name", "p_partkey")
    return m.select("p_brand", "p_partkey", F.nullif(F.array_join("other_urls", "|"), F.lit("")).alias("others"))
