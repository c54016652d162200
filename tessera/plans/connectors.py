"""Sources and sinks, each as a round trip: written to the shared folder, read back, with the SQL of what must come back."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.functions import text as T
from tessera.operators import dedupe, places, rules
from tessera.sources import buckets, committed, readers, schemas, sinks

from .registry import query, table
from .streams import _folder

# --- tables ------------------------------------------------------------------------------------------


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_totalprice AS DOUBLE) END AS o_totalprice, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, CAST(NULL AS VARCHAR) AS note
FROM orders""")
def table_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored table conformed to a declared schema: malformed numbers and missing columns are NULL."""
    out = _folder(spark)
    price = F.when(F.col("o_orderkey") % 7 == 0, "n/a").otherwise(F.col("o_totalprice").cast("string"))
    day = F.to_date("o_orderdate").cast("string")
    table(spark, sf_dir, "orders").select("o_orderkey", price.alias("o_totalprice"), day.alias("day"), F.lit(1).alias("extra")).write.parquet(out)
    wanted = StructType.fromDDL("o_orderkey long, o_totalprice double, day string, note string")
    return schemas.conform(readers.parquet(spark, out), wanted).withColumn("o_orderkey", F.col("o_orderkey").cast("long"))


@query("""SELECT CAST(count(*) AS BIGINT) AS missing, CAST((SELECT sum(n) FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 1)) AS BIGINT) AS duplicates FROM orders WHERE o_orderkey % 7 = 0""")
def table_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared constraints, counted."""
    o = table(spark, sf_dir, "orders").withColumn("key", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderkey")))
    found = schemas.violations(o, ["key"], ["o_custkey"])
    return spark.createDataFrame([(found["key is null"], found["duplicates"])], "missing long, duplicates long")


@query("""SELECT n_nationkey, n_name, 1 AS batch FROM nation UNION ALL SELECT n_nationkey, n_name, 2 FROM nation WHERE n_regionkey = 1""")
def sink_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overwritten, then appended to."""
    out, n = _folder(spark), table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    ready = lambda df, b: df.select("n_nationkey", "n_name", F.lit(b).alias("batch"))
    sinks.save(ready(n, 0), out)
    sinks.save(ready(n, 1), out, "overwrite")
    sinks.save(ready(n.filter("n_regionkey = 1"), 2), out)
    return readers.parquet(spark, out)


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE 'old' END AS state FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0""")
def sink_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upserts into a bucketed table: the newer row of a key wins."""
    out, c = _folder(spark), table(spark, sf_dir, "customer").select("c_custkey")
    buckets.upsert(c.filter("c_custkey % 2 = 0").withColumn("state", F.lit("old")), out, ["c_custkey"])
    buckets.upsert(c.filter("c_custkey % 3 = 0").withColumn("state", F.lit("new")), out, ["c_custkey"])
    return buckets.read(spark, out)


@query("""SELECT c_custkey, round(c_acctbal * 2, 2) AS worked FROM customer""")
def sink_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A restarted batch: keys that the sink has are not worked on again."""
    out, c = _folder(spark), table(spark, sf_dir, "customer")
    work = lambda keys: keys.join(c, "c_custkey").select("c_custkey", F.round(F.col("c_acctbal") * 2, 2).alias("worked"))
    committed.process_missing(c.filter("c_custkey % 3 = 0"), out, ["c_custkey"], work)
    committed.process_missing(c, out, ["c_custkey"], work)
    return committed.read(spark, out).drop("_flush")


@query("""SELECT event_id, user_id, CAST(ts AS DATE) AS day FROM events""")
def sink_clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partitioned by day, sorted by user inside."""
    out = _folder(spark)
    sinks.save_clustered(table(spark, sf_dir, "events").select("event_id", "user_id", "ts"), out, "ts", ["user_id"], files_per_day=2)
    return readers.parquet(spark, out).select("event_id", "user_id", F.col("_day").alias("day"))


@query("""SELECT event_id AS http_status, 'batch' AS ingest_batch_id, CAST(ts AS DATE) AS day, event_type AS ats_type FROM events""")
def sink_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw payloads with their facts, by day of fetching."""
    out = _folder(spark)
    e = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("fetched_at"), F.lit("batch").alias("ingest_batch_id"), F.col("event_type").alias("ats_type"), F.col("event_id").cast("string").alias("http_status"), F.col("props").alias("payload"))
    sinks.archive_payloads(e, out)
    return readers.parquet(spark, out).select(F.col("http_status").cast("long").alias("http_status"), "ingest_batch_id", F.col("_day").alias("day"), "ats_type")


@query("""SELECT r_regionkey, r_name, CAST(NULL AS VARCHAR) AS added FROM region UNION ALL SELECT r_regionkey, r_name, 'later' FROM region""")
def sink_evolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column added later is NULL in older files."""
    out, r = _folder(spark), table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    sinks.save(r, out)
    sinks.save(r.withColumn("added", F.lit("later")), out)
    return sinks.read_merged(spark, out).select("r_regionkey", "r_name", "added")


@query("""SELECT o_orderkey, CASE WHEN CAST(o_orderdate AS DATE) BETWEEN DATE '1995-03-01' AND DATE '1995-03-31' THEN 'b' ELSE 'a' END AS version FROM orders""")
def sink_replace_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch replaces its days, twice with the same result."""
    out, day = _folder(spark), F.to_date("o_orderdate")
    o = table(spark, sf_dir, "orders").select("o_orderkey", day.alias("day"))
    sinks.replace_days(o.withColumn("version", F.lit("a")), out, "day")
    for _ in range(2):
        sinks.replace_days(o.filter("day between '1995-03-01' and '1995-03-31'").withColumn("version", F.lit("b")), out, "day")
    return readers.parquet(spark, out).select("o_orderkey", "version")


# --- files -------------------------------------------------------------------------------------------


@query("""SELECT c_custkey, c_name, CAST(c_acctbal AS DOUBLE) AS c_acctbal FROM customer""")
def csv_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV with a header and declared types."""
    out = _folder(spark)
    table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal").write.option("header", True).csv(out)
    return readers.csv(spark, out, "c_custkey long, c_name string, c_acctbal double")


@query("""SELECT c_custkey AS id, c_name AS name FROM customer""")
def csv_preamble_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV exports, one for each nation, whose header comes after some lines."""
    out, c = _folder(spark), table(spark, sf_dir, "customer")
    rows = c.select("c_nationkey", F.col("c_custkey").alias("place"), F.concat_ws(",", "c_custkey", "c_name").alias("value"))
    first = F.posexplode(F.array(F.lit("Grants of all years"), F.lit(""), F.lit("id,name"))).alias("place", "value")
    head = c.select("c_nationkey").distinct().select("c_nationkey", first).withColumn("place", (F.col("place") - 3).cast("long"))
    lines = head.unionByName(rows).repartition("c_nationkey").sortWithinPartitions("c_nationkey", "place")
    lines.select("c_nationkey", "value").write.partitionBy("c_nationkey").text(out)
    return readers.csv_after(spark, out, "id,", "id long, name string").select("id", "name")


@query("""SELECT n_nationkey, n_name FROM nation WHERE n_nationkey >= 10""")
def first_filled_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first source that has rows."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return readers.first_filled(lambda: n.filter("n_nationkey > 1000"), lambda: n.filter("n_nationkey >= 10"), lambda: n)


@query("""SELECT c_custkey, o_orderkey AS id, o_orderpriority AS name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_custkey % 5 <> 0""")
def json_items_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per element of the documents; every fifth document is malformed and gives none."""
    items = F.array_sort(F.collect_list(F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("name"))))
    docs = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.to_json(F.struct(items.alias("jobs"))).alias("doc"))
    docs = docs.withColumn("doc", F.when(F.col("c_custkey") % 5 == 0, F.substring("doc", 1, 20)).otherwise(F.col("doc")))
    return readers.json_items(docs, "doc", "jobs array<struct<id:long,name:string>>", "jobs")


@query("""SELECT CAST(n_nationkey AS BIGINT) AS feed, u.title, u.link FROM nation, LATERAL (SELECT n_name || ': one' AS title, 'https://x.example/' || n_nationkey AS link UNION ALL SELECT 'two & three', NULL) u""")
def rss_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of RSS documents."""
    item = lambda title, link: F.concat(F.lit("<item><title>"), title, F.lit("</title>"), link, F.lit("</item>"))
    first = item(F.concat(F.col("n_name"), F.lit(": one")), F.concat(F.lit("<link>https://x.example/"), F.col("n_nationkey").cast("string"), F.lit("</link>")))
    xml = F.concat(F.lit("<rss><channel><title>feed</title>"), first, item(F.lit("two &amp; three"), F.lit("")), F.lit("</channel></rss>"))
    feeds = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("feed"), xml.alias("xml"))
    return readers.rss_items(feeds, "xml").select("feed", "title", "link")


@query("""SELECT c_custkey AS id, 'location.acceptable_hire_regions' AS name, 'N' || c_nationkey || ',' || c_mktsegment AS value FROM customer
UNION ALL SELECT c_custkey, 'location.allow_unspecified_location', CASE WHEN c_acctbal > 0 THEN 'true' ELSE 'false' END FROM customer
UNION ALL SELECT c_custkey, 'limit', CAST(c_custkey AS VARCHAR) FROM customer UNION ALL SELECT c_custkey, 'weights.role', '0.' || (c_nationkey + 1) || '5' FROM customer""")
def preferences_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small tree of preferences for each customer, as name and value."""
    c = table(spark, sf_dir, "customer")
    text = F.concat(
        F.lit("# who\nlocation:\n  acceptable_hire_regions:\n    - N"), F.col("c_nationkey"), F.lit("\n    - "), F.col("c_mktsegment"), F.lit("\n  allow_unspecified_location: "), F.when(F.col("c_acctbal") > 0, "true").otherwise("false"),
        F.lit("\nlimit: "), F.col("c_custkey"), F.lit("\n\nweights:\n  role: 0."), F.col("c_nationkey") + 1, F.lit("5\n"),
    )
    return readers.preference_rows(c.select(F.col("c_custkey").alias("id"), text.alias("text")), "id", "text")


def order_pages(stream: str, cursor: int | None) -> tuple[list[tuple], int | None]:
    """A collection of the orders of one status: a page for each row group of the table, from the last one on."""
    import pyarrow.dataset as ds

    path, _, status = stream.partition("|")
    groups = [(f, g.id) for f in ds.dataset(path.removeprefix("file://")).get_fragments() for g in f.row_groups]
    at = len(groups) - 1 if cursor is None else cursor
    fragment, group = groups[at]
    page = fragment.subset(row_group_ids=[group]).to_table(columns=["o_orderkey"], filter=ds.field("o_orderstatus") == status)
    return [(status, key) for key in page.column(0).to_pylist()], at - 1 if at else None


@query("""SELECT o_orderstatus AS stream, o_orderkey AS card FROM orders""")
def paged_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A paged collection as a data source: one partition per stream of pages, here the orders of a status."""
    spark.dataSource.register(readers.PagedSource)
    streams = ",".join(f"{sf_dir}/orders.parquet|{status}" for status in "FOP")
    reader = spark.read.format("paged").option("ddl", "stream string, card long").option("streams", streams)
    return reader.option("pages", "tessera.plans.connectors:order_pages").load()


@query("""SELECT page_id, 'P' || page_id AS name, page_id % 3 AS kind FROM pages""")
def script_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON in a script element of a page."""
    body = F.to_json(F.struct(F.concat(F.lit("P"), F.col("page_id").cast("string")).alias("name"), (F.col("page_id") % 3).alias("kind")))
    html = F.concat(F.col("html"), F.lit('<script id="__DATA__" type="application/json">'), body, F.lit("</script>"))
    found = table(spark, sf_dir, "pages").select("page_id", readers.script_json(html, "__DATA__", "name string, kind long").alias("j"))
    return found.select("page_id", "j.name", "j.kind")


# --- incremental -------------------------------------------------------------------------------------


@query("""WITH d AS (SELECT max(CAST(ts AS DATE)) AS day FROM events) SELECT 'stale' AS name, day + 1 AS first, day + 9 AS last FROM d UNION ALL SELECT 'fresh', NULL, NULL FROM d UNION ALL SELECT 'least', day - 4, day + 1 FROM d
UNION ALL SELECT 'empty', day - 28, day + 2 FROM d""")
def fetch_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days to fetch from a high-water mark, with a safe day, a look-back and a least number of days."""
    from datetime import timedelta

    latest = readers.latest_day(table(spark, sf_dir, "events"), "ts")
    ahead = lambda n: latest + timedelta(days=n)
    found = {
        "stale": readers.fetch_range(latest, ahead(9), 30), "fresh": readers.fetch_range(latest, latest, 30),
        "least": readers.fetch_range(latest, ahead(1), 30, 5), "empty": readers.fetch_range(None, ahead(2), 30),
    }
    return spark.createDataFrame([(name, *(days or (None, None))) for name, days in found.items()], "name string, first date, last date")


@query("""SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey % 4 <> 1""")
def unseen_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose key the sink lacks."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return readers.unseen(o, o.filter("o_custkey % 4 = 1"), ["o_custkey"])


@query("""WITH r AS (SELECT o_custkey AS key, min(CAST(o_orderdate AS DATE)) AS a, min(CAST(o_orderdate AS DATE)) + CAST(o_custkey % 9 AS INTEGER) - 2 AS b FROM orders GROUP BY o_custkey)
SELECT key, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS date FROM r WHERE a <= b""")
def requested_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per key and requested day; ranges that end before they start have none."""
    r = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.min(F.to_date("o_orderdate")).alias("a"))
    r = r.withColumn("b", F.date_add("a", (F.col("key") % 9 - 2).cast("int")))
    return readers.densified_request(r, "a", "b").select("key", "date")


_CELLS = """cells AS (SELECT CAST(o_orderkey % 24 AS DOUBLE) AS lon, CAST(o_custkey % 18 AS DOUBLE) AS lat, CAST(o_orderdate AS DATE) AS date, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / count(*) AS v FROM orders GROUP BY ALL),
boxes AS (SELECT n_name AS region, n_nationkey - 0.25 AS x0, n_nationkey + CASE WHEN n_nationkey % 3 = 0 THEN 0.1 ELSE 2.1 END AS x1, n_regionkey + 0.75 AS y0, n_regionkey + CASE WHEN n_nationkey % 3 = 0 THEN 0.8 ELSE 2.1 END AS y1 FROM nation)"""


@query(f"""WITH {_CELLS}, inside AS (SELECT region, date, avg(v) AS v FROM cells, boxes WHERE lon >= x0 AND lon <= x1 AND lat >= y0 AND lat <= y1 GROUP BY ALL),
sites AS (SELECT DISTINCT lon, lat FROM cells), far AS (SELECT region, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy FROM boxes WHERE region NOT IN (SELECT region FROM inside)),
near AS (SELECT region, lon, lat FROM (SELECT region, lon, lat, row_number() OVER (PARTITION BY region ORDER BY (lon - cx) * (lon - cx) + (lat - cy) * (lat - cy)) AS rn FROM far, sites) WHERE rn = 1)
SELECT region, date, round(v, 4) AS v FROM inside UNION ALL SELECT region, date, round(avg(v), 4) FROM near JOIN cells USING (lon, lat) GROUP BY ALL""")
def raster_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of the grid cells in each region's box; a box without cells takes the nearest cell."""
    o, n = table(spark, sf_dir, "orders"), table(spark, sf_dir, "nation")
    day = F.to_date("o_orderdate")
    cells = o.groupBy((F.col("o_orderkey") % 24).cast("double").alias("lon"), (F.col("o_custkey") % 18).cast("double").alias("lat"), day.alias("date")).agg((F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).cast("double") / F.count(F.lit(1))).alias("v"))
    thin = F.col("n_nationkey") % 3 == 0
    boxes = n.select(
        F.col("n_name").alias("region"), (F.col("n_nationkey") - 0.25).alias("lon_min"), (F.col("n_nationkey") + F.when(thin, 0.1).otherwise(2.1)).alias("lon_max"),
        (F.col("n_regionkey") + 0.75).alias("lat_min"), (F.col("n_regionkey") + F.when(thin, 0.8).otherwise(2.1)).alias("lat_max"),
    )
    boxes = boxes.withColumns({"centroid_lon": (F.col("lon_min") + F.col("lon_max")) / 2, "centroid_lat": (F.col("lat_min") + F.col("lat_max")) / 2})
    return places.grid_means(cells, boxes, "v").select("region", "date", F.round("v", 4).alias("v"))


# --- exports and registries --------------------------------------------------------------------------


@query("""SELECT CAST(event_id AS BIGINT) AS event_id, event_type, CAST(user_id AS BIGINT) AS "user" FROM events""")
def sink_line_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selected fields, one object a line."""
    out = _folder(spark)
    e = table(spark, sf_dir, "events").select("event_id", F.struct(F.col("event_type").alias("name"), F.col("user_id").alias("user")).alias("who"))
    sinks.line_json(e, out, ["event_id", "who.name", "who.user"])
    back = spark.read.text(out).select(F.from_json("value", "event_id long, `who.name` string, `who.user` long").alias("j"))
    return back.select("j.event_id", F.col("j.`who.name`").alias("event_type"), F.col("j.`who.user`").alias("user"))


_SCORED = "SELECT c_custkey, c_name, CASE WHEN c_custkey % 6 = 0 THEN 'n/a' ELSE CAST(c_custkey % 100 AS VARCHAR) END AS score FROM customer"


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.when(F.col("c_custkey") % 6 == 0, "n/a").otherwise((F.col("c_custkey") % 100).cast("string"))
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name", score.alias("score"))


@query(f"""SELECT c_custkey, c_name, CASE WHEN coalesce(TRY_CAST(score AS DOUBLE), 0) >= 60 THEN 'yes' ELSE 'no' END AS approved FROM ({_SCORED})""")
def sink_audit_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed columns with a verdict; a score that is no number is 0."""
    out = _folder(spark)
    sinks.audit_csv(_scored(spark, sf_dir), out, ["c_custkey", "c_name"], "score", 60)
    return readers.csv(spark, out, "c_custkey long, c_name string, approved string")


@query(f"""SELECT c_custkey, coalesce(TRY_CAST(score AS DOUBLE), 0) >= 60 AS approved FROM ({_SCORED})""")
def approved_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approved or rejected by score."""
    return rules.approve(_scored(spark, sf_dir), "score", 60).select("c_custkey", "approved")


@query(f"""WITH s AS (SELECT c_custkey, coalesce(TRY_CAST(score AS DOUBLE), 0) AS s FROM ({_SCORED})), t AS (SELECT CAST(count(*) AS BIGINT) AS total, CAST(count_if(s >= 60) AS BIGINT) AS approved, CAST(count_if(s < 60) AS BIGINT) AS rejected, round(avg(s), 1) AS mean FROM s),
l AS (SELECT row_number() OVER (ORDER BY s, c_custkey) AS place, c_custkey, s FROM s WHERE s < 60 ORDER BY s, c_custkey LIMIT 20)
SELECT total, approved, rejected, mean, place, c_custkey, s AS score FROM t LEFT JOIN l ON true""")
def score_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, mean and the twenty lowest of the rejected."""
    return rules.score_summary(_scored(spark, sf_dir), "score", 60, "c_custkey")




@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY p_brand, p_size % 2 ORDER BY p_size DESC, p_partkey) AS rn, '- **' || p_name || '** at ' || p_type || ' (' || p_size || '.0) https://x.example/' || p_partkey AS line FROM part),
t AS (SELECT p_brand AS reader, count(*) FILTER (p_size % 2 = 0) AS na, string_agg(line, chr(10) ORDER BY rn) FILTER (p_size % 2 = 0) AS a, count(*) FILTER (p_size % 2 = 1) AS nb, string_agg(line, chr(10) ORDER BY rn) FILTER (p_size % 2 = 1) AS b FROM r WHERE rn <= 20 GROUP BY 1)
SELECT reader, '# Digest 2026-08-01' || chr(10) || chr(10) || '## Curated (' || na || ')' || coalesce(chr(10) || a, '') || chr(10) || chr(10) || '## Boards (' || nb || ')' || coalesce(chr(10) || b, '') || chr(10) || chr(10) || '_Fetched '
|| (SELECT sum(r_regionkey) FROM region) || ', passed ' || (SELECT count(*) FROM region) || '; check: ' || (SELECT string_agg(r_name, ', ' ORDER BY r_name) FROM region WHERE r_regionkey > 2) || '_' || chr(10) AS text FROM t""")
def sink_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest of parts for each brand: two sections of at most twenty and a footer."""
    p = table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("reader"), F.when(F.col("p_size") % 2 == 0, "Curated").otherwise("Boards").alias("section"), F.col("p_name").alias("title"), F.col("p_type").alias("company_name"),
        F.col("p_size").cast("double").alias("score"), F.concat(F.lit("https://x.example/"), F.col("p_partkey")).alias("url"), "p_partkey",
    )
    stats = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("fetched"), F.lit(1).alias("passed"), F.when(F.col("r_regionkey") > 2, "bad").otherwise("ok").alias("health"), F.col("r_name").alias("source"))
    return sinks.markdown_digests(p, stats, "2026-08-01", "reader", "section", ["Curated", "Boards"], [F.desc("score"), F.asc("p_partkey")], 20)


@query("""SELECT o_orderkey, o_custkey, 2 AS attempts FROM orders""")
def sink_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders sent to a store that refuses each batch once: after the retry every row is there once."""
    from pyarrow import fs
    from pyarrow import parquet as pq

    out = _folder(spark)

    def send(name: str, batch) -> None:
        store, root = fs.FileSystem.from_uri(out)
        store.create_dir(f"{root}/tried", recursive=True)
        store.create_dir(f"{root}/data", recursive=True)
        if store.get_file_info(f"{root}/tried/{name}").type == fs.FileType.NotFound:
            store.open_output_stream(f"{root}/tried/{name}").close()
            raise OSError("Quota exceeded")
        with store.open_output_stream(f"{root}/data/{name}.parquet") as f:
            pq.write_table(pa.Table.from_batches([batch]), f)

    sent = sinks.send_batches(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), send, tries=3, sleep=lambda seconds: None)
    found = sent.agg(F.min("attempts").alias("low"), F.max("attempts").alias("attempts")).first()
    if found["low"] != found["attempts"]:
        raise AssertionError("every batch is refused once")
    return spark.read.parquet(f"{out}/data").withColumn("attempts", F.lit(found["attempts"]))


_BOARDS = """CASE s_suppkey % 5 WHEN 0 THEN 'https://boards.greenhouse.io/acme' || s_suppkey WHEN 1 THEN 'https://jobs.lever.co/acme' || s_suppkey || '/1' WHEN 2 THEN 'https://acme' || s_suppkey || '.recruitee.com/o/x'
WHEN 3 THEN 'https://careers.acme.example/' WHEN 4 THEN '' END"""


@query(f"""SELECT s_name AS company_name, CASE s_suppkey % 5 WHEN 0 THEN 'greenhouse' WHEN 1 THEN 'lever' WHEN 2 THEN 'recruitee' END AS ats_type, CASE WHEN s_suppkey % 5 < 3 THEN 'acme' || s_suppkey END AS ats_slug
FROM supplier WHERE s_suppkey % 5 <> 4""")
def registry_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registry exported as CSV and read again: rows need a name and an address; kind and slug come from the address."""
    out = _folder(spark)
    nothing = {c: F.lit(None).cast("string") for c in ("mission_category", "discovery_source", "ats_type", "ats_slug", "ats_region", "careers_url")}
    s = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("company_name"), F.expr(_BOARDS).alias("job_board_url")).withColumns(nothing)
    s.write.option("header", True).csv(out)
    return readers.companies(spark, out).select("company_name", "ats_type", "ats_slug")


@query("""WITH p AS (SELECT p_partkey, trim(CASE p_partkey % 9 WHEN 0 THEN '' WHEN 1 THEN ' UNKNOWN ' ELSE ' ' || p_brand || ' ' END) AS name, CASE WHEN p_partkey % 4 = 0 THEN 'https://jobs.lever.co/b' || p_size ELSE 'https://x.example' END AS url FROM part),
n AS (SELECT *, lower(name) AS key, row_number() OVER (PARTITION BY lower(name) ORDER BY p_partkey) AS rn FROM p WHERE name <> '' AND lower(name) <> 'unknown')
SELECT name AS company_name, 'feed' AS discovery_source, CASE WHEN url LIKE '%lever%' THEN 'lever' END AS ats_type, CASE WHEN url LIKE '%lever%' THEN substr(url, 23) END AS ats_slug, FALSE AS probed FROM n WHERE rn = 1 AND key NOT LIKE '%#11'
UNION ALL SELECT DISTINCT p_brand, 'pool', NULL, NULL, TRUE FROM part WHERE p_brand LIKE '%#11'""")
def employer_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Employers of postings that the pool lacks, by name, with a board found in the posting's texts."""
    p = table(spark, sf_dir, "part")
    name = F.when(F.col("p_partkey") % 9 == 0, "").when(F.col("p_partkey") % 9 == 1, " UNKNOWN ").otherwise(F.concat(F.lit(" "), F.col("p_brand"), F.lit(" ")))
    url = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("https://jobs.lever.co/b"), F.col("p_size").cast("string"))).otherwise("https://x.example")
    postings = p.select(F.col("p_partkey").alias("seen"), name.alias("company_name"), url.alias("url"), F.lit(None).cast("string").alias("description_text"))
    pool = p.filter("p_brand like '%#11'").select(F.col("p_brand").alias("company_name")).distinct().select("company_name", F.lit("pool").alias("discovery_source"), F.lit(None).cast("string").alias("ats_type"), F.lit(None).cast("string").alias("ats_slug"), F.lit(True).alias("probed"))
    return dedupe.mine_employers(pool, postings, "feed", "seen")


@query("""WITH a AS (SELECT 'one' AS discovery_source, n_name AS company_name, 1 AS place FROM nation WHERE n_regionkey <= 1 UNION ALL SELECT 'three', upper(n_name), 3 FROM nation WHERE n_regionkey BETWEEN 1 AND 2)
SELECT min_by(company_name, place) AS company_name, string_agg(discovery_source, '+' ORDER BY discovery_source) AS discovery_source FROM a GROUP BY lower(company_name)""")
def collected_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidates of the enabled sources in one table, one row per employer."""
    n = table(spark, sf_dir, "nation")
    of = lambda low, high, name=F.col("n_name"): lambda: n.filter(F.col("n_regionkey").between(low, high)).select(name.alias("company_name"))
    every = {"one": of(0, 1), "two": of(0, 4), "three": of(1, 2, F.upper("n_name"))}
    return dedupe.collect_sources(every, [" One", "three", "unknown"])


@query("""SELECT n_regionkey AS parent, n_name AS name, CAST(count(*) AS BIGINT) AS n FROM (SELECT n_regionkey, CASE WHEN n_nationkey % 4 = 0 THEN 'Same' ELSE n_name END AS n_name FROM nation) GROUP BY ALL HAVING count(*) > 1""")
def repeated_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that occur more than once within a parent."""
    n = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("parent"), F.when(F.col("n_nationkey") % 4 == 0, "Same").otherwise(F.col("n_name")).alias("name"))
    return places.repeated_within(n, "parent", "name")


@query("""SELECT n_name AS region, array_to_string(list_filter([CASE WHEN n_nationkey % 6 = 0 THEN 'no_name' END, CASE WHEN n_nationkey % 5 = 0 THEN 'lon_order' END, CASE WHEN n_nationkey % 7 = 0 THEN 'out_of_range' END,
CASE WHEN n_nationkey % 4 = 0 OR n_nationkey % 5 = 0 THEN 'centre_outside' END], lambda x: x IS NOT NULL), ', ') AS issues FROM nation""")
def region_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that a region's row breaks."""
    k = F.col("n_nationkey")
    west, east, north = F.when(k % 5 == 0, 20.0).otherwise(10.0), F.lit(15.0), F.when(k % 7 == 0, 95.0).otherwise(50.0)
    n = table(spark, sf_dir, "nation").select(
        "n_name", F.when(k % 6 == 0, " ").otherwise(F.col("n_name")).alias("region"), west.alias("lon_min"), east.alias("lon_max"), F.lit(40.0).alias("lat_min"), north.alias("lat_max"),
        F.lit(12.0).alias("centroid_lon"), F.when(k % 4 == 0, 30.0).otherwise(45.0).alias("centroid_lat"),
    )
    return places.region_issues(n).select(F.col("n_name").alias("region"), F.array_join("issues", ", ").alias("issues"))


@query("""SELECT c_nationkey AS nation, CAST(count(*) AS BIGINT) AS expected, CAST(count_if(c_custkey % 3 = 0 AND c_nationkey <> 4) AS BIGINT) AS stored, round(count_if(c_custkey % 3 = 0 AND c_nationkey <> 4) / count(*), 6) AS share FROM customer GROUP BY 1""")
def coverage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected against stored rows."""
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), "c_custkey")
    return places.coverage(c, c.filter("c_custkey % 3 = 0 and nation <> 4"), "nation").withColumn("share", F.round("share", 6))


@query("""SELECT c_nationkey AS region, array_to_string(list_sort(list(DISTINCT year(CAST(o_orderdate AS DATE)))), ', ') AS years FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1""")
def stored_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years that are stored for each region."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    years = places.years_of(o.withColumn("region", F.col("c_nationkey")), "region", "o_orderdate")
    return years.select("region", F.array_join(F.transform("years", lambda y: y.cast("string")), ", ").alias("years"))


@query("""WITH n AS (SELECT n_nationkey AS k, translate(n_name, '_0123456789', 'XABCDEFGHI') AS name FROM nation) SELECT k, lower(name) AS plain, replace(name, ' ', '_') || CASE WHEN k % 2 = 0 THEN '_County' ELSE '' END AS bare, name AS parent FROM n""")
def region_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Administrative names: suffixes, accents and numbered parts off."""
    k, name = F.col("n_nationkey"), F.translate("n_name", "_0123456789", "XABCDEFGHI")
    suffix = F.element_at(F.array(*map(F.lit, (" County", "_regency", " Ward", ""))), (k % 4 + 1).cast("int"))
    accented = F.translate(F.concat(name, suffix), "AEI", "ÁÉÍ")
    whole = F.concat(name, F.when(k % 2 == 0, " County").otherwise(F.element_at(F.array(*map(F.lit, ("_Complete", "_Ward", " Regency"))), (k % 3 + 1).cast("int"))))
    part = F.concat(name, F.element_at(F.array(*map(F.lit, ("_sub_1", "_12", "_part3", "_cell_2_4"))), (k % 4 + 1).cast("int")))
    return table(spark, sf_dir, "nation").select(k.alias("k"), places.plain_name(accented).alias("plain"), places.without_complete(whole).alias("bare"), places.parent_of(part).alias("parent"))


@query("""WITH n AS (SELECT n_nationkey AS k, 10.0 * (n_nationkey + 1) AS w FROM nation),
l AS (SELECT *, least(3, greatest(0, CAST(ceil(log2(greatest(w * 8 / 50, 1))) AS INTEGER))) AS c FROM n),
s AS (SELECT *, CASE WHEN w * 8 / pow(2, c) < 20 THEN greatest(c - 1, 0) ELSE c END AS m FROM l) SELECT k, CAST(pow(2, m) AS BIGINT) AS parts, CAST(w * 8 AS DOUBLE) AS area FROM s""")
def area_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes halved until their area is at most the target: how many, and that they cover the whole."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("region"), F.lit(0.0).alias("lon_min"), F.lit(0.0).alias("lat_min"), (10.0 * (F.col("n_nationkey") + 1)).alias("lon_max"), F.lit(8.0).alias("lat_max"))
    cut = places.split_area(n.withColumn("area", F.col("lon_max") * 8), "area", 50.0, 20.0, 3)
    size = (F.col("lon_max") - F.col("lon_min")) * (F.col("lat_max") - F.col("lat_min"))
    parts = cut.groupBy("region").agg(F.count_distinct("part").alias("parts"), F.round(F.sum(size), 6).alias("area"))
    return n.select("k", "region").join(parts, "region").select("k", "parts", "area")


@query("""WITH s AS (SELECT n_regionkey AS k, list(CASE WHEN n_nationkey % 4 = 3 THEN NULL ELSE CAST(n_nationkey AS DOUBLE) END ORDER BY n_nationkey) AS v FROM nation GROUP BY 1),
x AS (SELECT k, unnest(v) AS y, generate_subscripts(v, 1) - 1 AS i, len(v) AS n, list_min(v) AS lo, list_max(v) AS hi FROM s)
SELECT k, string_agg(CAST(round(i * (100.0 / greatest(n - 1, 1)), 1) AS VARCHAR) || ',' || CAST(round(20.0 - CASE WHEN hi = lo THEN 0.5 ELSE (y - lo) / (hi - lo) END * 20.0, 1) AS VARCHAR), ' ' ORDER BY i) AS path FROM x WHERE y IS NOT NULL GROUP BY 1""")
def sparklines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values scaled to a box as a path; NULLs are skipped."""
    v = F.when(F.col("n_nationkey") % 4 != 3, F.col("n_nationkey").cast("double"))
    s = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("k")).agg(F.array_sort(F.collect_list(F.struct("n_nationkey", v.alias("v")))).alias("s"))
    return s.select("k", places.sparkline(F.transform("s", lambda x: x["v"]), 100.0, 20.0).alias("path"))


@query("""WITH v AS (SELECT s_suppkey AS k, s_name AS name FROM supplier) SELECT k, 'acme ' || k AS squeezed, k % 3 <> 2 AS accepted FROM v WHERE k % 3 <> 2 UNION ALL SELECT k, 'acme ' || k, NULL FROM v WHERE k % 3 = 2 AND k % 2 = 0""")
def verdict_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings of employers with a verdict, and employers that need one."""
    k = F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier")
    jobs = s.filter("s_suppkey % 3 <> 2 or s_suppkey % 2 = 0").select(k.alias("k"), F.concat(F.lit("Acme   "), k.cast("string")).alias("employer"))
    verdicts = s.filter("s_suppkey % 3 <> 2").select(F.concat(F.lit(" ACME "), k.cast("string")).alias("employer"), F.lit(True).alias("accepted"))
    passed, pending = rules.cached_verdicts(jobs, verdicts)
    waiting = pending.select(F.regexp_extract("employer", "([0-9]+)$", 1).cast("long").alias("k"), F.col("employer").alias("squeezed"), F.lit(None).cast("boolean").alias("accepted"))
    return passed.select(F.col("k").cast("long").alias("k"), T.squeeze(F.col("employer")).alias("squeezed"), F.lit(True).alias("accepted")).unionByName(waiting)


@query("""WITH c AS (SELECT c_custkey AS k, c_acctbal AS v FROM customer) SELECT k, CASE WHEN k % 4 = 0 THEN 0.0 ELSE v END AS v FROM c""")
def update_only_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matching rows take the source's value where it has one; nothing is added."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    zero = F.when(F.col("k") % 4 == 0, F.lit(0.0)).cast(dict(c.dtypes)["v"])
    source = c.filter("k % 2 = 0").withColumn("v", zero).unionByName(c.withColumn("k", F.col("k") + 1_000_000_000))
    return dedupe.update_only(c, source, ["k"], ["v"])


@query("""SELECT c_custkey AS k, 'old' AS state FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, 'new' FROM customer WHERE c_custkey % 2 = 1""")
def insert_only_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that the target lacks are added, others left alone."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    return dedupe.insert_new(c.filter("k % 2 = 0").withColumn("state", F.lit("old")), c.union(c).withColumn("state", F.lit("new")), ["k"])


@query("""SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey < 5)""")
def delete_outside(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose key is not allowed any more go."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return dedupe.delete_keys(o, c.filter("c_nationkey < 5").select(F.col("c_custkey").alias("o_custkey")), ["o_custkey"]).select("o_orderkey")


@query("""SELECT e.event_id, CAST(date_diff('day', CAST(ts AS DATE), (SELECT max(CAST(ts AS DATE)) FROM events)) AS BIGINT) AS age FROM events e WHERE CAST(ts AS DATE) >= (SELECT max(CAST(ts AS DATE)) FROM events) - 7""")
def recent_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last seven days before an explicit target day, with their age."""
    e = table(spark, sf_dir, "events")
    target, day = F.lit(readers.latest_day(e, "ts")), F.to_date("ts")
    return e.filter(T.within_last(day, target, 7)).select("event_id", F.datediff(target, day).cast("long").alias("age"))


@query("""SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem WHERE year(CAST(l_shipdate AS DATE)) BETWEEN 1995 AND 1996""")
def year_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store partitioned by year, read for a range of years: only their folders are opened."""
    out = _folder(spark)
    x = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", F.year(F.to_date("l_shipdate")).alias("year")).distinct()
    x.repartition("year").write.partitionBy("year").parquet(out)
    return readers.parquet(spark, out).filter("year between 1995 and 1996").select("l_orderkey", "l_suppkey").distinct()


@query("""SELECT n_name, n_regionkey FROM nation""")
def all_but(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every column but some."""
    return spark.sql("SELECT * EXCEPT (n_nationkey, n_comment) FROM {n}", n=_with_comment(spark, sf_dir)).select("n_name", "n_regionkey")


def _with_comment(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    return n if "n_comment" in n.columns else n.withColumn("n_comment", F.lit(None).cast("string"))


@query("""WITH d AS (SELECT CAST(o_orderdate AS DATE) AS day, sum(o_totalprice) AS v FROM orders GROUP BY 1) SELECT d.day, CAST(k AS INTEGER) AS offset, CAST(d.day - to_years(CAST(k AS INTEGER)) AS DATE) AS earlier FROM d, (SELECT unnest(generate_series(1, 10)) AS k)""")
def ten_years_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten yearly offsets of one relation in one scan."""
    d = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    k = F.explode(F.sequence(F.lit(1), F.lit(10)))
    return d.withColumn("offset", k).withColumn("earlier", F.add_months("day", -12 * F.col("offset")))


@query("""SELECT o_custkey, CAST(o_orderdate AS DATE) AS day, round(sum(o_totalprice), 2) AS total, max(o_orderkey % 100) AS most FROM orders GROUP BY ALL""")
def day_sum_and_most(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A day's total and its largest effort, in one aggregate."""
    most = F.max(F.col("o_orderkey") % 100).alias("most")
    return table(spark, sf_dir, "orders").groupBy("o_custkey", F.to_date("o_orderdate").alias("day")).agg(F.round(F.sum("o_totalprice"), 2).alias("total"), most)
