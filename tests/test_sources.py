import json
import random
import statistics
from collections import Counter
from datetime import date, timedelta

from pyspark.sql import functions as F

from tessera.plans import migration
from tessera.sources import buckets, committed, postings, readers, schemas, sinks


def test_conform(spark):
    df = spark.createDataFrame([("x", "12.5", float("nan"))], "region string, precipitation string, ndvi double")
    row = schemas.conform(df, "region_days").first()
    assert (row.precipitation, row.ndvi, row.date) == (12.5, None, None)
    assert schemas.violations(df, ["region"], ["region"]) == {"region is null": 0, "duplicates": 0}


def test_vendors(spark):
    lever = {"id": "1", "text": "Engineer", "hostedUrl": "https://x/1", "createdAt": 1785566725000, "workplaceType": "remote", "descriptionPlain": "Do things", "categories": {"team": "Data", "location": "Berlin"}}
    green = {"id": 7, "title": "Analyst", "absolute_url": "https://x/7", "updated_at": "2026-07-01", "content": "<p>Hi &amp; bye</p>", "location": {"name": "Remote - EU"}}
    rows = [("lever", json.dumps(lever)), ("greenhouse", json.dumps(green)), ("greenhouse", "{broken")]
    df = spark.createDataFrame(rows, "vendor string, payload string").withColumns({"company_name": F.lit("Acme"), "mission_category": F.lit("climate"), "ats_slug": F.lit("acme")})
    out = {r.source_job_id: r for r in postings.normalize_all(df).collect()}
    assert (out["1"].location_text, out["1"].is_remote, out["1"].posted_at_hint) == ("remote, Berlin, Data", True, "2026-08-01T06:45:25+00:00")
    assert (out["7"].description_text, out["7"].is_remote, out["7"].url) == ("Hi & bye", True, "https://x/7")
    assert len(postings.VENDORS) == 31


def test_rss_json_and_scripts(spark):
    rss = "<rss><channel><item><title>Acme: Engineer</title><link>https://x/1</link></item><item><title>B</title></item></channel></rss>"
    items = readers.rss_items(spark.createDataFrame([(rss,)], "xml string"), "xml").collect()
    assert [r.title for r in items] == ["Acme: Engineer", "B"]
    docs = spark.createDataFrame([('{"jobs": [{"id": 1}, {"id": 2}]}',), ("broken",)], "p string")
    assert [r.id for r in readers.json_items(docs, "p", "jobs array<struct<id:int>>", "jobs").collect()] == [1, 2]
    html = spark.createDataFrame([('<script id="__DATA__" type="x">{"a": 3}</script>',)], "h string")
    assert html.select(readers.script_json(F.col("h"), "__DATA__", "a int").alias("j")).first().j.a == 3


def test_files(spark, tmp_path):
    (tmp_path / "c.csv").write_text("company_name,job_board_url,mission_category,discovery_source,ats_type,ats_slug,ats_region,careers_url\nAcme,https://jobs.lever.co/acme,x,y,,,,\n,https://z,,,,,,\n")
    rows = readers.companies(spark, str(tmp_path / "c.csv")).collect()
    assert [(r.ats_type, r.ats_slug) for r in rows] == [("lever", "acme")]
    (tmp_path / "p.csv").write_text("Some title\n\nid,name\n1,a\n2,b\n")
    assert [r.name for r in readers.csv_after(spark, str(tmp_path / "p.csv"), "id,", "id int, name string").collect()] == ["a", "b"]
    (tmp_path / "p.yaml").write_text("location:\n  acceptable_hire_regions:\n    - EU\n    - Canada\n  allow: true\nlimit: 5\n")
    assert readers.preferences(str(tmp_path / "p.yaml")) == {"location": {"acceptable_hire_regions": ["EU", "Canada"], "allow": True}, "limit": 5}


def test_ranges():
    assert readers.fetch_range(date(2024, 1, 5), date(2024, 1, 8), 30) == (date(2024, 1, 6), date(2024, 1, 8))
    assert readers.fetch_range(date(2024, 1, 8), date(2024, 1, 8), 30) is None
    assert readers.fetch_range(None, date(2024, 1, 8), 2) == (date(2024, 1, 6), date(2024, 1, 8))


def test_sinks(spark, tmp_path):
    a = spark.createDataFrame([(1, date(2024, 1, 1), "a"), (2, date(2024, 1, 2), "b")], "k int, day date, v string")
    path = f"file://{tmp_path}/t"
    buckets.upsert(a, path, ["k"])
    buckets.upsert(spark.createDataFrame([(2, date(2024, 1, 2), "B")], a.schema), path, ["k"])
    assert sorted(r.v for r in buckets.read(spark, path).collect()) == ["B", "a"]
    sinks.replace_days(a, f"{path}-d", "day")
    sinks.replace_days(a.filter("k = 2").withColumn("v", F.lit("new")), f"{path}-d", "day")
    assert sorted(r.v for r in spark.read.parquet(f"{path}-d").collect()) == ["a", "new"]
    work = lambda keys: keys.withColumn("done", F.lit(True))
    assert committed.process_missing(a, f"{path}-m", ["k"], work) == 2
    assert committed.process_missing(a, f"{path}-m", ["k"], work) == 0
    waits, calls = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise RuntimeError("quota exceeded")

    assert sinks.with_retry(flaky, sleep=waits.append) == 3 and waits == [60.0, 60.0]
    sinks.line_json(a, f"{path}-j", ["k", "v"])
    assert spark.read.json(f"{path}-j").count() == 2
    stats = spark.createDataFrame([("x", 3, 1, "ok"), ("y", 0, 0, "broken")], "source string, fetched int, passed int, health string")
    posts = spark.createDataFrame([("me", "Curated", "T", "Acme", 8.25, "https://x"), ("me", "Curated", "U", "Acme", 9.0, "https://y"), ("you", "Boards", "V", "B", 1.0, "https://z")], "who string, part string, title string, company_name string, score double, url string")
    made = {r.who: r.text for r in sinks.markdown_digests(posts, stats, "2026-07-12", "who", "part", ["Curated", "Boards"], [F.desc("score")], 1).collect()}
    assert made["me"] == "# Digest 2026-07-12\n\n## Curated (1)\n- **U** at Acme (9.0) https://y\n\n## Boards (0)\n\n_Fetched 3, passed 1; check: y_\n"
    assert "## Curated (0)\n\n## Boards (1)\n- **V**" in made["you"]


def pages(stream, cursor):
    start = cursor or 0
    return [(stream, i) for i in range(start, start + 2)], start + 2 if start < 2 else None


def test_paged_source(spark):
    spark.dataSource.register(readers.PagedSource)
    df = spark.read.format("paged").option("pages", "os.path:missing").option("streams", "a,b").option("ddl", "s string, i int").load()
    assert df.rdd.getNumPartitions() == 2
    reader = readers.PagedReader({"pages": f"{__name__}:pages", "streams": "a", "ddl": ""})
    assert list(reader.read(reader.partitions()[0])) == [("a", 0), ("a", 1), ("a", 2), ("a", 3)]


def test_early_arrivals(spark):
    rows = [("stork", y, date(y, 4, 1), "normal", "st", f"s{y}", 1, True) for y in (2001, 2002, 2003)] + [("stork", 2004, date(2004, 1, 5), "normal", "st", "early", 7, True)]
    s = spark.createDataFrame(rows, "common_name string, year int, observation_date date, status string, species_code string, submission_id string, count int, is_reviewed boolean")
    none = spark.createDataFrame([], "species_code string, submission_id string, observation_date date")
    out = {r.submission_id: r.status for r in migration.early_arrivals(s, none).collect()}
    assert out == {"s2001": "normal", "s2002": "normal", "s2003": "normal", "early": "confirmed_early"}
    before = spark.createDataFrame([("st", "other", date(2004, 1, 2)), ("st", "early", date(2004, 1, 3))], none.schema)
    assert {r.submission_id: r.status for r in migration.early_arrivals(s, before).collect()}["early"] == "probable_overwintering"


def test_early_arrivals_meet_days_instead_of_rows(spark):
    """Against brute force: equal sightings, missing values, edges of the month; no join of a species' rows by a range of days."""
    rng = random.Random(4)
    days = [date(2004, 1, 5), date(2004, 2, 29), date(2004, 3, 31), date(2004, 6, 1), date(2004, 7, 30)]
    rows = [(rng.choice("ab"), rng.choice(days), "unknown", rng.choice(["x", "y", "z"]), f"s{rng.randrange(12)}", rng.randrange(9), rng.random() < 0.5) for _ in range(120)]
    rows += [("a", None, "unknown", "x", "s1", 3, True), ("a", days[0], "unknown", None, "s2", 7, True), ("b", days[0], "unknown", "x", None, 2, None), (None, days[0], "unknown", "x", "s1", 1, True)]
    rows += rows[:40]
    before = [(rng.choice(["x", "y"]), f"s{rng.randrange(12)}", rng.choice(days) - timedelta(rng.choice([0, 1, 5, 28, 29, 30, 31, 32]))) for _ in range(25)] + [("x", None, date(2004, 1, 4)), (None, "s2", date(2004, 1, 4)), ("x", "s3", None)]
    s = spark.createDataFrame(rows, "common_name string, observation_date date, status string, species_code string, submission_id string, count int, is_reviewed boolean")
    b = spark.createDataFrame(before, "species_code string, submission_id string, observation_date date")
    out = migration.early_arrivals(s, b)
    doy = lambda d: d and date(2000, d.month, d.day).timetuple().tm_yday
    back = lambda d: date(d.year - (d.month == 1), (d.month - 2) % 12 + 1, min(d.day, [31, 29, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31][(d.month - 2) % 12]))
    median = {n: statistics.median({doy(r[1]) for r in rows if r[0] == n and r[1]}) for n in "ab"}
    want = []
    for r, times in Counter(r for r in rows if r[0]).items():
        hits = [x for x in before if r[1] and r[3] == x[0] and r[3] and x[1] and x[2] and back(r[1]) <= x[2] < r[1]] * times
        own = [x for x in hits if x[1] == r[4]]
        late = r[1] is not None and doy(r[1]) >= median[r[0]] - 30
        status = "normal" if late else ("confirmed_early" if r[6] and r[5] >= 5 else "possible_early") if not hits else ("probable_overwintering" if len(hits) > 1 else "possible_overwintering") if own else r[2]
        want.append((*r[:2], status, *r[3:]))
    assert sorted(map(str, want)) == sorted(str(tuple(x)) for x in out.collect())
    assert {w[2] for w in want} >= {"normal", "confirmed_early", "possible_early", "probable_overwintering", "unknown"}
    joins = [x for x in out._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in x]
    assert joins and not [x for x in joins if "add_months" in x and "submission_id" not in x]


def test_migration_chain(spark, sf_dir):
    marts = migration.build(*migration.inputs(spark, sf_dir))
    flags = migration.flags_of(marts["comparison_daily"])
    names = [c for c in flags.columns if c.endswith("_flag")]
    values = {v for r in flags.select(*names).collect() for v in r}
    assert values <= {-2.0, -1.0, 0.0, 1.0, 2.0, None}
    sizes = {r["count"] for r in marts["periods"].groupBy("chunk_id").count().collect()}
    assert max(sizes) <= 4
    assert len(marts["features_all"].columns) == 3 + 32
