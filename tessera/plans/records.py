"""Text, key, date, JSON and rule queries over documents, pages, parts and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import kernels as K
from tessera.functions import text as T

from .registry import query, table
from .timeseries import LD_SQL, UD_SQL, flag_days, user_days

INCLUDE, EXCLUDE, SENIOR = ["copper", "steel"], ["promo"], ["large", "economy"]


@query("""SELECT p_partkey, CASE WHEN trim(t) = '' THEN 'empty' WHEN regexp_matches(t, '\\b(promo)\\b', 'i') THEN 'exclude' WHEN regexp_matches(t, '\\b(economy|large)\\b', 'i') THEN 'seniority' WHEN regexp_matches(t, '\\b(copper|steel)\\b', 'i') THEN 'include' ELSE 'no_match' END AS reason FROM (SELECT p_partkey, p_type AS t FROM part)""")
def title_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", T.title_gate(F.col("p_type"), INCLUDE, EXCLUDE, SENIOR)[1].alias("reason"))


@query("""SELECT o_orderkey, substr(sha256(concat_ws('|', lower(c_name), lower(o_orderpriority), lower(n_name), concat(isoyear(o_orderdate), '-W', lpad(CAST(weekofyear(o_orderdate) AS VARCHAR), 2, '0')))), 1, 32) AS key
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""")
def canonical_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _canonical_keys(spark, sf_dir, table(spark, sf_dir, "orders"))


def _canonical_keys(spark: SparkSession, sf_dir: str, o: DataFrame) -> DataFrame:
    c, n = (table(spark, sf_dir, x) for x in ("customer", "nation"))
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    place = F.concat(F.lit("Anywhere, "), F.col("n_name"))
    return j.select("o_orderkey", T.canonical_key(F.col("c_name"), F.col("o_orderpriority"), place, F.to_date("o_orderdate")).alias("key"))


@query("""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '<(script|style)\\b.*?</(script|style)\\s*>', ' ', 'gis'), '<br\\s*/?>|</(p|div|li|tr|h[1-6])\\s*>', chr(10), 'gi'), '<[^>]*>', '', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '[ \\t]+', ' ', 'g'), ' ?\\n\\s*', chr(10), 'g'), '^\\s+|\\s+$', '', 'g') AS text FROM pages""")
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.html_text(F.col("html")).alias("text"))


@query("""SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, replace(strip_accents(lower(concat('São ', n_name))), ' ', '_') AS slug, split_part(lower(n_name), ' ', 1) AS first_word FROM nation""")
def slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), T.slug(F.concat(F.lit("São "), F.col("n_name"))).alias("slug"), T.first_word(F.col("n_name")).alias("first_word"))


@query("""WITH t AS (SELECT p_partkey, list_filter(list_distinct(string_split(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')), ' ')), lambda x: x <> '') AS a, list_filter(list_distinct(string_split(trim(regexp_replace(lower(p_type), '[^a-z0-9]+', ' ', 'g')), ' ')), lambda x: x <> '') AS b FROM part)
SELECT p_partkey, len(list_filter(list_intersect(a, b), lambda x: x NOT IN ('steel', 'part'))) > 0 AS aligned FROM t""")
def name_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", T.names_align(F.col("p_name"), F.col("p_type"), ["steel", "part"]).alias("aligned"))


@query("""SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k, CAST(props->>'$.missing' AS VARCHAR) AS missing FROM events""")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested field access: a hit, and NULL on a miss."""
    parsed = table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long, missing string").alias("p"))
    return parsed.select("event_id", F.col("p.k").alias("k"), F.col("p.missing").alias("missing"))


@query(f"""WITH {UD_SQL} SELECT user_id, day, array_to_string(list_filter([CASE WHEN v > 80 THEN 'high' END, CASE WHEN v < 20 THEN 'low' END, CASE WHEN n > 3 THEN 'busy' END], lambda x: x IS NOT NULL), ',') AS flags FROM ud""")
def array_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = T.flags({"high": F.col("v") > 80, "low": F.col("v") < 20, "busy": F.col("n") > 3})
    return user_days(spark, sf_dir).select("user_id", "day", F.array_join(f, ",").alias("flags"))


@query("""SELECT o_orderkey, concat(isoyear(o_orderdate), '-W', lpad(CAST(weekofyear(o_orderdate) AS VARCHAR), 2, '0')) AS week FROM orders""")
def iso_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", T.iso_week(F.to_date("o_orderdate")).alias("week"))


@query("""SELECT doc_id, sha256(text) AS content_hash, CAST(length(text) AS BIGINT) AS chars FROM documents""")
def sha_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.content_hash(F.col("text")).alias("content_hash"), F.length("text").cast("long").alias("chars"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 3 THEN NULL ELSE CAST(epoch(date_trunc('second', ts)) AS BIGINT) END AS epoch FROM events""")
def flex_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One instant written as epoch seconds, ISO, RFC 822 with a wrong weekday, and as nothing valid."""
    e = table(spark, sf_dir, "events").withColumn("t", F.date_trunc("second", F.col("ts").cast("timestamp")))
    k = F.col("event_id") % 4
    hint = (
        F.when(k == 0, F.unix_timestamp("t").cast("string")).when(k == 1, F.date_format("t", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(k == 2, F.concat(F.lit("Tue, "), F.date_format("t", "dd MMM yyyy HH:mm:ss"), F.lit(" +0000"))).otherwise("not-a-date")
    )
    return e.select("event_id", F.unix_timestamp(T.flexible_timestamp(hint)).alias("epoch"))


@query(f"""WITH {LD_SQL}, c AS (SELECT flag, month(day) AS m, quantile_cont(q, 0.2) AS a, quantile_cont(q, 0.8) AS b, quantile_cont(q, 0.95) AS d FROM ld GROUP BY 1, 2)
SELECT ld.flag, ld.day, round(CASE WHEN q <= a THEN CASE WHEN a <= 0 THEN 20.0 ELSE greatest(0, 20 * q / a) END WHEN q >= d THEN least(100, 95 + 5 * least(1.0, (q - d) / greatest(d - b, 1e-9) * 0.5)) WHEN q < b THEN 20 + (q - a) * 60 / (b - a) ELSE 80 + (q - b) * 15 / (d - b) END, 4) AS pct FROM ld JOIN c ON ld.flag = c.flag AND month(ld.day) = c.m""")
def anchor_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.operators.stats import climatology

    d = flag_days(spark, sf_dir).withColumn("month", F.month("day"))
    c = climatology(d, ["flag", "month"], ["q"])
    anchors = [(20.0, F.col("q_p20")), (80.0, F.col("q_p80")), (95.0, F.col("q_p95"))]
    return d.join(c, ["flag", "month"]).select("flag", "day", F.round(K.anchor_percentile(F.col("q"), anchors), 4).alias("pct"))


@query(f"""WITH {UD_SQL}, w AS (SELECT user_id, avg(v) FILTER (day <= DATE '2024-01-15') AS a, avg(v) FILTER (day > DATE '2024-01-15') AS b, CAST(count(*) FILTER (day <= DATE '2024-01-15') AS DOUBLE) AS c, CAST(count(*) FILTER (day > DATE '2024-01-15') AS DOUBLE) AS d FROM ud GROUP BY 1)
SELECT user_id, CASE WHEN ((b - a) + (d - c)) / 2 > 3 THEN 'worsening' WHEN ((b - a) + (d - c)) / 2 < -3 THEN 'improving' ELSE 'stable' END AS outlook, round(b - a, 6) AS delta_v, d - c AS delta_n FROM w WHERE a IS NOT NULL AND b IS NOT NULL""")
def outlook_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.col("day") <= F.lit("2024-01-15").cast("date")
    halves = user_days(spark, sf_dir).groupBy("user_id").agg(
        F.avg(F.when(first, F.col("v"))).alias("a"), F.avg(F.when(~first, F.col("v"))).alias("b"), F.count_if(first).cast("double").alias("c"), F.count_if(~first).cast("double").alias("d")
    ).filter("a IS NOT NULL AND b IS NOT NULL")
    named = lambda x, y: F.create_map(F.lit("v"), F.col(x), F.lit("n"), F.col(y))
    deltas = K.percentile_deltas(named("a", "c"), named("b", "d"))
    return halves.select("user_id", K.outlook_trend(named("a", "c"), named("b", "d")).alias("outlook"), F.round(F.element_at(deltas, "v"), 6).alias("delta_v"), F.element_at(deltas, "n").alias("delta_n"))


@query("""SELECT doc_id, rtrim(CASE WHEN length(s) > 320 THEN concat(rtrim(substr(s, 1, 319)), '…') ELSE s END) AS summary FROM (SELECT doc_id, array_to_string(list_slice(regexp_split_to_array(trim(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g')), chr(1)), 1, 2), ' ') AS s FROM documents)""")
def truncate_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summaries(table(spark, sf_dir, "documents"))


def _summaries(d: DataFrame) -> DataFrame:
    return d.select("doc_id", F.rtrim(T.truncate_sentences(F.regexp_replace("text", "[.!?]\\s+$", "$0"))).alias("summary"))


@query("""SELECT page_id, regexp_extract(lower(url), '^[a-z]+://([^/?#]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path, regexp_matches(html, '(?i)nav') AS has_nav FROM pages""")
def page_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", F.regexp_extract(F.lower("url"), "^[a-z]+://([^/?#]+)", 1).alias("host"), F.regexp_extract("url", "^[a-z]+://[^/?#]+([^?#]*)", 1).alias("path"), F.col("html").rlike("(?i)nav").alias("has_nav"))


@query("""SELECT page_id, nullif(regexp_extract(html, '<title>(.*?)</title>', 1), '') AS title, CAST(len(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS BIGINT) AS links FROM pages""")
def html_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of raw pages by patterns."""
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", F.nullif(F.regexp_extract("html", "<title>(.*?)</title>", 1), F.lit("")).alias("title"), F.size(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).cast("long").alias("links"))


@query("""SELECT conv_id, CAST(count(*) AS BIGINT) AS turns, CAST(sum(length(text)) AS BIGINT) AS chars, string_agg(role, '>' ORDER BY turn) AS roles FROM conversations GROUP BY 1""")
def nested_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Child rows folded into an ordered list, and its fields joined."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", F.length("text").alias("n"))))
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(turns.alias("t"))
    return c.select("conv_id", F.size("t").cast("long").alias("turns"), F.aggregate("t", F.lit(0), lambda s, x: s + x["n"]).cast("long").alias("chars"), F.array_join(F.transform("t", lambda x: x["role"]), ">").alias("roles"))


@query("""SELECT p_partkey, CASE WHEN p_brand = 'Brand#13' THEN 0 WHEN p_brand = 'Brand#55' THEN 1 WHEN p_brand = 'Brand#21' THEN 2 ELSE 3 END::BIGINT AS priority FROM part""")
def source_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", T.source_priority(F.col("p_brand"), ["Brand#13", "Brand#55", "Brand#21"]).alias("priority"))


@query(f"""WITH {UD_SQL} SELECT user_id, day, concat(CASE WHEN m < 0 THEN '-' ELSE '+' END, CASE WHEN abs(m) >= 60 THEN concat(abs(m) // 60, 'h ', abs(m) % 60, 'm') ELSE concat(abs(m), 'm') END) AS t FROM (SELECT user_id, day, CAST(round(v * 3 - 120) AS BIGINT) AS m FROM ud)""")
def duration_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return user_days(spark, sf_dir).select("user_id", "day", K.duration_text(F.col("v") * 3 - 120, True).alias("t"))


@query("""SELECT CASE WHEN hour(ts) >= 22 OR hour(ts) < 6 THEN 'night' WHEN hour(ts) >= 9 AND hour(ts) < 17 THEN 'work' ELSE 'other' END AS band, CAST(count(*) AS BIGINT) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1""")
def time_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bands of the day, one of them over midnight."""
    h = F.hour("ts")
    band = F.when(K.in_band(h, 22, 6), "night").when(K.in_band(h, 9, 17), "work").otherwise("other")
    return table(spark, sf_dir, "events").groupBy(band.alias("band")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query("""SELECT user_id, day, click, view, (coalesce(click, 0) + coalesce(view, 0)) AS total, round(100.0 * click / nullif(coalesce(click, 0) + coalesce(view, 0), 0), 6) AS click_pct FROM (SELECT user_id, CAST(ts AS DATE) AS day, CAST(count(*) FILTER (event_type = 'click') AS BIGINT) AS click, CAST(count(*) FILTER (event_type = 'view') AS BIGINT) AS view FROM events GROUP BY 1, 2)""")
def row_percentages(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count_if(F.col("event_type") == "click").alias("click"), F.count_if(F.col("event_type") == "view").alias("view"))
    total = F.col("click") + F.col("view")
    return d.select("user_id", "day", "click", "view", total.alias("total"), F.round(K.safe_divide(100.0 * F.col("click"), F.nullif(total, F.lit(0))), 6).alias("click_pct"))


@query("""SELECT a.status AS old_status, b.status AS new_status, CAST(count(*) AS BIGINT) AS n FROM (SELECT o_orderkey, o_orderstatus AS status FROM orders) a JOIN (SELECT o_orderkey, CASE WHEN o_totalprice > 150000 THEN 'P' ELSE o_orderstatus END AS status FROM orders) b ON a.o_orderkey = b.o_orderkey WHERE a.status <> b.status GROUP BY 1, 2""")
def gate_backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old decisions against new ones: gained and lost by reason."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("old_status"), F.when(F.col("o_totalprice") > 150000, "P").otherwise(F.col("o_orderstatus")).alias("new_status"))
    return o.filter("old_status <> new_status").groupBy("old_status", "new_status").agg(F.count("*").alias("n"))


@query("""SELECT source, CAST(count(*) AS BIGINT) AS fetched, CAST(count_if(n_chars > 1000) AS BIGINT) AS passed, CASE WHEN count(*) = 0 THEN 'broken' WHEN count_if(n_chars > 1000) = 0 THEN 'quiet' ELSE 'ok' END AS health FROM documents GROUP BY 1""")
def source_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    passed = F.count_if(F.col("n_chars") > 1000)
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("fetched"), passed.alias("passed"), F.when(F.count("*") == 0, "broken").when(passed == 0, "quiet").otherwise("ok").alias("health"))


@query("""SELECT * FROM (SELECT CAST(label AS BIGINT) AS class, CAST(sum(CASE WHEN l = label THEN 1 ELSE 0 END) AS BIGINT) AS support, round(sum(CASE WHEN l = label AND p = label THEN 1.0 ELSE 0 END) / nullif(sum(CASE WHEN p = label THEN 1 ELSE 0 END), 0), 6) AS precision, round(sum(CASE WHEN l = label AND p = label THEN 1.0 ELSE 0 END) / nullif(sum(CASE WHEN l = label THEN 1 ELSE 0 END), 0), 6) AS recall FROM (SELECT toxic AS l, quality AS p FROM labels), (SELECT 0 AS label UNION ALL SELECT 1) GROUP BY 1)""")
def classification_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.operators.stats import classification_report as report

    r = report(table(spark, sf_dir, "labels").select(F.col("toxic").alias("label"), F.col("quality").alias("predicted")))
    return r.select(F.col("class").cast("long").alias("class"), F.col("support"), F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query()
def career_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of pages by how much they look like careers pages."""
    from tessera.operators.rules import career_links as links

    return links(table(spark, sf_dir, "pages"))


@query("""SELECT o_orderkey FROM orders WHERE o_totalprice % 3 >= 1.5 OR o_orderkey % 7 = 0 OR o_orderstatus = 'P'""")
def needs_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Never scored, changed since, or with a missing flag."""
    from tessera.operators.rules import needs_scoring as due

    day = F.col("o_orderdate").cast("timestamp")
    scored = F.when(F.col("o_totalprice") % 3 < 1.5, day)
    changed = F.when(F.col("o_orderkey") % 7 == 0, F.timestamp_add("DAY", F.lit(1), day)).otherwise(day)
    flag = F.when(F.col("o_orderstatus") != "P", 1)
    return table(spark, sf_dir, "orders").filter(due(scored, changed, [flag], day, day, day, None)).select("o_orderkey")
