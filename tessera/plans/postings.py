"""Posting pipeline: normalise, gate, key, score, select."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.kernels import combined_score
from tessera.operators import placement as P
from tessera.sources import postings as N

from . import vendors as V
from .registry import query, table


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as postings of every vendor in turn."""
    vendors = list(V.VENDORS)
    p = table(spark, sf_dir, "part").selectExpr(*V.BASE_COLUMNS)
    payload = reduce(lambda found, i: found.when(F.col("number") % len(vendors) == i, F.expr(V.payload_sql(vendors[i]))), range(len(vendors)), F)
    vendor = F.get(F.array(*map(F.lit, vendors)), (F.col("number") % len(vendors)).cast("int"))
    return p.select(vendor.alias("vendor"), payload.alias("payload"), F.col("brand").alias("company_name"), F.lit("parts").alias("mission_category"), F.col("slug").alias("ats_slug"))


@query(V.expected_sql())
def posting_normalizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All thirty-one vendors to one shape."""
    return N.normalize_all(payloads(spark, sf_dir))


@query(f"""WITH p AS (SELECT {V.BASE} FROM part) SELECT 'greenhouse' AS source, k AS source_job_id, name AS title, page AS url, place AS location_text, size % 5 = 0 AS is_remote, kind AS description_text,
CASE WHEN size % 2 = 0 THEN '2026-08-01' ELSE '2026-07-01' END AS posted_at_hint FROM p WHERE number % 31 = 0""")
def greenhouse_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One vendor alone."""
    out = N.normalize(payloads(spark, sf_dir).filter("vendor = 'greenhouse'"), "greenhouse")
    return out.select("source", "source_job_id", "title", "url", "location_text", "is_remote", "description_text", "posted_at_hint")


_RULES = """CASE WHEN n_nationkey % 4 = 0 THEN 'Remote (EU)' WHEN n_nationkey % 4 = 1 THEN 'United States (Remote)' WHEN n_nationkey % 4 = 2 THEN n_name ELSE 'Anywhere' END"""


@query(f"""WITH p AS (SELECT CAST(n_nationkey AS BIGINT) AS n, lower({_RULES}) AS loc FROM nation),
c AS (SELECT n, loc, regexp_matches(loc, 'united states') AS us, regexp_matches(loc, 'eu|germany|france|united kingdom') AS eu, regexp_matches(loc, 'canada|india') AS other, regexp_matches(loc, 'anywhere') AS anywhere FROM p)
SELECT n, CASE WHEN anywhere THEN true WHEN eu THEN true WHEN us OR other THEN false ELSE true END AS fit FROM c""")
def hire_region_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey") % 4
    place = F.when(k == 0, "Remote (EU)").when(k == 1, "United States (Remote)").when(k == 2, F.col("n_name")).otherwise("Anywhere")
    c = P.constraints(F.lit("Engineer"), place, F.lit(""))
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("n"), P.region_fit(c, ["EU"]).alias("fit"))


@query("""WITH p AS (SELECT p_brand AS employer, p_size > 48 AS r, p_container FROM (SELECT p_brand, p_size, CASE p_partkey % 50 WHEN 0 THEN 'Paris, France' ELSE 'Austin, USA' END AS p_container FROM part))
SELECT employer, CAST(count(*) AS BIGINT) AS postings, CAST(count_if(r OR p_container LIKE '%France%') AS BIGINT) AS eu_or_remote, CASE WHEN count_if(r OR p_container LIKE '%France%') > 0 THEN 'keep' WHEN count(*) < 3 THEN 'undecided' ELSE 'demote' END AS verdict FROM p GROUP BY 1""")
def employer_footprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _footprints(table(spark, sf_dir, "part"))


def _footprints(p: DataFrame) -> DataFrame:
    p = p.select(F.col("p_brand").alias("employer"), (F.col("p_size") > 48).alias("is_remote"), F.when(F.col("p_partkey") % 50 == 0, "Paris, France").otherwise("Austin, USA").alias("location"))
    return P.footprint(p, "employer")


@query("""WITH j AS (SELECT o_orderkey, concat('K', o_orderkey) AS job_key, CAST(o_custkey AS VARCHAR) AS company_name, o_orderpriority AS title, CAST(round(0.4 * (o_orderkey % 100) + 0.35 * (o_custkey % 100) + 0.25 * (o_orderkey % 37), 6) AS DOUBLE) AS s, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 END AS ok FROM orders),
f AS (SELECT *, row_number() OVER (PARTITION BY company_name, title ORDER BY s DESC, job_key) AS rn FROM j WHERE s >= 60 AND ok = 1 AND o_orderkey % 7 <> 0)
SELECT job_key, company_name, title, s AS score FROM f WHERE rn = 1 ORDER BY s DESC, company_name, title LIMIT 30""")
def posting_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score, gates with three-valued logic, sent keys out, one per organisation and title, top n."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    score = F.round(combined_score(k % 100, F.col("o_custkey") % 100, k % 37), 6)
    ok = F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 0)
    jobs = o.select(F.concat(F.lit("K"), k).alias("job_key"), F.col("o_custkey").cast("string").alias("company_name"), F.col("o_orderpriority").alias("title"), score.alias("combined_score"), ok.alias("remote_ok"), ok.alias("region_ok"))
    sent = o.filter("o_orderkey % 7 = 0").select(F.concat(F.lit("k"), k).alias("job_key"))
    return P.digest(jobs, sent, 60.0, 30).select("job_key", "company_name", "title", F.col("combined_score").alias("score"))
