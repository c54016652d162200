"""Index-referenced documents and generated reports, built from whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import documents

from .registry import query, table


@query("""SELECT o_custkey, '{"id":"c' || o_custkey || '","orders":[' || string_agg('{"key":"' || o_orderkey || '","price":"' || o_orderpriority || '","self":null,"tags":["' || o_orderstatus || '",{}]}', ',' ORDER BY o_orderkey) || ']}' AS value
FROM orders GROUP BY 1""")
def referenced_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders of a customer, written as slots that point at each other, put together again; a slot that points back at the document is null."""
    o = table(spark, sf_dir, "orders")
    own = o.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority", "o_orderstatus"))).alias("l"))
    # Slot 0 is the document, 1 its id, 2 the list; then six slots for each order.
    first = lambda i: (i * 6 + 3).cast("string")
    at = lambda i, n: (i * 6 + 3 + n).cast("string")
    text = lambda c: F.concat(F.lit('"'), c.cast("string"), F.lit('"'))
    order = F.transform("l", lambda x, i: F.concat_ws(
        ",", F.concat(F.lit('{"key":'), at(i, 1), F.lit(',"self":0,"tags":'), at(i, 3), F.lit(',"price":'), at(i, 2), F.lit("}")), text(x["o_orderkey"]), text(x["o_orderpriority"]),
        F.concat(F.lit("["), at(i, 4), F.lit(","), at(i, 5), F.lit("]")), text(x["o_orderstatus"]), F.lit("{}"),
    ))
    slots = F.concat(F.lit('[{"id":1,"orders":2},"c'), F.col("o_custkey"), F.lit('",['), F.array_join(F.transform("l", lambda x, i: first(i)), ","), F.lit("],"), F.array_join(order, ","), F.lit("]"))
    return documents.dereference(own.select("o_custkey", slots.alias("slots")), "o_custkey", "slots")


# Reports of customers from their orders: what they claim follows status and priority, what is true follows price and balance.
_LEVEL = "CASE WHEN o_totalprice > 200000 THEN 'strong' WHEN o_totalprice > 100000 THEN 'mild' ELSE 'none' END"


@query(f"""WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i FROM orders), t AS (SELECT o.*, {_LEVEL} AS level, c_acctbal FROM o JOIN customer ON o_custkey = c_custkey),
s AS (SELECT *, CASE WHEN o_orderstatus = 'P' THEN 'area' WHEN level = 'none' AND o_orderpriority = '1-URGENT' THEN 'low confidence' WHEN level = 'none' THEN 'not elevated' END AS why FROM t WHERE i < 3),
u AS (SELECT *, sum(CASE WHEN why IS NULL AND o_orderstatus = 'O' THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ups FROM s),
w AS (SELECT o_custkey AS id, 'signals_today' AS section, i AS place, CASE WHEN why IS NULL AND o_orderstatus = 'O' AND ups >= 2 THEN 'positives' ELSE why END AS reason FROM u),
f AS (SELECT o_custkey AS id, 'key_findings' AS section, i AS place, CASE WHEN o_orderpriority = '5-LOW' THEN 'unknown insight' WHEN trim(o_clerk_or_blank) = '' THEN 'narrative' END AS reason
  FROM (SELECT *, CASE WHEN o_orderpriority = '3-MEDIUM' THEN '  ' ELSE o_orderpriority END AS o_clerk_or_blank FROM t WHERE i < 3)),
r AS (SELECT DISTINCT o_custkey AS id, 'risk' AS section, 0 AS place, CASE WHEN c_acctbal / 100 < 30 THEN 'load' END AS reason FROM t),
a AS (SELECT DISTINCT t.o_custkey AS id, 'actions_today' AS section, 0 AS place, CASE WHEN NOT EXISTS (SELECT 1 FROM w WHERE w.id = t.o_custkey AND w.reason IS NULL) THEN 'tied to nothing' WHEN c_acctbal < 0 THEN 'steps' END AS reason FROM t)
SELECT id, section, CAST(place AS INTEGER) AS place, reason IS NULL AS kept, reason FROM (SELECT * FROM w UNION ALL SELECT * FROM f UNION ALL SELECT * FROM r UNION ALL SELECT * FROM a)""")
def report_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item of a customer's report, kept or with the reason why it goes."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    own = o.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice"))).alias("l")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    level = lambda x: F.when(x["o_totalprice"] > 200000, "strong").when(x["o_totalprice"] > 100000, "mild").otherwise("none")
    some = F.col("l")
    signals = F.transform(some, lambda x, i: F.struct(
        F.when(x["o_orderstatus"] == "P", "moon").otherwise("sleep").alias("area"), F.when(x["o_orderstatus"] == "O", "positive").otherwise("negative").alias("direction"), F.lit("strong").alias("magnitude"),
        F.concat(F.lit(" today_wellness.m"), i.cast("string")).alias("evidence_field"),
    ))
    findings = F.transform(some, lambda x, i: F.struct(
        F.when(x["o_orderpriority"] == "5-LOW", "nobody").otherwise(F.concat(F.lit("i"), x["o_orderkey"].cast("string"))).alias("based_on"), F.lit("stress").alias("category"),
        F.when(x["o_orderpriority"] == "3-MEDIUM", "  ").otherwise(x["o_orderpriority"]).alias("narrative"),
    ))
    step = lambda s: F.struct(s.alias("instruction"))
    actions = F.array(F.struct(F.lit("sleep_repair").alias("theme"), F.lit("sleep").alias("tied_to_signal_area"), F.array(step(F.lit("20 min walk")), step(F.when(F.col("c_acctbal") < 0, "Take it easy at 10:00").otherwise("Box breathing")), step(F.lit("Rest"))).alias("steps")))
    risk = F.array(F.struct(F.lit("overreach").alias("type"), F.lit("low").alias("severity"), F.lit("load").alias("why")))
    report = F.to_json(F.struct(F.lit("green").alias("health_state"), signals.alias("signals_today"), findings.alias("key_findings"), risk.alias("risk"), actions.alias("actions_today")))
    measures = F.map_from_entries(F.transform(some, lambda x, i: F.struct(
        F.concat(F.lit("m"), i.cast("string")).alias("key"), F.struct(level(x).alias("magnitude"), F.when((level(x) == "none") & (x["o_orderpriority"] == "1-URGENT"), "low").otherwise("high").alias("confidence"), F.lit(3).alias("today")).alias("value"),
    )))
    insights = F.transform(some, lambda x: F.struct(F.concat(F.lit("i"), x["o_orderkey"].cast("string")).alias("id")))
    facts = F.to_json(F.struct(insights.alias("insights"), measures.alias("today_wellness"), F.struct((F.col("c_acctbal") / 100).alias("ctl")).alias("load")))
    return documents.report_items(own.select(F.col("o_custkey").alias("id"), report.alias("report"), facts.alias("facts")), "id", "report", "facts")
