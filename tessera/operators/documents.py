"""Nested documents as VARIANT values: reference decoding in rounds, and validation of generated reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.scratch import stored


def kind(v: Column) -> Column:
    """BIGINT, STRING, ARRAY, OBJECT, VOID and so on; NULL for a missing value."""
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


#: Fixed value: a document that comes apart into more pieces than this is resolved by joins.
PIECES = 65_536
#: Rounds between two looks at which documents are done.
ROUNDS = 6


def _opened(p: Column, slots: Column) -> Column:
    """The pieces that stand for one: a list or object becomes its entries between brackets, with references followed one step; anything else is final."""
    piece = lambda before, text, seen, depth: F.struct(before.alias("before"), text.alias("text"), seen.alias("seen"), depth.alias("depth"))
    final = lambda before, text: F.array(piece(before, text, F.lit(None).cast("array<long>"), p["depth"]))
    text, value = p["text"], F.try_parse_json(p["text"])
    whole = lambda t: F.when(t.rlike("^-?[0-9]{1,19}$"), t.try_cast("long"))
    start = lambda i, bracket: F.when(i == 0, F.concat(p["before"], F.lit(bracket))).otherwise(",")
    quoted = lambda key: F.regexp_extract(F.to_json(F.array(key)), r"(?s)^\[(.*)\]$", 1)

    # One struct after the other names what is used more than once, so that it is made once.
    def looked_up(entries: Column) -> Column:
        entries = F.transform(entries, lambda e: F.struct(e["lead"].alias("lead"), e["text"].alias("text"), whole(e["text"]).alias("to")))
        there = lambda e: (e["to"] >= 0) & (e["to"] < F.size(slots)) & ~F.array_contains(p["seen"], e["to"])
        return F.transform(entries, lambda e: F.struct(e["lead"].alias("lead"), e["text"].alias("text"), e["to"].alias("to"), F.when(there(e), e["to"]).alias("at")))

    def placed(before: Column, e: Column, depth: Column) -> Column:
        to, at = e["to"], e["at"]
        found = F.when(to.isNull(), e["text"]).when(at.isNull(), "null").otherwise(F.coalesce(F.get(slots, at.cast("int")), F.lit("null")))
        return piece(before, found, F.when(at.isNull(), p["seen"]).otherwise(F.array_append(p["seen"], at)), depth + F.when(to.isNull(), 0).otherwise(1))

    named = lambda v: F.coalesce(F.to_json(v), F.lit("null")).alias("text")
    texts = F.transform(F.variant_get(value, "$", "array<variant>"), lambda e: F.struct(F.lit("").alias("lead"), named(e)))
    items = F.transform(looked_up(texts), lambda e, i: placed(start(i, "["), e, p["depth"] + 1))
    entries = F.sort_array(F.transform(F.map_entries(F.variant_get(value, "$", "map<string,variant>")), lambda e: F.struct(e["key"].alias("lead"), named(e["value"]))))
    members = F.transform(looked_up(entries), lambda e, i: placed(F.concat(start(i, "{"), quoted(e["lead"]), F.lit(":")), e, p["depth"] + 1))
    alone = F.transform(looked_up(F.array(F.struct(F.lit("").alias("lead"), text.alias("text")))), lambda e: placed(p["before"], e, p["depth"]))
    return (
        F.when(text.isin("[]", "{}"), final(p["before"], text))
        .when(text.startswith("["), F.concat(items, final(F.lit(""), F.lit("]"))))
        .when(text.startswith("{"), F.concat(members, final(F.lit(""), F.lit("}"))))
        .when(whole(text).isNull(), final(p["before"], text))
        .otherwise(alone)
    )


def dereference(df: DataFrame, id_col: str, json_col: str, max_depth: int = 64, pieces: int = PIECES) -> DataFrame:
    """(id, value): index-referenced JSON as nested JSON text.

    A document is an array of slots; every whole number in it stands for the slot of that
    index, and the document is what slot 0 becomes. An index that is not there, or that is
    being resolved already (a cycle), is null. A document is a list of pieces of text, and
    each round puts in place of its references and containers what they hold; rows need no
    shuffle. Documents of more than `pieces` pieces are resolved by joins of all their
    references, so that no row grows with them. Beyond `max_depth` steps, each a reference
    or a container, it raises. Ids are unique; documents that are no JSON array have no row.
    """
    slots = F.transform(F.try_variant_get(F.try_parse_json(json_col), "$", "array<variant>"), lambda v: F.to_json(v))
    first = F.array(F.struct(F.lit("").alias("before"), F.lit("0").alias("text"), F.array().cast("array<long>").alias("seen"), F.lit(0).alias("depth")))
    front = df.select(F.col(id_col), F.col(json_col).alias("_json"), slots.alias("_slots")).withColumn("_parts", F.when(F.col("_slots").isNotNull(), first))
    more, fits, deep = F.exists("_parts", lambda p: p["seen"].isNotNull()), F.size("_parts") <= pieces, F.exists("_parts", lambda p: p["depth"] >= max_depth - 1)
    opened = F.flatten(F.transform("_parts", lambda p: F.when(p["seen"].isNull(), F.array(p)).otherwise(_opened(p, F.col("_slots")))))
    text = F.array_join(F.transform("_parts", lambda p: F.concat(p["before"], p["text"])), "")
    done, rest = [], []
    while True:
        for _ in range(ROUNDS):
            front = front.withColumn("_parts", F.when(fits, opened).otherwise(F.col("_parts")))
        front = front.withColumn("_more", more)  # null for what is no array; filters come after the table, since they would be inlined round by round
        kept = [F.when(F.col("_more"), F.col(c)).alias(c) for c in ("_json", "_slots", "_parts")]
        front = stored(front.select(id_col, "_more", fits.alias("_fits"), deep.alias("_deep"), F.when(~F.col("_more"), text).alias("value"), *kept))
        if front.filter("_deep").limit(1).count():
            raise ValueError(f"references nest deeper than {max_depth}")
        done.append(front.filter("not _more").select(id_col, "value"))
        rest.append(front.filter("_more and not _fits").select(id_col, "_json"))
        front = front.filter("_more and _fits").select(id_col, "_json", "_slots", "_parts")
        if not front.limit(1).count():
            break
    value, large = reduce(DataFrame.unionByName, done), reduce(DataFrame.unionByName, rest)
    return value.unionByName(_joined(large, id_col, "_json", max_depth)) if large.limit(1).count() else value


def _joined(df: DataFrame, id_col: str, json_col: str, max_depth: int) -> DataFrame:
    """`dereference` of large documents: each round joins the references of all documents with their slots and opens
    what they found; then values are put together from the deepest places up, in their order."""
    parsed = df.select(F.col(id_col).alias("_id"), F.try_variant_get(F.try_parse_json(json_col), "$", "array<variant>").alias("_slots")).filter("_slots is not null")
    slots = stored(parsed.select("_id", F.posexplode("_slots").alias("_slot", "_v")).withColumn("_v", F.to_json("_v")))  # text: the form that files keep
    value = F.try_parse_json("_text")
    start = parsed.select("_id", F.lit("0").alias("_path"), F.lit("").alias("_parent"), F.lit("").alias("_key"), F.lit("0").alias("_text"), F.array().cast("array<long>").alias("_seen"))
    nodes, front = [], stored(start.withColumn("_kind", kind(value)))
    for _ in range(max_depth):
        if front.limit(1).count() == 0:
            break
        place = ["_id", "_path", "_parent", "_key"]
        nodes.append(front.filter("_kind <> 'BIGINT' or _kind is null").select(*place, "_kind", F.coalesce("_text", F.lit("null")).alias("_text")))
        refs = front.filter("_kind = 'BIGINT'").withColumn("_to", F.col("_text").cast("long"))
        found = refs.join(slots, (refs["_id"] == slots["_id"]) & (F.col("_to") == F.col("_slot")) & ~F.array_contains("_seen", F.col("_to")), "left")
        found = found.select(*[refs[c] for c in place], F.col("_v").alias("_text"), F.array_append("_seen", F.col("_to")).alias("_seen"))
        inside = lambda entry, key: [F.col("_id"), F.format_string("%s/%08d", "_path", F.col("_i")).alias("_path"), F.col("_path").alias("_parent"), key.alias("_key"), F.to_json(entry).alias("_text"), F.col("_seen")]
        lists = front.filter("_kind = 'ARRAY'").select("*", F.posexplode(F.variant_get(value, "$", "array<variant>")).alias("_i", "_e")).select(*inside(F.col("_e"), F.lit("")))
        entries = F.array_sort(F.transform(F.map_entries(F.variant_get(value, "$", "map<string,variant>")), lambda e: F.struct(e["key"].alias("key"), F.to_json(e["value"]).alias("text"))))
        objects = front.filter("_kind = 'OBJECT'").select("*", F.posexplode(entries).alias("_i", "_e")).select(*inside(F.try_parse_json("_e.text"), F.col("_e.key")))
        front = stored(found.unionByName(lists).unionByName(objects).withColumn("_kind", kind(value)))
    else:
        raise ValueError(f"references nest deeper than {max_depth}")
    if not nodes:
        return parsed.select(F.col("_id").alias(id_col), F.lit("").alias("value")).limit(0)
    tree = stored(reduce(DataFrame.unionByName, nodes).withColumn("_level", F.size(F.split("_path", "/"))))
    quoted = F.expr("substring(to_json(array(_key)), 2, length(to_json(array(_key))) - 2)")
    low = tree.agg(F.max("_level")).first()[0]
    done: DataFrame | None = None
    for level in range(low, 0, -1):
        own = tree.filter(F.col("_level") == level)
        if done is None:
            own = own.withColumn("_in", F.lit(None).cast("array<struct<p:string,k:string,t:string>>"))
        else:
            held = done.groupBy(F.col("_id").alias("_i"), F.col("_parent").alias("_p")).agg(F.array_sort(F.collect_list(F.struct(F.col("_path").alias("p"), quoted.alias("k"), F.col("_done").alias("t")))).alias("_in"))
            own = own.join(held, (F.col("_id") == F.col("_i")) & (F.col("_path") == F.col("_p")), "left")
        parts = lambda f: F.coalesce(F.array_join(F.transform("_in", f), ","), F.lit(""))
        text = F.when(F.col("_kind") == "OBJECT", F.concat(F.lit("{"), parts(lambda x: F.concat(x["k"], F.lit(":"), x["t"])), F.lit("}"))).when(F.col("_kind") == "ARRAY", F.concat(F.lit("["), parts(lambda x: x["t"]), F.lit("]")))
        done = stored(own.select("_id", "_path", "_parent", "_key", F.coalesce(text, "_text").alias("_done")))
    return done.select(F.col("_id").alias(id_col), F.col("_done").alias("value"))


# --- generated reports ---------------------------------------------------------------------------------

#: The vocabulary of reports.
CATEGORIES = ("sleep", "stress", "recovery", "circadian", "training_response", "illness_watch", "cognitive", "positive")
AREAS = ("sleep", "stress", "cardio", "hrv", "respiration", "recovery", "energy")
DIRECTIONS = ("positive", "negative", "neutral")
MAGNITUDES = ("mild", "significant", "strong")
RISKS = ("illness", "overreach", "sleep_debt", "stress_overload")
SEVERITIES = ("low", "moderate", "elevated")
THEMES = ("sleep_repair", "stress_reset", "parasympathetic_morning", "illness_defense", "recovery_movement", "maintenance")
TECHNIQUES = ("4-7-8", "coherent", "box breathing", "physiological sigh", "daylight walk", "mobility", "electrolyte")
FORBIDDEN = ("stay hydrated", "manage stress", "listen to your body", "get enough sleep", "rest is important", "take it easy", "self-care", "self care", "use sleep tracking", "track sleep quality", "track sleep")
#: How many items of a section are looked at, signals that may be positive, the load below which nobody overreaches.
LIMITS = {"key_findings": 3, "signals_today": 3, "risk": 2, "actions_today": 3}
POSITIVE_SIGNALS, LOAD_FLOOR = 2, 30


def _text(v: Column, path: str) -> Column:
    """A string member; NULL if it is missing or of another type."""
    return F.when(kind(F.try_variant_get(v, path, "variant")) == "STRING", F.try_variant_get(v, path, "string"))


def _first(rules: list[tuple[str, Column]]) -> Column:
    """The name of the first condition that is not true, or NULL."""
    out = F.lit(None).cast("string")
    for name, good in reversed(rules):
        out = F.when(F.coalesce(good, F.lit(False)), out).otherwise(F.lit(name))
    return out


def _specific(step: Column) -> Column:
    """An instruction that names a number or a technique, and no commonplace."""
    low = F.lower(step)
    holds = lambda words: reduce(lambda a, b: a | b, [low.contains(w) for w in words])
    return (F.trim(step) != "") & ~holds(FORBIDDEN) & (step.rlike("[0-9]") | holds(TECHNIQUES))


def report_items(df: DataFrame, id_col: str, report_col: str, facts_col: str) -> DataFrame:
    """(id, section, place, kept, reason) of each item of a report, held against the facts of its day.

    Both are JSON text. Types, vocabulary and evidence are checked: a finding names an insight
    of the facts, a signal a measure that is elevated and not of low confidence (two may be
    positive), an overreach needs load, an action is tied to a kept signal or finding and has two
    specific steps. What cannot be read has no items; reasons name the first check that fails.
    """
    v = df.select(F.col(id_col).alias("_id"), F.try_parse_json(report_col).alias("_r"), F.try_parse_json(facts_col).alias("_f"))
    listed = lambda s, n: F.slice(F.coalesce(F.try_variant_get("_r", f"$.{s}", "array<variant>"), F.array().cast("array<variant>")), 1, n)
    tagged = lambda s: lambda x, i: F.struct(F.lit(s).alias("section"), i.alias("place"), x.alias("item"))
    sections = [F.transform(listed(s, n), tagged(s)) for s, n in LIMITS.items()]
    ids = F.transform(F.try_variant_get("_f", "$.insights", "array<variant>"), lambda i: _text(i, "$.id"))
    today = F.try_variant_get("_f", "$.today_wellness", "map<string,variant>")
    load = F.coalesce(F.try_variant_get("_f", "$.load.ctl", "double"), F.lit(0.0))
    state = _text(F.col("_r"), "$.health_state")
    rows = v.select("_id", ids.alias("_ids"), today.alias("_today"), load.alias("_load"), state.alias("_state"), F.explode(F.concat(*sections)).alias("_s")).select("*", "_s.*")
    x = F.col("item")
    t = lambda name: _text(x, f"$.{name}")
    field = F.trim(t("evidence_field"))
    measure = F.when(field.rlike(r"^today_wellness\.[a-z_0-9]+$"), F.try_element_at("_today", F.substring(field, 16, 200)))
    rows = rows.withColumn("_m", measure)
    m = lambda name: _text(F.col("_m"), f"$.{name}")
    hrv = ~field.endswith("hrv_proxy_nocturnal") | F.coalesce(F.try_variant_get("_m", "$.percentile_30d", "double").isNotNull(), F.lit(False))
    findings = _first([("no object", kind(x) == "OBJECT"), ("unknown insight", F.array_contains("_ids", t("based_on"))), ("category", t("category").isin(*CATEGORIES)), ("narrative", F.trim(t("narrative")) != "")])
    signals = _first(
        [("no object", kind(x) == "OBJECT"), ("area", t("area").isin(*AREAS)), ("direction", t("direction").isin(*DIRECTIONS)), ("magnitude", t("magnitude").isin(*MAGNITUDES)), ("evidence field", field.rlike(r"^today_wellness\.[a-z_0-9]+$")),
         ("no evidence", kind(F.col("_m")) == "OBJECT"), ("low confidence", F.coalesce(m("confidence"), F.lit("")) != "low"), ("not elevated", m("magnitude").isin(*MAGNITUDES)), ("no percentile", hrv)]
    )
    risks = _first([("no object", kind(x) == "OBJECT"), ("type", t("type").isin(*RISKS)), ("load", (t("type") != "overreach") | (F.col("_load") >= LOAD_FLOOR)), ("severity", t("severity").isin(*SEVERITIES)), ("why", F.trim(t("why")) != "")])
    direction = F.when(m("direction").isin(*DIRECTIONS), m("direction")).otherwise(t("direction"))
    reason = F.when(F.col("section") == "key_findings", findings).when(F.col("section") == "signals_today", signals).when(F.col("section") == "risk", risks)
    rows = rows.withColumns({"_why": reason, "_up": direction == "positive"})
    # Items of one report: at most eleven rows a window.
    own = Window.partitionBy("_id")
    good = F.col("_why").isNull() & (F.col("section") == "signals_today") & F.coalesce("_up", F.lit(False))
    before = F.sum(good.cast("int")).over(own.orderBy("section", "place").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_why", F.when(good & (F.coalesce(before, F.lit(0)) >= POSITIVE_SIGNALS), "positives").otherwise(F.col("_why")))
    kept = F.col("_why").isNull()
    ties = F.collect_set(F.when(kept & (F.col("section") == "signals_today"), t("area")).when(kept & (F.col("section") == "key_findings"), t("category"))).over(own)
    rows = rows.withColumn("_ties", ties)
    tied = t("tied_to_signal_area")
    fits = F.when(tied == "maintenance", (t("theme") == "maintenance") & (F.col("_state") == "green")).otherwise(F.array_contains("_ties", tied))
    steps = F.filter(F.slice(F.coalesce(F.try_variant_get(x, "$.steps", "array<variant>"), F.array().cast("array<variant>")), 1, 5), lambda s: F.coalesce(_specific(_text(s, "$.instruction")), F.lit(False)))
    actions = _first([("no object", kind(x) == "OBJECT"), ("theme", t("theme").isin(*THEMES)), ("tied to nothing", fits), ("steps", F.size(steps) >= 2)])
    why = F.when(F.col("section") == "actions_today", actions).otherwise(F.col("_why"))
    return rows.select(F.col("_id").alias(id_col), "section", "place", why.isNull().alias("kept"), why.alias("reason"))
