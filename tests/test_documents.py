"""References between slots against a plain resolver; reports item by item."""

import json
import random

import pytest

from tessera.operators import documents


def _plain(slots, value=0, seen=()):
    if isinstance(value, int) and not isinstance(value, bool):
        return None if value in seen or not 0 <= value < len(slots) else _plain(slots, slots[value], (*seen, value))
    if isinstance(value, list):
        return [_plain(slots, v, seen) for v in value]
    if isinstance(value, dict):
        return {k: _plain(slots, v, seen) for k, v in value.items()}
    return value


def _slots(rng):
    n = rng.randint(1, 9)
    leaf = lambda: rng.choice(["x", 'q"\\ é', None, True, 1.5, "", {}, [], rng.randint(-2, n + 1), rng.randint(0, n - 1)])
    some = lambda: rng.choice([leaf(), [leaf() for _ in range(rng.randint(0, 3))], {f"k{rng.randrange(9)}": leaf() for _ in range(rng.randint(0, 3))}, [{"b": leaf(), "a": [leaf()]}]])
    return [some() for _ in range(n)]


def test_references_are_resolved(spark):
    rng = random.Random(4)
    docs = {i: _slots(rng) for i in range(150)} | {500: [[1] * 12, "w"], 501: [], 502: [{"a": 1}, {"b": 0}]}
    rows = [(i, json.dumps(d)) for i, d in docs.items()] + [(900, "broken["), (901, None), (902, '{"a":1}')]
    got = {r.i: json.loads(r.value) for r in documents.dereference(spark.createDataFrame(rows, "i long, j string"), "i", "j").collect()}
    assert got == {i: _plain(d) for i, d in docs.items()}


def test_depth_is_bounded(spark):
    chain = spark.createDataFrame([(1, json.dumps([[i + 1] for i in range(20)]))], "i long, j string")
    with pytest.raises(ValueError, match="deeper than 8"):
        documents.dereference(chain, "i", "j", max_depth=8)
    assert documents.dereference(chain.limit(0), "i", "j").count() == 0


def test_small_documents_are_one_table_without_a_shuffle(spark, monkeypatch):
    tables, stored = [], documents.stored
    monkeypatch.setattr(documents, "stored", lambda df: (tables.append(df._jdf.queryExecution().executedPlan().toString()), stored(df))[1])
    docs = {i: [{"a": 1}, [2, 2, 3], {"b": 3}, "x"] for i in range(40)}
    df = spark.range(40).selectExpr("id as i", f"'{json.dumps(docs[0])}' as j")
    assert {r.i: json.loads(r.value) for r in documents.dereference(df, "i", "j").collect()} == {i: _plain(d) for i, d in docs.items()}
    assert len(tables) == 1
    assert "Exchange" not in tables[0]


def test_large_documents_are_joined(spark):
    rng = random.Random(5)
    docs = {i: _slots(rng) for i in range(80)} | {500: [list(range(1, 60)), *[{"k": 60, "l": "t"} for _ in range(59)], "w"], 501: [[1] * 6, [2] * 6, [3] * 6, "w"]}
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in docs.items()] + [(900, "broken["), (901, None)], "i long, j string")
    got = documents.dereference(df, "i", "j", pieces=12).collect()
    assert len(got) == len(docs)
    assert {r.i: json.loads(r.value) for r in got} == {i: _plain(d) for i, d in docs.items()}


def test_both_ways_give_the_same_text(spark):
    texts = [
        "[]", "[null]", "[1.0,7]", "[[1,1e2,-0,0.10],1.0]", "[[99999999999999999999,9223372036854775807,9223372036854775808,-9223372036854775809,-1]]",
        '[{"":1,"b\\"\\n":2,"a]":2},[[],{},[[]]],{"z":{"y":[3]}},"[1]"]', '[{"a":1,"a":2},3]', '["{}"]', "[3,[0],2,1]", '[1,2,3,{"é":[0,1,4]},"1"]',
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, j string")
    rows = [{r.i: r.value for r in documents.dereference(df, "i", "j", pieces=n).collect()} for n in (0, documents.PIECES)]
    assert rows[0] == rows[1]
    assert len(rows[0]) == len(texts) - 1  # a key that comes twice is no JSON


def _depth(slots, value=0, seen=(), deep=0):
    if isinstance(value, int):
        return deep + 1 if value in seen or not 0 <= value < len(slots) else _depth(slots, slots[value], (*seen, value), deep + 1)
    inside = value if isinstance(value, list) else value.values() if isinstance(value, dict) else []
    return max([deep, *[_depth(slots, v, seen, deep + 1) for v in inside]])


@pytest.mark.parametrize(("slots", "pieces"), [([[i + 1] for i in range(4)], documents.PIECES), ([[i + 1] for i in range(4)], 0), ([[[{"a": [[1]]}]], {"b": [{}]}], documents.PIECES), ([*range(1, 9), "x"], documents.PIECES)])
def test_both_ways_end_at_the_same_depth(spark, slots, pieces):
    df = spark.createDataFrame([(1, json.dumps(slots))], "i long, j string")
    least = _depth(slots) + 2
    assert json.loads(documents.dereference(df, "i", "j", max_depth=least, pieces=pieces).first().value) == _plain(slots)
    with pytest.raises(ValueError, match=f"deeper than {least - 1}"):
        documents.dereference(df, "i", "j", max_depth=least - 1, pieces=pieces)


def test_report_items(spark):
    facts = {"insights": [{"id": "a"}], "load": {"ctl": 12}, "today_wellness": {"rhr": {"magnitude": "mild", "direction": "negative"}, "hrv_proxy_nocturnal": {"magnitude": "mild"}, "flat": 3}}
    signal = lambda field, **k: {"area": "sleep", "direction": "positive", "magnitude": "strong", "evidence_field": field} | k
    report = {
        "health_state": "green",
        "key_findings": [{"based_on": "a", "category": "sleep", "narrative": "n"}, {"based_on": "a", "category": "odd", "narrative": "n"}, "text", {"based_on": "a"}],
        "signals_today": [signal("today_wellness.rhr"), signal("today_wellness.hrv_proxy_nocturnal"), signal("today_wellness.flat")],
        "risk": [{"type": "overreach", "severity": "low", "why": "w"}, {"type": "illness", "severity": "low", "why": " "}],
        "actions_today": [
            {"theme": "maintenance", "tied_to_signal_area": "maintenance", "steps": [{"instruction": "Walk 20 min"}, {"instruction": "mobility"}]},
            {"theme": "sleep_repair", "tied_to_signal_area": "sleep", "steps": [{"instruction": "Walk 20 min"}, {"instruction": "just relax"}]},
            {"theme": "sleep_repair", "tied_to_signal_area": "cardio", "steps": []},
        ],
    }
    rows = [(1, json.dumps(report), json.dumps(facts)), (2, "no json", "{}"), (3, None, None), (4, json.dumps({"key_findings": "text", "risk": [None]}), "{}"), (5, json.dumps({"key_findings": report["key_findings"][:1]}), "bad")]
    out = documents.report_items(spark.createDataFrame(rows, "i long, r string, f string"), "i", "r", "f").collect()
    got = {(r.i, r.section, r.place): r.reason for r in out}
    assert got == {
        (1, "key_findings", 0): None, (1, "key_findings", 1): "category", (1, "key_findings", 2): "no object",
        (1, "signals_today", 0): None, (1, "signals_today", 1): "no percentile", (1, "signals_today", 2): "no evidence", (1, "risk", 0): "load", (1, "risk", 1): "why",
        (1, "actions_today", 0): None, (1, "actions_today", 1): "steps", (1, "actions_today", 2): "tied to nothing", (4, "risk", 0): "no object", (5, "key_findings", 0): "unknown insight",
    }
    assert all(r.kept == (r.reason is None) for r in out)
