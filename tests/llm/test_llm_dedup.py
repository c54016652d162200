import hashlib
import random

import pytest
import reference as R
from pyspark.sql import functions as F

from tessera.llm import exact_dedup, graph, kernels, ngram_join, substring_dedup, suffix_dedup

pairs = lambda df: [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def bytes_of(df, **options):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(df, **options).drop("kept").collect()}


def words_of(df, **options):
    return {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove_repeats(df, **options).drop("kept").collect()}


def near_of(df, **options):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(df, **options).collect()}


@pytest.mark.parametrize("hot", [100_000, 2])
def test_suffix_array(documents, hot):
    assert bytes_of(documents, hot=hot) == R.repeated_bytes(pairs(documents), 200)


@pytest.mark.parametrize("options", [{}, {"hot": 3}, {"length": 60, "k": 12}])
def test_suffix_array_edges(edge, edge_rows, options):
    assert bytes_of(edge, **options) == R.repeated_bytes(edge_rows, options.get("length", 200))


def test_suffix_array_repeats_and_nothing(spark, edge, nothing):
    """A row listed twice repeats every window of 200 bytes; rows without ids are documents too."""
    twice = edge.filter("doc_id = 17").unionByName(edge.filter("doc_id = 17"))
    out = suffix_dedup.remove_repeats(twice).collect()
    assert len(out) == 2 and all(r.n_removed == r.n_bytes and r.n_spans == 1 for r in out)
    unnamed = edge.filter("doc_id in (10, 12)").withColumn("doc_id", F.lit(None).cast("long"))
    assert sum(r.n_removed for r in suffix_dedup.remove_repeats(unnamed).collect()) > 0
    assert suffix_dedup.remove_repeats(nothing).count() == 0


def test_suffix_tree_against_pairs():
    """The matcher alone, on random contexts over two letters."""
    rng = random.Random(1)
    match = suffix_dedup.interval_tree(12, 4)
    for _ in range(200):
        contexts = [bytes(rng.choice(b"ab") for _ in range(8)) + b"abab" + bytes(rng.choice(b"ab") for _ in range(8)) for _ in range(rng.randint(2, 9))]
        contexts = list(dict.fromkeys(contexts))
        got = {i: (lo, hi) for i, lo, hi in match(contexts, [8] * len(contexts), [(i, 0, 8) for i in range(len(contexts))])}
        for i, c in enumerate(contexts):
            lo = hi = 0
            for j, d in enumerate(contexts):
                if i != j:
                    left = next((k for k in range(8) if c[7 - k] != d[7 - k]), 8)
                    right = next((k for k in range(12) if c[8 + k] != d[8 + k]), 12)
                    if left + right >= 12:
                        lo, hi = max(lo, left), max(hi, right)
            assert got.get(i, (0, 0)) == (lo, hi)


@pytest.mark.parametrize("hot", [100_000, 2])
def test_substring(documents, hot):
    assert words_of(documents, hot=hot) == R.repeated_words(pairs(documents), 20)


@pytest.mark.parametrize("options", [{}, {"hot": 3}, {"length": 8, "k": 3}])
def test_substring_edges(edge, edge_rows, options):
    assert words_of(edge, **options) == R.repeated_words(edge_rows, options.get("length", 20))


def test_substring_repeats_and_nothing(edge, nothing):
    """A row listed twice is one document: its words stay in both listings."""
    twice = edge.filter("doc_id = 17").unionByName(edge.filter("doc_id = 17"))
    assert [r.n_removed for r in substring_dedup.remove_repeats(twice).collect()] == [0, 0]
    assert substring_dedup.remove_repeats(nothing).count() == 0


def test_automaton():
    rng = random.Random(2)
    for _ in range(100):
        texts = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 12))) for _ in range(4)]
        a = substring_dedup.SuffixAutomaton()
        known: set[str] = set()
        for t in texts:
            # Known from texts before, and from the text itself where it starts earlier.
            want = [max(n for n in range(e + 2) if t[e + 1 - n : e + 1] in known | {""} or t[e + 1 - n : e + 1] in t[:e]) for e in range(len(t))]
            assert a.stream(list(t)) == want
            known |= {t[i:j] for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
        assert a.stream(list(texts[0]), grow=False) == list(range(1, len(texts[0]) + 1))


def test_automaton_shards():
    """Small shards find what one automaton finds."""
    rng = random.Random(4)
    for _ in range(200):
        words = lambda n: [rng.choice("abc") for _ in range(n)]
        contexts = [" ".join([*words(5), "x", *words(5)]).encode() for _ in range(rng.randint(2, 12))]
        leads, places = [5] * len(contexts), [(i, 0, 5) for i in range(len(contexts))]

        def covered(shard):
            return {(i, p) for i, lo, hi in substring_dedup.automaton_matcher(5, shard)(contexts, leads, places) for p in range(5 - lo, 5 + hi)}

        assert covered(2) == covered(6000)


def test_automaton_passages():
    """Contexts of a document that touch are one passage, in which a window is no copy of itself."""
    words = [b"x", *(b"w%d" % i for i in range(9)), b"x", *(b"w%d" % i for i in range(9))]
    contexts, leads = [b" ".join(words[:15]), b" ".join(words[5:])], [0, 5]
    match = substring_dedup.automaton_matcher(5)
    assert match(contexts, leads, [(1, 7, 0), (1, 7, 10)]) == [(0, -10, 20)]
    assert match(contexts[:1] * 2, [0, 0], [(1, 7, 0), (2, 7, 0)]) == [(0, -10, 15), (1, 0, 15)]


def test_ngram_join(documents):
    assert near_of(documents) == R.near_documents(pairs(documents))


@pytest.mark.parametrize("options", [{}, {"group": 2, "block_tokens": 100}, {"chance": 0.0}])
def test_ngram_join_edges(edge, edge_rows, options):
    """Also with groups cut into blocks of two members or a hundred tokens, and without the filter by chance."""
    assert near_of(edge, **options) == R.near_documents(edge_rows)


def test_ngram_join_random_families(spark):
    rng = random.Random(3)
    rows, n = [], 0
    for _ in range(12):
        base = [f"w{rng.randint(0, 5000)}" for _ in range(rng.randint(3, 150))]
        for _ in range(rng.randint(1, 9)):
            w = [x if rng.random() > 0.02 else f"e{rng.randint(0, 9999)}" for x in base]
            rows.append((n, " ".join(w)))
            n += 1
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert near_of(df) == near_of(df, group=3) == R.near_documents(rows)


def test_ngram_join_keeps_one(edge, edge_rows, nothing):
    want = {i for i, (_, c) in R.near_documents(edge_rows).items() if i == c}
    kept = ngram_join.keep_one(edge)
    assert {r.doc_id for r in kept.collect()} == want and kept.columns == edge.columns
    assert ngram_join.near_duplicates(nothing).count() == 0
    assert ngram_join.keep_one(nothing).count() == 0


def test_ngram_join_without_ids(spark):
    """Texts without ids link like others: alone they have no component, with an id they take it."""
    near = " ".join(f"w{i}" for i in range(60))
    rows = [(None, near), (None, near + " x"), (None, "quite another text of more than five words"), (9, near + " y"), (9, "other text under the same id, of ten words")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in ngram_join.near_duplicates(df).collect())
    assert got == [("9", 5, "9"), ("9", 57, "9"), ("None", 4, "None"), ("None", 56, "9"), ("None", 57, "9")]


def test_least_shared_is_a_lower_tail():
    for n in (1, 5, 40, 300, 5000):
        assert 1 <= ngram_join.least_shared(n) <= ngram_join.prefix_length(n)
    assert ngram_join.least_shared(600) > 50


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(100, 160)] + [(200, i) for i in range(201, 300)] + [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(40)]
    classes = R.Classes({x for e in edges for x in e})
    for a, b in edges:
        classes.join(a, b)
    got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: classes.find(x) for e in edges if e[0] != e[1] for x in e}


def test_exact(edge, edge_rows, nothing):
    groups = {}
    for i, t in edge_rows:
        groups.setdefault(t or "", []).append(i)
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.label_duplicates(edge).collect()}
    assert got == {i: (max(g), len(g), i == max(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g}
    kept = exact_dedup.deduplicate(edge)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(map(max, groups.values())) and kept.columns == edge.columns
    assert exact_dedup.label_duplicates(nothing).count() == exact_dedup.deduplicate(nothing).count() == 0


def test_exact_ties(spark):
    """Rows that repeat id and text share the answer, and one of them stays; null ids lose to others."""
    df = spark.createDataFrame([(1, "x"), (5, "x"), (5, "x"), (None, "x"), (None, "y"), (None, "y")], "doc_id long, text string")
    got = sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept) for r in exact_dedup.label_duplicates(df).collect())
    assert got == [("1", "5", 4, False), ("5", "5", 4, True), ("5", "5", 4, True), ("None", "5", 4, False), ("None", "None", 2, True), ("None", "None", 2, True)]
    assert sorted(str(r.doc_id) for r in exact_dedup.deduplicate(df).collect()) == ["5", "None"]


def test_anchors_cover_equal_windows():
    import numpy as np

    rng = np.random.default_rng(6)
    data = rng.integers(97, 101, 3000).astype(np.uint8)
    data[2000:2300] = data[100:400]
    offsets = np.array([0, 1500, 3000])
    prefix = kernels.prefix_hash(kernels.byte_units(data))
    a = set(kernels.anchors(prefix, offsets[:-1], offsets[1:], 8, 33).tolist())
    for p in range(100, 361):
        own = {x - p for x in a if p <= x <= p + 32}
        other = {x - p - 1900 for x in a if p + 1900 <= x <= p + 1932}
        assert own & other
