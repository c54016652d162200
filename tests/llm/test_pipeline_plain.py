"""The pipeline, stage by stage, against plain Python on a small corpus."""

from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import reference as R
from tokenizers import Tokenizer

import corpus_pipeline
from tessera.llm import toxicity


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Clean and foul documents, exact and near copies, an empty one, two sources."""
    rng = np.random.default_rng(12)
    text = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 400, n))
    texts = [text(40 + i) for i in range(40)]
    texts += [f"{text(20)} foul vile words {text(20)}" for _ in range(20)]
    texts += texts[:5] + [" ".join([*texts[i].split()[:-1], "changed"]) for i in range(5, 10)] + [None, "", "short one"]
    rows = [(i, t, "en", "ab"[i % 2], len(t or "")) for i, t in enumerate(texts)]
    folder = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1, int(40 <= i < 60)) for i in range(60)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_stages(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    rows = lambda df: {r.doc_id: r for r in df.collect()}

    scores = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.fit(docs, spark.read.parquet(f"{corpus}/labels.parquet"))).collect()}
    clean = stages["toxicity"](spark, docs, corpus).cache()
    kept = rows(clean)
    assert kept.keys() == {i for i, s in scores.items() if s < 0.3}

    single = stages["exact_dedup"](spark, clean, corpus).cache()
    last = {}
    for i in sorted(kept):
        last[kept[i].text or ""] = i
    kept = {i: kept[i] for i in last.values()}
    assert rows(single).keys() == kept.keys()

    apart = stages["ngram_join"](spark, single, corpus).cache()
    near = R.near_documents([(i, r.text) for i, r in kept.items()])
    kept = {i: r for i, r in kept.items() if near[i][1] == i}
    assert rows(apart) == kept

    mixed = stages["mixing"](spark, apart, corpus).cache()
    copies = Counter(r.doc_id for r in mixed.collect())
    sizes, taken = defaultdict(int), defaultdict(int)
    for i, r in kept.items():
        words = len(R.WORD.findall(r.text or ""))
        sizes[r.source] += words
        taken[r.source] += words * copies[i]
    share = {"a": 5 / 7, "b": 2 / 7}
    assert set(copies.values()) <= {1, 2, 3} and copies.keys() <= kept.keys()
    assert all(abs(taken[s] - sum(sizes.values()) * share[s]) <= 60 for s in sizes)

    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    packed = stages["packing"](spark, mixed, corpus).collect()
    tokens, held = Counter(), Counter()
    for r in packed:
        tokens[r.doc_id] += r.length
        held[r.sequence_id] += r.length
    assert tokens == {i: n * (len(slow.encode(kept[i].text or "", add_special_tokens=False).ids) + 1) for i, n in copies.items()}
    assert all(n <= 2048 for n in held.values())
    again = Counter()
    for r in corpus_pipeline.run(spark, corpus).collect():
        again[r.doc_id] += r.length
    assert again == tokens


LABELS = "doc_id long, quality int, toxic int"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def _run(spark, folder, rows, labels):
    spark.createDataFrame(rows, DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{folder}/labels.parquet")
    return {r.doc_id for r in corpus_pipeline.run(spark, str(folder)).collect()}


def test_without_labels_the_corpus_stays(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(f"w{x}" for x in rng.integers(0, 5000, 30)), "en", "a", 1) for i in range(40)]
    assert len(_run(spark, tmp_path / "none", rows, [])) >= 38  # the mix rounds single documents
    huge = [(99, "w1 " * 300_000 + " " * 1_000_000 + "end", "en", "a", 1)]
    assert len(_run(spark, tmp_path / "huge", rows + huge, [(99, 1, 0)])) >= 38


def test_an_empty_corpus(spark, tmp_path):
    assert _run(spark, tmp_path, [], []) == set()
