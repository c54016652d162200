import numpy as np
import pytest
import reference as R

from tessera.llm import kernels as K
from tessera.llm import toxicity

BITS = 12


def features(text):
    """Words, adjacent pairs and pairs that skip one or two words, hashed one by one."""
    words = [K.words(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w.encode())]), lower=True)[0] for w in R.WORD.findall(text or "")]
    hashed = [K.mix(w ^ toxicity._KINDS[0]) for w in words]
    for gap in (1, 2, 3):
        hashed += [K.mix(a * toxicity._PAIR + b * toxicity._KINDS[gap]) for a, b in zip(words, words[gap:], strict=False)]
    return sorted({int(h[0]) >> (64 - BITS) for h in hashed})


def plain_fit(rows, labels, epochs=5):
    """Dictionaries instead of arrays; rows: (id, text) in the order in which the sample is sorted."""
    learnt = [(features(t), labels[i]) for i, t in rows]
    return R.ftrl(learnt, 1 << BITS, l1=min(max(len(learnt) / 600, 1.0), 16.0), orders=[np.random.default_rng(7)] * epochs)


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(4)
    texts = []
    for i in range(120):
        words = [f"w{x}" for x in rng.integers(0, 60, 15)]
        texts.append(" ".join([*words, "Foul", "word"] if i % 3 == 0 else words))
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, "again the same id"), (500, None), (501, "")]
    labels = {i: int(i % 3 == 0) for i in range(120)}
    return rows, labels


def test_scores_equal_the_plain_version(spark, labelled):
    rows, labels = labelled
    df = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame(list(labels.items()), "doc_id long, toxic int")
    order = {r._lid: r._order for r in toxicity.labelled_sample(df, known, 16_384, 1 << 30).selectExpr("_id as _lid", "_order").collect()}
    held = lambda i: R.zlib.crc32(str(i).encode()) % 4 == 2
    assert order.keys() == {i for i in labels if not held(i)}
    sample = sorted(((order[i], i, len(features(t)), R.zlib.crc32(np.array(features(t), np.int32))), t) for i, t in rows if i in order)
    weights, bias = plain_fit([(k[1], t) for k, t in sample], labels)
    got = {}
    for r in toxicity.score(df, toxicity.fit(df, known, bits=BITS), bits=BITS).collect():
        got.setdefault(r.doc_id, []).append((r.score, r.predicted, r.held_out))
    for i, t in rows:
        total = sum(weights.get(f, 0.0) for f in features(t)) + bias
        want = 1 / (1 + np.exp(-np.clip(total, -35, 35)))
        assert any(s == pytest.approx(want, abs=1e-9) and p == (s >= 0.3) and h == held(i) for s, p, h in got[i])
    assert sum(map(len, got.values())) == len(rows)


def test_sample_is_bounded_in_bytes(spark, labelled):
    rows, labels = labelled
    df = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame(list(labels.items()), "doc_id long, toxic int")
    whole = toxicity.labelled_sample(df, known, 16_384, 1 << 30).collect()
    some = toxicity.labelled_sample(df, known, 16_384, 2000).collect()
    assert 0 < sum(len(r._text.encode()) for r in some) <= 2000 < sum(len(r._text.encode()) for r in whole)
    first = sorted({(r._order, r._id) for r in whole})[: len({r._id for r in some})]
    assert {(r._order, r._id) for r in some} == set(first)
