"""Texts made to collide: a Thue-Morse word and its complement share any polynomial hash modulo 2**64."""

import numpy as np
import pytest
import reference as R

from tessera.llm import kernels, ngram_join, substring_dedup, suffix_dedup


def thue_morse(n, a, b):
    return "".join(b if i.bit_count() % 2 else a for i in range(n))


def test_the_polynomial_collides_and_digests_do_not():
    raw = (thue_morse(4096, "a", "b") + " " + thue_morse(4096, "b", "a")).encode()
    data, offsets = np.frombuffer(raw, np.uint8), np.array([0, len(raw)])
    h = kernels.words(data, offsets)[0]
    d = kernels.words(data, offsets, exact=True)[0]
    assert h[0] == h[1] and d[0] != d[1]


@pytest.fixture(scope="module", params=[1024, 4096])
def crafted(spark, request):
    left, right = [f"l{i}" for i in range(30)], [f"r{i}" for i in range(30)]
    words = [thue_morse(request.param, "a", "b"), thue_morse(request.param, "b", "a")]
    rows = [(i, " ".join([*left, w, *right])) for i, w in enumerate(words)]
    other = [thue_morse(request.param, a, b) for a, b in ("cd", "dc")]
    rows += [(2 + i, " ".join([w] * 3)) for i, w in enumerate(other)]
    return spark.createDataFrame(rows, "doc_id long, text string"), rows


def test_substring(crafted):
    df, rows = crafted
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove_repeats(df).collect()}
    assert got == R.repeated_words(rows, 20)


def test_suffix(crafted):
    df, rows = crafted
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(df).collect()}
    assert got == R.repeated_bytes(rows, 200)


def test_ngram_join(crafted):
    df, rows = crafted
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(df).collect()}
    assert got == R.near_documents(rows)
    assert {r.doc_id for r in ngram_join.keep_one(df).collect()} == {i for i, (_, c) in R.near_documents(rows).items() if i == c}


def test_a_link_must_be_sure():
    """Hashes propose; what the shingles themselves say decides."""
    tokens, at, side = np.array([1, 2, 3, 1, 2, 3, 1, 2, 3]), np.array([0, 3, 6, 9]), np.full(3, -1)
    enough = lambda i, j, overlap: overlap >= 2
    assert len(ngram_join.spanning_links(tokens, at, side, enough, lambda i, j: True)) == 2
    assert ngram_join.spanning_links(tokens, at, side, enough, lambda i, j: False) == []
    assert ngram_join.spanning_links(tokens, at, side, enough, lambda i, j: 2 in (i, j)) == [(0, 2), (1, 2)]


def test_shingles():
    assert ngram_join.shingles_of(b" A b\tC d\x0be F ", 5) == {b"a b c d e", b"b c d e f"}
    assert ngram_join.shingles_of(b"A b", 5) == {b"a b"} and ngram_join.shingles_of(b" ", 5) == set()


def test_keep_one_tells_rows_apart_by_text(spark):
    """A repeated id with another text stays; rows without ids and repeated rows go but for one."""
    near = " ".join(f"w{i}" for i in range(60))
    rows = [(1, near), (2, near + " x"), (2, "quite another text of more than five words"), (None, near + " y"), (None, near + " z"), (7, "same"), (7, "same"), (None, None), (8, " ")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in ngram_join.keep_one(df).collect()), key=str)
    assert got == sorted([(1, near), (2, "quite another text of more than five words"), (7, "same"), (None, None), (8, " ")], key=str)
