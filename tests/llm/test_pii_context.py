import time

import reference as R
from pyspark.sql import functions as F

from tessera.llm import pii


def found(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [[(x.kind, x.match, x.score) for x in r.found] for r in pii.find_pii(df).orderBy("doc_id").collect()]


def test_context_decides(spark):
    """The same string stays or goes by the words within 40 characters before or after it."""
    iban, token, ssn = "DE89370400440532013000", "24be64439e3e49cf46b2d7c90f3602a3d0b907ff", "078-05-1120"
    far = " filler" * 9
    got = found(spark, [
        f"pay {iban} now", f"serial {iban} now", f"{iban} is a model", f"serial{far} {iban}", f"account of a model {iban}",
        f'token = "{token}" x', f"'{token}' is the secret", f"commit {token}", f"token{far} {token}", f"example token {token}",
        f"SSN {ssn}", f"part {ssn}", ssn,
    ])
    assert got == [
        [("iban", iban, 0.7)], [], [], [("iban", iban, 0.7)], [("iban", iban, 0.7)],
        [("secret", token, 0.6)], [("secret", token, 0.6)], [], [], [],
        [("ssn", ssn, 0.6)], [], [],
    ]


def test_context_moves_the_score_of_base_kinds(spark):
    """They stay whatever their score; a rejected match of the kind does not hide the words before it."""
    got = found(spark, ["call +49 30 1234567", "+49 30 1234567", "model +49 30 1234567", "call +1 2, +49 30 1234567"])
    assert got == [[("phone", "+49 30 1234567", s)] for s in (0.7, 0.5, 0.3, 0.7)]


def test_long_texts_take_linear_time(spark):
    """100,000 matches in one text: a copied array per match would take hours."""
    text = "a@b.cd, 1.2.3.4; " * 100_000
    began = time.time()
    spans = pii.find_pii(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().found
    assert time.time() - began < 60
    assert [(x.start, x.order, x.kind, x.end) for x in spans] == R.personal(text)


def test_running_sums(spark):
    for n in (0, 1, pii.CHUNK, pii.CHUNK + 1, 3 * pii.CHUNK + 5):
        steps = [(i * 7) % 11 for i in range(n)]
        got = spark.createDataFrame([(steps,)], "a array<int>").select(pii.running_sums(F.col("a"))).first()[0]
        assert got == [sum(steps[: i + 1]) for i in range(n)]
