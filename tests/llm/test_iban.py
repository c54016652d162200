import pytest

from tessera.llm import pii

#: Published examples of 24, 22, 18, 15, 27 and 20 characters.
IBANS = ["ES91 2100 0418 4502 0005 1332", "DE89 3704 0044 0532 0130 00", "NL91 ABNA 0417 1643 00", "NO93 8601 1117 947", "FR14 2004 1010 0505 0001 3M02 606", "AT61 1904 3002 3457 3201"]


@pytest.mark.parametrize("after", ["", " CALL", " 2024", " CALL 2024 NOW", ", x", " A", " 12"])
def test_iban_ends_at_its_own_length(spark, after):
    rows = [(i, f"pay {b}{after}") for i, b in enumerate(x for iban in IBANS for x in (iban, iban.replace(" ", "")))]
    found = {r.doc_id: [x.match for x in r.found if x.kind == "iban"] for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {i: [t[4 : len(t) - len(after)]] for i, t in rows}


def test_iban_of_wrong_length_or_sum(spark):
    rows = [(1, "DE89 3704 0044 0532 0130 01"), (2, "DE89 3704 0044 0532 0130"), (3, "DE89370400440532013000CALL"), (4, "xDE89370400440532013000")]
    assert not any(x.kind == "iban" for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect() for x in r.found)
