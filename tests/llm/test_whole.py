"""Cases that the corpus operators once left out."""

import pytest

from plumbline.llm import pii, secrets

KEY, AWS = "q8ZrT2mPv9KxL4nWc7YbJ3dF", "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY"
VALUES = [f"aws_secret_access_key={AWS}", f"auth={KEY}", f"https://a.example/x?sig={KEY}&n=1", f"export KEY_OF_MINE={KEY}==", f"a=b={KEY}", f"key: {KEY}"]
WORDS = ["path=some_long_identifier_name_2", "n=1111111111111111111111a", "alphabet=abcdefghijklmnopqrstuvwxyz0123456789ABCDEF"]


@pytest.fixture(scope="module")
def values(spark):
    return spark.createDataFrame(list(enumerate(VALUES + WORDS * 10)), "doc_id long, text string")


def test_random_values_after_an_equals_sign_are_found(values):
    found = {r.doc_id: [s.text for s in r.spans] for r in secrets.find_secrets(values).collect()}
    assert [found[i] for i in range(len(VALUES))] == [[AWS], [KEY], [KEY], [KEY + "=="], [KEY], [KEY]]
    assert all(not found[i] for i in range(len(VALUES), len(found)))


def test_random_values_after_an_equals_sign_are_redacted(values):
    out = {r.doc_id: r.text for r in secrets.redact(values).collect()}
    assert out[0] == "aws_secret_access_key=[SECRET:random]" and out[2] == "https://a.example/x?sig=[SECRET:random]&n=1"
    assert [out[len(VALUES) + i] for i in range(len(WORDS))] == WORDS


def test_personal_data_beside_other_personal_data_is_found(spark):
    texts = {
        "call 555-234-5678 or 555-987-6543": ["555-234-5678", "555-987-6543"], "my ssn is 123-45-6789, born 1984-05-12": ["123-45-6789", "1984-05-12"],
        "IBAN DE89370400440532013000 or GB82WEST12345698765432": ["DE89370400440532013000", "GB82WEST12345698765432"], "HR department phone: 555-234-5678": ["555-234-5678"],
        "I prefer a call at 555-234-5678": ["555-234-5678"], "john (at) example (dot) com": ["john (at) example (dot) com"], "version 1999-01-02 of part 223-456-7890": [],
        "serial 223-456-7890, 323-456-7890": [], "IBAN-like GB83WEST12345698765432": [], "list[at]index.value": [],
    }
    out = pii.find_personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {list(texts)[r.doc_id]: [s.text for s in r.spans] for r in out} == texts
