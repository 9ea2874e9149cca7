"""What counts as personal data: check digits, notations, names of several words; where the mentions stand; very long texts."""

import re

import pytest
from pyspark.sql import functions as F

from tickspark.llm import pii_surrogates as Pii
from tickspark.llm.queries import KEY


def luhn(digits):
    d = [int(c) for c in digits][::-1]
    return (sum(d[0::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


FOUND = {
    "Dr. Maria Garcia Lopez came": "Maria Garcia Lopez", "Mr. McDonald said": "McDonald", "Mr. O'Brien, who": "O'Brien", "see MR. JOHN SMITH now": "JOHN SMITH",
    "Mrs. Anna-Lena Meyer-Schmidt": "Meyer-Schmidt", "card 4111111111111111.": "4111111111111111", "my card number: 1234567890123456!": "1234567890123456", "paid 4111-1111-1111-1111": "4111-1111-1111-1111", "old card 4222222222222 here": "4222222222222",
    "amex 378282246310005,": "378282246310005", "iban DE89370400440532013000": "DE89370400440532013000", "Maria Garcia Lopez wrote": "Garcia Lopez",
}
LEFT = ["5105105105105101 paid", "order id 1234567890123456", "no 4111111111111112 here", "ref DE00370400440532013000 ends", "serial 9999999999999", "The Mr and the Dr.", "MR X"]


@pytest.fixture(scope="module")
def out(spark):
    rows = dict(enumerate([*FOUND, *LEFT]))
    found = Pii.pseudonymise(spark.createDataFrame(list(rows.items()), "doc_id long, text string"), KEY, details=True)
    return {rows[r.doc_id]: r for r in found.collect()}


def test_entities_are_replaced(out):
    for text, entity in FOUND.items():
        r = out[text]
        assert entity not in r.text and r.n_entities == 1 == len(r.kinds), (text, r)
        before, after = text.split(entity)
        if r.kinds == ["name"]:
            assert r.text.endswith(after)
        else:
            assert r.text.startswith(before) and r.text.endswith(after)
    for text in ("card 4111111111111111.", "old card 4222222222222 here", "amex 378282246310005,"):
        assert luhn(re.sub("[^0-9]", "", out[text].text))
    assert re.search(r"MR\. [A-Z]+ [A-Z]+ now", out["see MR. JOHN SMITH now"].text)
    # capitals and small letters are one name
    assert out["Dr. Maria Garcia Lopez came"].text.split()[2:4] == out["Maria Garcia Lopez wrote"].text.split()[1:3]


def test_other_numbers_and_words_stay(out):
    for text in LEFT:
        assert out[text].text == text and out[text].n_entities == 0 and out[text].kinds == []


def test_mentions_in_a_very_long_text(spark):
    """Every mention of a text of a million characters is replaced in its place, all else stays."""
    filler = "word and word, " * 7000
    text = filler.join(["start ", "mail a.b@example.org ", "card 4111 1111 1111 1111 ", "id 1234567890123456 ", "again a.b@example.org ", "end"])
    df = spark.createDataFrame([(1, text)], "doc_id long, text string").withColumns({"text_": F.lit("a.b@example.org"), "row": F.lit("taken"), "kind": F.lit(1)})
    r = Pii.pseudonymise(df, KEY, details=True).first()
    parts = r.text.split(filler)
    assert len(parts) == 6 and parts[0] == "start " and parts[3] == "id 1234567890123456 " and parts[5] == "end"
    assert parts[1].split()[1] == parts[4].split()[1] != "a.b@example.org" and r.n_entities == 3
    assert (r.text_, r.row, r.kind) == ("a.b@example.org", "taken", 1)


def test_offsets_by_brute_force(spark, small):
    """Outside the mentions, which Python's own search finds, texts are left letter by letter."""
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    mail = re.compile(r"(?<![\w.%+-])[\w.%+-]{1,64}@[\w-]{1,63}(?:\.[\w-]{1,63}){0,6}\.[A-Za-z]{2,24}(?!\w)")
    old = {r.doc_id: r.text for r in docs.collect()}
    for r in Pii.pseudonymise(docs, KEY, details=True).collect():
        if r.kinds and set(r.kinds) == {"email"}:
            assert mail.split(r.text) == mail.split(old[r.doc_id])
        if not r.kinds:
            assert r.text == old[r.doc_id]
