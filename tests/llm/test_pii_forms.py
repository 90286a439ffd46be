"""Written forms of personal numbers and dates that stand in brackets, timestamps and groups."""

import re

from kinsift.llm import pii


def test_written_forms(spark):
    texts = ["call (415-555-2671) now", "call (+49 30 1234567) now", "call (415) 555-2671", "at 2021-03-04T10:00:00Z", "to DE89 3704 0044 0532 0130 00 CODE", "to DE89370400440532013000", "to AT61 1904 3002 3457 3201 2000 EUR", "no DE88 3704 0044 0532 0130 00", "2021-03-04Tea"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in pii.pseudonymise(df, "key").collect()}
    assert [[x.kind for x in rows[i].pii] for i in range(7)] == [["phone"], ["phone"], ["phone"], ["date"], ["iban"], ["iban"], ["iban"]]
    shape = lambda s: re.sub("[0-9]", "0", s)
    assert all(shape(rows[i].text) == shape(texts[i]) and rows[i].text != texts[i] for i in range(7))
    assert rows[3].text.endswith("T10:00:00Z") and rows[6].text.endswith(" 2000 EUR")
    assert rows[4].pii[0].pseudonym.replace(" ", "") == rows[5].pii[0].pseudonym
    assert not any(x.kind == "iban" for x in rows[7].pii) and rows[8].text == texts[8]
