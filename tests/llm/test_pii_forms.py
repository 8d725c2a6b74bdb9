"""Values in forms that op9_pii must not leave in clear text."""

import re

import pytest

pytest.importorskip("lattica.llm")

from lattica.llm import pii  # noqa: E402

CARD, IBAN = "4111 1111 1111 1111", "DE89 3704 0044 0532 0130 00"
CASES = [
    (f"2024 {CARD} end", "card", CARD),
    (f"7 2024-{CARD.replace(' ', '-')}", "card", CARD.replace(" ", "-")),
    ("Nr.4111111111111111", "card", "4111111111111111"),
    ("Nr_4111111111111111", "card", "4111111111111111"),
    (f"IBAN {IBAN}.", "iban", IBAN),
    (f"{IBAN} 2024 PAID", "iban", IBAN),
    ("to BE68 5390 0754 7034 IS PAID", "iban", "BE68 5390 0754 7034"),
    ("no=NO93 8601 1117 947", "iban", "NO93 8601 1117 947"),
    ("tel +33 1 23 45 67 89", "phone", "+33 1 23 45 67 89"),
    ("Tel.01.23.45.67.89", "phone", "01.23.45.67.89"),
    ("at 2021-03-04T10:00:00Z", "date", "2021-03-04"),
    ("log_2021-03-04 x", "date", "2021-03-04"),
    ("host-10.1.2.3", "ip", "10.1.2.3"),
]
LEFT = ["1.4111111111111111", "2021-03-04Tea", "1.2.3.4.5", f"2024 {CARD[:-1]}2 end", "IBAN DE88 3704 0044 0532 0130 00.", "x 12-123-45-6789", ""]


def test_values_in_all_forms(spark):
    df = spark.createDataFrame([*enumerate(t for t, _, _ in CASES), *((100 + i, t) for i, t in enumerate(LEFT)), (200, None), (300, IBAN.replace(" ", ""))], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.pseudonymise(df, "k").collect()}
    for i, (text, kind, value) in enumerate(CASES):
        ((found, new),) = got[i].pii
        assert (text, found) == (text, kind) and new != value
        assert got[i].text == text.replace(value, new) and re.sub("[A-Z]", "A", re.sub(r"\d", "0", new)) == re.sub("[A-Z]", "A", re.sub(r"\d", "0", value)) or kind == "ip"
    for i, text in enumerate(LEFT):
        assert (got[100 + i].text, got[100 + i].pii) == (text, [])
    assert got[200].text is None and got[300].text == got[4].pii[0].value.replace(" ", "")
    again = pii.pseudonymise(spark.createDataFrame([(i, r.text) for i, r in got.items()], "doc_id long, text string"), "other").collect()
    assert {r.doc_id: [p.kind for p in r.pii] for r in again} == {i: [p.kind for p in r.pii] for i, r in got.items()}
