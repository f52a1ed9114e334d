"""IBANs whatever stands after them."""

from lodestrata.llm import pii

DE, GB, NO = "DE89370400440532013000", "GB82WEST12345698765432", "NO9386011117947"
SPACED = "DE89 3704 0044 0532 0130 00"
#: (text, the IBANs in it)
CASES = [
    (f"IBAN {DE} Bitte zahlen", [DE]),
    (f"{SPACED} BIC COBADEFF", [SPACED]),
    (f"{DE} 2024", [DE]),
    (f"{DE} {GB} A", [DE, GB]),
    (f"é {SPACED} {NO} X1 {GB}", [SPACED, NO, GB]),
    (f"{DE}x {DE}9 x{DE}", []),
    ("DE88370400440532013000 Bitte", []),
    (f"AB12 CD34 {DE}.", [DE]),
    (f"my iban {SPACED}", [SPACED]),
    (None, []),
]


def test_ibans_before_capitals_and_digits(spark):
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "doc_id int, text string")
    rows = pii.with_spans(docs).collect()
    got = {r.doc_id: [r.text[x.start : x.end] for x in r.pii if x.kind == "iban"] for r in rows}
    assert got == {i: want for i, (_, want) in enumerate(CASES)}
    text = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert text[0] == "IBAN [IBAN] Bitte zahlen" and text[2] == "[IBAN] 2024"
