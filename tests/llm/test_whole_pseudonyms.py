"""Pseudonyms: a card or account number is found whatever number or word follows it."""

from simsift.llm import pseudonyms

CARD, IBAN = "4111 1111 1111 1111", "BE71 0961 2345 6769"
CASES = [
    (f"pay {CARD} 04/27 now", [CARD], " 04/27 now"), ("4111111111111111 123", ["4111111111111111"], " 123"),
    (f"{IBAN} BIC GEBABEBB", [IBAN], " BIC GEBABEBB"), (f"to {IBAN} 2024.", [IBAN], " 2024."),
    (f"{CARD} 04 {IBAN} 2024 x 10.0.0.1 end", [CARD, IBAN, "10.0.0.1"], " end"),
    (f"{CARD} 12-{CARD} 13", [CARD], " 13"), (f"{CARD} 04/27, {CARD} 05/28, {CARD} 06/29", [CARD] * 3, " 06/29"),
    ("4111 1111 1111 1112 04/27", [], " 04/27"),
]


def test_numbers_before_further_text(spark):
    rows = [(i, t) for i, (t, _, _) in enumerate(CASES)] + [(90, CARD), (91, IBAN), (92, None), (93, "")]
    frame = spark.createDataFrame(rows, "doc_id int, text string")
    got = {r["doc_id"]: r for r in pseudonyms.pseudonymise(frame, "k").select("row.*", "found").collect()}
    alone = {CARD: got[90]["text"], IBAN: got[91]["text"]}
    assert got[92]["text"] is None and got[93]["text"] == ""
    for i, (text, values, end) in enumerate(CASES):
        found = [f["value"] for f in got[i]["found"]]
        assert found[: len(values)] == values and got[i]["text"].endswith(end), (text, got[i])
        want = text
        for f in got[i]["found"]:
            assert f["pseudonym"] == alone.get(f["value"], f["pseudonym"])  # linked across documents
            want = want.replace(f["value"], f["pseudonym"], 1) if values.count(f["value"]) < 2 else want
        if len(set(values)) == len(values) and len(found) == len(values):
            assert got[i]["text"] == want
