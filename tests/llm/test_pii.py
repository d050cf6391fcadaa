"""Personal data against the plain patterns."""

import random
import re

from tests.llm.frames import docs_frame, odd_docs
from tidepanel.llm import pii


def brute(text):
    found = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        found.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            found.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c.isdigit()]
        odd = sum(digits[-1::-2]) + sum(sum(divmod(2 * d, 10)) for d in digits[-2::-2])
        if 13 <= len(digits) <= 19 and odd % 10 == 0:
            found.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            found.append(("phone", *m.span()))
    return found


def test_base_spans_equal_the_patterns():
    r = random.Random(6)
    parts = ["a", "Z", "9", "12", "255", "256", "@", ".", "..", "-", "+", "+4", " ", "(", ")", "%", "_", "é", "4111111111111111", "b@c.d", "\n"]
    for _ in range(20_000):
        text = "".join(r.choices(parts, k=r.randint(0, 18)))
        got = [s[:3] for s in pii.find(text) if s.kind in pii.BASE_KINDS]
        assert got == brute(text), text


def test_accounts_and_context():
    text = "Konto DE89 3704 0044 0532 0130 00, not DE89 3704 0044 0532 0130 01."
    assert [(s.kind, text[s.start : s.end]) for s in pii.find(text) if s.kind == "iban"] == [("iban", "DE89 3704 0044 0532 0130 00")]
    near, far = (pii.find(f"{word} 4111111111111111")[0].score for word in ("visa", "example"))
    assert near > far
    assert pii.masked("to a@b.org now") == "to <email> now"


def test_accounts_before_capital_words_and_numbers():
    plain, spaced, other = "DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "GB29 NWBK 6016 1331 9268 19"
    for text, want in (
        (f"IBAN {spaced} BIC COBADEFFXXX", [spaced]),
        (f"{plain} 150 EUR", [plain]),
        (f"{spaced} {other} {plain}", [spaced, other, plain]),
        (f"AB12 3456 7890 1234 {spaced} END", [spaced]),
        (f"{plain}X and {plain[:-1]}1 EUR", []),
    ):
        assert [text[s.start : s.end] for s in pii.find(text) if s.kind == "iban"] == want, text
    assert pii.masked(f"IBAN {spaced} BIC COBADEFFXXX") == "IBAN <iban> BIC COBADEFFXXX"


def test_long_runs_take_linear_time():
    for text in ("1" * 200_000, "a" * 200_000, "a@" * 100_000, "1." * 100_000, "+1 " * 60_000, "AB12" * 50_000):
        pii.find(text)


def test_rows(spark):
    docs = odd_docs(spark)
    got = {x.doc_id: x.spans for x in pii.personal_data(docs).collect()}
    assert pii.personal_data(docs).count() == docs.count() and got[0] == []
    assert [s.kind for s in got[12]] == ["email", "ip", "card", "phone"]
    assert pii.personal_data(docs.limit(0)).count() == 0


def test_scores_stand_in_the_order_of_the_spans(spark):
    texts = ["visa 4111 1111 1111 1111 and a@b.org", "for example 4111 1111 1111 1111", "nothing", None]
    got = pii.personal_data(docs_frame(spark, texts)).select("doc_id", pii.written("spans").alias("s"), pii.written_scores("spans").alias("v"))
    for doc_id, spans, scores in got.collect():
        found = pii.find(texts[doc_id] or "")
        assert spans == ",".join(f"{s.kind}:{s.start}:{s.end}" for s in found)
        assert scores == ",".join(f"{s.score:.2f}" for s in found)
