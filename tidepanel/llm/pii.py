"""Personal data: patterns propose, checksums confirm, context adjusts.

Regular expressions propose spans of e-mail and IP addresses, payment cards, telephone
numbers and bank accounts (IBAN). Validators decide on them: number ranges, lengths, the
Luhn sum of cards, the remainder modulo 97 of accounts. A confirmed span starts from its
kind's score; words of the kind nearby raise it, words that speak of examples or of other
numbers lower it. Scores order and filter findings; confirmed spans are never dropped.

Matching runs in linear time on any text: each pattern can only start where a run of its
characters starts.

Defined results: a null text is empty; spans of different kinds may overlap; rows that
repeat a doc_id keep a row each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.common import pieces, texts_of

# The patterns of the task, but for starts at the start of a run alone.
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
# Characters of an account by country, of the IBAN registry.
_ACCOUNTS = (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 ES24 FI18 FO18 FR27 GB22 GE22 "
    "GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IS26 IT27 JO30 KW30 KZ20 LB28 LI21 LT20 LU20 LV21 MC27 MD24 ME22 MK19 MR27 MT31 MU30 "
    "NL18 NO15 PK24 PL28 PS29 PT25 QA29 RO24 RS22 SA24 SE24 SI19 SK24 SM27 TN24 TR26 UA29 VA22 VG24 XK20"
)
ACCOUNT_LENGTH = {x[:2]: int(x[2:]) for x in _ACCOUNTS.split()}

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban")
BASE_SCORE = {"email": 0.8, "ip": 0.5, "card": 0.7, "phone": 0.6, "iban": 0.8}
# Characters to either side in which context words are looked for.
NEARBY = 48
# Words that speak for a kind.
CONTEXT = {
    "email": ("mail", "email", "e-mail", "contact", "correo", "courriel"),
    "ip": ("ip", "address", "host", "server", "adresse", "dirección"),
    "card": ("card", "visa", "credit", "payment", "karte", "tarjeta", "carte"),
    "phone": ("phone", "call", "tel", "mobile", "fax", "telefon", "teléfono", "téléphone"),
    "iban": ("iban", "bank", "account", "konto", "cuenta", "compte"),
}
# Words that speak against personal data.
AGAINST = ("example", "sample", "version", "order", "isbn", "test")
_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def mod_97(account: str) -> bool:
    """The remainder of an account number, its first four characters put last."""
    plain = account.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            free = m.end()
        else:
            free = at + 1  # no later match can reach over this sign
        at = text.find("@", free)


def _accounts(text: str) -> Iterator[tuple[int, int]]:
    """Account numbers, which capital words and numbers may follow: of the ends of groups,
    the one at the country's length is tried first, then longer ones before shorter ones."""
    m = _IBAN.search(text)
    while m:
        ends, n = [], 0
        for at in range(m.start(), m.end()):
            n += text[at] != " "
            after = text[at + 1 : at + 2]
            if n >= 15 and text[at] != " " and not (after.isascii() and after.isalnum()):
                ends.append((n == ACCOUNT_LENGTH.get(m[0][:2]), at + 1))
        end = next((e for _, e in sorted(ends, reverse=True) if mod_97(text[m.start() : e])), None)
        if end:
            yield m.start(), end
        m = _IBAN.search(text, end or m.start() + 1)


def _digits(text: str) -> str:
    return re.sub(r"[^0-9]", "", text)


def proposals(text: str) -> Iterator[tuple[str, int, int]]:
    """Confirmed spans, kind by kind."""
    for start, end in _emails(text):
        yield "email", start, end
    for m in _IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in m.groups()):
            yield "ip", m.start(), m.end()
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(digits := _digits(m[0])) <= 19 and luhn(digits):
            yield "card", m.start(), m.end()
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                yield "phone", m.start(), m.end()
    for start, end in _accounts(text):
        yield "iban", start, end


def scored(text: str, kind: str, start: int, end: int) -> Span:
    near = text[max(0, start - NEARBY) : start] + " " + text[end : end + NEARBY]
    words = {w.lower() for w in _WORD.findall(near)}
    score = BASE_SCORE[kind] + 0.2 * bool(words & set(CONTEXT[kind])) - 0.2 * bool(words & set(AGAINST))
    return Span(kind, start, end, round(min(1.0, max(0.0, score)), 2))


def find(text: str) -> list[Span]:
    """All confirmed spans with their scores, by kind, then start."""
    return [scored(text, *p) for p in proposals(text)]


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, spans (array of kind, start, end, score), in code points."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1024):
            found = [[s._asdict() for s in find(t)] for t in texts_of(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], ["doc_id", "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(search, "doc_id long, spans array<struct<kind:string,start:long,end:long,score:double>>")


def masked(text: str) -> str:
    """The text with each finding replaced by its kind; the longer of two that overlap."""
    out, at = [], 0
    for s in sorted(find(text), key=lambda s: (s.start, -s.end)):
        if s.start >= at:
            out += [text[at : s.start], f"<{s.kind}>"]
            at = s.end
    return "".join([*out, text[at:]])


def written(spans: str):
    """kind:start:end of all spans, joined by commas."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def written_scores(spans: str):
    """Scores of all spans in the order of ``written``, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.format_number(s["score"], 2)), ",")


def sha256_of(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8")).hexdigest()
