"""Personal data (operator 1): patterns propose spans, checksums confirm, words nearby adjust.

Base kinds: ``email``, ``ip``, ``card`` (Luhn), ``phone``. Kinds the method adds: ``iban`` (mod-97),
``phone_local`` (a number without a country code) and ``id_number`` (three groups, as 123-45-6789);
the last two have no checksum and count only with a word nearby that speaks for them.
"""

from __future__ import annotations

import hashlib
import re
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from trailmark.llm.workers import map_batches, slices

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("iban", "phone_local", "id_number")
KINDS = BASE_KINDS + ADDED_KINDS
MIN_SCORE = 0.5
NEARBY = 40  # characters before a span, and half as many after it

LOCAL_PART = re.compile(r"[A-Za-z0-9._%+-]+\Z")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: A run of digits is tried from its start only: what fails there fails from inside it as well.
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN_START = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=\x20?[A-Z0-9])")
IBAN_RUN = re.compile(r"(?:\x20?[A-Z0-9]){11,30}")
IBAN_END = re.compile(r"(?<=[A-Z0-9])(?![A-Za-z0-9])")
#: Characters of an IBAN by country.
IBAN_LENGTHS = {
    country: length
    for length, countries in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK",
        21: "CH CR HR LI LV", 22: "BG BH DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
        24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR",
        27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA",
        30: "JO KW MU YE", 31: "MT SC", 33: "LC RU",
    }.items()
    for country in countries.split()
}
PHONE_LOCAL = re.compile(r"(?<![\w+.-])\(?[0-9]{2,5}\)?(?:[\x20./-][0-9]{2,5}){1,4}(?![\w.-]|-[0-9])")
ID_NUMBER = re.compile(r"(?<![\w.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])")

#: Words that speak for or against a kind, and what a span scores without them.
FOR = {
    "email": re.compile(r"(?i)\b(?:e-?mail|mail|contact|write|from|to)\b"),
    "ip": re.compile(r"(?i)\b(?:ip|host|server|address|client|login)\b"),
    "card": re.compile(r"(?i)\b(?:card|visa|mastercard|amex|credit|payment|pay|karte|tarjeta|carte)\b"),
    "phone": re.compile(r"(?i)\b(?:phone|tel|telefon|call|mobile|cell|fax|whatsapp|sms)\b"),
    "iban": re.compile(r"(?i)\b(?:iban|bank|account|konto|cuenta|compte)\b"),
    "id_number": re.compile(r"(?i)\b(?:ssn|social security|tax|identity)\b"),
}
FOR["phone_local"] = FOR["phone"]
AGAINST = {
    "ip": re.compile(r"(?i)\b(?:version|release|build|chapter|section)\b|\bv\Z"),
    "card": re.compile(r"(?i)\b(?:order|invoice|tracking|serial|isbn|id)\b"),
}
PRIOR = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.7, "iban": 0.9, "phone_local": 0.3, "id_number": 0.3}
RAISE, LOWER = 0.3, 0.3

SCHEMA = (
    "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, "
    "base_sha256 string, spans string, scores array<double>"
)


class Span(NamedTuple):
    start: int
    rank: int  # of the kind in KINDS
    end: int
    score: float

    @property
    def kind(self) -> str:
        return KINDS[self.rank]


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    text = iban.replace(" ", "")
    moved = text[4:] + text[:4]
    return 15 <= len(text) <= 34 and int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def is_octet(digits: str) -> bool:
    """At most 255, however many zeros come first and however long the run is."""
    digits = digits.lstrip("0")
    return len(digits) <= 3 and int(digits or 0) <= 255


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str):
    """Leftmost matches: each ``@`` takes what precedes it, as far as the pattern allows."""
    free, at = 0, text.find("@")
    while at >= 0:
        reach = at
        while reach > free and LOCAL_PART.match(text, reach - 1, reach):
            reach -= 1
        domain = DOMAIN.match(text, at) if reach < at else None
        if domain:
            yield reach, domain.end()
            free = domain.end()
        at = text.find("@", max(at + 1, free))


def ibans(text: str):
    """From left to right: each start takes the first end that passes, and what ends there is used up.

    Ends are where a group of characters ends. The length its country has is tried first. Without
    one that passes, a country that is known has the longest end only, any other one every end.
    """
    free = 0
    for found in IBAN_START.finditer(text):
        start = found.start()
        run = IBAN_RUN.match(text, found.end()) if start >= free else None
        if not run:
            continue
        ends = [end.start() for end in IBAN_END.finditer(text, run.start(), run.end() + 1)]
        ends = [end for end in reversed(ends) if end <= run.end()]
        length = IBAN_LENGTHS.get(text[start : start + 2])
        if length:
            usual = [end for end in ends if end - start - text.count(" ", start, end) == length]
            ends = usual + ends[:1]
        end = next((end for end in ends if mod97(text[start:end])), None)
        if end:
            yield start, end
            free = end


def proposals(text: str):
    """(kind, start, end) of all spans that match and pass their checks."""
    if "@" in text:
        yield from (("email", *span) for span in emails(text))
    for found in IP.finditer(text):
        if all(map(is_octet, found.group().split("."))):
            yield "ip", *found.span()
    for found in CARD.finditer(text):
        digits = digits_of(found.group())
        if 14 <= len(digits) <= 19 and luhn(digits):
            yield "card", *found.span()
    if "+" in text:
        for found in PHONE.finditer(text):
            if 10 <= len(digits_of(found.group())) <= 15:
                yield "phone", *found.span()
    yield from (("iban", *span) for span in ibans(text))
    for found in ID_NUMBER.finditer(text):
        yield "id_number", *found.span()
    for found in PHONE_LOCAL.finditer(text):
        if 7 <= len(digits_of(found.group())) <= 13:
            yield "phone_local", *found.span()


def score(kind: str, text: str, start: int, end: int) -> float:
    before, after = text[max(0, start - NEARBY) : start], text[end : end + NEARBY // 2]
    value = PRIOR[kind]
    if FOR[kind].search(before) or FOR[kind].search(after):
        value += RAISE
    if kind in AGAINST and AGAINST[kind].search(before):
        value -= LOWER
    return round(min(max(value, 0.0), 1.0), 6)


def find_spans(text: str | None) -> list[Span]:
    """All spans in order: base ones and IBANs whatever overlaps them, base ones whatever they score,
    the other added ones from ``MIN_SCORE`` on and only where no other span is."""
    text = text or ""
    found = [
        Span(start, KINDS.index(kind), end, score(kind, text, start, end))
        for kind, start, end in proposals(text)
    ]
    sure = (*BASE_KINDS, "iban")
    base = [span for span in found if span.kind in sure]
    if len(base) < len(found):
        taken = sorted((span.start, span.end) for span in base)
        for span in sorted(s for s in found if s.kind not in sure and s.score >= MIN_SCORE):
            if not any(start < span.end and span.start < end for start, end in taken):
                base.append(span)
                taken.append((span.start, span.end))
    return sorted(base)


def written(spans: list[Span]) -> str:
    return ",".join(f"{span.kind}:{span.start}:{span.end}" for span in spans)


def masked(text: str, spans: list[Span]) -> str:
    """``text`` with every span as ``[KIND]``; overlapping spans become one, named by the best score."""
    pieces, at, i = [], 0, 0
    while i < len(spans):
        best, end = spans[i], spans[i].end
        i += 1
        start = best.start
        while i < len(spans) and spans[i].start < end:
            end = max(end, spans[i].end)
            best = max(best, spans[i], key=lambda span: span.score)
            i += 1
        pieces += [text[at:start], f"[{best.kind.upper()}]"]
        at = end
    return "".join([*pieces, text[at:]])


def _finder(batches):
    for part in slices(batches):
        found = [find_spans(text) for text in part.column("text").to_pylist()]
        base = [[span for span in spans if span.kind in BASE_KINDS] for spans in found]
        counts = [
            pa.array([sum(span.kind == kind for span in spans) for spans in base], pa.int64())
            for kind in BASE_KINDS
        ]
        digests = [hashlib.sha256(written(spans).encode()).hexdigest() for spans in base]
        yield pa.RecordBatch.from_arrays(
            [
                part.column("doc_id"),
                *counts,
                pa.array(digests, pa.string()),
                pa.array([written(spans) for spans in found], pa.string()),
                pa.array([[span.score for span in spans] for spans in found], pa.list_(pa.float64())),
            ],
            ["doc_id", *[f"n_{kind}" for kind in BASE_KINDS], "base_sha256", "spans", "scores"],
        )


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, scores of every row of ``docs``.

    ``spans`` lists ``kind:start:end`` (code points, end exclusive) by start, then kind, and
    ``scores`` their scores in the same order; the counts and the digest are of base kinds. A null
    or empty text has no span. Repeated rows give repeated rows; other columns are not read.
    Narrow: no shuffle.
    """
    return map_batches(
        docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text"), _finder, SCHEMA
    )


def mask_pii(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced by ``[KIND]`` and ``n_chars``, where there
    is one, set to the new length. All rows and all other columns stay as they are; a null text
    stays null. Narrow: no shuffle.
    """
    names = docs.columns

    def run(batches):
        for part in slices(batches):
            texts = [
                text and masked(text, find_spans(text)) for text in part.column("text").to_pylist()
            ]
            columns = {name: part.column(i) for i, name in enumerate(names)}
            columns["text"] = pa.array(texts, pa.string())
            if "n_chars" in columns:
                columns["n_chars"] = pc.utf8_length(columns["text"]).cast(columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names)

    return map_batches(docs, run, docs.schema)
