from __future__ import annotations

import hashlib
import random
import time

import helpers
import pytest
from trailmark.llm import pii


def written(spans):
    return ",".join(f"{kind}:{start}:{end}" for start, _, kind, end in spans)


def base_only(text):
    return ",".join(s for s in pii.written(pii.find_spans(text)).split(",") if s.split(":")[0] in pii.BASE_KINDS)


def test_whole_table_against_the_patterns(spark):
    docs = helpers.documents(spark)
    texts = {r.doc_id: r.text for r in docs.collect()}
    found = pii.find_pii(helpers.with_clashes(docs)).collect()
    assert len(found) == len(texts)
    for row in found:
        spans = helpers.base_spans(texts[row.doc_id])
        assert row.base_sha256 == hashlib.sha256(written(spans).encode()).hexdigest()
        counts = [sum(s[2] == kind for s in spans) for kind in pii.BASE_KINDS]
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == counts


def test_random_texts_against_the_patterns():
    rng = random.Random(3)
    alphabet = ["a@b.c", "@", ".", "-", "+", "1", "25", "4111 1111 1111 1111", " ", "x.y", "é", "😀", "(", ")", "300"]
    for _ in range(4_000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 25)))
        assert base_only(text) == written(helpers.base_spans(text)), text


@pytest.mark.parametrize(
    "text, kinds",
    [
        ("pay to DE89 3704 0044 0532 0130 00 now", ["iban"]),
        ("pay to DE88 3704 0044 0532 0130 00 now", []),
        ("my ssn is 123-45-6789", ["id_number"]),
        ("part 123-45-6789", []),
        ("call 0171 555 1234 today", ["phone_local"]),
        ("see 0171 555 1234 today", []),
    ],
)
def test_added_kinds_need_a_checksum_or_a_word_nearby(text, kinds):
    assert [span.kind for span in pii.find_spans(text)] == kinds


def test_very_long_runs_of_digits():
    long = "1" * 9_000
    text = f"{long}.1.2.3 {long} +{long} 000000000000.0.00.255 {long}@{long}"
    start = text.index("0000")
    assert pii.written(pii.find_spans(text)) == f"ip:{start}:{start + 21}"


def test_words_nearby_move_the_score_but_never_drop_base_spans():
    plain = pii.find_spans("x 10.1.2.3")[0].score
    assert pii.find_spans("server 10.1.2.3")[0].score > plain > pii.find_spans("version 10.1.2.3")[0].score


def test_odd_rows(spark):
    rows = [(1, None), (1, ""), (None, "a@b.co"), (2, "a@b.co"), (2, "a@b.co"), (3, "x" * 200_000 + " a@b.co")]
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = pii.find_pii(table).collect()
    assert sorted(r.n_email for r in found) == [0, 0, 1, 1, 1, 1]
    assert [r.spans for r in found if r.doc_id == 3] == ["email:200001:200007"]
    assert pii.find_pii(table.limit(0)).count() == 0


def test_masking(spark):
    rows = [(1, "mail a@b.co or 10.0.0.1", "x", 99), (2, None, "y", None), (3, "clean", "z", 5)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, code string, n_chars bigint")
    found = {r.doc_id: tuple(r) for r in pii.mask_pii(table).collect()}
    assert found == {1: (1, "mail [EMAIL] or [IP]", "x", 20), 2: (2, None, "y", None), 3: (3, "clean", "z", 5)}


@pytest.mark.parametrize(
    "text, found",
    [
        ("IBAN DE89 3704 0044 0532 0130 00 BIC COBADEFFXXX", ["DE89 3704 0044 0532 0130 00"]),
        ("DE89370400440532013000 BIC: COBADEFFXXX", ["DE89370400440532013000"]),
        ("DE89 3704 0044 0532 0130 00 EUR 500", ["DE89 3704 0044 0532 0130 00"]),
        ("DE89 3704 0044 0532 0130 00 2024", ["DE89 3704 0044 0532 0130 00"]),
        ("REF AB12 DE89 3704 0044 0532 0130 00", ["DE89 3704 0044 0532 0130 00"]),
        ("DE89 3704 0044 0532 0130 00 GB82 WEST 1234 5698 7654 32 X", ["DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32"]),
        ("NO9386011117947 AND MORE", ["NO9386011117947"]),
        ("MT84 MALT 0110 0001 2345 MTLC AST0 01S BIC X", ["MT84 MALT 0110 0001 2345 MTLC AST0 01S"]),
        ("DE88 3704 0044 0532 0130 00 BIC COBADEFFXXX", []),
        ("DE89 3704 0044 0532 0130 00x", []),
    ],
)
def test_ibans_end_where_their_checksum_says(text, found):
    assert [text[s.start : s.end] for s in pii.find_spans(text) if s.kind == "iban"] == found


def test_an_iban_stays_beside_a_card_number_inside_it():
    codes = (f"5390075{n:05d}" for n in range(1_000))
    digits = (f"{98 - int(code + '111400') % 97:02d}{code}" for code in codes)
    text = "BE" + next(d for d in digits if pii.luhn(d))
    spans = pii.find_spans(f"to {text} EUR 500")
    assert [(s.kind, s.start, s.end) for s in spans] == [("iban", 3, 19), ("card", 5, 19)]
    assert pii.masked(f"to {text} EUR 500", spans) == "to [IBAN] EUR 500"


@pytest.mark.parametrize("text", ["7" * 1_000_000, "12." * 300_000, "1 " * 500_000, "+1(" * 300_000, "9-" * 400_000 + "x"])
def test_long_runs_take_time_in_proportion(text):
    started = time.perf_counter()
    pii.find_spans(text)
    assert time.perf_counter() - started < 20


def test_addresses_in_long_runs_of_numbers_and_points():
    rng = random.Random(12)
    for _ in range(3_000):
        text = "".join(rng.choice(["1", "25", "256", "0", ".", ".", "..", " ", "a"]) for _ in range(rng.randint(1, 40)))
        want = [(start, end) for start, _, kind, end in helpers.base_spans(text) if kind == "ip"]
        assert [(s.start, s.end) for s in pii.find_spans(text) if s.kind == "ip"] == want, text
