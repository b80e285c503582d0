from __future__ import annotations

import random
import zlib
from collections import defaultdict

import helpers
import numpy as np
import public_tokenizers
import pytest
from trailmark.llm import packing, token_counts, token_memo

BYTES = public_tokenizers.path("byte_bpe_50k.json")
WORDS = public_tokenizers.path("word_bpe_49k.json")
ALPHABET = list("aBz '1éßµ\n\t!<|.,") + ["<|endoftext|>", "<|ENDOFTEXT|>", "\u00a0", "\u3000", "😀", "'s", "  ", "σΣ", "\u0301", "\u2028"]


def random_texts(n, longest):
    rng = random.Random(1)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(1, longest))) for _ in range(n)]


def tokens(path, text):
    return token_memo.tokenizer(path).encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("chunk, overlap", [(300, 70), (700, 90)])
def test_spliced_chunks_give_the_count_of_the_whole(chunk, overlap):
    tokenizer = token_memo.tokenizer(BYTES)
    odd = ["a" * 3_000, " " * 2_000 + "x", "<|endoftext|>" * 300, "\n \n" * 700 + "é€😀 " * 200, "漢字" * 900]
    for text in odd + random_texts(60, 1_500):
        assert token_counts.count_by_chunks(tokenizer, text, chunk, overlap) == len(tokens(BYTES, text))


def test_counts_of_a_table(spark):
    docs = helpers.documents(spark)
    texts = {r.doc_id: r.text for r in docs.collect()}
    found = token_counts.count_tokens(helpers.with_clashes(docs), BYTES, chunk=5_000).collect()
    assert len(found) == len(texts)
    for row in found:
        text = texts[row.doc_id] or ""
        n = len(tokens(BYTES, text))
        assert (row.n_bytes, row.n_tokens, row.over_limit) == (len(text.encode()), n, n > 512)


def test_odd_counts(spark):
    texts = [None, "", " ", "x" * 100_000, *random_texts(300, 80)]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for row in token_counts.count_tokens(table, BYTES).collect():
        assert row.n_tokens == len(tokens(BYTES, texts[row.doc_id] or ""))
    assert token_counts.count_tokens(table.limit(0), BYTES).count() == 0


def test_pieces_have_the_ids_of_the_whole():
    texts = random_texts(3_000, 60)
    want = [np.array(tokens(WORDS, t), dtype="<u4").tobytes() for t in texts]
    assert packing.id_bytes(WORDS, texts) == want


def check_packing(found, texts, window):
    """Every id in one piece, sequences without gaps; returns the padding."""
    sequences = defaultdict(list)
    documents = defaultdict(list)
    for row in found:
        sequences[row.sequence_id].append(row)
        documents[row.doc_id].append(row)
    assert set(documents) == set(texts)
    for doc_id, pieces in documents.items():
        ids = np.array([*tokens(WORDS, texts[doc_id] or ""), 1], dtype="<u4")
        at = 0
        for piece in sorted(pieces, key=lambda p: p.start):
            assert piece.start == at and piece.length > 0 and piece.doc_tokens == len(ids)
            assert piece.ids_crc32 == zlib.crc32(ids[at : at + piece.length].tobytes())
            at += piece.length
        assert at == len(ids)
    padding = 0
    for pieces in sequences.values():
        at = 0
        for piece in sorted(pieces, key=lambda p: p.offset):
            assert piece.offset == at
            at += piece.length
        assert at <= window
        padding += window - at
    return padding


@pytest.mark.parametrize("window, max_open", [(2048, 4096), (64, 4)])
def test_packing_a_table(spark, window, max_open):
    docs = helpers.documents(spark)
    texts = {r.doc_id: r.text for r in docs.collect()}
    packed = packing.pack(helpers.with_clashes(docs), WORDS, window=window, max_open=max_open)
    padding = check_packing(packed.collect(), texts, window)
    assert padding < window * docs.rdd.getNumPartitions()


def test_odd_packing(spark):
    texts = {0: None, 1: "", 2: "a " * 10_000, 3: "b"}
    table = spark.createDataFrame([(k, v) for k, v in texts.items()], "doc_id bigint, text string").coalesce(1)
    check_packing(packing.pack(table, WORDS).collect(), texts, 2048)
    twice = packing.pack(table.unionAll(table).coalesce(1), WORDS).collect()
    assert sum(r.length for r in twice) == 2 * sum(len(tokens(WORDS, t or "")) + 1 for t in texts.values())
    assert packing.pack(table.limit(0), WORDS).count() == 0


def test_the_level_taken_keeps_the_sum_of_squares_lowest():
    rng = random.Random(4)
    packer = packing.Packer(32, 0, 10_000)
    for number in range(400):
        size = rng.randint(1, 31)
        counts = packer.counts.copy()

        def cost(level):
            after = counts.copy()
            if level:
                after[level] -= 1
            if level + size < 32:
                after[level + size] += 1
            return int((after[1:32] ** 2).sum())

        options = [0, *[level for level in range(1, 32 - size + 1) if counts[level]]]
        assert cost(packer.best_level(size)) == min(map(cost, options))
        packer.add(number, b"\0\0\0\1" * size)
