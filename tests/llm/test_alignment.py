"""Alignment against the libraries on whole texts and all pairs of tokens."""

from __future__ import annotations

import bisect
import hashlib
import random
from collections import Counter, defaultdict

import helpers
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer
from trailmark.llm import alignment, queries

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ALPHABET = list("aBz '1éßµ\n\t!<|.,\0") + [
    "<|endoftext|>", "<s>", "</s>", "<unk>", "<0x41>", "▁", " ", "　", "😀", "'s", "  ", "   ", "\r\n", "́", " ",
]
ODD = [" ", "  ", "a ", "\n", "\n a", "x" * 3_000, " " * 777 + "y", "▁", "<|endoftext|>", "</s>"]


def random_texts(n, longest):
    rng = random.Random(3)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(1, longest))) for _ in range(n)]


@pytest.fixture(scope="module")
def encoders():
    tokenizer = Tokenizer.from_file(A)
    tokenizer.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=B)
    shown = {c: bytes([b]) for c, b in alignment.byte_characters().items()}
    named = [tokenizer.id_to_token(i) for i in range(tokenizer.get_vocab_size())]

    def bytes_a(number):
        return b"".join(shown[c] for c in named[number])

    def bytes_b(number):
        if pieces.is_byte(number):
            return bytes([int(pieces.id_to_piece(number)[1:-1], 16)])
        return pieces.id_to_piece(number).replace("▁", " ").encode()

    def tokens(text):
        """(id, start, end) of each side, or nothing where the bytes differ."""
        if not text:
            return [], []
        want = (" " + text).encode()
        found = []
        for ids, of in (
            (tokenizer.encode(" " + text, add_special_tokens=False).ids, bytes_a),
            (pieces.encode(text), bytes_b),
        ):
            parts = [of(i) for i in ids]
            if b"".join(parts) != want:
                return [], []
            ends = np.cumsum([len(p) for p in parts]).tolist()
            found.append(list(zip(ids, [0, *ends[:-1]], ends)))
        return tuple(found)

    return tokens


def links_of(a, b):
    if not a:
        return []
    (_, s, e), (_, t, f) = np.array(a).T[:, :, None], np.array(b).T
    return list(zip(*[x.tolist() for x in np.nonzero((s < f) & (t < e))]))


def group_text(a, b):
    cuts = sorted({e for _, _, e in a} & {e for _, _, e in b})
    groups = [([], []) for _ in cuts]
    for which, side in enumerate((a, b)):
        for number, _, end in side:
            groups[bisect.bisect_left(cuts, end)][which].append(str(number))
    return ["|".join(map(",".join, group)) for group in groups]


def plain(texts, tokens):
    """The figures of each text, by all pairs of its tokens."""
    sides = [tokens(text) for text in texts]
    links = [[(a[i][0], b[j][0]) for i, j in links_of(a, b)] for a, b in sides]
    counts = Counter(pair for own in links for pair in set(own))
    most = defaultdict(int)
    for (first, _), n in counts.items():
        most[first] = max(most[first], n)
    rows = []
    for (a, b), own in zip(sides, links):
        groups = group_text(a, b)
        best = sum(counts[pair] == most[pair[0]] for pair in own)
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""
        rows.append((len(a), len(b), len(groups), len(own), best, sum(counts[p] for p in own), digest))
    return rows


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_ids_are_those_of_the_whole_text(encoders):
    texts = random_texts(800, 300) + ODD
    a_side, b_side = alignment.side(A), alignment.side(B)
    assert b_side.splits
    for text, a, b in zip(texts, a_side.ids(texts), b_side.ids(texts)):
        want_a, want_b = encoders(text)
        if want_a:
            assert (a.tolist(), b.tolist()) == ([i for i, _, _ in want_a], [i for i, _, _ in want_b])
        else:
            assert a is None or b is None


@pytest.mark.parametrize("lane", [1, 5, 64])
def test_links_and_cuts(encoders, lane):
    texts = [*random_texts(150, 200), *ODD, None, ""]
    found = alignment.align(texts, alignment.side(A), alignment.side(B), lane)
    a, b, starts = found.sorted_links()
    groups = alignment.group_texts(found, alignment.digit_table(50_257))
    for d, text in enumerate(texts):
        own = slice(starts[d], starts[d + 1])
        got = list(zip((a[own] - found.a_from[d]).tolist(), (b[own] - found.b_from[d]).tolist()))
        sides = encoders(text)
        assert got == links_of(*sides)
        assert groups[d].decode() == ";".join(group_text(*sides))


@pytest.mark.parametrize("pair_block", [alignment.PAIR_BLOCK, 700])
def test_figures_of_a_table(spark, encoders, pair_block):
    texts = [*random_texts(60, 150), *ODD, None, "", "the cat", "the cat", "the cats"]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    figures = alignment.alignment_figures(helpers.with_clashes(table), A, B, pair_block=pair_block)
    found = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in figures.collect()}
    assert [found[i] for i in range(len(texts))] == plain(texts, encoders)


def test_query_against_all_pairs_of_tokens(spark, encoders):
    rows = helpers.documents(spark).orderBy("doc_id").collect()
    found = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in queries.op11_alignment(spark, helpers.SF_DIR).collect()}
    assert [found[r.doc_id] for r in rows] == plain([r.text for r in rows], encoders)
    assert len(found) == len(rows)


def test_aligned_documents(spark, encoders):
    texts = ["two words", None, "", "naïve café\n", "▁"]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for row in alignment.align_documents(table, A, B).collect():
        a, b = encoders(texts[row.doc_id])
        assert (row.a_ids, row.b_ids) == ([i for i, _, _ in a], [i for i, _, _ in b])
        assert [(x.a, x.b) for x in row.links] == links_of(a, b)
        cuts = [(a[x.a - 1][2], b[x.b - 1][2]) for x in row.cuts]
        assert [x for x, _ in cuts] == [y for _, y in cuts]
        assert [x for x, _ in cuts] == sorted({e for *_, e in a} & {e for *_, e in b})


def test_odd_tables(spark):
    table = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b")], "doc_id bigint, text string")
    rows = alignment.alignment_figures(table, A, B).collect()
    assert len(rows) == 3 and len({tuple(r[c] for c in COLUMNS) for r in rows}) == 1
    assert rows[0].count_sum == 3 * rows[0].n_links
    assert alignment.alignment_figures(table.limit(0), A, B).count() == 0
    assert alignment.align_documents(table.limit(0), A, B).count() == 0
