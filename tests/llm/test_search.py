"""Top-k and ranked search against all pairs."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import helpers
import numpy as np
import pytest
from trailmark.llm import bitslices, lexical, queries

VECTORS = "vec_id bigint, embedding array<double>"


def plain_top(rows, k=20, step=20, scale=64):
    """(query_id, [(score, vec_id)]) of each query row, by all pairs."""
    usable = [
        (i, v, [math.floor(scale * x) for x in e])
        for i, (v, e) in enumerate(rows)
        if e is not None and all(x is not None and math.isfinite(x) for x in e)
    ]
    found = []
    for i, v, e in usable:
        if v is None or v % step:
            continue
        scored = [
            (-sum(a * b for a, b in zip(e, f)), w is None, w or 0) for j, w, f in usable if j != i
        ]
        found.append((v, [(-s, None if nameless else w) for s, nameless, w in sorted(scored)[:k]]))
    return sorted(found, key=str)


def answers(frame):
    """The same out of the result, where each query_id is asked once."""
    by_query = {}
    for r in sorted(frame.collect(), key=lambda r: (r.query_id, r.rank)):
        by_query.setdefault(r.query_id, []).append((r.score, r.vec_id, r.rank))
    for found in by_query.values():
        assert [rank for *_, rank in found] == list(range(1, len(found) + 1))
    return sorted(((q, [f[:2] for f in found]) for q, found in by_query.items()), key=str)


@pytest.mark.parametrize("block_rows, cell_queries", [(bitslices.BLOCK_ROWS, 4_096), (100, 9), (64, 30)])
def test_top_rows_against_all_pairs(spark, block_rows, cell_queries):
    rng = random.Random(5)
    rows = [(i, [rng.choice([0.0, -0.5, 0.25, rng.gauss(0, 1)]) for _ in range(6)]) for i in range(300)]
    rows += [(300 + i, rows[i][1]) for i in range(150)]  # copies, so that scores tie
    table = spark.createDataFrame(rows, VECTORS)
    found = bitslices.top_matches(
        helpers.with_clashes(table), block_rows=block_rows, cell_queries=cell_queries
    )
    assert answers(found) == plain_top(rows)


def test_top_rows_of_odd_vectors(spark):
    rows = [
        (0, [1.0, 2.0, 3.0]), (20, None), (40, []), (60, [1.0, None, 0.0]), (80, [float("nan"), 0.0, 0.0]),
        (100, [float("inf"), 0.0, 0.0]), (120, [-1.5, 2.25]), (None, [1.0, 2.0, 3.0]), (3, [1.0, 2.0, 3.0]),
        (5, [0.0, 0.0, 0.0]), (140, [1e-9, -1e-9, 1000.0]), (7, [-0.001, -1000.0, 5.0]),
    ]
    table = spark.createDataFrame(rows, VECTORS)
    for k in (1, 2, 4, 20):
        assert answers(bitslices.top_matches(table, k=k)) == plain_top(rows, k)
    assert bitslices.top_matches(table.limit(0)).count() == 0
    assert bitslices.top_matches(table.where("vec_id = 3")).count() == 0
    alone = bitslices.top_matches(table.where("vec_id = 0"))
    assert alone.count() == 0 and alone.columns == ["query_id", "rank", "vec_id", "score"]


def test_each_row_stands_for_itself(spark):
    table = spark.createDataFrame([(0, [1.0]), (0, [2.0]), (1, [1.0])], VECTORS)
    found = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in bitslices.top_matches(table).collect())
    assert found == sorted([
        (0, 1, 0, 128 * 64), (0, 2, 1, 64 * 64), (0, 1, 0, 128 * 64), (0, 2, 1, 128 * 64),
    ])


def test_components_without_a_score_of_64_bits_are_refused(spark):
    table = spark.createDataFrame([(0, [1e300]), (1, [1.0])], VECTORS)
    with pytest.raises(Exception, match="64 bits"):
        bitslices.top_matches(table).collect()


def test_slices_add_up_to_the_products():
    rng = np.random.default_rng(2)
    matrix = rng.integers(-40, 41, (200, 17))
    matrix[:, 3] = 5
    block = bitslices.Block.of(matrix)
    for query in [*rng.integers(-70, 71, (30, 17)), np.zeros(17, np.int64)]:
        part, shift, negative = bitslices.signed_digits(query)
        value = np.zeros(17, np.int64)
        np.add.at(value, part, np.where(negative, -1, 1) << shift)
        assert value.tolist() == query.tolist()
        slices, constant = block.scores(query)
        total = np.full(200, constant)
        for weight, digit in enumerate(slices):
            bits = np.unpackbits(digit.view(np.uint8), bitorder="little")[:200]
            total += bits.astype(np.int64) << weight
        assert total.tolist() == (matrix @ query).tolist()


def plain_terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", helpers.lowered(text or ""))


def plain_ranking(docs, items, k=50):
    """(item, rank, doc_id, score), term by term."""
    terms = [(i, Counter(plain_terms(t))) for i, t in docs]
    n_docs = sum(bool(t) for _, t in terms)
    n_terms = sum(t.total() for _, t in terms)
    df = Counter(term for _, t in terms for term in t)
    wanted = {}
    for item, text in items:
        wanted.setdefault(item, set()).update(plain_terms(text))
    found = []
    for item, own in wanted.items():
        scored = []
        for doc_id, held in terms:
            score = 0
            for term in own & held.keys():
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[term] + 1)))
                m = 100 - 50 + 50 * held.total() * n_docs // n_terms
                score += w * (1_000_000_000 * held[term] // (1000 * held[term] + 20 * m))
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0))
        for rank, (score, nameless, doc_id) in enumerate(sorted(scored)[:k], 1):
            found.append((item, rank, None if nameless else doc_id, -score))
    return sorted(found, key=str)


def ranking(frame):
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in frame.collect()), key=str)


DOCS = [
    (0, "The cat, the CAT; concatenate!"), (1, None), (2, ""), (3, "... --- !"), (4, "naïve Ünï été ÉTÉ café"),
    (5, "cat"), (5, "cat"), (None, "cat"), (6, "x" * 50_000 + " cat"), (7, "a1 b2 a1\0a1　漢字 漢字"),
    (8, "the dog\nthe\tdog"), (9, "cat " * 3_000), (10, "café cat_dog"),
]
ITEMS = [
    (1, "Cat dog"), (2, None), (3, ""), (4, "?!"), (5, "ÉTÉ été naïve"), (5, "a1 漢字"), (None, "dog"), (None, "the"),
    (6, "zebra"), (7, "con catenate concatenate"), (8, "cat cat the"), (9, "漢字"),
]


@pytest.mark.parametrize("k, block_items, block_terms", [(50, 2_000, 100_000), (2, 3, 4), (1, 1, 1)])
def test_ranking_of_odd_rows(spark, k, block_items, block_terms):
    docs = helpers.with_clashes(spark.createDataFrame(DOCS, "doc_id bigint, text string"))
    items = helpers.with_clashes(spark.createDataFrame(ITEMS, "item_id bigint, text string"))
    sizes = {"block_items": block_items, "block_terms": block_terms}
    assert ranking(lexical.rank_documents(docs, items, k=k, **sizes)) == plain_ranking(DOCS, ITEMS, k)


def test_ranking_without_rows(spark):
    docs = spark.createDataFrame(DOCS, "doc_id bigint, text string")
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    assert lexical.rank_documents(docs.limit(0), items).count() == 0
    assert lexical.rank_documents(docs, items.limit(0)).count() == 0
    assert lexical.rank_documents(docs, items.where("item_id = 4")).count() == 0


def test_ranking_keeps_the_type_of_item_ids(spark):
    docs = spark.createDataFrame(DOCS, "doc_id bigint, text string")
    items = spark.createDataFrame([("x", "cat")], "item_id string, text string")
    found = lexical.rank_documents(docs, items, k=1).collect()
    assert [tuple(r) for r in found] == plain_ranking(DOCS, [("x", "cat")], 1)


def test_small_tables_of_candidates_lose_nothing(spark, monkeypatch):
    rng = np.random.default_rng(1)
    scores = rng.integers(0, 40, (7, 500))
    monkeypatch.setattr(lexical, "HELD", 10)
    best = lexical.Best(7, 5)
    ids = rng.permutation(500)
    for at in range(0, 500, 23):
        part = slice(at, at + 23)
        best.add(scores[:, part], ids[part], np.ones(len(ids[part]), dtype=bool))
    item, score, found, _ = best.cut()
    for number in range(7):
        want = sorted((-s, i) for s, i in zip(scores[number].tolist(), ids.tolist()) if s > 0)[:5]
        own = item == number
        assert [(-s, i) for s, i in zip(score[own].tolist(), found[own].tolist())] == want


def test_queries_against_all_pairs(spark):
    vectors = spark.read.parquet(f"{helpers.SF_DIR}/embeddings.parquet").select("vec_id", "embedding").collect()
    found = queries.op12_topk(spark, helpers.SF_DIR)
    assert answers(found) == plain_top([(r.vec_id, r.embedding) for r in vectors])
    docs = [(r.doc_id, r.text) for r in helpers.documents(spark).collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{helpers.SF_DIR}/benchmark.parquet").collect()]
    assert ranking(queries.op13_lexical(spark, helpers.SF_DIR)) == plain_ranking(docs, items)
