from __future__ import annotations

import math
import random

import helpers
import numpy as np
import pytest
from trailmark.llm import embeddings, local_links, simhash
from trailmark.llm.components import connected_components


def test_fingerprints_and_components_of_a_table(spark):
    docs = helpers.documents(spark)
    texts = {r.doc_id: r.text for r in docs.collect()}
    ids = sorted(texts)
    codes = [helpers.fingerprint(texts[i]) for i in ids]
    roots = helpers.components(len(ids), lambda i, j: (codes[i] ^ codes[j]).bit_count() <= 4)
    found = {r.doc_id: r for r in simhash.near_duplicates(helpers.with_clashes(docs)).collect()}
    assert len(found) == len(ids)
    for i, doc_id in enumerate(ids):
        assert found[doc_id].fingerprint == f"{codes[i]:016x}"
        assert found[doc_id].component_id == ids[roots[i]]
    kept = simhash.keep_first(helpers.with_clashes(docs))
    assert {r.doc_id for r in kept.collect()} == {ids[r] for r in roots}


def random_codes():
    rng = np.random.default_rng(0)
    found = set(rng.integers(0, 2**64, 120, dtype=np.uint64).tolist())
    for code in sorted(found)[:20]:
        for _ in range(15):
            changed = code
            for bit in rng.choice(64, size=rng.integers(1, 6), replace=False):
                changed ^= 1 << int(bit)
            found.add(changed)
    centre = min(found)
    for _ in range(200):  # one group that shares nearly all bits
        changed = centre
        for bit in rng.choice(64, size=3, replace=False):
            changed ^= 1 << int(bit)
        found.add(changed)
    return np.array(sorted(found), dtype=np.uint64)


@pytest.mark.parametrize("cell_limit", [2048, 60, 8])
def test_no_link_is_lost_in_cells_of_any_size(spark, cell_limit):
    codes = random_codes()
    want = helpers.components(len(codes), lambda i, j: int(codes[i] ^ codes[j]).bit_count() <= 4)
    table = spark.createDataFrame([(int(c),) for c in codes.view(np.int64)], "code bigint")
    place = {int(c): i for i, c in enumerate(codes.view(np.int64))}
    edges = [(place[r.a], place[r.b]) for r in simhash.links(table, cell_limit=cell_limit).collect()]
    labels = np.arange(len(codes))
    if edges:
        labels = local_links.merge(labels, *(np.array(side) for side in zip(*edges)))
    assert labels.tolist() == want


def test_close_pairs_are_all_close_pairs():
    codes = random_codes()
    want = {(i, j) for j in range(len(codes)) for i in range(j) if int(codes[i] ^ codes[j]).bit_count() <= 4}
    found = {(int(a), int(b)) for i, j in simhash.close_pairs(codes) for a, b in zip(i, j)}
    assert found == want


def long_codes():
    """Codes of 128 bits in groups of one to a thousand, with clusters and loners, and their groups."""
    rng = np.random.default_rng(5)
    codes, group = [], []
    for number, size in enumerate([1, 2, 3, 31, 33, 1, 400, 1_000, 2, 1]):
        centres = rng.integers(0, 2**64, (2, max(1, size // 70)), dtype=np.uint64)
        for _ in range(size):
            code = centres[:, rng.integers(centres.shape[1])].copy()
            for bit in rng.choice(128, size=rng.integers(0, 25), replace=False):
                code[bit // 64] ^= np.uint64(1 << int(bit % 64))
            codes.append(code)
            group.append(number)
    return np.array(codes).T.copy(), np.array(group)


def gray_rank(code: np.ndarray) -> int:
    """From the top bit down, each the sum of all code bits so far."""
    number, rank = int(code[0]) << 64 | int(code[1]), 0
    for bit in reversed(range(128)):
        rank = rank << 1 | ((number >> bit).bit_count() & 1)
    return rank


def test_close_pairs_of_long_codes_in_many_groups(monkeypatch):
    codes, group = long_codes()
    order = sorted(range(len(group)), key=lambda i: (group[i], gray_rank(codes[:, i])))
    codes, group = codes[:, order].copy(), group[order]
    differing = np.bitwise_count(codes[:, :, None] ^ codes[:, None, :]).sum(axis=0, dtype=int)
    together = group[:, None] == group[None, :]
    for max_bits in (0, 8, 32, 128):
        want = np.argwhere(np.triu(together & (differing <= max_bits), 1))
        found = [(int(a), int(b)) for i, j in simhash.close_pairs(codes, max_bits, group) for a, b in zip(i, j)]
        assert sorted(found) == [tuple(pair) for pair in want.tolist()]
    # The index leaves pairs of groups out: of separate tight clusters only those of one are compared.
    rng = np.random.default_rng(6)
    tight = np.repeat(rng.integers(0, 2**64, (2, 16), dtype=np.uint64), 64, axis=1)
    tight[1] ^= np.uint64(1) << rng.integers(0, 64, 1_024, dtype=np.uint64)
    ranks = [gray_rank(tight[:, i]) for i in range(1_024)]
    tight = tight[:, np.argsort(np.array(ranks, dtype=object), kind="stable")].copy()
    compared, plain = [], simhash._expand
    monkeypatch.setattr(simhash, "_expand", lambda *of: (compared.append(len(x[0])) or x for x in plain(*of)))
    linked = sum(len(i) for i, _ in simhash.close_pairs(tight, 32))
    assert linked == 16 * 64 * 63 // 2 and sum(compared) < 1_024 * 1_023 // 2 // 4


def test_gray_ranks_of_long_codes(spark):
    codes, _ = long_codes()
    signed = codes.view(np.int64)
    table = spark.createDataFrame([(int(a), int(b)) for a, b in signed.T], "a bigint, b bigint")
    found = table.select("a", "b", *simhash.gray_ranks(table["a"], table["b"])).collect()
    for a, b, first, second in found:
        code = np.array([a, b], dtype=np.int64).view(np.uint64)
        assert (first % 2**64) << 64 | second % 2**64 == gray_rank(code)


def test_odd_documents(spark):
    rows = [(5, None), (3, ""), (9, " \t "), (7, "one"), (8, "ONE"), (None, "one"), (7, "one"), (None, "alone here"),
            (None, "alone here"), (2, "a b c d " * 30_000)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(table).collect()), key=str)
    assert found == sorted(
        [(5, 3), (3, 3), (9, 3), (7, 7), (8, 7), (None, 7), (7, 7), (None, None), (None, None), (2, 2)], key=str
    )
    kept = simhash.keep_first(helpers.with_clashes(table))
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([3, 7, 2, None, None], key=str)
    assert simhash.near_duplicates(table.limit(0)).count() == 0
    assert simhash.keep_first(table.limit(0)).count() == 0


@pytest.mark.parametrize("shingle", [4, 5])
def test_keep_first_loses_no_text(spark, shingle):
    """Texts under a shared doc_id, and copies without one."""
    a, b, c = ("ab cd ef gh ij kl", "mn op qr st uv wx", "aa bb cc dd ee ff gg")
    rows = [(1, a, "x"), (1, b, "x"), (2, b, "x"), (None, c, "x"), (None, c, "x"), (3, c + " hh", "x"), (4, a, "y"), (1, a, "w")]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    kept = simhash.keep_first(helpers.with_clashes(table), shingle=shingle, max_bits=0).collect()
    assert sorted((tuple(r)[:3] for r in kept), key=str) == sorted(
        [(1, a, "w"), (1, b, "x"), (None, c, "x"), (None, c, "x"), (3, c + " hh", "x")], key=str
    )


def test_connected_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(150), rng.randrange(150)) for _ in range(110)]
    edges += [(i, i + 1) for i in range(200, 230)] + [(300, 300 + i) for i in range(1, 40)] + [(7, 7)]
    want = helpers.components(400, lambda i, j, e=set(edges): (i, j) in e or (j, i) in e)
    table = spark.createDataFrame([*edges, *edges[:5], (None, 3)], "x bigint, y bigint")
    found = {r.node: r.component for r in connected_components(table).collect()}
    assert found == {i: want[i] for i in {x for e in edges for x in e if e[0] != e[1]}}
    assert connected_components(table.limit(0)).count() == 0


def plain_links(vectors, threshold):
    fit = {i: v for i, v in enumerate(vectors) if v and all(x is not None and math.isfinite(x) for x in v) and any(v)}

    def linked(i, j):
        if i not in fit or j not in fit or len(fit[i]) != len(fit[j]):
            return False
        a, b = fit[i], fit[j]
        norms = math.sqrt(math.fsum(x * x for x in a)) * math.sqrt(math.fsum(x * x for x in b))
        return math.fsum(x * y for x, y in zip(a, b)) / norms >= threshold

    return linked


@pytest.mark.parametrize("unit_values, leaf_rows", [(262_144, 512), (640, 7)])
def test_vectors_against_all_pairs(spark, unit_values, leaf_rows):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 8))
    vectors = [(centres[i % 12] + rng.normal(size=8) * 0.13 * (i % 3)).tolist() for i in range(260)]
    vectors += [None, [], [0.0] * 8, [1.0, None] + [0.0] * 6, [float("nan")] * 8, [float("inf")] + [1.0] * 7,
                [1.0, 2.0], [2.0, 4.0], [-0.0, 1.0], [0.0, 1.0], vectors[0], vectors[0], [1e200] * 8, [1e200] * 8]
    linked = plain_links(vectors, 0.95)
    roots = helpers.components(len(vectors), linked)
    table = spark.createDataFrame(list(enumerate(vectors)), "vec_id bigint, embedding array<double>")
    found = {
        r.vec_id: (r.n_links, r.component_id, r.kept)
        for r in embeddings.near_vectors(
            table.selectExpr("*", "1 AS unit", "'x' AS label", "2 AS copies"), unit_values=unit_values, leaf_rows=leaf_rows
        ).collect()
    }
    huge = {len(vectors) - 2, len(vectors) - 1}  # their squares overflow in the plain version
    for i in set(range(len(vectors))) - huge:
        n = sum(linked(i, j) for j in range(len(vectors)) if j != i and j not in huge)
        if i not in found or found[i][1] in huge or any(found[h][1] == found[i][1] for h in huge):
            continue
        assert found[i] == (n, roots[i], roots[i] == i), i
    assert found[len(vectors) - 2][1] == found[len(vectors) - 1][1]


def test_odd_vector_rows(spark):
    rows = [(None, [1.0, 0.0]), (4, [1.0, 0.0]), (4, [1.0, 0.0]), (2, [1.0, 0.0]), (9, None)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    found = sorted((tuple(r) for r in embeddings.near_vectors(table).collect()), key=str)
    assert found == sorted(
        [(None, 0, None, False), (4, 2, 2, False), (4, 2, 2, False), (2, 2, 2, True), (9, 0, 9, True)], key=str
    )
    assert embeddings.near_vectors(table.limit(0)).count() == 0
    # one vec_id, different vectors: links are those of each vector
    rows = [(4, [1.0, 0.0]), (5, [1.0, 0.01]), (4, [0.0, 1.0]), (5, [-1.0, 0.0]), (3, [-1.0, 0.02])]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    found = sorted(tuple(r) for r in embeddings.near_vectors(table).collect())
    assert found == [(3, 1, 3, True), (4, 0, 4, True), (4, 1, 4, True), (5, 1, 3, False), (5, 1, 4, False)]
    with pytest.raises(ValueError):
        embeddings.near_vectors(table, threshold=0.0)
