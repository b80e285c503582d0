"""Near copies against the similarity of all pairs."""

from __future__ import annotations

import itertools
import random

import helpers
import numpy as np
import pyarrow as pa
import pytest
from trailmark.llm import local_links, near_copies, simhash


def words(rng, n):
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(n)]


def changed(rng, own, times):
    own = list(own)
    for at in rng.sample(range(len(own)), times):
        own[at] = "".join(rng.choice("klmnop") for _ in range(5))
    return own


def random_texts():
    """Texts with near copies of many degrees, exact copies, and groups that share most words."""
    rng = random.Random(11)
    found = []
    for _ in range(40):
        own = words(rng, rng.choice([40, 120, 400]))
        found.append(own)
        for share in (0.004, 0.01, 0.02, 0.03, 0.05, 0.1):
            found.append(changed(rng, own, max(1, int(share * len(own)))))
    base = words(rng, 200)
    found += [changed(rng, base, 2) for _ in range(60)]
    texts = [" ".join(own) for own in found]
    texts += [texts[3], texts[3].upper().replace(" ", "\n"), None, "", " \t", "one two", "One  two"]
    rng.shuffle(texts)
    return texts


def linked_pairs(texts):
    sets = [helpers.shingles(t) for t in texts]
    return {(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if helpers.jaccard(sets[i], sets[j]) >= 0.8}


def of_other_words(texts, pairs):
    name = [near_copies.class_of(near_copies.words_of(t)) for t in texts]
    return [(i, j) for i, j in pairs if name[i] != name[j]]


@pytest.mark.parametrize("limits", [{}, {"cell_limit": 8, "part_texts": 7}])
def test_near_copies_of_random_texts(spark, limits):
    texts = random_texts()
    pairs = linked_pairs(texts)
    roots = helpers.components(len(texts), lambda i, j: (j, i) in pairs or (i, j) in pairs)
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = {r.doc_id: r for r in near_copies.near_copies(helpers.with_clashes(table), **limits).collect()}
    assert len(found) == len(texts)
    # Nothing is linked that is not, and of the pairs with other words nearly all are found.
    for i, row in found.items():
        assert roots[row.component_id] == roots[i] and row.component_id <= i
    others = of_other_words(texts, pairs)
    caught = sum(found[i].component_id == found[j].component_id for i, j in others)
    assert len(others) > 1_500 and caught >= 0.97 * len(others)
    single = [(i, j) for i, j in others if sum(roots[k] == roots[i] for k in range(len(texts))) < 10]
    assert sum(found[i].component_id == found[j].component_id for i, j in single) >= 0.95 * len(single)


def test_recall_on_given_documents_without_copies(spark):
    """Of the pairs whose words differ; copies would always be found."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.collect()}
    ids = sorted(texts)
    pairs = linked_pairs([texts[i] for i in ids])
    others = of_other_words([texts[i] for i in ids], pairs)
    found = {r.doc_id: r.component_id for r in near_copies.near_copies(docs).collect()}
    caught = sum(found[ids[i]] == found[ids[j]] for i, j in others)
    assert len(others) >= 10 and caught >= 0.9 * len(others)
    roots = helpers.components(len(ids), lambda i, j: (j, i) in pairs or (i, j) in pairs)
    assert all(roots[ids.index(found[i])] == roots[ids.index(i)] for i in ids)


def test_one_row_of_each_group_stays(spark):
    rng = random.Random(1)
    a, b, c = (" ".join(words(rng, 60)) for _ in range(3))
    rows = [
        (1, a, "x"), (1, b, "x"), (2, b, "x"), (None, c, "z"), (None, c, "y"), (5, a, "x"), (7, None, "x"), (6, "", "x"),
        (9, "short one", "q"), (9, "short one", "p"), (8, a + " more words", "x"),
    ]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, class string")
    kept = near_copies.keep_one(helpers.with_clashes(table))
    assert kept.columns == helpers.with_clashes(table).columns
    assert sorted((tuple(r)[:3] for r in kept.collect()), key=str) == sorted(
        [(1, a, "x"), (1, b, "x"), (None, c, "y"), (6, "", "x"), (9, "short one", "p")], key=str
    )
    assert near_copies.keep_one(table.limit(0)).count() == 0
    assert near_copies.near_copies(table.limit(0)).count() == 0


def test_bits_are_counted_and_set_by_majority():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 7, 100, 5_000):
        rows = rng.integers(0, 2**64, (n, 3), dtype=np.uint64)
        bits = np.unpackbits(rows.view(np.uint8), bitorder="little").reshape(n, -1)
        assert near_copies.bit_counts(rows).tolist() == bits.sum(axis=0).tolist()
    hashes = rng.integers(0, 2**64, 9_001, dtype=np.uint64)
    whole = near_copies.wide_fingerprint(hashes, 4)
    assert whole.tolist() == near_copies.wide_fingerprint(hashes[::-1].copy(), 4).tolist()
    assert near_copies.wide_fingerprint(hashes[:0], 4).tolist() == [0] * 4


@pytest.mark.parametrize("rows", [1, 7, 1_000])
def test_near_sketches_are_found_by_the_index(monkeypatch, rows):
    """In every cell and deal, whatever batches it lies in."""
    rng = np.random.default_rng(7)
    keys = sorted((int(c), int(d), int(s)) for c, d, s in zip(*(rng.integers(0, n, 300) for n in (40, 3, 3))))
    centres = rng.integers(-(2**63), 2**63, (4, 2))
    sketches = centres[rng.integers(0, 4, 300)]
    for bit in rng.integers(0, 64, (8, 300, 2)):
        sketches ^= np.left_shift(np.int64(1), bit)
    calls, plain = [], simhash.close_pairs
    monkeypatch.setattr(simhash, "close_pairs", lambda *of: calls.append(of) or plain(*of))
    columns = [*(pa.array(k) for k in zip(*keys)), pa.array(range(300)), *(pa.array(x) for x in sketches.T)]
    table = pa.Table.from_arrays(columns, ["cell", "deal", "side", "node", "s0", "s1"])
    links = [
        (a, b)
        for part in near_copies._sketch_links(table.to_batches(max_chunksize=rows))
        for a, b in zip(*(c.to_pylist() for c in part.columns))
    ]

    def linked(i, j):
        meets = keys[i][:2] == keys[j][:2] and (keys[i][2] == 0 or keys[i][2] != keys[j][2])
        return meets and np.bitwise_count((sketches[i] ^ sketches[j]).view(np.uint64)).sum() <= near_copies.SKETCH_BITS

    labels = local_links.merge(np.arange(300), *(np.array(side) for side in zip(*links)))
    assert calls and labels.tolist() == helpers.components(300, linked)
    assert len(links) == 300 - len(set(labels.tolist())) > 20


def test_sets_meet_in_pairs():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 30, rng.integers(0, 25))).astype(np.uint64) for _ in range(60)]
    found = {(int(a), int(b)) for i, j in near_copies.similar_pairs(sets, 0.5) for a, b in zip(i, j)}
    plain = [set(s.tolist()) for s in sets]
    want = {(i, j) for i in range(60) for j in range(i) if plain[i] & plain[j] and helpers.jaccard(plain[i], plain[j]) >= 0.5}
    assert found == want


def test_very_long_text(spark):
    text = " ".join(f"w{i}" for i in range(60_000))
    table = spark.createDataFrame([(1, text), (2, text + " end"), (3, "w1 w2")], "doc_id bigint, text string")
    found = {r.doc_id: r.component_id for r in near_copies.near_copies(table).collect()}
    assert found == {1: 1, 2: 1, 3: 3}
