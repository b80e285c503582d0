from __future__ import annotations

import hashlib

import helpers
import pytest
from trailmark.llm import decontaminate

ITEMS = [
    (1, "one two three four five six seven eight nine ten eleven"),
    (2, "short item"), (3, "Word"), (4, None), (5, " ... "), (6, "Ünï cödé words"), (1, "another text of one"),
    (None, "no name here"),
]
TEXTS = [
    "x ONE two three four five six seven eight nine ten eleven y", "one two three four five six seven eight nine",
    "a short, item! short item", "word word", None, "", "ünï cödé WORDS", "Ünï cödé WORDS", "no name here short",
    "two three four five six seven eight nine ten eleven two three four five six seven eight nine ten eleven",
]


@pytest.mark.parametrize("block_windows", [200_000, 4])
def test_against_a_plain_search(spark, block_windows):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id bigint, text string")
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    named = [("" if i is None else str(i), t) for i, t in ITEMS]
    rows = decontaminate.find_contamination(
        helpers.with_clashes(docs), items.selectExpr("*", "1 AS n"), block_windows=block_windows
    ).collect()
    assert len(rows) == len(TEXTS)
    for row in rows:
        words, hit, found = helpers.contamination(TEXTS[row.doc_id], named)
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        want = (len(words), len(hit), len(found), digest, bool(hit))
        assert (row.n_words, row.n_hit, row.n_items, row.items_sha256, row.contaminated) == want
    kept = decontaminate.drop_contaminated(docs, items, block_windows=block_windows)
    assert kept.columns == docs.columns
    clean = {i for i, t in enumerate(TEXTS) if not helpers.contamination(t, named)[1]}
    assert {r.doc_id for r in kept.collect()} == clean


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "word")], "doc_id bigint, text string")
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    assert decontaminate.find_contamination(docs.limit(0), items).count() == 0
    row = decontaminate.find_contamination(docs, items.limit(0)).head()
    assert (row.n_words, row.n_hit, row.contaminated) == (1, 0, False)
    assert decontaminate.drop_contaminated(docs, items.limit(0)).count() == 1
