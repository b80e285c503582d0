"""The registered queries against their SQL, and the pipeline against a plain version."""

from __future__ import annotations

import check_queries
import corpus_pipeline
import helpers
import public_tokenizers
import pytest
from test_llm_tokens import check_packing
from trailmark.llm import langid, packing, pii, queries


@pytest.fixture(scope="module")
def connection():
    return check_queries.connect(helpers.SF_DIR)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_agrees_with_sql(spark, connection, name):
    assert check_queries.compare(spark, connection, helpers.SF_DIR, name) is None


def test_one_query_of_each_operator():
    numbers = sorted(int(name[2:].split("_")[0]) for name in queries.queries())
    assert numbers == list(range(1, len(numbers) + 1))


def plain_pipeline(spark):
    """(documents that reach packing, text by doc_id), without any of the joins."""
    docs = helpers.documents(spark)
    rows = sorted(docs.collect(), key=lambda r: r.doc_id)
    classifier = langid.Classifier(langid.learn_dictionaries(langid.training_rows(docs)), langid.MIN_MARGIN)
    rows = [r for r in rows if not classifier.judge(r.text)[2]]
    sets = [helpers.shingles(r.text) for r in rows]
    roots = helpers.components(len(rows), lambda i, j: helpers.jaccard(sets[i], sets[j]) >= 0.8)
    rows = [r for i, r in enumerate(rows) if roots[i] == i]
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{helpers.SF_DIR}/benchmark.parquet").collect()]
    rows = [r for r in rows if not helpers.contamination(r.text, items)[1]]
    return {r.doc_id: pii.masked(r.text, pii.find_spans(r.text)) for r in rows}


def test_pipeline_against_a_plain_version(spark):
    texts = plain_pipeline(spark)
    found = corpus_pipeline.run(spark, helpers.SF_DIR).collect()
    check_packing(found, texts, packing.WINDOW)
    assert 0 < len(texts) < helpers.documents(spark).count()


def test_stages_keep_the_columns(spark):
    docs = helpers.documents(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, helpers.SF_DIR)
        assert docs.schema.simpleString() == helpers.documents(spark).schema.simpleString()
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), helpers.SF_DIR).count() == 0
    assert public_tokenizers.path("word_bpe_49k.json")


def test_stages_on_no_documents(spark):
    empty = spark.createDataFrame([], helpers.DOCS)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, helpers.SF_DIR).count() == 0
