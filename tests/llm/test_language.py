from __future__ import annotations

import zlib

import helpers
from trailmark.llm import langid


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    dictionaries = langid.learn_dictionaries(langid.training_rows(docs))
    assert set(dictionaries) == {"de", "en", "es", "fr"}
    known = {r.doc_id: r.lang for r in docs.collect()}
    found = langid.identify(helpers.with_clashes(docs).drop("held_out"), dictionaries).collect()
    assert len(found) == len(known)
    for row in found:
        assert row.held_out == (zlib.crc32(str(row.doc_id).encode()) % 4 == 2)
        assert 0 <= row.score <= 1
    held = [r for r in found if r.held_out and known[r.doc_id]]
    assert sum(r.lang_pred == known[r.doc_id] for r in held) / len(held) > 0.97
    assert sum(r.rejected for r in found) / len(found) < 0.02


def test_only_training_rows_teach(spark):
    docs = helpers.documents(spark)
    held = docs.where(langid.remainder(docs["doc_id"]) == 2)
    other = docs.subtract(held).unionByName(held.selectExpr("doc_id", "'zzz' AS text", "'xx' AS lang", "source", "n_chars"))
    assert langid.learn_dictionaries(langid.training_rows(docs)) == langid.learn_dictionaries(langid.training_rows(other))


def test_odd_rows(spark):
    docs = helpers.documents(spark)
    dictionaries = langid.learn_dictionaries(langid.training_rows(docs))
    rows = [(1, None), (2, ""), (3, "123 !!"), (4, "the of and " * 20_000), (None, "the and of that"), (4, "x")]
    table = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], helpers.DOCS)
    found = langid.identify(table, dictionaries).collect()
    assert len(found) == len(rows)
    assert [(r.lang_pred, r.score, r.rejected) for r in found if r.doc_id in (1, 2, 3)] == [("und", 0.0, True)] * 3
    assert {r.doc_id for r in langid.keep_identified(table, dictionaries).collect()} >= {4, None}
    assert langid.keep_identified(table, dictionaries).columns == table.columns
    assert langid.identify(table.limit(0), dictionaries).count() == 0


def test_no_language_learned(spark):
    table = spark.createDataFrame([(1, "some words", None)], "doc_id bigint, text string, lang string")
    assert langid.learn_dictionaries(table) == {}
    row = langid.identify(table, {}).head()
    assert (row.lang_pred, row.score, row.rejected) == ("und", 0.0, True)


def test_equal_sizes_are_rejected_and_named_by_order():
    judge = langid.Classifier({"b": b"same words " * 50, "a": b"same words " * 50}, 0.01).judge
    assert judge("same words here") == ("a", 0.0, True)


def test_a_language_with_one_short_text_shortens_no_other(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    four = langid.learn_dictionaries(langid.training_rows(docs))
    rare = spark.createDataFrame([("kort verhaal over ons", "nl")], "text string, lang string")
    five = langid.learn_dictionaries(langid.training_rows(docs).select("text", "lang").unionByName(rare))
    assert five == {**four, "nl": b"kort verhaal over ons"}
    rows = docs.where("lang IS NOT NULL").orderBy("doc_id").limit(160).collect()
    before, after = langid.Classifier(four, 0.01), langid.Classifier(five, 0.01)
    same = [before.judge(r.text) == after.judge(r.text) for r in rows]
    assert sum(same) / len(same) > 0.98
    alone = langid.Classifier({"en": four["en"], "nl": five["nl"]}, 0.01)
    english = [alone.judge(r.text) for r in rows if r.lang == "en"]
    assert sum(lang == "en" and not rejected for lang, _, rejected in english) / len(english) > 0.95
    assert after.judge("kort verhaal over ons, kort verhaal over ons")[0] == "nl"


def test_copies_of_few_texts_are_learned(spark):
    copies = spark.range(30_000).selectExpr("concat('goede tekst nummer ', id % 20) AS text", "'nl' AS lang")
    other = spark.range(2_000).selectExpr("concat('some english text ', id) AS text", "'en' AS lang")
    learned = langid.learn_dictionaries(copies.unionByName(other))
    assert len(learned["nl"].split(b"\n")) == 20
    assert 400 < len(learned["en"].split(b"\n")) < 800
