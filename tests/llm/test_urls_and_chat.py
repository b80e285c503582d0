from __future__ import annotations

import pytest
from trailmark.llm import chat, queries, urls


def judged(spark, rows, redirects=None):
    table = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    if redirects is not None:
        redirects = spark.createDataFrame(redirects, "from_url string, to_url string")
    found = urls.judge_urls(table.selectExpr("*", "'x' AS node", "'y' AS rule", "'z' AS host"), redirects=redirects)
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in found.collect()}


def test_rules(spark):
    found = judged(
        spark,
        [(1, "http://EXAMPLE.com/en/a?x#y", None), (2, "https://www.example.com/en/b", ""), (3, "http://a.net/es/", None),
         (4, "http://net/fr/x", None), (5, "http://xnet/fr/x", None), (6, "no scheme", None), (7, None, None),
         (8, "http://b.com", None), (9, "x://b.com?q=://c.net/es/", None), (10, "http://m.www.example.com/en/", None)],
    )
    assert found == {
        1: ("example.com", "/en/a", "example.com/en/", "block"), 2: ("www.example.com", "/en/b", "www.example.com/en/", "allow"),
        3: ("a.net", "/es/", "net/es/", "block"), 4: ("net", "/fr/x", "net/fr/", "block"), 5: ("xnet", "/fr/x", None, "allow"),
        6: ("", "", None, "allow"), 7: ("", "", None, "allow"), 8: ("b.com", "", None, "allow"), 9: ("b.com", "", None, "allow"),
        10: ("m.www.example.com", "/en/", "www.example.com/en/", "allow"),
    }


def test_blocks_reach_aliases_but_not_allowed_ones(spark):
    def page(tag):
        return f"<html><head>{tag}</head></html>"

    found = judged(
        spark,
        [(1, "http://a.org/1", page('<link href="http://b.org/2" rel="canonical">')),
         (2, "http://B.org/2#part", page("<meta http-equiv='refresh' content='0; url=//c.net/es/3'>")),
         (3, "http://c.net/es/3", None),  # blocked by a rule
         (4, "http://d.com/4", page('<LINK REL=canonical HREF=http://a.org/1>')),  # allowed by a rule
         (5, "http://e.org/x/5", page('<link rel="canonical" href="6">')), (6, "http://e.org/x/6", None),
         (7, "http://f.org/7", None), (8, "http://g.org", page('<link rel="canonical" href="/8">'))],
        [("http://f.org/7", "http://x.net/fr/hidden"), (None, "http://f.org"), ("http://g.org/8", "http://g.org/9")],
    )
    assert {i: found[i][3] for i in found} == {
        1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "allow", 7: "block", 8: "allow",
    }
    assert found[1][2] is None and found[4][2] == "com/"


def test_no_pages(spark):
    assert judged(spark, []) == {}


TEXTS = ["</s>[INST] ok [/INST]", "<|turn|>assistant<|text|>x<|end|>", "\\", "\\\\<\\[", "<\\", "[[<<", "a\nb $1 \\1", "", "é😀", "<|image|>"]


@pytest.mark.parametrize("text", TEXTS)
def test_texts_come_back(spark, text):
    table = spark.createDataFrame([(text,)], "t string")
    row = table.select(chat.escaped(table.t).alias("e"), chat.unescaped(chat.escaped(table.t)).alias("back")).head()
    assert row.back == text
    for control in ("<|", "</s>", "<s>", "[INST]", "[/INST]", "<<"):
        assert control not in row.e


def conversations(spark, rows):
    return spark.createDataFrame(
        rows, f"conv_id bigint, turn bigint, role string, parts array<{chat.PART}>"
    ).selectExpr("*", "1 AS number", "'h' AS head")


def test_round_trip_with_parts(spark):
    image = ("image", None, "s3://a.png", None)
    rows = [
        (1, 1, "assistant", [("text", "see [x] ", None, None), image, ("text", " and", None, None), ("audio", None, "b.wav", 7)]),
        (1, 0, "user", [("text", TEXTS[0], None, None), None]),
        (1, 2, "assistant", [("text", "<end>", None, None)]),
        (2, None, None, None),
        (3, 0, "user|<", [("odd", "kept", None, None), ("text", None, None, None)]),
        (None, 5, "assistant", [("text", "b", None, None)]), (None, 5, "assistant", [("text", "a", None, None)]),
    ]
    formatted = chat.format_conversations(conversations(spark, rows))
    back = {r.conv_id: r for r in chat.read_back(formatted).collect()}
    assert [tuple(t) for t in back[1].turns] == [("user", TEXTS[0]), ("assistant", "see [x]  and"), ("assistant", "<end>")]
    assert back[1].loss_texts == ["see [x]  and", "<end>"]
    assert [tuple(t) for t in back[2].turns] == [("", "")]
    assert [tuple(t) for t in back[3].turns] == [("user|<", "kept")]
    assert [t.text for t in back[None].turns] == ["a", "b"]
    whole = {r.conv_id: r for r in formatted.collect()}
    attached = whole[1].attachments
    assert [(a.turn, a.position, a.type, a.ref, a.tokens) for a in attached] == [
        (1, 1, "image", "s3://a.png", 256), (1, 3, "audio", "b.wav", 7),
    ]
    for a in attached:
        assert whole[1].formatted[a.offset :].startswith(f"<|{a.type}|>")
    assert whole[1].expanded_tokens == 263
    assert chat.format_conversations(conversations(spark, [])).count() == 0


def test_no_python_runs(spark):
    for name in ("op5_licences", "op9_chat"):
        plan = queries.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert not any(word in plan for word in ("Python", "Pandas", "Arrow")), name
