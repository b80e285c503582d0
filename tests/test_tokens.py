"""Path columns against a plain Python reading of the rules, on random text."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from trailmark.functions import journeys, tokens

BLANKS = tokens.SPACE_SEPARATORS
DELIMITERS = ["->", ",", ">", "|", "--", "aba", " ", " / ", "$", "\\", ".*", "→", "\\E"]


def split(path, delimiter, blanks=BLANKS):
    return [t.strip(blanks) for t in path.split(delimiter)]


def collapse(events):
    return [e for i, e in enumerate(events) if i == 0 or e != events[i - 1]]


def random_paths(delimiter, count=400):
    rng = random.Random(delimiter)
    pieces = ["A", "B", "A", "ab", "a", "-", "é", "", " ", " ", "　", "\t", " x y ",
              delimiter, delimiter, delimiter, delimiter]
    return ["".join(rng.choices(pieces, k=rng.randint(0, 14))) for _ in range(count)]


@pytest.mark.parametrize("delimiter", DELIMITERS)
def test_tokens_and_dedupe_match_plain_python(spark, delimiter):
    paths = random_paths(delimiter)
    events = F.col("events")
    found = (
        spark.createDataFrame([(p,) for p in paths], "path string")
        .withColumn("events", tokens.tokenize_path(F.col("path"), delimiter))
        .select(
            "path",
            "events",
            tokens.dedupe_consecutive(events).alias("consecutive"),
            tokens.dedupe_unique(events).alias("unique"),
            tokens.drop_blank_events(events).alias("filled"),
            tokens.first_event(F.col("path"), delimiter).alias("first"),
            tokens.last_event(F.col("path"), delimiter).alias("last"),
            tokens.sanitize_path(F.col("path"), "consecutive", delimiter).alias("clean"),
        )
        .collect()
    )
    assert len(found) == len(paths)
    for row in found:
        expected = split(row.path, delimiter)
        assert row.events == expected, row.path
        assert row.consecutive == collapse(expected)
        assert row.unique == list(dict.fromkeys(expected))
        assert row.filled == [e for e in expected if e]
        assert row.first == expected[0]
        assert row.last == expected[-1]
        assert row.clean == delimiter.join(collapse(expected))


def test_unique_keeps_first_occurrence_order(spark):
    row = spark.range(1).select(tokens.sanitize_path(F.lit("A->B->A->C"), "unique").alias("p"))
    assert row.head().p == "A->B->C"


def test_null_path_stays_null(spark):
    path = F.lit(None).cast("string")
    row = spark.range(1).select(
        tokens.tokenize_path(path).alias("t"),
        tokens.sanitize_path(path, "consecutive").alias("c"),
        journeys.journey_steps(path).alias("j"),
    ).head()
    assert (row.t, row.c, row.j) == (None, None, [])


@pytest.mark.parametrize("delimiter", ["", None])
def test_empty_delimiter_is_refused(delimiter):
    with pytest.raises(ValueError, match="delimiter"):
        tokens.check_delimiter(delimiter)


def test_long_runs_of_blanks_stay_fast(spark):
    path = F.concat(F.lit("A->"), F.repeat(F.lit(" "), 300_000), F.lit("B"))
    row = spark.range(1).select(tokens.tokenize_path(path).alias("t")).head()
    assert row.t == ["A", "B"]


# Journeys ------------------------------------------------------------------------------------


def steps_of(path, delimiter="->"):
    return [t for t in split(path, delimiter, journeys.JOURNEY_BLANKS) if t]


def marks(steps, event, subpath):
    hits = {i for i, s in enumerate(steps) if event and s == event.strip()}
    parts = steps_of(subpath or "")
    for start in range(len(steps) - len(parts) + 1 if parts else 0):
        if steps[start:start + len(parts)] == parts:
            hits.update(range(start, start + len(parts)))
    return hits


def grouped(steps, hits):
    groups = []
    for i, step in enumerate(steps):
        if groups and groups[-1][0] == step:
            name, count, hit = groups[-1]
            groups[-1] = (name, count + 1, hit or i in hits)
        else:
            groups.append((step, 1, i in hits))
    return groups


def preview(groups):
    if len(groups) <= 8:
        return [(*g, False) for g in groups]
    shown = [(*g, False) for g in groups[:8]]
    later = [i for i, g in enumerate(groups) if i >= 8 and g[2]]
    if later:
        if later[0] > 8:
            shown.append((None, later[0] - 8, False, True))
        shown.append((*groups[later[0]], False))
    return shown


@pytest.mark.parametrize(
    "event, subpath",
    [("A", None), (None, "A->B"), (" B ", "A -> A->B"), ("", ""), ("Z", "A->A"), (None, "->B->")],
)
def test_journeys_match_plain_python(spark, event, subpath):
    from trailmark import session_journeys

    rng = random.Random(f"{event}{subpath}")
    paths = ["->".join(rng.choices(["A", "A", "B", " C", "", "D\t"], k=rng.randint(0, 30)))
             for _ in range(300)]
    table = spark.createDataFrame(
        [(str(i), p, 1) for i, p in enumerate(paths)],
        "SESSION string, EVENT_PATH string, TOTAL_EVENTS bigint",
    )
    found = session_journeys(table, event=event, subpath=subpath).collect()
    for row in found:
        steps = steps_of(paths[int(row.SESSION)])
        hits = marks(steps, event, subpath)
        groups = grouped(steps, hits)
        assert row.match_positions == sorted(hits)
        assert [tuple(g) for g in row.groups] == groups
        assert [tuple(g) for g in row.preview] == preview(groups)
        shown = sum(1 for g in preview(groups) if not g[3])
        assert row.hidden_groups == len(groups) - shown
