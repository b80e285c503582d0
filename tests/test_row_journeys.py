"""Journeys and searches over rows against those over paths."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import trailmark as tm
from conftest import rows
from trailmark.operators import row_journeys

SMALL = {"piece_events": 4, "part_pieces": 2}


@pytest.fixture(scope="module")
def forms(spark, tmp_path_factory):
    """Sessions as paths and as rows: runs, blank and padded events, one session of a single run."""
    rng = random.Random(7)
    turns = []
    for key in range(60):
        event = "a"
        for turn in range(rng.choice([1, 3, 9, 40])):
            event = event if rng.random() < 0.5 else rng.choice(["a", "b", " c ", "", "\td"])
            turns.append((key, turn, event))
    turns += [(99, i, "b") for i in range(50)]
    table = spark.createDataFrame(turns, "conv_id int, turn int, role string").coalesce(1)
    folder = tmp_path_factory.mktemp("forms")
    paths, in_rows = tm.conversation_paths(table), tm.conversation_rows(table)
    paths.coalesce(1).write.parquet(str(folder / "paths"))
    in_rows.coalesce(2).write.parquet(str(folder / "rows"))
    return tuple(spark.read.parquet(str(folder / name)) for name in ("paths", "rows"))


WANTED = [{"event": "c"}, {"subpath": "a->b"}, {"event": "d", "subpath": "b->b->b"}, {"subpath": "b->a->a->b->b"}, {}]


@pytest.mark.parametrize("wanted", WANTED)
def test_journeys_over_rows(forms, wanted):
    paths, in_rows = forms
    want = tm.session_journeys(paths, **wanted)
    steps = tm.journey_rows(in_rows)
    places = want.select("SESSION", F.explode("match_positions").alias("p"))
    found = tm.match_positions_from_rows(steps, **wanted, **SMALL)
    assert set(rows(found)) == set(rows(places))
    groups = tm.journey_groups_from_rows(steps, **wanted, **SMALL)
    whole = want.select("SESSION", F.posexplode("groups").alias("position", "g"))
    assert set(rows(groups)) == set(rows(whole.select("SESSION", "position", "g.*")))
    seen = {r.session_key: r for r in tm.journey_previews_from_rows(groups).collect()}
    for r in want.where("size(groups) > 0").collect():
        mine = seen.pop(r.SESSION)
        assert mine.groups == len(r.groups) and mine.hidden_groups == r.hidden_groups
        assert [tuple(x) for x in mine.preview] == [tuple(x) for x in r.preview]
    assert not seen


def test_very_many_runs_are_previewed_without_being_collected(spark):
    table = spark.range(60_000).selectExpr("0 AS conv_id", "id AS turn", "if(id % 2 = 0, 'a', 'b') AS role")
    steps = tm.journey_rows(tm.conversation_rows(table.unionAll(table.limit(3).selectExpr("0", "turn + 60000", "'z'"))))
    groups = tm.journey_groups_from_rows(steps, event="z")
    found = tm.journey_previews_from_rows(groups).head()
    assert found.groups == 60_001 and found.hidden_groups == 60_001 - 9
    assert tuple(found.preview[-1]) == ("z", 3, True, False) and found.preview[-2]["count"] == 60_000 - 8


def test_many_subpaths_in_one_search(forms):
    paths, in_rows = forms
    subpaths = [f"{x}->{y}" for x in ("a", "b", " c ", "") for y in ("a", "b", " c ", "")]
    subpaths += ["a", "b->b->b->b", "a->b->a->b", "zzz", " c", "b->b->b->a"]
    found = tm.search_rows(in_rows, events=["c", "nothing"], subpaths=subpaths, **SMALL).collect()
    for number, subpath in enumerate(subpaths):
        want = {r.SESSION for r in tm.match_sessions(paths, subpath=subpath).collect()}
        assert {r.SESSION for r in found if number in r.found_subpaths} == want, subpath
    want = {r.SESSION for r in tm.match_sessions(paths, event="c").collect()}
    assert {r.SESSION for r in found if r.found_events == [0]} == want
    assert all(r.found_events or r.found_subpaths for r in found)
    with pytest.raises(ValueError):
        tm.search_rows(in_rows)


def test_a_search_by_depth_and_event_only(forms):
    paths, in_rows = forms
    found = tm.search_rows(in_rows, events=["b"], min_events=10)
    want = tm.match_sessions(paths, event="b", min_events=10)
    assert set(rows(found, "SESSION", "TOTAL_EVENTS")) == set(rows(want, "SESSION", "TOTAL_EVENTS"))


def test_the_automaton_finds_what_ends_at_each_place(spark):
    rng = random.Random(5)
    wanted = [["a"], ["a", "b"], ["b", "a", "b"], ["b", "b"], ["a", "b", "a", "b", "c"], ["c", "c"]]
    automaton = row_journeys._Automaton(wanted)
    texts = [[rng.choice("abcx") for _ in range(rng.randint(0, 12))] for _ in range(200)]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, events array<string>")
    for r in table.select("i", automaton.found(F.col("events")).alias("found")).collect():
        own = texts[r.i]
        want = {n for n, w in enumerate(wanted) if any(own[at : at + len(w)] == w for at in range(len(own)))}
        assert set(r.found) == want
