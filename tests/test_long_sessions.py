"""Sessions of any length: pieces, scans over hot keys, and analyses that merge along pieces."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

import trailmark as tm
from conftest import rows
from test_adapters import random_events
from test_plans import final_plan
from trailmark.sources import positions

EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string"
MODES = ["none", "consecutive", "unique"]
#: So small that random sessions have several pieces, and some several parts.
SMALL = {"piece_events": 3, "part_pieces": 2}


def untidy_events(count, seed):
    """Events of which some lack a time, a user or a name; user 0 holds a third."""
    found = random_events(count, 30, 86_400 * 20, seed)
    return [
        (i // 2 if i % 17 == 0 else i, t if i % 11 else None, u if i % 7 else None, k if i % 13 else None)
        for i, t, u, k in found
    ]


@pytest.fixture(scope="module")
def events(spark):
    return spark.createDataFrame(untidy_events(1_500, 6), EVENTS).coalesce(2)


def hot(options=None):
    return {"piece_rows": 40, **(options or {})}


def by_key(found):
    return sorted(rows(found), key=str)


@pytest.mark.parametrize("gap", [600, 86_400])
def test_a_hot_user_in_pieces_has_the_same_sessions(spark, events, gap):
    plain = tm.sessionize_events(events, gap_seconds=gap)
    cut = tm.sessionize_events(events, gap_seconds=gap, **hot())
    assert by_key(cut) == by_key(plain)
    columns = ["session_key", "SESSION", "position", "event"]
    plain, cut = (
        tm.session_rows(events, gap_seconds=gap, keep_unnamed=True, **options) for options in ({}, hot())
    )
    assert sorted(rows(cut, *columns), key=str) == sorted(rows(plain, *columns), key=str)


def test_positions_along_a_key(spark):
    rng = random.Random(2)
    # ties in all of the order, a missing key, a key with a third of the rows
    found = [(rng.choice([None, 1, 1, 1, 2, 3]), rng.randrange(40), rng.randrange(3)) for _ in range(2_000)]
    table = spark.createDataFrame(found, "k int, a int, b int")
    for size in (positions.PIECE_ROWS, 70):
        numbered = positions.numbered(table, ["k"], ["a", "b"], piece_rows=size).collect()
        by_key = {}
        for row in numbered:
            by_key.setdefault(row.k, []).append((row.position, (row.a, row.b)))
        assert {k: len(v) for k, v in by_key.items()} == {
            k: sum(x[0] == k for x in found) for k in {x[0] for x in found}
        }
        for own in by_key.values():
            own.sort()
            assert [p for p, _ in own] == list(range(1, len(own) + 1))
            assert [o for _, o in own] == sorted(o for _, o in own)


def test_rows_of_one_place_cannot_be_cut(spark):
    table = spark.createDataFrame([(1, 5)] * 500 + [(1, 6), (2, 5)], "k int, a int")
    found = positions.numbered(table, ["k"], ["a"], piece_rows=10)
    assert found.groupBy("k").agg(F.max("position").alias("n")).where("k = 1").head().n == 501


def test_split_points_are_bounded(spark):
    table = spark.range(40_000).selectExpr("id % 3 AS k", "id AS a")
    points = positions.split_points(table, ["k"], ["a"], 1)
    held = points.agg(F.sum(F.size(positions.POINTS))).head()[0]
    assert 10 < held <= 2 * positions.PIECES * positions.shuffle_partitions(spark)


@pytest.mark.parametrize("key", [1, None])
def test_keyed_paths_and_rows_of_a_hot_key(spark, key):
    rng = random.Random(9)
    turns = [
        (rng.choice([key, key, 2, 3, 4]), t // 3, rng.choice(["user", "assistant", " tool ", "", None]))
        for t in range(900)
    ]
    talk = spark.createDataFrame(turns, "conv_id long, turn int, role string")
    assert by_key(tm.conversation_paths(talk, **hot())) == by_key(tm.conversation_paths(talk))
    assert by_key(tm.conversation_rows(talk, **hot())) == by_key(tm.conversation_rows(talk))


@pytest.mark.parametrize("options", [{}, {"piece_rows": 1_000}])
def test_only_the_too_long_key_is_missing(spark, options):
    """One conversation does not fit a record; all others come, and it comes as rows."""
    table = spark.range(24_000).selectExpr(
        "if(id % 3 = 0, 1, id % 50 + 2) AS conv_id", "id AS turn", "repeat('r', 300) AS role"
    )
    spec = {"key": "conv_id", "order_by": ["turn"], "event": "role", "max_record": 2_000_000, **options}
    with pytest.raises(Exception, match="exceeds the record limit"):
        tm.keyed_paths(table, **spec).count()
    paths, in_rows = tm.keyed_sessions(table, **spec)
    assert paths.count() == 50 and paths.where("SESSION = '1'").count() == 0
    assert paths.agg(F.sum("TOTAL_EVENTS")).head()[0] == 16_000
    found = in_rows.groupBy("SESSION").agg(F.max("position").alias("n"), F.count("*").alias("rows"))
    assert rows(found) == [("1", 8_000, 8_000)]
    with pytest.raises(ValueError, match="long sessions"):
        tm.keyed_paths(table, too_long="cut", **spec)


@pytest.fixture(scope="module")
def stored_events(spark, events, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("events") / "events.parquet")
    events.write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("options", [{}, {"piece_rows": 40}])
def test_events_are_read_once(stored_events, options):
    for build in (tm.sessionize_events, tm.session_rows):
        plan = final_plan(build(stored_events, **options))
        assert plan.count("event_type") and plan.count("events.parquet") == 1
    keyed = {"key": "user_id", "order_by": ["ts", "event_id"], "event": "event_type"}
    for build in (tm.keyed_paths, tm.keyed_rows):
        assert final_plan(build(stored_events, **keyed, **options)).count("events.parquet") == 1


def test_sessions_take_one_shuffle(stored_events):
    plan = final_plan(tm.sessionize_events(stored_events))
    assert plan.count(" Exchange ") == 1
    assert "Join" not in plan


@pytest.fixture(scope="module")
def both_forms(spark, events, tmp_path_factory):
    """The sessions as paths and as rows."""
    folder = tmp_path_factory.mktemp("forms")
    found = tm.sessionize_events(events), tm.session_rows(events, keep_unnamed=True)
    for name, frame in zip(("paths", "rows"), found):
        frame.coalesce(2).write.parquet(str(folder / name))
    return tuple(spark.read.parquet(str(folder / name)) for name in ("paths", "rows"))


@pytest.mark.parametrize("sizes", [SMALL, {"piece_events": 1, "part_pieces": 1}])
@pytest.mark.parametrize("mode", MODES)
def test_funnels_over_rows(both_forms, mode, sizes):
    paths, in_rows = both_forms
    for steps in (["a", "b", "c"], ["b", "b", "b", "a", "z"]):
        want = rows(tm.funnel(paths, steps, dedupe=mode))
        assert rows(tm.funnel_from_rows(in_rows, steps, dedupe=mode, **sizes)) == want


def test_reach_over_rows(both_forms):
    paths, in_rows = both_forms
    reach = tm.funnel(paths, ["b", "z", "a"], sequential=False)
    assert rows(tm.funnel_from_rows(in_rows, ["b", "z", "a"], sequential=False)) == rows(reach)


def test_runs_over_the_borders_of_pieces(spark):
    """A run that several pieces belong to is one event, also where a piece is nothing but the run."""
    found = ("aaaaaaa", "aabbbbbbbbba", "abbbbbbabbbbbbb", "bbbbbbbbaaaaaaaab", "ab" * 8)
    turns = [(k, i, e) for k, path in enumerate(found) for i, e in enumerate(path)]
    table = spark.createDataFrame(turns, "conv_id int, turn int, role string").coalesce(1)
    paths, in_rows = tm.conversation_paths(table), tm.conversation_rows(table)
    for steps in (["a", "a"], ["a", "b", "b"], ["a", "b", "a", "b", "b"]):
        want = rows(tm.funnel(paths, steps, dedupe="consecutive"))
        assert rows(tm.funnel_from_rows(in_rows, steps, dedupe="consecutive", **SMALL)) == want


def test_funnel_steps_of_rows_are_checked(spark, events):
    in_rows = tm.session_rows(events)
    for steps in ([], [" "], "a"):
        with pytest.raises(ValueError):
            tm.funnel_from_rows(in_rows, steps)
    empty = tm.funnel_from_rows(in_rows.limit(0), ["a", "b"])
    assert rows(empty, "session_count") == [(0,), (0,)]


def test_no_group_holds_a_long_session(spark):
    """The largest array is a piece; parts spread a session over groups."""
    table = spark.range(100_000).selectExpr("0 AS conv_id", "id AS turn", "if(id % 2 = 0, 'a', 'b') AS role")
    pieces = tm.session_pieces(tm.conversation_rows(table), part_pieces=8)
    sizes = pieces.agg(F.max(F.size("events")), F.count("*"), F.count_distinct("part")).head()
    assert tuple(sizes) == (4_096, 25, 4)
    found = tm.funnel_from_rows(tm.conversation_rows(table), ["a", "b"] * 20, part_pieces=8)
    assert {r.session_count for r in found.collect()} == {1}


@pytest.mark.parametrize("mode", MODES)
def test_edges_over_rows(both_forms, mode):
    paths, in_rows = both_forms
    want = set(rows(tm.edge_counts(paths, dedupe=mode)))
    assert set(rows(tm.edges_from_rows(in_rows, mode, **SMALL))) == want


@pytest.mark.parametrize("mode", MODES)
def test_top_paths_over_rows(both_forms, mode):
    paths, in_rows = both_forms
    want = rows(tm.top_paths(paths, dedupe=mode, top_n=400, min_events=2))
    assert rows(tm.top_paths_from_rows(in_rows, dedupe=mode, top_n=400, min_events=2, **SMALL)) == want
    assert tm.top_paths_from_rows(in_rows.limit(0), dedupe=mode).count() == 0


def test_paths_too_long_for_the_top(spark):
    table = spark.createDataFrame([(1, i, "x" * 100) for i in range(20_100)], "conv_id int, turn int, role string")
    with pytest.raises(Exception, match="exceeds the record limit"):
        tm.top_paths_from_rows(tm.conversation_rows(table), max_record=2_000_000).collect()


def plain_top(sessions, top_n):
    counts = {}
    for _, path, depth in sessions:
        if path is not None and depth is not None and depth >= 1:
            counts[path, depth] = counts.get((path, depth), 0) + 1
    ranked = sorted((-n, path, depth) for (path, depth), n in counts.items())[:top_n]
    return [(path, depth, -n) for n, path, depth in ranked]


@pytest.mark.parametrize("limit", [2_000, 3])
def test_top_paths_with_many_equal_counts(spark, monkeypatch, limit):
    """Whether few or many paths reach the threshold, and whether they occur once or more often."""
    from trailmark.operators import paths

    monkeypatch.setattr(paths, "CANDIDATES", limit)
    rng = random.Random(4)
    for repeats, tops in ((1, (1, 60)), (2, (4, 500))):
        found = [(f"s{i}", f"p{i // repeats}->q", rng.randrange(1, 3)) for i in range(200)]
        found += [("t", "often", 1)] * 5 + [("n", None, 3), ("z", "p1", None), ("z", "p1", 0)]
        table = spark.createDataFrame(found, "SESSION string, EVENT_PATH string, TOTAL_EVENTS bigint")
        for top_n in tops:
            got = tm.top_paths(table, top_n=top_n)
            assert rows(got, "full_path", "TOTAL_EVENTS", "session_count") == plain_top(found, top_n)
            shares = {(r.full_path, r.TOTAL_EVENTS): r.share_percent for r in got.collect()}
            assert shares["often", 1] == round(500 / len(found), 2)


def test_no_text_in_the_exchange_that_counts_paths(spark, stored_events, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    plans = []
    collect = DataFrame.collect
    monkeypatch.setattr(
        DataFrame, "collect", lambda self: plans.append(self._jdf.queryExecution().executedPlan().toString()) or collect(self)
    )
    tm.top_paths(tm.generate_sessions(spark, 500), dedupe="consecutive")
    assert len(plans) == 1
    counting = [line for line in plans[0].splitlines() if "Exchange hashpartitioning" in line]
    assert counting and not any("EVENT_PATH" in line or "full_path" in line for line in counting)
