"""Counts kept per file: equal to a full run, and nothing read that did not change."""

from __future__ import annotations

import random
from pathlib import Path

import pytest
from conftest import SESSION_SCHEMA, rows
from pyspark.sql import functions as F

import trailmark as tm
from trailmark.errors import SessionDataError
from trailmark.operators.metrics import PERCENTILES
from trailmark.plans import kept

EVENTS = ["A", "B", " C ", "", "D"]


def session_rows(seed, n=40, depths=9):
    pick = random.Random(seed)
    made = []
    for i in range(n):
        path = "->".join(pick.choice(EVENTS) for _ in range(pick.randint(1, 6)))
        depth = pick.choice([None, 0, *range(1, depths)])
        made.append((f"{seed}-{i}", None if pick.random() < 0.05 else path, depth))
    return made


@pytest.fixture
def folder(spark, tmp_path):
    """A folder of files, and a function that puts a file into it."""
    place = tmp_path / "exports [x] y.parquet"
    place.mkdir()

    def put(name, content, schema=SESSION_SCHEMA):
        made = tmp_path / f"made-{name}-{random.random()}"
        spark.createDataFrame(content, schema).coalesce(1).write.parquet(str(made))
        (part,) = made.glob("part-*.parquet")
        (place / f"{name}.parquet").write_bytes(part.read_bytes())

    return place, put


def pattern(place):
    """Spark takes brackets for a pattern."""
    return str(place).replace("[", "\\[").replace("]", "\\]")


def names(files):
    return [Path(file).name for file in files]


def full(spark, place):
    return tm.as_sessions(spark.read.parquet(pattern(place)))


def assert_equal_to_a_full_run(spark, place, state):
    sessions = full(spark, place)
    for mode in ("none", "consecutive", "unique"):
        for drop in (False, True):
            expected = tm.edge_counts(sessions, dedupe=mode, drop_blanks=drop)
            found = tm.kept_edges(spark, state, mode, drop_blanks=drop)
            assert sorted(rows(found), key=str) == sorted(rows(expected), key=str)
    assert rows(tm.kept_kpis(spark, state)) == rows(tm.session_kpis(sessions))
    report = tm.kept_report(spark, state, top_n=5)
    assert rows(report.tables["entry_points"]) == rows(tm.entry_events(sessions))
    assert rows(report.tables["exit_points"]) == rows(tm.exit_events(sessions))
    assert rows(report.tables["events"]) == rows(
        tm.event_frequencies(sessions, top_n=5, dedupe="consecutive")
    )


def test_only_changed_files_are_read(spark, folder, tmp_path):
    place, put = folder
    state = str(tmp_path / "state")
    for i in range(10):
        put(f"day{i}", session_rows(i))
    first = tm.update_counts(spark, pattern(place), state)
    assert names(first.read) == [f"day{i}.parquet" for i in range(10)]
    assert_equal_to_a_full_run(spark, place, state)

    assert tm.update_counts(spark, pattern(place), state).read == []
    put("day3", session_rows(33, n=55))
    (place / "day4.parquet").unlink()
    put("day10", [])
    done = tm.update_counts(spark, pattern(place), state)
    assert names(done.read) == ["day10.parquet", "day3.parquet"]
    assert names(done.removed) == ["day4.parquet"]
    assert len(done.kept) == 8
    assert_equal_to_a_full_run(spark, place, state)


def test_what_did_not_change_need_not_be_readable(spark, folder, tmp_path, monkeypatch):
    place, put = folder
    state = str(tmp_path / "state")
    for i in range(3):
        put(f"day{i}", session_rows(i))
    tm.update_counts(spark, pattern(place), state)
    put("day1", session_rows(9))
    asked = []
    read = kept._read
    monkeypatch.setattr(kept, "_read", lambda s, p, files, o: asked.append(files) or read(s, p, files, o))
    tm.update_counts(spark, pattern(place), state)
    assert [names(files) for files in asked] == [["day1.parquet"]]


def test_a_failed_update_leaves_the_counts(spark, folder, tmp_path):
    place, put = folder
    state = str(tmp_path / "state")
    put("day0", session_rows(0))
    tm.update_counts(spark, pattern(place), state)
    before = rows(tm.kept_kpis(spark, state))
    put("day1", [("s", "A", 1.5)], "SESSION string, EVENT_PATH string, TOTAL_EVENTS double")
    with pytest.raises(SessionDataError):
        tm.update_counts(spark, pattern(place), state)
    assert rows(tm.kept_kpis(spark, state)) == before
    with pytest.raises(ValueError):
        tm.update_counts(spark, pattern(place), state, delimiter=",")


def test_every_file_may_go(spark, folder, tmp_path):
    place, put = folder
    state = str(tmp_path / "state")
    put("day0", session_rows(0))
    tm.update_counts(spark, pattern(place), state)
    (place / "day0.parquet").unlink()
    assert names(tm.update_counts(spark, pattern(place), state).removed) == ["day0.parquet"]
    nothing = spark.createDataFrame([], SESSION_SCHEMA)
    assert rows(tm.kept_kpis(spark, state)) == rows(tm.session_kpis(nothing))
    assert rows(tm.kept_edges(spark, state, "unique")) == []


def test_exports_as_csv(spark, tmp_path):
    place = tmp_path / "exports"
    place.mkdir()
    for i in range(3):
        lines = [f"s{i}{j},A->B{'->C' * i},{j + 1}" for j in range(4)]
        (place / f"day{i}.csv").write_text("\n".join(["SESSION,EVENT_PATH,TOTAL_EVENTS", *lines]) + "\n")
    state = str(tmp_path / "state")
    assert len(tm.update_counts(spark, str(place), state).read) == 3
    sessions = tm.read_csv(spark, str(place))
    assert rows(tm.kept_kpis(spark, state)) == rows(tm.session_kpis(sessions))
    found = tm.kept_search(spark, str(place), state, event="C", subpath="C->C")
    assert sorted(r["SESSION"] for r in found.collect()) == [f"s2{j}" for j in range(4)]


# Searches that skip files --------------------------------------------------------------------


def test_a_rare_event_is_looked_for_in_its_files_only(spark, folder, tmp_path):
    place, put = folder
    state = str(tmp_path / "state")
    for i in range(8):
        put(f"day{i}", session_rows(i))
    put("day5", [*session_rows(5), ("rare", "A-> Gold ->B", 3)])
    tm.update_counts(spark, pattern(place), state)
    # one file changes later: it has to be searched whatever was counted
    put("day2", [*session_rows(2), ("late", "Gold", 1)])
    wanted = {"event": "Gold"}
    files = tm.files_to_search(spark, pattern(place), state, **wanted)
    assert names(files) == ["day2.parquet", "day5.parquet"]
    found = tm.kept_search(spark, pattern(place), state, **wanted)
    assert len(found.inputFiles()) == 2
    assert sorted(rows(found)) == sorted(rows(tm.match_sessions(full(spark, place), **wanted)))


@pytest.mark.parametrize(
    "wanted",
    [
        {"event": "A"},
        {"event": ""},
        {"event": "nowhere"},
        {"subpath": "A->B"},
        {"subpath": " C ->"},
        {"event": "D", "subpath": "B->A"},
        {"min_events": 8},
        {"event": "A", "min_events": 99},
    ],
)
def test_search_equals_a_search_of_everything(spark, folder, tmp_path, wanted):
    place, put = folder
    state = str(tmp_path / "state")
    for i in range(4):
        put(f"day{i}", session_rows(i, n=12, depths=3 + 2 * i))
    tm.update_counts(spark, pattern(place), state)
    found = tm.kept_search(spark, pattern(place), state, **wanted)
    expected = tm.match_sessions(full(spark, place), **wanted)
    assert sorted(rows(found), key=str) == sorted(rows(expected), key=str)


# Percentiles of many depths ------------------------------------------------------------------


def test_percentiles_of_a_million_depths_from_ten_small_rows(spark, tmp_path):
    place, state = str(tmp_path / "many.parquet"), str(tmp_path / "state")
    depth = F.when(F.col("id") % 7 == 0, 5).otherwise(F.pmod(F.xxhash64("id"), F.lit(10**12)))
    table = spark.range(0, 1_100_000, 1, 10).select(
        F.col("id").cast("string").alias("SESSION"), F.lit("A").alias("EVENT_PATH"), depth.alias("TOTAL_EVENTS")
    )
    table.write.parquet(place)
    tm.update_counts(spark, place, state)
    files = kept._state(spark, state, "files")
    assert files.count() == 10
    assert files.agg(F.max(F.size("points"))).head()[0] <= 2 * kept.SLICES + 1
    found = tm.kept_kpis(spark, state).head()
    exact = tm.session_kpis(tm.read_parquet(spark, place)).head()
    assert found["total_sessions"] == exact["total_sessions"]
    assert found["max_events"] == exact["max_events"]
    depths = tm.read_parquet(spark, place).select("TOTAL_EVENTS")
    for name, percent in PERCENTILES.items():
        below = depths.where(F.col("TOTAL_EVENTS") < found[name]).count()
        upto = depths.where(F.col("TOTAL_EVENTS") <= found[name]).count()
        rank = 1_100_000 * percent / 100
        assert below <= rank + kept.RANK_ERROR * 1_100_000
        assert upto >= rank
