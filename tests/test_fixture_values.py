"""Known answers on the four-session fixture and on the edge rows."""

from __future__ import annotations

import pytest

import trailmark as tm
from conftest import mapping, rows


@pytest.mark.parametrize(
    "mode, counts",
    [
        ("none", {"A": 6, "B": 4, "C": 1}),
        ("consecutive", {"A": 5, "B": 4, "C": 1}),
        ("unique", {"A": 4, "B": 4, "C": 1}),
    ],
)
def test_frequencies(base, mode, counts):
    found = tm.event_frequencies(base, dedupe=mode)
    assert mapping(found, "event_name", "occurrence_count") == counts


def test_frequency_shares_are_of_all_events_before_the_limit(base):
    found = tm.event_frequencies(base, top_n=2)
    assert rows(found, "event_name", "percentage") == [("A", 54.55), ("B", 36.36)]


def test_transition_pairs(base):
    raw = mapping(tm.transition_pairs(base), "transition", "transition_count")
    assert raw == {"A -> B": 3, "B -> A": 2, "A -> A": 1, "B -> C": 1}
    deduped = mapping(
        tm.transition_pairs(base, dedupe="consecutive"), "transition", "transition_count"
    )
    assert deduped == {"A -> B": 3, "B -> A": 2, "B -> C": 1}


@pytest.mark.parametrize("mode, self_loops", [("none", 1), ("consecutive", 0), ("unique", 0)])
def test_matrix(base, mode, self_loops):
    cells = {
        (r.source_event, r.target_event): r.transition_count
        for r in tm.transition_matrix(base, top_n=3, dedupe=mode).collect()
    }
    assert len(cells) == 9
    assert cells["A", "A"] == self_loops
    assert cells["A", "B"] == 3
    assert cells["B", "A"] == (1 if mode == "unique" else 2)
    assert cells["C", "A"] == 0


def test_matrix_wide_is_square_in_rank_order(base):
    wide = tm.transition_matrix_wide(base, top_n=3)
    assert wide.columns == ["source_event", "A", "B", "C"]
    assert rows(wide) == [("A", 1, 3, 0), ("B", 2, 0, 1), ("C", 0, 0, 0)]


def test_matrix_wide_of_nothing(make):
    assert rows(tm.transition_matrix_wide(make((None, 1)))) == []


def test_ordered_funnel_with_repeated_step(base):
    found = tm.funnel(base, ["A", "B", "A"])
    assert rows(found) == [
        (1, "A", 4, 100.0, 0.0, 100.0),
        (2, "B", 3, 75.0, 25.0, 75.0),
        (3, "A", 1, 33.33, 66.67, 25.0),
    ]
    same = tm.funnel(base, ["A", "B", "A"], dedupe="consecutive")
    assert [r.session_count for r in same.collect()] == [4, 3, 1]


@pytest.mark.parametrize("mode, last", [("none", 1), ("consecutive", 0), ("unique", 0)])
def test_funnel_steps_that_repeat_depend_on_dedupe(base, mode, last):
    assert rows(tm.funnel(base, ["A", "A", "B"], dedupe=mode), "session_count")[-1] == (last,)


def test_reach_funnel(base):
    found = tm.funnel(base, ["A", "B", "C"], sequential=False)
    assert rows(found, "session_count", "step_conversion_pct") == [
        (4, 100.0), (4, 100.0), (1, 25.0),
    ]


def test_reach_funnel_may_rise(base):
    found = rows(tm.funnel(base, ["C", "A"], sequential=False))
    assert found[1] == (2, "A", 4, 400.0, -300.0, 400.0)


@pytest.mark.parametrize("steps, text", [(["A", " "], "cannot be empty"), ([], "at least one")])
def test_funnel_rejects_bad_steps(base, steps, text):
    with pytest.raises(ValueError, match=text):
        tm.funnel(base, steps)


def test_funnel_rejects_a_plain_string(base):
    with pytest.raises(ValueError, match="list of event names"):
        tm.funnel(base, "A,B")


def test_funnel_steps_may_hold_a_comma(make):
    found = tm.funnel(make(("a,b->c", 2)), ["a,b", " c "])
    assert rows(found, "step_name", "session_count") == [("a,b", 1), ("c", 1)]


def test_funnel_report(base):
    found = tm.funnel_report(tm.funnel(base, ["A", "B", "A"]))
    assert rows(found, "bar_share", "severity") == [(1.0, "start"), (0.75, "ok"), (0.25, "warn")]


def test_entries_exits_paths_and_kpis(base):
    assert rows(tm.entry_events(base)) == [("A", 3, 75.0), ("B", 1, 25.0)]
    assert rows(tm.exit_events(base)) == [("A", 2, 50.0), ("B", 1, 25.0), ("C", 1, 25.0)]
    assert rows(tm.top_paths(base), "session_count", "share_percent") == [(1, 25.0)] * 4
    assert rows(tm.session_kpis(base)) == [(4, 0, 0.0, 2.75, 3, 3, 3, 3)]


def test_search_by_event_matches_tokens(base):
    assert tm.search_sessions(base, event="A").count() == 4
    assert tm.search_sessions(base, event="A->B").count() == 0


def test_search_by_subpath_keeps_event_boundaries(base, make):
    assert rows(tm.search_sessions(base, subpath="A->B"), "SESSION") == [
        ("one",), ("three",), ("two",),
    ]
    assert tm.search_sessions(make(("XA->B", 2), ("A->BX", 2)), subpath="A->B").count() == 0


def test_search_limit_and_depth(base):
    assert tm.search_sessions(base, min_events=3, limit=2).count() == 2
    assert tm.search_sessions(base, min_events=4).count() == 0
    assert tm.search_sessions(base, limit=3, ordered=False).count() == 3


def test_sql_on_data(base):
    found = tm.sql_on_data(base, "SELECT 'metadata' AS label, COUNT(*) AS count FROM data")
    assert rows(found) == [("metadata", 4)]
    with pytest.raises(tm.RowLimitError, match="row limit"):
        tm.sql_on_data(base, "SELECT * FROM data", max_rows=2)
    assert tm.sql_on_data(base, "SELECT * FROM data", max_rows=4).count() == 4


@pytest.mark.parametrize(
    "operator", [tm.event_frequencies, tm.top_paths, tm.transition_pairs, tm.transition_matrix]
)
def test_unknown_dedupe_mode_is_refused(base, operator):
    with pytest.raises(ValueError, match="Unknown dedupe mode"):
        operator(base, dedupe="adjacent")
    with pytest.raises(ValueError, match="top_n"):
        operator(base, top_n=0)


# Edge rows -----------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "mode, expected",
    [
        ("none", [("A", 10, 62.5), ("B", 6, 37.5)]),
        ("consecutive", [("A", 9, 60.0), ("B", 6, 40.0)]),
        ("unique", [("A", 8, 57.14), ("B", 6, 42.86)]),
    ],
)
def test_edge_frequencies(edge, mode, expected):
    assert rows(tm.event_frequencies(edge, dedupe=mode)) == expected


@pytest.mark.parametrize(
    "mode, expected",
    [
        ("none", {("A", "A"): 2, ("A", "B"): 6}),
        ("consecutive", {("A", "B"): 6}),
        ("unique", {("A", "B"): 6}),
    ],
)
def test_edge_matrix(edge, mode, expected):
    cells = tm.transition_matrix(edge, dedupe=mode).where("transition_count > 0").collect()
    assert {(r.source_event, r.target_event): r.transition_count for r in cells} == expected


def test_edge_pairs_do_not_bridge_blanks(edge):
    found = mapping(tm.transition_pairs(edge), "transition", "transition_count")
    assert found == {"A -> B": 6, "A -> A": 1}


def test_edge_paths(edge):
    plain = tm.top_paths(edge)
    assert [r.session_count for r in plain.collect()] == [1] * 7
    assert {r.share_percent for r in plain.collect()} == {10.0}
    for mode in ("consecutive", "unique"):
        top = rows(tm.top_paths(edge, dedupe=mode))[0]
        assert top == ("A->B", 2, 2, 20.0)
    both = tm.top_paths(edge, dedupe="consecutive").where("full_path = 'A->B'")
    assert {(r.TOTAL_EVENTS, r.session_count) for r in both.collect()} == {(2, 2), (3, 1)}


def test_edge_entries_and_exits(edge):
    assert rows(tm.entry_events(edge)) == [("A", 6, 85.71)]
    assert rows(tm.exit_events(edge)) == [("B", 3, 42.86), ("A", 2, 28.57)]
    assert rows(tm.exit_events(edge, top_n=1)) == [("B", 3, 42.86)]


def test_edge_kpis(edge):
    assert rows(tm.session_kpis(edge)) == [(10, 3, 30.0, 1.56, 2, 2, 3, 3)]


def test_sketched_kpis_agree_on_few_depths(edge, base):
    for table in (edge, base):
        assert rows(tm.session_kpis(table, approximate=True)) == rows(tm.session_kpis(table))


def test_edge_search(edge):
    found = tm.search_sessions(edge, event="A", subpath="A->B")
    assert rows(found, "SESSION") == [("e10",), ("e5",), ("e9",)]
    assert "e1" in [r.SESSION for r in tm.search_sessions(edge).collect()]
    padded = tm.search_sessions(edge, event="B")
    assert "e6" in [r.SESSION for r in padded.collect()]


def test_edge_funnel_keeps_sessions_without_a_path(edge):
    assert rows(tm.funnel(edge, ["A"]))[0] == (1, "A", 8, 80.0, 20.0, 100.0)


def test_pipe_delimiter(make):
    table = make(("a|b", 2))
    assert rows(tm.transition_pairs(table, delimiter="|"), "transition") == [("a -> b",)]
    assert rows(tm.exit_events(table, delimiter="|"), "event_name") == [("b",)]


def test_empty_table(spark):
    empty = spark.createDataFrame([], "SESSION string, EVENT_PATH string, TOTAL_EVENTS bigint")
    assert rows(tm.session_kpis(empty)) == [(0, 0, 0.0, None, None, None, None, None)]
    assert rows(tm.funnel(empty, ["A", "B"])) == [
        (1, "A", 0, 0.0, 100.0, 0.0), (2, "B", 0, 0.0, 100.0, 0.0),
    ]
    for operator in (tm.event_frequencies, tm.top_paths, tm.transition_pairs,
                     tm.transition_matrix, tm.entry_events, tm.exit_events):
        assert rows(operator(empty)) == []
    assert rows(tm.flow_links(tm.transition_matrix(empty))) == []


def test_browser_fixture_links(make):
    table = make(("Home->Search->Checkout", 3), ("Home->Search", 2), ("Home->Checkout", 2),
                 ("Search->Checkout", 2))
    links = tm.flow_links(tm.transition_matrix(table, top_n=10, dedupe="consecutive"))
    assert {(r.source_event, r.target_event): r.value for r in links.collect()} == {
        ("Home", "Search"): 2, ("Search", "Checkout"): 2, ("Home", "Checkout"): 1,
    }
    nodes = {(r.side, r.event_name): r.total for r in tm.flow_nodes(links).collect()}
    assert nodes == {("source", "Home"): 3, ("source", "Search"): 2, ("target", "Search"): 2,
                     ("target", "Checkout"): 3}
    preset = tm.funnel_preset(table, "checkout")
    assert rows(preset, "step_name", "session_count") == [
        ("Home", 3), ("Search", 2), ("Checkout", 1),
    ]
    assert [r.step_name for r in tm.funnel_auto(table, top_n=2).collect()] == ["Checkout", "Home"]
    with pytest.raises(ValueError, match="Unknown funnel preset"):
        tm.funnel_preset(table, "other")


def test_heatmap_bands(make):
    table = make(*[("A->B", 2)] * 10, *[("B->C", 2)] * 5, *[("C->A", 2)] * 1)
    bands = {
        (r.source_event, r.target_event): (r.band, r.opacity)
        for r in tm.heatmap_cells(tm.transition_matrix(table)).collect()
    }
    assert bands["A", "B"] == ("peak", 1.0)
    assert bands["B", "C"] == ("high", 0.5)
    assert bands["C", "A"] == ("low", 0.15)
    assert bands["A", "A"] == ("none", 0.0)


def test_reports(base):
    long = tm.analyze_report(base, steps=["A", "B"], dedupe="none").long()
    found = {(r.section, r.rank): (r.label, r.value) for r in long.collect()}
    assert found["events", 1] == ("A", 6.0)
    assert found["transitions", 1] == ("A -> B", 3.0)
    assert found["funnel", 2] == ("B", 3.0)
    kpis = {r.label: r.value for r in tm.insights_report(base).long().collect()
            if r.section == "kpis"}
    assert kpis["avg_events_per_session"] == 2.75


def test_neighbour_summary_agrees_with_the_direct_counts(edge):
    from trailmark.operators import edges

    counts = edges.neighbour_counts(edge)
    for mode in ("none", "consecutive"):
        for drop in (False, True):
            direct = edges.edge_counts(edge, dedupe=mode, drop_blanks=drop)
            again = edges.edges_from_neighbours(counts, mode, drop_blanks=drop)
            assert sorted(rows(again), key=str) == sorted(rows(direct), key=str)
    assert set(rows(edges.end_counts(counts, "exit"))) == {("A", 2), ("B", 3), ("", 2)}
    with pytest.raises(ValueError, match="first occurrences"):
        edges.edges_from_neighbours(counts, "unique")
    full = tm.session_report(edge, dedupe="unique", matrix_dedupe="unique").long().collect()
    assert ("matrix", "A -> B", 6.0) in {(r.section, r.label, r.value) for r in full}
