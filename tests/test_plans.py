"""What the plans must look like to hold at scale."""

from __future__ import annotations

import re

import pytest

import registry
import trailmark as tm


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plans") / "sessions.parquet")
    tm.generate_sessions(spark, 2_000).write.parquet(path)
    return spark.read.parquet(path)


def final_plan(frame) -> str:
    """The executed plan after a run, without the initial plan of adaptive execution."""
    frame.collect()
    text = frame._jdf.queryExecution().executedPlan().toString()
    kept, skip_from = [], None
    for line in text.splitlines():
        depth = len(line) - len(line.lstrip(" :+-"))
        if skip_from is not None and depth >= skip_from:
            continue
        skip_from = depth if "== Initial Plan ==" in line else None
        if skip_from is None:
            kept.append(line)
    return "\n".join(kept)


ANALYSES = {
    "frequencies": lambda s: tm.event_frequencies(s, dedupe="none"),
    "frequencies_consecutive": lambda s: tm.event_frequencies(s, dedupe="consecutive"),
    "frequencies_unique": lambda s: tm.event_frequencies(s, dedupe="unique"),
    "pairs": lambda s: tm.transition_pairs(s, dedupe="consecutive"),
    "matrix": lambda s: tm.transition_matrix(s, dedupe="consecutive"),
    "entry": tm.entry_events,
    "exit": tm.exit_events,
    "funnel": lambda s: tm.funnel(s, ["Home", "Search", "Checkout"], dedupe="consecutive"),
    "kpis": tm.session_kpis,
    "top_paths": lambda s: tm.top_paths(s, dedupe="consecutive", min_events=2),
    "kpis_sketched": lambda s: tm.session_kpis(s, approximate=True),
    "heatmap": lambda s: tm.heatmap_cells(tm.transition_matrix(s, dedupe="consecutive")),
    "links": lambda s: tm.flow_links(tm.transition_matrix(s, top_n=10)),
    "nodes": lambda s: tm.flow_nodes(tm.flow_links(tm.transition_matrix(s, top_n=10))),
    "funnel_report": lambda s: tm.funnel_report(tm.funnel(s, ["Home", "Search"])),
    "neighbours": tm.neighbour_counts,
    "search": lambda s: tm.search_sessions(s, event="Home", subpath="Home->Search"),
    "journeys": lambda s: tm.session_journeys(s, event="Home", subpath="Home->Search"),
}


@pytest.mark.parametrize("name", ANALYSES)
def test_one_scan(stored, name):
    scans = final_plan(ANALYSES[name](stored)).count("FileScan parquet")
    assert scans == 1, name


@pytest.mark.parametrize("name", sorted(registry.build()))
def test_no_python_and_no_cross_join(spark, name):
    frame = registry.build()[name](spark, "/root/testdata/sf0.001")
    plan = frame._jdf.queryExecution().executedPlan().toString()
    for operator in ("PythonUDF", "ArrowEvalPython", "BatchEvalPython", "MapInPandas",
                     "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert operator not in plan, operator


def test_columns_and_filters_reach_the_scan(stored):
    kpis = final_plan(tm.session_kpis(stored))
    assert "ReadSchema: struct<TOTAL_EVENTS:bigint>" in kpis
    pairs = final_plan(tm.transition_pairs(stored))
    assert "ReadSchema: struct<EVENT_PATH:string>" in pairs
    found = final_plan(tm.search_sessions(stored, event="Checkout", min_events=4))
    assert "GreaterThanOrEqual(TOTAL_EVENTS,4)" in found
    assert "StringContai" in found  # the plan text is shortened here


def test_counts_are_partial_before_each_shuffle(stored):
    plan = final_plan(tm.transition_pairs(stored))
    assert re.search(r"Exchange hashpartitioning.*\n.*partial_count", plan)


def test_funnel_moves_one_row_per_task(stored):
    plan = final_plan(tm.funnel(stored, ["Home", "Search"]))
    assert plan.count(" Exchange ") == 1 and "partial_count" in plan


def test_paths_are_split_in_code_generation_without_lambdas(stored):
    for name in ("frequencies", "frequencies_consecutive", "frequencies_unique", "pairs",
                 "matrix"):
        assert "lambdafunction" not in final_plan(ANALYSES[name](stored)), name


def test_top_rows_are_taken_without_a_full_sort(stored):
    plan = final_plan(tm.search_sessions(stored, event="Checkout"))
    assert "TakeOrderedAndProject" in plan and "rangepartitioning" not in plan
