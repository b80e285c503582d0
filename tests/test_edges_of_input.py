"""Empty tables, clashing names, statements that are no queries, and exact percentiles."""

from __future__ import annotations

import random

import pytest

import trailmark as tm
from conftest import SESSION_SCHEMA, rows


def test_automatic_funnels_on_no_sessions(spark):
    empty = spark.createDataFrame([], SESSION_SCHEMA)
    for frame in (tm.funnel_auto(empty), tm.funnel_preset(empty, "checkout")):
        assert frame.columns == tm.funnel(empty, ["A"]).columns
        assert frame.count() == 0


def test_wide_matrix_with_an_event_named_like_its_key(make):
    wide = tm.transition_matrix_wide(make(("source_event->A->source_event", 3)))
    assert sorted(wide.columns) == ["A", "source_event", "source_event_"]
    found = {r["source_event_"]: (r["source_event"], r["A"]) for r in wide.collect()}
    assert found == {"source_event": (0, 1), "A": (1, 0)}


@pytest.mark.parametrize(
    "statement",
    ["CREATE TABLE t AS SELECT 1 AS a", "INSERT INTO data VALUES (1)", "SET a=1", "DROP VIEW data",
     "WITH x AS (SELECT 1) INSERT INTO data SELECT * FROM x"],
)
def test_only_queries_run(base, statement):
    with pytest.raises(Exception, match="Only queries"):
        tm.sql_on_data(base, statement)


def test_the_callers_view_and_the_row_limit(spark, base):
    spark.sql("SELECT 1 AS own").createOrReplaceTempView("data")
    found = tm.sql_on_data(base, "SELECT * FROM data", max_rows=4)
    assert spark.table("data").columns == ["own"]
    assert found.count() == 4
    with pytest.raises(tm.RowLimitError, match="row limit"):
        tm.sql_on_data(base, "SELECT * FROM data", max_rows=3)
    spark.catalog.dropTempView("data")


@pytest.mark.parametrize("kind", ["double", "bigint"])
def test_percentiles_are_exact_with_very_many_depths(spark, kind):
    rng = random.Random(5)
    depths = [rng.randrange(10**6) / (7 if kind == "double" else 1) for _ in range(20_000)] + [3] * 9_000
    depths = [float(d) if kind == "double" else int(d) for d in depths]
    table = spark.createDataFrame([(d,) for d in depths] + [(None,)] * 5, f"TOTAL_EVENTS {kind}")
    found = tm.session_kpis(table.selectExpr("'' AS SESSION", "'' AS EVENT_PATH", "TOTAL_EVENTS")).head()
    ordered = sorted(depths)
    want = [ordered[-(-len(ordered) * p // 100) - 1] for p in (50, 75, 90)]
    assert [found.median_events, found.p75_events, found.p90_events] == want
    assert found.total_sessions == len(depths) + 5 and found.max_events == ordered[-1]


def test_reports_split_the_paths_once(spark, make, tmp_path):
    sessions = make(("A->B->A", 3), ("B", 1))
    report = tm.insights_report(sessions)
    assert rows(report.tables["entry_points"], "event_name", "entry_count") == [("A", 1), ("B", 1)]
    for name in ("entry_points", "exit_points"):
        plan = report.tables[name]._jdf.queryExecution().optimizedPlan().toString()
        assert "EVENT_PATH" not in plan
    analysis = tm.analyze_report(sessions)
    for name in ("events", "transitions"):
        plan = analysis.tables[name]._jdf.queryExecution().optimizedPlan().toString()
        assert "EVENT_PATH" not in plan


def test_a_bound_query_runs_once_and_keeps_its_columns(spark, base):
    """Equal names and columns that are NULL by type are kept; what is returned does not run it again."""
    query = "SELECT SESSION, TOTAL_EVENTS AS x, 2 * TOTAL_EVENTS AS x, NULL AS nothing FROM data ORDER BY SESSION DESC"
    found = tm.sql_on_data(base, query, max_rows=10)
    assert found.columns == ["SESSION", "x", "x", "nothing"]
    assert found.schema["nothing"].dataType.simpleString() == "void"
    assert [tuple(r) for r in found.collect()][0] == ("two", 3, 6, None)
    drawn = tm.sql_on_data(base, "SELECT uuid() AS u FROM data", max_rows=10)
    assert rows(drawn) == rows(drawn)
    assert "LocalTableScan" not in found._jdf.queryExecution().executedPlan().toString()
    assert tm.sql_on_data(base, "SELECT 1 AS x WHERE false", max_rows=0).count() == 0
