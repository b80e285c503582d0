"""Relations that must hold on any data, on generated sessions."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import trailmark as tm
from trailmark.sources.synthetic import FOLLOW_UPS, SHOP_EVENTS, START_EVENTS

ALL = 10_000


@pytest.fixture(scope="module")
def generated(spark):
    return tm.generate_sessions(spark, 20_000, seed=7).persist()


def counts(frame, column):
    return {r[0]: r[1] for r in frame.select("event_name", column).collect()}


def test_generator(spark, generated):
    facts = generated.agg(
        F.count(F.lit(1)).alias("n"),
        F.countDistinct("SESSION").alias("ids"),
        F.min("TOTAL_EVENTS").alias("low"),
        F.max("TOTAL_EVENTS").alias("high"),
        F.avg("TOTAL_EVENTS").alias("mean"),
        F.count_if(~F.col("SESSION").rlike("^SESS_[0-9A-F]{12}$")).alias("odd"),
    ).head()
    assert (facts.n, facts.ids, facts.low, facts.high, facts.odd) == (20_000, 20_000, 1, 8, 0)
    assert 3.0 < facts.mean < 3.2  # the length weights average 3.09
    assert {r.event_name for r in tm.entry_events(generated).collect()} == set(START_EVENTS)
    other = tm.generate_sessions(spark, 20_000, seed=7, partitions=3)
    assert generated.exceptAll(other).isEmpty()
    assert not generated.exceptAll(tm.generate_sessions(spark, 20_000, seed=8)).isEmpty()


def test_generator_follows_the_transition_lists(generated):
    for r in tm.transition_pairs(generated, top_n=ALL).collect():
        assert r.target_event in FOLLOW_UPS.get(r.source_event, SHOP_EVENTS)


def test_depth_is_path_length_and_pairs_are_one_less(generated):
    total = generated.agg(F.sum("TOTAL_EVENTS").alias("n")).head().n
    events = tm.event_frequencies(generated, top_n=ALL)
    assert events.agg(F.sum("occurrence_count")).head()[0] == total
    pairs = tm.transition_pairs(generated, top_n=ALL).agg(F.sum("transition_count")).head()[0]
    assert pairs == total - 20_000


def test_shares_add_up(generated):
    for mode in ("none", "consecutive", "unique"):
        events = tm.event_frequencies(generated, dedupe=mode, top_n=ALL)
        assert abs(events.agg(F.sum("percentage")).head()[0] - 100) < 0.1
    for ends in (tm.entry_events(generated), tm.exit_events(generated)):
        assert abs(ends.agg(F.sum(ends.columns[2])).head()[0] - 100) < 0.1


def test_dedupe_modes_only_remove(generated):
    none, consecutive, unique = (
        counts(tm.event_frequencies(generated, dedupe=m, top_n=ALL), "occurrence_count")
        for m in ("none", "consecutive", "unique")
    )
    assert all(unique[e] <= consecutive[e] <= none[e] for e in none)


def test_entries_and_exits_cover_all_sessions(generated):
    entries = counts(tm.entry_events(generated, top_n=ALL), "entry_count")
    exits = counts(tm.exit_events(generated, top_n=ALL), "exit_count")
    assert sum(entries.values()) == sum(exits.values()) == 20_000


@pytest.mark.parametrize("mode", ["none", "consecutive", "unique"])
def test_ordered_funnel_never_rises_and_stays_below_reach(generated, mode):
    steps = ["Home", "Product_View", "Add_To_Cart", "Checkout", "Payment"]
    ordered = [r.session_count for r in tm.funnel(generated, steps, dedupe=mode).collect()]
    reach = [r.session_count for r in
             tm.funnel(generated, steps, dedupe=mode, sequential=False).collect()]
    assert ordered == sorted(ordered, reverse=True)
    assert all(o <= r for o, r in zip(ordered, reach))
    assert ordered[0] == reach[0]


def test_matrix_agrees_with_pairs(generated):
    pairs = {(r.source_event, r.target_event): r.transition_count
             for r in tm.transition_pairs(generated, top_n=ALL, dedupe="consecutive").collect()}
    matrix = tm.transition_matrix(generated, top_n=ALL, dedupe="consecutive").collect()
    assert {(r.source_event, r.target_event): r.transition_count
            for r in matrix if r.transition_count} == pairs
    assert len(matrix) == len(SHOP_EVENTS) ** 2


def test_search_agrees_with_reach(generated):
    reach = tm.funnel(generated, ["Payment"], sequential=False).head().session_count
    assert tm.match_sessions(generated, event="Payment").count() == reach


def test_kpis_agree_with_sorted_depths(generated):
    depths = sorted(r.TOTAL_EVENTS for r in generated.select("TOTAL_EVENTS").collect())
    kpis = tm.session_kpis(generated).head()
    for name, percent in (("median_events", 50), ("p75_events", 75), ("p90_events", 90)):
        assert kpis[name] == depths[-(-len(depths) * percent // 100) - 1]
