"""Sessions from raw rows, against a plain Python reading."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

import trailmark as tm
from conftest import rows

START = datetime(2024, 1, 1)


def expected_sessions(events, gap):
    users = {}
    for event_id, ts, user, kind in events:
        users.setdefault(user, []).append((ts, event_id, kind))
    found = {}
    for user, steps in users.items():
        number, last = 0, None
        for ts, _, kind in sorted(steps):
            if last is None or ts - last > gap:
                number += 1
            last = ts
            found.setdefault((user, number), []).append(kind)
    return {(f"{u}_{n}", "->".join(k), len(k)) for (u, n), k in found.items()}


def random_events(count, users, spread_seconds, seed):
    rng = random.Random(seed)
    # user 0 holds a third of all rows
    return [
        (i, START + timedelta(seconds=rng.randrange(spread_seconds)),
         0 if rng.random() < 1 / 3 else rng.randrange(users), rng.choice("abcd"))
        for i in range(count)
    ]


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
@pytest.mark.parametrize("gap", [60, 3_600, 86_400])
def test_sessionize_matches_plain_python(spark, kind, gap):
    events = random_events(3_000, 40, gap * 300, gap)
    # exact gaps: equal to the gap stays, one second more breaks; also on slot edges
    events += [
        (9_000, START, 99, "x"), (9_001, START + timedelta(seconds=gap), 99, "y"),
        (9_002, START + timedelta(seconds=2 * gap + 1), 99, "z"),
        (9_003, START - timedelta(seconds=gap), 99, "w"),
        (9_005, START, 98, "second"), (9_004, START, 98, "first"),
    ]
    table = spark.createDataFrame(events, "event_id bigint, ts timestamp, user_id bigint, "
                                          "event_type string")
    table = table.withColumn("ts", F.col("ts").cast(kind))
    found = tm.sessionize_events(table, gap_seconds=gap)
    assert set(rows(found)) == expected_sessions(events, timedelta(seconds=gap))


def test_rows_without_a_user_are_kept(spark):
    table = spark.createDataFrame(
        [(1, START, None, "a"), (2, START, None, "b"), (3, START, 5, "c")],
        "event_id bigint, ts timestamp, user_id bigint, event_type string",
    )
    found = rows(tm.sessionize_events(table), "SESSION", "EVENT_PATH", "TOTAL_EVENTS")
    assert sorted(found, key=str) == [("5_1", "c", 1), (None, "a", 1), (None, "b", 1)]
    keyed = tm.keyed_paths(table, key="user_id", order_by=["event_id"], event="event_type")
    assert sorted(rows(keyed, "EVENT_PATH")) == [("a->b",), ("c",)]


def test_events_without_a_time_are_sessions_of_their_own(spark):
    later = START + timedelta(hours=1)
    table = spark.createDataFrame(
        [(4, None, 5, "d"), (3, None, 5, "c"), (1, START, 5, "a"), (2, later, 5, "b"),
         (4, None, 5, None), (9, None, None, "x"), (9, None, None, "x")],
        "event_id bigint, ts timestamp, user_id bigint, event_type string",
    )
    found = rows(tm.sessionize_events(table), "SESSION", "EVENT_PATH", "TOTAL_EVENTS")
    assert sorted(found, key=str) == sorted(
        [("5_1", "a->b", 2), ("5_2", "c", 1), ("5_3", None, 1), ("5_4", "d", 1),
         (None, "x", 1), (None, "x", 1)], key=str)


def test_very_many_events_without_a_user_do_not_end_the_job(spark):
    table = spark.range(30_000).select(
        F.col("id").alias("event_id"),
        F.lit(START).alias("ts"),
        F.lit(None).cast("bigint").alias("user_id"),
        F.repeat(F.lit("e"), 100).alias("event_type"),
    )
    assert tm.sessionize_events(table, max_record=2_000_000).count() == 30_000


def test_unnamed_events_count_but_leave_no_mark(spark):
    hours = [START + timedelta(hours=h) for h in (0, 20, 40, 400)]
    table = spark.createDataFrame(
        [(1, hours[0], 5, None), (2, hours[1], 5, "a"), (3, hours[2], 5, ""), (4, hours[3], 5, None)],
        "event_id bigint, ts timestamp, user_id bigint, event_type string",
    )
    assert set(rows(tm.sessionize_events(table))) == {("5_1", "a->", 3), ("5_2", None, 1)}


def test_oversized_session_fails_instead_of_being_cut(spark):
    table = spark.range(30_000).select(
        F.col("id").alias("event_id"),
        F.lit(START).alias("ts"),
        F.lit(1).alias("user_id"),
        F.repeat(F.lit("e"), 100).alias("event_type"),
    )
    with pytest.raises(Exception, match="exceeds the record limit"):
        tm.sessionize_events(table, max_record=2_000_000).count()
    with pytest.raises(Exception, match="exceeds the record limit"):
        tm.keyed_paths(
            table, key="user_id", order_by=["event_id"], event="event_type", max_record=2_000_000
        ).collect()
    assert tm.sessionize_events(table).head().TOTAL_EVENTS == 30_000


def test_conversations_and_orders(spark):
    talk = spark.createDataFrame(
        [(1, 1, "assistant"), (1, 0, "user"), (2, 0, "user")],
        "conv_id bigint, turn bigint, role string",
    )
    assert sorted(rows(tm.conversation_paths(talk))) == [("1", "user->assistant", 2),
                                                         ("2", "user", 1)]
    orders = spark.createDataFrame(
        [(2, 7, START, "LOW"), (1, 7, START, "HIGH"), (3, 7, START - timedelta(days=1), "MID")],
        "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp, o_orderpriority string",
    )
    assert rows(tm.order_paths(orders)) == [("7", "MID->HIGH->LOW", 3)]


@pytest.mark.parametrize("mode", ["none", "consecutive"])
def test_the_row_form_gives_the_same_answers(spark, mode):
    events = [(i, t if i % 11 else None, u if i % 7 else None, k if i % 13 else None)
              for i, t, u, k in random_events(2_000, 30, 86_400 * 40, 6)]
    table = spark.createDataFrame(events, "event_id bigint, ts timestamp, user_id bigint, event_type string")
    paths, in_rows = tm.sessionize_events(table), tm.session_rows(table)
    assert set(rows(tm.edges_from_rows(in_rows, mode))) == set(rows(tm.edge_counts(paths, dedupe=mode)))
    for end, whole in (("entry", tm.entry_events(paths)), ("exit", tm.exit_events(paths))):
        assert set(rows(tm.ends_from_rows(in_rows, end))) == set(rows(whole, "event_name", f"{end}_count"))


def test_the_row_form_has_no_record_limit(spark):
    table = spark.range(30_000).select(
        F.col("id").alias("event_id"), F.lit(START).alias("ts"),
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("user_id"),
        F.repeat(F.lit("e"), 300).alias("event_type"),
    )
    with pytest.raises(Exception, match="exceeds the record limit"):
        tm.sessionize_events(table, max_record=2_000_000).count()
    found = tm.session_rows(table)
    assert found.count() == 30_000
    assert found.where("SESSION = '1_1'").agg(F.max("position")).head()[0] == 10_001


@pytest.mark.parametrize("mode", ["none", "consecutive"])
def test_keyed_rows_count_as_their_paths(spark, mode):
    rng = random.Random(8)
    turns = [(rng.choice([None, 1, 1, 2, 3, 4]), t, rng.choice(["user", "assistant", " tool ", "", None])) for t in range(600)]
    talk = spark.createDataFrame(turns, "conv_id long, turn int, role string")
    paths, in_rows = tm.conversation_paths(talk), tm.conversation_rows(talk)
    assert set(rows(tm.edges_from_rows(in_rows, mode))) == set(rows(tm.edge_counts(paths, dedupe=mode)))
    for end, whole in (("entry", tm.entry_events(paths)), ("exit", tm.exit_events(paths))):
        assert set(rows(tm.ends_from_rows(in_rows, end))) >= set(rows(whole, "event_name", f"{end}_count"))


def test_keyed_rows_have_no_record_limit(spark):
    talk = spark.range(30_000).selectExpr("id % 2 AS conv_id", "id AS turn", "repeat('r', 300) AS role")
    with pytest.raises(Exception, match="exceeds the record limit"):
        tm.conversation_paths(talk, max_record=2_000_000).count()
    assert tm.conversation_rows(talk).groupBy("SESSION").agg(F.max("position").alias("n")).where("n = 15000").count() == 2
    assert sorted(r.n for r in tm.edges_from_rows(tm.conversation_rows(talk)).collect()) == [2, 29_998]
