"""Counts over sessions: event frequencies, entries, exits and KPIs.

Each aggregate shuffles partially aggregated rows once. Totals are scalar subqueries over the
same grouped rows, so Spark reads the input once and reuses the exchange; no window ever runs
over an unbounded number of groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.functions.rates import rate_percent, share_percent
from trailmark.functions.tokens import (
    DEFAULT_DELIMITER,
    check_dedupe,
    check_top_n,
    dedupe_unique,
    first_event,
    last_event,
    tokenize_path,
)
from trailmark.operators.edges import neighbour_rows


# The depth percentiles reported.
PERCENTILES = {"median_events": 50, "p75_events": 75, "p90_events": 90}
SKETCH_ACCURACY = 10_000


def _event_rows(sessions: DataFrame, delimiter: str, mode: str) -> DataFrame:
    """One row per event of the deduplicated paths: (event_name)."""
    if mode == "consecutive":
        # An event survives when it opens a run: comparing neighbours needs no lambda.
        rows = neighbour_rows(sessions, delimiter)
        return rows.where(
            F.col("event").isNotNull() & ~F.col("event").eqNullSafe(F.col("previous"))
        ).select(F.col("event").alias("event_name"))
    events = tokenize_path(F.col("EVENT_PATH"), delimiter)
    if mode == "unique":
        events = dedupe_unique(events)
    return sessions.select(F.explode(events).alias("event_name"))


def rank_frequencies(counts: DataFrame, top_n: int) -> DataFrame:
    """Top events with their share of all counted events, from (event_name, occurrence_count)."""
    total = counts.agg(F.sum("occurrence_count")).scalar()
    return (
        counts.orderBy(F.desc("occurrence_count"), "event_name")
        .limit(check_top_n(top_n))
        .withColumn("percentage", share_percent(F.col("occurrence_count"), total))
    )


def frequencies_from_edges(edges: DataFrame, top_n: int) -> DataFrame:
    """Event frequencies out of ``edge_counts`` rows."""
    counts = (
        edges.where(F.col("event") != "")
        .groupBy(F.col("event").alias("event_name"))
        .agg(F.sum("n").alias("occurrence_count"))
    )
    return rank_frequencies(counts, top_n)


def event_frequencies(
    sessions: DataFrame,
    *,
    delimiter: str = DEFAULT_DELIMITER,
    top_n: int = 20,
    dedupe: str | None = "none",
) -> DataFrame:
    """(event_name, occurrence_count, percentage) of the most frequent events.

    Blank events are dropped after dedupe; the percentage is of all events, before the limit.
    """
    counts = (
        _event_rows(sessions, delimiter, check_dedupe(dedupe))
        .where(F.col("event_name") != "")
        .groupBy("event_name")
        .agg(F.count(F.lit(1)).alias("occurrence_count"))
    )
    return rank_frequencies(counts, top_n)


def rank_ends(counts: DataFrame, end: str, top_n: int) -> DataFrame:
    """Top entry or exit events with their share, from (event_name, n).

    Blank events count in the total but are not reported. They sort last and go after the
    limit, so that the total and the ranking read one and the same aggregate.
    """
    total = counts.agg(F.sum("n")).scalar()
    return (
        counts.orderBy(F.col("event_name") == "", F.desc("n"), "event_name")
        .limit(check_top_n(top_n))
        .where(F.col("event_name") != "")
        .select(
            "event_name",
            F.col("n").alias(f"{end}_count"),
            share_percent(F.col("n"), total).alias(f"{end}_share_pct"),
        )
    )


def path_ends(sessions: DataFrame, delimiter: str = DEFAULT_DELIMITER) -> DataFrame:
    """(entry, exit, n): how many sessions with a positive depth start and end so."""
    path = F.col("EVENT_PATH")
    return (
        sessions.where(path.isNotNull() & (F.col("TOTAL_EVENTS") > 0))
        .select(first_event(path, delimiter).alias("entry"), last_event(path, delimiter).alias("exit"))
        .groupBy("entry", "exit")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _end_events(sessions: DataFrame, event: Column, end: str, top_n: int) -> DataFrame:
    counts = (
        sessions.where(F.col("EVENT_PATH").isNotNull() & (F.col("TOTAL_EVENTS") > 0))
        .select(event.alias("event_name"))
        .groupBy("event_name")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return rank_ends(counts, end, top_n)


def entry_events(
    sessions: DataFrame, *, delimiter: str = DEFAULT_DELIMITER, top_n: int = 10
) -> DataFrame:
    """(event_name, entry_count, entry_share_pct) of the first events."""
    event = first_event(F.col("EVENT_PATH"), delimiter)
    return _end_events(sessions, event, "entry", top_n)


def exit_events(
    sessions: DataFrame, *, delimiter: str = DEFAULT_DELIMITER, top_n: int = 10
) -> DataFrame:
    """(event_name, exit_count, exit_share_pct) of the last events.

    A path that ends with a delimiter has a blank last event and is not reported.
    """
    event = last_event(F.col("EVENT_PATH"), delimiter)
    return _end_events(sessions, event, "exit", top_n)


def session_kpis(sessions: DataFrame, *, approximate: bool = False) -> DataFrame:
    """One row of key figures over all sessions, NULL paths and NULL depths included.

    Percentiles are discrete and exact. They are taken in the same aggregate as the other figures: each
    task sends how often each depth occurs, one counter for each different depth.
    ``approximate`` sketches them instead, in a state whose size does not depend on how many different
    depths there are; use it for depths that are hardly ever equal.
    """
    depth = F.col("TOTAL_EVENTS")
    if approximate:
        percentiles = F.percentile_approx(depth, [p / 100 for p in PERCENTILES.values()], SKETCH_ACCURACY)
    else:
        shares = ", ".join(str(p / 100) for p in PERCENTILES.values())
        percentiles = F.expr(f"percentile_disc(array({shares})) WITHIN GROUP (ORDER BY TOTAL_EVENTS)")
    figures = sessions.agg(
        F.count(F.lit(1)).alias("total_sessions"),
        F.count_if(depth == 1).alias("single_event_bounces"),
        F.avg(depth).alias("avg_events_per_session"),
        percentiles.alias("percentiles"),
        F.max(depth).alias("max_events"),
    )
    kind = sessions.schema["TOTAL_EVENTS"].dataType
    return figures.select(
        "total_sessions",
        "single_event_bounces",
        rate_percent(F.col("single_event_bounces"), F.col("total_sessions")).alias(
            "bounce_rate_pct"
        ),
        F.round("avg_events_per_session", 2).alias("avg_events_per_session"),
        *[F.get("percentiles", F.lit(i)).cast(kind).alias(name) for i, name in enumerate(PERCENTILES)],
        "max_events",
    )
