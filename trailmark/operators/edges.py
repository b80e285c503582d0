"""Neighbouring events of a path as rows, and their counts.

Pairs come from two shifted copies of one array, inside the row: no self-join, no window and no
sort over events.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmark.functions.tokens import (
    DEFAULT_DELIMITER,
    check_dedupe,
    dedupe_unique,
    drop_blank_events,
    tokenize_path,
    trim_event,
)
from trailmark.operators.pieces import first_places, session_pieces


def _neighbours(events: Column) -> Column:
    """Array of (previous, event), from NULL before the first event to NULL after the last."""
    shifted = F.concat(F.array(F.lit(None).cast("string")), events)
    return F.arrays_zip(shifted.alias("previous"), events.alias("event"))


def neighbour_rows(
    sessions: DataFrame,
    delimiter: str = DEFAULT_DELIMITER,
    *,
    unique: bool = False,
    drop_blanks: bool = False,
) -> DataFrame:
    """(previous, event) for every step of every path.

    ``previous`` is NULL at the first event and ``event`` is NULL after the last one, so a path
    of n events gives n + 1 rows. A NULL path gives none.
    """
    events = tokenize_path(F.col("EVENT_PATH"), delimiter)
    if drop_blanks:
        events = drop_blank_events(events)
    if unique:
        events = dedupe_unique(events)
    # The array is used twice: its own projection keeps the split from being evaluated twice.
    split = sessions.select(events.alias("events"))
    pairs = split.select(F.explode(_neighbours(F.col("events"))).alias("pair"))
    return pairs.select("pair.previous", "pair.event")


def edge_counts(
    sessions: DataFrame,
    delimiter: str = DEFAULT_DELIMITER,
    dedupe: str | None = "none",
    *,
    drop_blanks: bool = False,
) -> DataFrame:
    """(previous, event, n): how often ``event`` follows ``previous`` after dedupe.

    Rows with a NULL ``previous`` count first events, so summing n over ``event`` gives event
    frequencies and the rows with both ends give transitions: one scan and one shuffle of
    partial counts serve both.
    """
    mode = check_dedupe(dedupe)
    rows = neighbour_rows(
        sessions, delimiter, unique=mode == "unique", drop_blanks=drop_blanks
    ).where(F.col("event").isNotNull())
    if mode == "consecutive":
        # Within a collapsed path neighbours always differ, and neighbours that differ are
        # exactly the run boundaries of the raw path.
        rows = rows.where(~F.col("event").eqNullSafe(F.col("previous")))
    return rows.groupBy("previous", "event").agg(F.count(F.lit(1)).alias("n"))


def neighbour_counts(
    sessions: DataFrame,
    delimiter: str = DEFAULT_DELIMITER,
    *,
    unique: bool = False,
    by: Sequence[str] = (),
) -> DataFrame:
    """(blanks, deep, previous, event, n): all neighbours of all paths, counted in one pass.

    A small table that answers frequencies, transitions, matrices, entries and exits without
    another look at the paths, for the modes ``none`` and ``consecutive``. ``blanks`` says what
    a row holds: ``absent`` for paths without blank events, and for the others ``kept`` or
    ``dropped``, each path being counted both ways. ``deep`` is TOTAL_EVENTS > 0. With ``unique``
    only the first place of each event counts, which answers the mode ``unique``. Columns named
    in ``by`` come first, with counts of their own for each value.
    """
    split = sessions.select(
        *by,
        tokenize_path(F.col("EVENT_PATH"), delimiter).alias("events"),
        F.coalesce(F.col("TOTAL_EVENTS") > 0, F.lit(False)).alias("deep"),
    )

    def way(blanks: str, events: Column) -> Column:
        taken = dedupe_unique(events) if unique else events
        return F.struct(F.lit(blanks).alias("blanks"), taken.alias("events"))

    as_is, events = F.col("events"), F.col("way.events")
    ways = F.when(
        F.array_contains(as_is, ""),
        F.array(way("kept", as_is), way("dropped", drop_blank_events(as_is))),
    ).otherwise(F.array(way("absent", as_is)))
    return (
        split.select(*by, "deep", F.explode(ways).alias("way"))
        .select(*by, "way.blanks", "deep", F.explode(_neighbours(events)).alias("pair"))
        .select(*by, "blanks", "deep", "pair.previous", "pair.event")
        .groupBy(*by, "blanks", "deep", "previous", "event")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def edges_from_neighbours(
    counts: DataFrame, dedupe: str | None = "none", *, drop_blanks: bool = False
) -> DataFrame:
    """What ``edge_counts`` gives, out of ``neighbour_counts``; not for the mode ``unique``."""
    mode = check_dedupe(dedupe)
    if mode == "unique":
        raise ValueError("Neighbour counts do not hold the first occurrences of events.")
    unwanted = "kept" if drop_blanks else "dropped"
    rows = counts.where((F.col("blanks") != unwanted) & F.col("event").isNotNull())
    if mode == "consecutive":
        rows = rows.where(~F.col("event").eqNullSafe(F.col("previous")))
    return rows.groupBy("previous", "event").agg(F.sum("n").alias("n"))


def end_counts(counts: DataFrame, end: str) -> DataFrame:
    """(event_name, n) of the first or last events of sessions with a positive depth."""
    here, beyond = ("event", "previous") if end == "entry" else ("previous", "event")
    return (
        counts.where((F.col("blanks") != "dropped") & F.col("deep") & F.col(beyond).isNull())
        .groupBy(F.col(here).alias("event_name"))
        .agg(F.sum("n").alias("n"))
    )


def edges_from_rows(rows: DataFrame, dedupe: str | None = "none", **sizes: int) -> DataFrame:
    """What ``edge_counts`` gives, out of ``session_rows``, for sessions of any length.

    Neighbours are found in pieces of a session, each of which also holds the event before it. For
    the mode ``unique`` the first place of each event is found first; neighbours are those among the
    first places, of which a session has as many as it has different events. ``sizes`` are those of
    ``session_pieces``.
    """
    mode = check_dedupe(dedupe)
    if mode == "unique":
        in_session = Window.partitionBy("session_key").orderBy("position")
        pairs = first_places(rows).select(F.lag("event").over(in_session).alias("previous"), "event")
    else:
        whole = F.concat("before", "events")
        # The first event of a session follows nothing; that of a later piece follows what it carries.
        opened = F.when(F.size("before") == 0, F.array(F.lit(None).cast("string")))
        before = F.concat(F.coalesce(opened, F.array().cast("array<string>")), whole)
        pieces = session_pieces(rows, overlap=1, **sizes).select(before.alias("all"))
        zipped = F.arrays_zip(
            F.col("all").alias("previous"), F.slice("all", F.lit(2), F.size("all")).alias("event")
        )
        pairs = pieces.select(F.explode(zipped).alias("pair")).select("pair.previous", "pair.event")
        pairs = pairs.where(F.col("event").isNotNull())
    if mode == "consecutive":
        pairs = pairs.where(~F.col("event").eqNullSafe(F.col("previous")))
    return pairs.groupBy("previous", "event").agg(F.count(F.lit(1)).alias("n"))


def ends_from_rows(rows: DataFrame, end: str) -> DataFrame:
    """(event_name, n) of the first or last events of the sessions in ``session_rows``."""
    pick = F.min_by if end == "entry" else F.max_by
    named = rows.where(F.col("event").isNotNull())
    ends = named.groupBy("session_key").agg(pick("event", "position").alias("event"))
    return ends.groupBy(trim_event(F.col("event")).alias("event_name")).agg(
        F.count(F.lit(1)).alias("n")
    )
