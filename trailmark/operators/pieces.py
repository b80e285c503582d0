"""Analyses of sessions of any length: rows in bounded pieces, and states that merge along them.

A session in the row form (``session_rows``, ``keyed_rows``) is cut by position into pieces of a fixed
number of events. A piece is one array, so the column functions for paths work on it. What an
analysis needs to know of a piece is a small state; the states of neighbouring pieces merge to
that of both, first within a part of a session, which is one group of the shuffle that made the
pieces, then over its parts. No task holds a long session whole, and a short one is a single piece.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmark.functions.tokens import trim_event

#: Events of a piece, and pieces of a part.
PIECE_EVENTS, PART_PIECES = 4_096, 32


def session_pieces(
    rows: DataFrame,
    *,
    piece_events: int = PIECE_EVENTS,
    part_pieces: int = PART_PIECES,
    overlap: int = 0,
    ahead: int = 0,
    trimmed: bool = True,
) -> DataFrame:
    """(session_key, part, piece, before, events, after, n_rows): the events of each session in pieces.

    ``events`` are in order, and trimmed unless that is not wanted. ``before`` holds up to ``overlap``
    events that precede them, ``after`` up to ``ahead`` events that follow.
    ``n_rows`` also counts the rows without an event or position, which belong to the first piece, so
    that a session without any named event has one piece without events.
    """
    if not 0 <= min(overlap, ahead) <= max(overlap, ahead) <= piece_events:
        raise ValueError("What a piece shares with its neighbours cannot exceed a piece.")
    at = F.coalesce(F.col("position"), F.lit(1)) - 1
    own = F.floor(at / piece_events).cast("bigint")
    event = trim_event(F.col("event")) if trimmed else F.col("event")
    laid = rows.select(
        "session_key", "position", event.alias("event"), own.alias("piece"), F.lit(0).alias("side")
    )
    if overlap or ahead:
        # The last events of a piece are given to the next one as well, the first to the one before.
        into = F.col("position") - F.col("piece") * piece_events
        copies = [(F.lit(True), 0), (into > piece_events - overlap, 1), (into <= ahead, -1)]
        places = [
            F.when(F.coalesce(wanted, F.lit(False)) & (F.col("piece") + side >= 0), F.lit(side))
            for wanted, side in copies
        ]
        laid = laid.withColumn("side", F.explode(F.array_compact(F.array(*places))))
        laid = laid.withColumn("piece", F.col("piece") + F.col("side"))
    part = F.floor(F.col("piece") / part_pieces).cast("bigint").alias("part")
    placed = laid.select("*", part).repartition("session_key", "part")

    def in_order(side: int) -> Column:
        if not {1: overlap, 0: 1, -1: ahead}[side]:
            return F.array().cast("array<string>")
        kept = F.when(F.col("event").isNotNull() & (F.col("side") == side), F.struct("position", "event"))
        return F.sort_array(F.collect_list(kept)).getField("event")

    pieces = placed.groupBy("session_key", "part", "piece").agg(
        in_order(1).alias("before"),
        in_order(0).alias("events"),
        in_order(-1).alias("after"),
        F.count_if(F.col("side") == 0).alias("n_rows"),
    )
    return pieces.where("n_rows > 0") if overlap or ahead else pieces


def first_places(rows: DataFrame) -> DataFrame:
    """(session_key, position, event): each trimmed event of a session once, at its first place.

    The places are counted anew from 1. A session has as many rows as different events: the window
    that counts them is bounded by the vocabulary, not by the session.
    """
    named = rows.where(F.col("event").isNotNull())
    firsts = named.groupBy("session_key", trim_event(F.col("event")).alias("event")).agg(
        F.min("position").alias("first")
    )
    in_session = Window.partitionBy("session_key").orderBy("first")
    return firsts.select(
        "session_key", F.row_number().over(in_session).cast("bigint").alias("position"), "event"
    )


def merged(
    pieces: DataFrame, state: Column, merge: Callable[[Column, Column], Column]
) -> DataFrame:
    """(session_key, state): the states of all pieces of each session, merged from left to right."""

    def folded(groups: DataFrame, place: str) -> DataFrame:
        listed = F.sort_array(F.collect_list(F.struct(place, "state"))).getField("state")
        rest = F.slice("states", F.lit(2), F.size("states"))
        return groups.agg(listed.alias("states")).withColumn(
            "state", F.aggregate(rest, F.get("states", F.lit(0)), merge)
        ).drop("states")

    made = pieces.select("session_key", "part", "piece", state.alias("state"))
    parts = folded(made.groupBy("session_key", "part"), "piece")
    return folded(parts.groupBy("session_key"), "part")
