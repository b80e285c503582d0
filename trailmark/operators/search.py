"""Session search by event, by contiguous subpath and by depth, and the journey view."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.functions import journeys
from trailmark.functions.tokens import (
    DEFAULT_DELIMITER,
    check_delimiter,
    check_top_n,
    tokenize_path,
)


def match_sessions(
    sessions: DataFrame,
    *,
    event: str | None = None,
    subpath: str | None = None,
    min_events: int = 1,
    delimiter: str = DEFAULT_DELIMITER,
) -> DataFrame:
    """All matching sessions, unordered: (SESSION, EVENT_PATH, TOTAL_EVENTS).

    ``event`` must equal a whole trimmed token. ``subpath`` must occur in the raw path string
    between delimiters, blanks included. The depth filter reaches the Parquet scan.
    """
    check_delimiter(delimiter)
    path = F.col("EVENT_PATH")
    found = sessions.where(F.col("TOTAL_EVENTS") >= min_events)
    if event:
        # The text test is implied by the token test and spares splitting most rows.
        found = found.where(
            path.contains(event) & F.array_contains(tokenize_path(path, delimiter), event)
        )
    if subpath:
        fence = F.lit(delimiter)
        fenced = F.concat(fence, path, fence)
        found = found.where(
            path.contains(subpath) & fenced.contains(delimiter + subpath + delimiter)
        )
    return found.select("SESSION", "EVENT_PATH", "TOTAL_EVENTS")


def search_sessions(
    sessions: DataFrame,
    *,
    event: str | None = None,
    subpath: str | None = None,
    min_events: int = 1,
    limit: int = 50,
    delimiter: str = DEFAULT_DELIMITER,
    ordered: bool = True,
) -> DataFrame:
    """Up to ``limit`` matching sessions, by SESSION so that the answer is repeatable.

    ``ordered=False`` returns any matching rows and lets Spark stop reading once it has enough.
    """
    found = match_sessions(
        sessions, event=event, subpath=subpath, min_events=min_events, delimiter=delimiter
    )
    if ordered:
        found = found.orderBy("SESSION", "EVENT_PATH", "TOTAL_EVENTS")
    return found.limit(check_top_n(limit, "limit"))


def session_journeys(
    sessions: DataFrame,
    *,
    event: str | None = None,
    subpath: str | None = None,
    delimiter: str = DEFAULT_DELIMITER,
) -> DataFrame:
    """Sessions with their run-length journey, match positions and preview.

    Columns (SESSION, TOTAL_EVENTS, match_positions, groups, preview, hidden_groups).
    """
    marked = (
        sessions.select(
            "SESSION",
            "TOTAL_EVENTS",
            journeys.journey_steps(F.col("EVENT_PATH"), delimiter).alias("steps"),
        )
        .withColumn("flags", journeys.match_flags(F.col("steps"), event, subpath, delimiter))
        .withColumn("groups", journeys.compress_journey(F.col("steps"), F.col("flags")))
        .withColumn("preview", journeys.preview_groups(F.col("groups")))
    )
    return marked.select(
        "SESSION",
        "TOTAL_EVENTS",
        journeys.match_positions(F.col("flags")).alias("match_positions"),
        "groups",
        "preview",
        journeys.hidden_group_count(F.col("groups"), F.col("preview")).alias("hidden_groups"),
    )
