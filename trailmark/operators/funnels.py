"""Ordered and reach funnels, their rates, automatic and preset step lists, report bands.

A funnel is one scan and one global aggregate: every session yields its depth in one pass over
its events, tasks send one partial row each, and the step rows are unfolded from the single
result row, so no window or join follows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmark.functions.rates import rate_percent
from trailmark.functions.tokens import (
    DEFAULT_DELIMITER,
    check_dedupe,
    check_top_n,
    dedupe_consecutive,
    dedupe_events,
    tokenize_path,
    trim_event,
)
from trailmark.operators.metrics import event_frequencies
from trailmark.operators.pieces import merged, session_pieces

# Named step lists of the presets, how many frequent events they draw on, how many
# events stand in when none of the named ones occurs, and the largest automatic funnel.
PRESET_STEPS = {
    "checkout": (
        "Home", "Search", "Product_View", "Add_To_Cart", "Checkout", "Payment",
        "Order_Confirmation",
    ),
    "search": ("Search", "Product_View", "Category_Browse", "Add_To_Cart"),
}
PRESET_FALLBACK = {"top": 4, "checkout": 4, "search": 3}
PRESET_EVENT_POOL = 20
MAX_AUTO_STEPS = 8

# Drop-off percentages at which a step is reported as a warning and as an alert.
WARN_DROPOFF, ALERT_DROPOFF = 40.0, 70.0


def clean_steps(steps: Sequence[str]) -> list[str]:
    if isinstance(steps, str):
        raise ValueError("Funnel steps must be a list of event names.")
    names = [step.strip() for step in steps]
    if not names:
        raise ValueError("A funnel needs at least one step.")
    if not all(names):
        raise ValueError("A funnel step cannot be empty.")
    return names


def funnel_depth(
    path: Column,
    steps: Sequence[str],
    delimiter: str = DEFAULT_DELIMITER,
    dedupe: str | None = "none",
) -> Column:
    """How many steps a path completes in order, each strictly after the one before."""
    names = clean_steps(steps)
    mode = check_dedupe(dedupe)
    if mode == "consecutive" and not any(a == b for a, b in zip(names, names[1:])):
        # Collapsing runs changes a match only when a step is followed by itself.
        mode = "none"
    events = dedupe_events(tokenize_path(path, delimiter), mode)
    wanted = F.array(*[F.lit(name) for name in names])
    depth = F.aggregate(
        events,
        F.lit(0),
        lambda done, event: F.when(F.get(wanted, done) == event, done + 1).otherwise(done),
    )
    # A path without the first step's text cannot complete it: skip splitting such rows.
    return F.when(path.contains(names[0]), depth).otherwise(F.lit(0))


def _step_rows(counted: DataFrame, names: list[str]) -> DataFrame:
    """Unfold (total, array of counts) into one row per step with its rates."""

    def count(i: int) -> Column:
        return F.get("counts", F.lit(i))

    def step(i: int) -> Column:
        whole = F.greatest(F.col("total"), F.lit(1)) if i == 0 else count(i - 1)
        return F.struct(
            F.lit(i + 1).cast("bigint").alias("step_number"),
            F.lit(names[i]).alias("step_name"),
            count(i).alias("session_count"),
            rate_percent(count(i), whole).alias("step_conversion_pct"),
            rate_percent(count(i), count(0)).alias("overall_conversion_pct"),
        )

    rows = counted.select(F.inline(F.array(*[step(i) for i in range(len(names))])))
    return rows.select(
        "step_number",
        "step_name",
        "session_count",
        "step_conversion_pct",
        F.bround(F.lit(100.0) - F.col("step_conversion_pct"), 2).alias("step_dropoff_pct"),
        "overall_conversion_pct",
    )


def funnel(
    sessions: DataFrame,
    steps: Sequence[str],
    *,
    delimiter: str = DEFAULT_DELIMITER,
    sequential: bool = True,
    dedupe: str | None = "none",
) -> DataFrame:
    """(step_number, step_name, session_count, step_conversion_pct, step_dropoff_pct,
    overall_conversion_pct).

    Sequential: a session counts for a step when it completes it after all earlier steps; other
    events may come between and a step may repeat. Otherwise a session counts for every step it
    contains, in any order, so conversion can pass 100. Sessions without a path stay in the
    total that the first step is measured against.
    """
    names = clean_steps(steps)
    path = F.col("EVENT_PATH")
    if sequential:
        state = funnel_depth(path, names, delimiter, dedupe)
        reached = [F.col("state") >= i + 1 for i in range(len(names))]
    else:
        check_dedupe(dedupe)  # dedupe never removes the last copy of an event
        state = tokenize_path(path, delimiter)
        reached = [F.array_contains("state", name) for name in names]
    counted = sessions.select(state.alias("state")).agg(
        F.count(F.lit(1)).alias("total"),
        F.array(*[F.count_if(hit) for hit in reached]).alias("counts"),
    )
    return _step_rows(counted, names)


def _piece_map(events: Column, names: list[str], alone: Column) -> Column:
    """How deep a funnel is after ``events``, for each depth it can have before them.

    For the first piece of a session (``alone``) that is depth 0 only.
    """
    wanted = F.array(*[F.lit(name) for name in names])
    # Other events change nothing; most of them go before the fold.
    steps = F.filter(events, lambda event: F.array_contains(wanted, event))
    start = F.when(alone, F.array(F.lit(0))).otherwise(
        F.array(*[F.lit(depth) for depth in range(len(names) + 1)])
    )

    def taken(depths: Column, event: Column) -> Column:
        return F.transform(
            depths, lambda depth: F.when(F.get(wanted, depth) == event, depth + 1).otherwise(depth)
        )

    return F.aggregate(steps, start, taken)


def _after(first: Column, then: Column) -> Column:
    """The map of two neighbouring pieces."""
    return F.transform(first, lambda depth: F.get(then, depth))


def _row_depths(rows: DataFrame, names: list[str], mode: str, sizes: dict[str, int]) -> DataFrame:
    """(session_key, depth): how many steps each session completes in order."""
    if mode == "unique":
        # Each event counts at its first place only, so the first places of the steps decide.
        event = trim_event(F.col("event"))
        distinct = list(dict.fromkeys(names))
        places = rows.groupBy("session_key").agg(
            *[F.min(F.when(event == name, F.col("position"))).alias(f"at{i}") for i, name in enumerate(distinct)]
        )
        at = [F.col(f"at{distinct.index(name)}") for name in names]
        reached = at[0].isNotNull()
        depth = F.when(reached, 1).otherwise(0)
        for before, here in zip(at, at[1:]):
            reached = reached & F.coalesce(here > before, F.lit(False))
            depth = depth + F.when(reached, 1).otherwise(0)
        return places.select("session_key", depth.alias("depth"))
    pieces = session_pieces(rows, **sizes)
    alone, events = F.col("piece") == 0, F.col("events")
    if mode == "none" or not any(a == b for a, b in zip(names, names[1:])):
        found = merged(pieces, _piece_map(events, names, alone), _after)
        return found.select("session_key", F.get("state", F.lit(0)).alias("depth"))
    # Of a run that goes on from the piece before, the first event is not counted again.
    runs = dedupe_consecutive(events)
    rest = F.slice("runs", F.lit(2), F.size("runs"))
    state = F.struct(
        F.get("runs", F.lit(0)).alias("first"),
        F.get("runs", F.size("runs") - 1).alias("last"),
        _piece_map(F.col("runs"), names, alone).alias("whole"),
        _piece_map(rest, names, alone).alias("rest"),
    )

    def merge(left: Column, right: Column) -> Column:
        goes_on = left["last"].eqNullSafe(right["first"])
        then = F.when(goes_on, right["rest"]).otherwise(right["whole"])
        return F.struct(
            left["first"].alias("first"),
            right["last"].alias("last"),
            _after(left["whole"], then).alias("whole"),
            _after(left["rest"], then).alias("rest"),
        )

    found = merged(pieces.withColumn("runs", runs), state, merge)
    return found.select("session_key", F.get("state.whole", F.lit(0)).alias("depth"))


def funnel_from_rows(
    rows: DataFrame,
    steps: Sequence[str],
    *,
    sequential: bool = True,
    dedupe: str | None = "none",
    **sizes: int,
) -> DataFrame:
    """What ``funnel`` gives, out of ``session_rows``, for sessions of any length.

    An ordered funnel turns each piece of a session into a map from the depth before it to the depth
    after it; maps of neighbouring pieces make the map of both, so that no task holds a session
    whole. ``sizes`` are those of ``session_pieces``. Sessions without any named event count in the
    total if they have a row, as with ``keep_unnamed``.
    """
    names = clean_steps(steps)
    mode = check_dedupe(dedupe)
    if sequential:
        depths = _row_depths(rows, names, mode, sizes)
        reached = [F.col("depth") >= i + 1 for i in range(len(names))]
    else:
        event = trim_event(F.col("event"))
        depths = rows.groupBy("session_key").agg(
            *[F.max(F.coalesce(event == name, F.lit(False))).alias(f"has{i}") for i, name in enumerate(names)]
        )
        reached = [F.col(f"has{i}") for i in range(len(names))]
    counted = depths.agg(
        F.count(F.lit(1)).alias("total"), F.array(*[F.count_if(hit) for hit in reached]).alias("counts")
    )
    return _step_rows(counted, names)


def frequent_events(
    sessions: DataFrame, delimiter: str, top_n: int, dedupe: str | None
) -> list[str]:
    """Names of the most frequent events; at most ``top_n`` rows reach the driver."""
    top = event_frequencies(sessions, delimiter=delimiter, top_n=top_n, dedupe=dedupe)
    return [row["event_name"] for row in top.select("event_name").collect()]


def _no_steps(sessions: DataFrame) -> DataFrame:
    """A funnel without rows."""
    return funnel(sessions.limit(0), ["none"]).limit(0)


def funnel_auto(
    sessions: DataFrame,
    *,
    delimiter: str = DEFAULT_DELIMITER,
    top_n: int = 15,
    dedupe: str | None = "consecutive",
) -> DataFrame:
    """Reach funnel over the most frequent events, at most eight of them; no rows without any."""
    size = min(check_top_n(top_n), MAX_AUTO_STEPS)
    steps = frequent_events(sessions, delimiter, size, dedupe)
    if not steps:
        return _no_steps(sessions)
    return funnel(sessions, steps, delimiter=delimiter, sequential=False, dedupe=dedupe)


def preset_steps(
    sessions: DataFrame,
    preset: str,
    *,
    delimiter: str = DEFAULT_DELIMITER,
    dedupe: str | None = "consecutive",
) -> list[str]:
    """Steps of a preset: its named events that are among the frequent ones, in its order."""
    if preset not in PRESET_FALLBACK:
        raise ValueError(f"Unknown funnel preset: {preset}. Use {', '.join(PRESET_FALLBACK)}.")
    frequent = frequent_events(sessions, delimiter, PRESET_EVENT_POOL, dedupe)
    named = [step for step in PRESET_STEPS.get(preset, ()) if step in frequent]
    return named or frequent[: PRESET_FALLBACK[preset]]


def funnel_preset(
    sessions: DataFrame,
    preset: str = "top",
    *,
    delimiter: str = DEFAULT_DELIMITER,
    dedupe: str | None = "consecutive",
) -> DataFrame:
    """Ordered funnel over the steps of a preset: ``top``, ``checkout`` or ``search``.

    No rows when the sessions have no events.
    """
    steps = preset_steps(sessions, preset, delimiter=delimiter, dedupe=dedupe)
    if not steps:
        return _no_steps(sessions)
    return funnel(sessions, steps, delimiter=delimiter, dedupe=dedupe)


def funnel_report(steps: DataFrame) -> DataFrame:
    """Funnel rows with the bar length relative to the first step and a severity."""
    # A window over the step rows; another look at the counts would read the sessions again.
    first = F.first("session_count").over(Window.orderBy("step_number"))
    drop = F.col("step_dropoff_pct")
    return (
        steps.withColumn("bar_share", F.col("session_count") / F.greatest(first, F.lit(1)))
        .withColumn(
            "severity",
            F.when(F.col("step_number") == 1, "start")
            .when(drop < WARN_DROPOFF, "ok")
            .when(drop < ALERT_DROPOFF, "warn")
            .otherwise("alert"),
        )
    )
