"""Session tables out of raw event rows.

Sessions are found along each user's events in one pass: the rows of a user with very many of them
are cut into pieces by time, and what a piece has to know of those before it (the time of the last
event, how many sessions have begun, where the last one did) is added up from one summary row per
piece. A session's path is one cell, so a session has to fit one row. The texts of its pieces are
added up first, and a path of more than ``max_record`` bytes fails the job before they are put
together. (The ``max_record`` of a CSV scan bounds the characters of a field.) Sessions of any size
come as rows from ``session_rows`` and ``keyed_rows``. Nothing is cut or dropped.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmark.functions.tokens import DEFAULT_DELIMITER, check_delimiter
from trailmark.sources.positions import (
    PIECE,
    PIECE_ROWS,
    given_back,
    in_pieces,
    numbered,
    split_points,
)
from trailmark.sources.readers import DEFAULT_MAX_RECORD, check_max_record
from trailmark.sources.storage import stored_table

DAY_SECONDS = 86_400
#: What happens to a session whose path does not fit a record.
TOO_LONG = ("fail", "leave_out")


def _path_bytes(event: str, delimiter: str) -> Column:
    return F.sum(
        F.coalesce(F.octet_length(F.col(event)), F.lit(0)) + len(delimiter.encode("utf-8"))
    )


def _check_too_long(too_long: str) -> str:
    if too_long not in TOO_LONG:
        raise ValueError(f"Unknown treatment of long sessions: {too_long}. Use {', '.join(TOO_LONG)}.")
    return too_long


def _within_limit(sessions: DataFrame, size: str, max_record: int, too_long: str) -> DataFrame:
    """``sessions``, whose reading fails where ``size`` is too large, whatever columns are read; or
    those that are not too large."""
    message = f"A session path exceeds the record limit of {max_record} bytes"
    fits = F.coalesce(F.col(size), F.lit(0)) <= max_record
    if too_long == "leave_out":
        return sessions.where(fits)
    return sessions.where(F.when(fits, True).otherwise(F.raise_error(F.lit(message)).cast("boolean")))


USER, TIME = ["who", "nobody"], ["undated", "ts", "tie", "event"]


def _steps(events: DataFrame, user: str, timestamp: str, tie_break: str, event: str) -> DataFrame:
    """(who, nobody, undated, ts, tie, event): the events under plain, never-NULL user keys.

    An event without a user has itself in place of one.
    """
    ts, tie = F.col(timestamp), F.col(tie_break)
    itself = F.to_json(F.struct(tie.alias("t"), ts.alias("s"), F.col(event).alias("e")))
    return events.select(
        F.coalesce(F.col(user).cast("string"), itself).alias("who"),
        F.col(user).isNull().alias("nobody"),
        ts.isNull().alias("undated"),
        ts.alias("ts"),
        tie.alias("tie"),
        F.col(event).alias("event"),
    )


def _opens(previous: Column, gap_seconds: int) -> Column:
    """1 for an event that begins a session, given the time of the event before it or NULL."""
    near = F.col("ts") <= previous + F.expr(f"INTERVAL {gap_seconds} seconds")
    return F.when(~F.col("nobody") & F.coalesce(near, F.lit(False)), 0).otherwise(1)


def _piece_summaries(steps: DataFrame, points: DataFrame, gap_seconds: int) -> DataFrame:
    """For each piece of a user that is cut, what the pieces before it leave behind:
    ``last_ts``, ``sessions``, ``names`` (named events), ``begun`` (names before the last session)."""
    pieces = in_pieces(steps, points, USER, TIME, only_cut=True)
    within = Window.partitionBy(*USER, PIECE).orderBy(*TIME)
    up_to = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    named = F.when(F.col("event").isNotNull(), 1).otherwise(0)
    seen = pieces.select(
        *USER, PIECE, "ts", named.alias("named"), F.row_number().over(within).alias("at"),
        F.sum(named).over(up_to).alias("names"),
        _opens(F.lag("ts").over(within), gap_seconds).alias("opens"),
    )
    # Whether the first row of a piece begins a session depends on the piece before.
    first, later = F.col("at") == 1, (F.col("at") > 1) & (F.col("opens") == 1)
    sums = seen.groupBy(*USER, PIECE).agg(
        F.min(F.when(first, F.col("ts"))).alias("ts"),
        F.max_by("ts", "at").alias("end"),
        F.count_if(later).alias("later"),
        F.sum("named").alias("own_names"),
        F.max(F.when(later, F.col("names") - F.col("named"))).alias("own_begun"),
    )
    by_piece = Window.partitionBy(*USER).orderBy(PIECE)
    up_to = by_piece.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = by_piece.rowsBetween(Window.unboundedPreceding, -1)
    nothing = F.lit(0).cast("bigint")
    scanned = (
        sums.withColumn("last_ts", F.lag("end").over(by_piece))
        .withColumn("opened", _opens(F.col("last_ts"), gap_seconds) + F.col("later"))
        .withColumn("sessions", F.coalesce(F.sum("opened").over(before), nothing))
        .withColumn("names", F.coalesce(F.sum("own_names").over(before), nothing))
    )
    begun = F.coalesce(
        F.col("own_begun") + F.col("names"), F.when(F.col("opened") > F.col("later"), F.col("names"))
    )
    return scanned.withColumn("own_begun", begun).select(
        *USER, PIECE, "last_ts", "sessions", "names", F.max("own_begun").over(before).alias("begun")
    )


def _sessions(steps: DataFrame, gap_seconds: int, piece_rows: int) -> tuple[DataFrame, bool]:
    """(steps with ``_piece``, ``session_no`` and ``position``; whether any user is cut).

    ``position`` is that of named events in their session.
    """
    points = split_points(steps.where(~F.col("nobody")), USER, TIME, piece_rows)
    cut = in_pieces(steps, points, USER, TIME)
    nothing = F.lit(0).cast("bigint")
    last_ts, sessions, names, begun = F.lit(None), nothing, nothing, nothing
    if points is not None:
        carried = stored_table(_piece_summaries(steps, points, gap_seconds), "pieces")
        renamed = {name: f"_{name}" for name in ("last_ts", "sessions", "names", "begun")}
        cut = given_back(cut, carried.withColumnsRenamed(renamed), USER)
        last_ts = F.col("_last_ts")
        sessions, names, begun = (
            F.coalesce(f"_{name}", nothing) for name in ("sessions", "names", "begun")
        )
    within = Window.partitionBy(*USER, PIECE).orderBy(*TIME)
    up_to = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    previous = F.lag("ts").over(within)
    if points is not None:
        previous = F.when(F.row_number().over(within) == 1, last_ts).otherwise(previous)
    named = F.when(F.col("event").isNotNull(), 1).otherwise(0)
    counted = (
        cut.withColumn("opens", _opens(previous, gap_seconds))
        .withColumn("session_no", F.sum("opens").over(up_to) + sessions)
        .withColumn("names_up_to", F.sum(named).over(up_to) + names)
    )
    # Names are counted along the user; the last session to begin says where its own start.
    start = F.max(F.when(F.col("opens") == 1, F.col("names_up_to") - named)).over(up_to)
    position = F.when(named == 1, F.col("names_up_to") - F.coalesce(start, begun))
    found = counted.withColumn("position", position.cast("bigint"))
    return found.select(*USER, *TIME, PIECE, "session_no", "position"), points is not None


def _session_name() -> Column:
    return F.concat(
        F.when(~F.col("nobody"), F.col("who")), F.lit("_"), F.col("session_no").cast("string")
    )


def _paths(
    steps: DataFrame,
    session: list[str],
    order: Sequence[str],
    event: str,
    delimiter: str,
    max_record: int,
    cut: bool,
    too_long: str,
) -> DataFrame:
    """(session columns, EVENT_PATH, TOTAL_EVENTS) of rows with their ``_piece``.

    The rows of a piece become text first, then the texts of a session's pieces are put together.
    """
    named = F.col("named") > 0
    pieces = steps.groupBy(*session, PIECE).agg(
        F.collect_list(F.struct(*dict.fromkeys([*order, event]))).alias("steps"),
        F.count(event).alias("named"),
        F.count(F.lit(1)).alias("n"),
        _path_bytes(event, delimiter).alias("bytes"),
    )
    text = F.when(named, F.array_join(F.sort_array("steps").getField(event), delimiter))
    if not cut:
        fitting = _within_limit(pieces, "bytes", max_record, too_long)
        return fitting.select(*session, text.alias("EVENT_PATH"), F.col("n").alias("TOTAL_EVENTS"))
    size = F.sum("bytes").over(Window.partitionBy(*session))
    texts = pieces.select(*session, PIECE, "named", "n", "bytes", text.alias("text"))
    fitting = _within_limit(texts.withColumn("size", size), "size", max_record, too_long)
    whole = fitting.groupBy(*session).agg(
        F.collect_list(F.when(named, F.struct(PIECE, "text"))).alias("pieces"),
        F.sum("named").alias("named"),
        F.sum("n").alias("TOTAL_EVENTS"),
    )
    joined = F.when(named, F.array_join(F.sort_array("pieces").getField("text"), delimiter))
    return whole.select(*session, joined.alias("EVENT_PATH"), "TOTAL_EVENTS")


def sessionize_events(
    events: DataFrame,
    *,
    user: str = "user_id",
    timestamp: str = "ts",
    tie_break: str = "event_id",
    event: str = "event_type",
    gap_seconds: int = DAY_SECONDS,
    delimiter: str = DEFAULT_DELIMITER,
    max_record: int = DEFAULT_MAX_RECORD,
    piece_rows: int = PIECE_ROWS,
    too_long: str = "fail",
) -> DataFrame:
    """One session per user and run of events no more than ``gap_seconds`` apart.

    The events are read and shuffled once, after a count of the rows of each user. A user with more
    than ``piece_rows`` events, or in large tables than a piece's share of all, is cut by time and
    spread over tasks.

    An event without a timestamp has no distance to any other: it is a session of its own, numbered
    after the user's dated ones by ``tie_break``. Events without a user share none: each is a
    session of its own, without a name.

    A session whose path is longer than ``max_record`` fails the job, or with ``too_long="leave_out"``
    is left out, while all others come; ``session_rows`` has it.
    """
    check_delimiter(delimiter)
    check_max_record(max_record)
    _check_too_long(too_long)
    steps, cut = _sessions(_steps(events, user, timestamp, tie_break, event), gap_seconds, piece_rows)
    found = _paths(steps, [*USER, "session_no"], TIME, "event", delimiter, max_record, cut, too_long)
    return found.select(_session_name().alias("SESSION"), "EVENT_PATH", "TOTAL_EVENTS")


def session_rows(
    events: DataFrame,
    *,
    user: str = "user_id",
    timestamp: str = "ts",
    tie_break: str = "event_id",
    event: str = "event_type",
    gap_seconds: int = DAY_SECONDS,
    keep_unnamed: bool = False,
    piece_rows: int = PIECE_ROWS,
) -> DataFrame:
    """The sessions of ``sessionize_events`` as rows: (session_key, SESSION, position, event).

    No session has to fit one row, so there is no record limit. ``session_key`` tells sessions
    without a name apart. Named events are counted from 1 in their session. Events without a name
    are left out, and with them sessions without any named event; with ``keep_unnamed`` they come as
    rows without position and event.
    """
    steps, _ = _sessions(_steps(events, user, timestamp, tie_break, event), gap_seconds, piece_rows)
    kept = steps if keep_unnamed else steps.where(F.col("event").isNotNull())
    key = F.concat_ws("_", F.col("nobody").cast("string"), "who", F.col("session_no").cast("string"))
    return kept.select(key.alias("session_key"), _session_name().alias("SESSION"), "position", "event")


def keyed_paths(
    rows: DataFrame,
    *,
    key: str,
    order_by: Sequence[str],
    event: str,
    delimiter: str = DEFAULT_DELIMITER,
    max_record: int = DEFAULT_MAX_RECORD,
    piece_rows: int = PIECE_ROWS,
    too_long: str = "fail",
) -> DataFrame:
    """One session per ``key``: its rows in order, as a path of ``event``.

    The rows are read and shuffled once, after a count of the rows of each key; a key with more than
    ``piece_rows`` of them is cut by its order and spread over tasks.

    A key whose path is longer than ``max_record`` fails the job, or with ``too_long="leave_out"`` is
    left out, while all others come; ``keyed_sessions`` gives its rows beside them.
    """
    check_delimiter(delimiter)
    check_max_record(max_record)
    _check_too_long(too_long)
    steps = rows.select(*dict.fromkeys([key, *order_by, event]))
    order = list(dict.fromkeys([*order_by, event]))
    points = split_points(steps, [key], order, piece_rows)
    pieces = in_pieces(steps, points, [key], order)
    found = _paths(pieces, [key], order, event, delimiter, max_record, points is not None, too_long)
    return found.select(F.col(key).cast("string").alias("SESSION"), "EVENT_PATH", "TOTAL_EVENTS")


def keyed_rows(
    rows: DataFrame,
    *,
    key: str,
    order_by: Sequence[str],
    event: str,
    piece_rows: int = PIECE_ROWS,
) -> DataFrame:
    """The sessions of ``keyed_paths`` as rows: (session_key, SESSION, position, event).

    As in ``session_rows``, there is no record limit, and named events only are counted from 1.
    """
    order = list(dict.fromkeys([*order_by, event]))
    named = rows.where(F.col(event).isNotNull()).select(
        F.col(key).cast("string").alias("session_key"), *order
    )
    return numbered(named, ["session_key"], order, piece_rows=piece_rows).select(
        "session_key", F.col("session_key").alias("SESSION"), "position", F.col(event).alias("event")
    )


def keyed_sessions(
    rows: DataFrame,
    *,
    key: str,
    order_by: Sequence[str],
    event: str,
    delimiter: str = DEFAULT_DELIMITER,
    max_record: int = DEFAULT_MAX_RECORD,
    piece_rows: int = PIECE_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """(``keyed_paths`` of all keys whose path fits a record, ``keyed_rows`` of the others).

    Of the others there are at most as many as records of ``max_record`` bytes in the input.
    """
    spec = {"key": key, "order_by": order_by, "event": event, "piece_rows": piece_rows}
    paths = keyed_paths(
        rows, delimiter=delimiter, max_record=max_record, too_long="leave_out", **spec
    )
    sizes = rows.groupBy(F.col(key).alias("_key")).agg(_path_bytes(event, delimiter).alias("_bytes"))
    long_keys = sizes.where(F.col("_bytes") > max_record).select("_key")
    long_rows = rows.join(long_keys, rows[key].eqNullSafe(long_keys["_key"]), "left_semi")
    return paths, keyed_rows(long_rows, **spec)


CONVERSATIONS = {"key": "conv_id", "order_by": ["turn"], "event": "role"}
ORDERS = {"key": "o_custkey", "order_by": ["o_orderdate", "o_orderkey"], "event": "o_orderpriority"}


def conversation_paths(conversations: DataFrame, **options) -> DataFrame:
    """One session per conversation: the roles in turn order."""
    return keyed_paths(conversations, **CONVERSATIONS, **options)


def conversation_rows(conversations: DataFrame, **options) -> DataFrame:
    """The sessions of ``conversation_paths`` as rows."""
    return keyed_rows(conversations, **CONVERSATIONS, **options)


def order_paths(orders: DataFrame, **options) -> DataFrame:
    """One session per customer: order priorities by date."""
    return keyed_paths(orders, **ORDERS, **options)


def order_rows(orders: DataFrame, **options) -> DataFrame:
    """The sessions of ``order_paths`` as rows."""
    return keyed_rows(orders, **ORDERS, **options)
