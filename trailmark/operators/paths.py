"""The most frequent full paths, counted by digest.

What is shuffled for counting is a digest of each path and its depth, never its text. The counts of
the top rows give a threshold; text is fetched only for paths at or above it and counted by text, so
that the answer has exact texts and counts. Sessions of any length come as rows: their digests are
put together from those of their pieces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.functions.rates import share_percent
from trailmark.functions.tokens import (
    DEFAULT_DELIMITER,
    check_dedupe,
    check_delimiter,
    check_top_n,
    dedupe_consecutive,
    sanitize_path,
    trim_event,
)
from trailmark.operators.pieces import first_places, merged, session_pieces
from trailmark.sources.readers import DEFAULT_MAX_RECORD, check_max_record
from trailmark.sources.storage import stored_table

#: Paths at or above the threshold that come to the driver; with more of them, text is joined.
CANDIDATES = 2_000

#: Moduli and bases of the digest of a row of events: products stay below 64 bits.
LANES = (
    (2_147_483_647, 1_000_003),
    (2_147_483_629, 998_244_353),
    (2_147_483_587, 19_260_817),
    (2_147_483_579, 100_000_007),
)


def _digest(text: Column) -> Column:
    """128 bits of a text."""
    return F.struct(
        F.xxhash64(text).alias("a"), F.xxhash64(F.lit("second"), text).alias("b")
    ).alias("digest")


def _threshold(counts: DataFrame, top_n: int, keys: list[str]) -> tuple[list, int]:
    """(rows at or above the count of the last one of the top, that count); None instead of the rows
    if there are more than ``CANDIDATES``."""
    most = max(CANDIDATES, top_n) + 1
    top = counts.orderBy(F.desc("n")).limit(most).select(*keys, "n").collect()
    if not top:
        return [], 1
    least = top[min(top_n, len(top)) - 1]["n"]
    found = [row for row in top if row["n"] >= least]
    return (None if len(found) == most else found), least


def top_paths(
    sessions: DataFrame,
    *,
    top_n: int = 15,
    min_events: int = 1,
    dedupe: str | None = "none",
    delimiter: str = DEFAULT_DELIMITER,
) -> DataFrame:
    """(full_path, TOTAL_EVENTS, session_count, share_percent) of the most frequent paths.

    Paths are grouped with the depth as recorded, so one deduplicated path can fill several
    rows. The share is of all sessions, also those without a path or below ``min_events``.

    Paths are counted by a digest of 128 bits first; that is run at once. What is returned reads the
    text of the paths that reach the count of the last one of the top.
    """
    check_top_n(top_n)
    counted = F.col("EVENT_PATH").isNotNull() & (F.col("TOTAL_EVENTS") >= min_events)
    kept = F.coalesce(counted, F.lit(False))
    cleaned = sanitize_path(F.col("EVENT_PATH"), dedupe, delimiter)
    paths = sessions.where(counted).select(cleaned.alias("full_path"), "TOTAL_EVENTS")
    # Sessions that are not ranked are one group, below all others.
    counts = (
        sessions.select(
            F.when(kept, _digest(cleaned)).alias("digest"),
            F.when(kept, F.col("TOTAL_EVENTS")).alias("TOTAL_EVENTS"),
        )
        .groupBy("digest", "TOTAL_EVENTS")
        .agg(F.count(F.lit(1)).alias("sessions"))
        .withColumn("n", F.when(F.col("digest").isNotNull(), F.col("sessions")).otherwise(0))
    )
    total = F.sum("sessions").alias("total")
    all_sessions = counts.agg(total).scalar()
    keys = ["digest", "TOTAL_EVENTS"]
    found, least = _threshold(counts.withColumn("total", all_sessions), top_n, [*keys, "total"])
    whole = found[0]["total"] if found else None
    if found is None:
        whole = sessions.count()
        if least == 1:
            ranked = _all_but_few(paths, counts, top_n)
        else:
            wanted = counts.where(F.col("n") >= least).select(*keys)
            ranked = _ranked(_among(paths, wanted), top_n)
    else:
        named = [row for row in found if row["n"] > 0]
        schema = counts.select(*keys).schema
        wanted = sessions.sparkSession.createDataFrame([(row["digest"], row["TOTAL_EVENTS"]) for row in named], schema)
        ranked = _ranked(_among(paths, F.broadcast(wanted)), top_n)
    return ranked.withColumn("share_percent", share_percent(F.col("session_count"), F.lit(whole)))


def _among(paths: DataFrame, wanted: DataFrame) -> DataFrame:
    return paths.withColumn("digest", _digest(F.col("full_path"))).join(
        wanted, ["digest", "TOTAL_EVENTS"], "left_semi"
    )


def _ranked(paths: DataFrame, top_n: int) -> DataFrame:
    """The top of the paths by their text."""
    counts = paths.groupBy("full_path", "TOTAL_EVENTS").agg(F.count(F.lit(1)).alias("session_count"))
    return counts.orderBy(F.desc("session_count"), "full_path", "TOTAL_EVENTS").limit(top_n)


def _all_but_few(paths: DataFrame, counts: DataFrame, top_n: int) -> DataFrame:
    """The top where paths that occur once are part of it: all others are among the top anyway, and
    of those the first in order are taken without a shuffle of their text."""
    more = counts.where(F.col("n") > 1).select("digest", "TOTAL_EVENTS").limit(top_n)
    often = _ranked(_among(paths, F.broadcast(more)), top_n)
    once = (
        paths.withColumn("digest", _digest(F.col("full_path")))
        .join(F.broadcast(more), ["digest", "TOTAL_EVENTS"], "left_anti")
        .select("full_path", "TOTAL_EVENTS", F.lit(1).cast("bigint").alias("session_count"))
    )
    order = [F.desc("session_count"), "full_path", "TOTAL_EVENTS"]
    return often.unionAll(once.orderBy(*order).limit(top_n)).orderBy(*order).limit(top_n)


# Sessions as rows ---------------------------------------------------------------------------


def _lane_start() -> Column:
    fields = [F.lit(0).cast("bigint").alias(f"h{i}") for i in range(len(LANES))]
    fields += [F.lit(1).cast("bigint").alias(f"w{i}") for i in range(len(LANES))]
    return F.struct(*fields, F.lit(0).cast("bigint").alias("length"))


def _joined_lanes(left: Column, right: Column) -> Column:
    """The digest of two rows of events, one after the other: polynomials in the hashes of the events,
    with the weight that moves them past the right one."""
    fields = [
        ((left[f"h{i}"] * right[f"w{i}"] + right[f"h{i}"]) % modulus).alias(f"h{i}")
        for i, (modulus, _) in enumerate(LANES)
    ]
    fields += [
        ((left[f"w{i}"] * right[f"w{i}"]) % modulus).alias(f"w{i}") for i, (modulus, _) in enumerate(LANES)
    ]
    return F.struct(*fields, (left["length"] + right["length"]).alias("length"))


def _lanes(events: Column) -> Column:
    """The digest of a row of events."""

    def one(code: Column) -> Column:
        fields = [F.pmod(code, F.lit(modulus)).alias(f"h{i}") for i, (modulus, _) in enumerate(LANES)]
        fields += [F.lit(base).cast("bigint").alias(f"w{i}") for i, (_, base) in enumerate(LANES)]
        return F.struct(*fields, F.lit(1).cast("bigint").alias("length"))

    codes = F.transform(events, lambda event: F.xxhash64(event))
    return F.aggregate(codes, _lane_start(), lambda so_far, code: _joined_lanes(so_far, one(code)))


def _path_digests(rows: DataFrame, mode: str, sizes: dict[str, int]) -> DataFrame:
    """(session_key, digest) of sessions with any named event."""
    raw = mode == "none"
    named = rows.where(F.col("event").isNotNull())
    named = first_places(named) if mode == "unique" else named
    pieces = session_pieces(named, trimmed=not raw, **sizes)
    if mode != "consecutive":
        found = merged(pieces, _lanes(F.col("events")), _joined_lanes)
        return found.select("session_key", F.col("state").alias("digest"))
    # A run that goes on from the piece before has been counted there.
    state = F.struct(
        F.get("runs", F.lit(0)).alias("first"),
        F.get("runs", F.size("runs") - 1).alias("last"),
        _lanes(F.slice("runs", F.lit(1), F.lit(1))).alias("head"),
        _lanes(F.slice("runs", F.lit(2), F.size("runs"))).alias("rest"),
    )

    def merge(left: Column, right: Column) -> Column:
        goes_on = left["last"].eqNullSafe(right["first"])
        head = F.when(goes_on, _lane_start()).otherwise(right["head"])
        return F.struct(
            left["first"].alias("first"),
            right["last"].alias("last"),
            left["head"].alias("head"),
            _joined_lanes(left["rest"], _joined_lanes(head, right["rest"])).alias("rest"),
        )

    found = merged(pieces.withColumn("runs", dedupe_consecutive(F.col("events"))), state, merge)
    return found.select("session_key", _joined_lanes(F.col("state.head"), F.col("state.rest")).alias("digest"))


def _path_texts(rows: DataFrame, keys: DataFrame, mode: str, delimiter: str) -> DataFrame:
    """(session_key, full_path) of the sessions in ``keys``, whose paths fit one row."""
    chosen = rows.where(F.col("event").isNotNull()).join(keys, "session_key", "left_semi")
    if mode == "unique":
        chosen = first_places(chosen)
    elif mode == "consecutive":
        chosen = chosen.withColumn("event", trim_event(F.col("event")))
    listed = chosen.groupBy("session_key").agg(
        F.sort_array(F.collect_list(F.struct("position", "event"))).getField("event").alias("events")
    )
    events = dedupe_consecutive(F.col("events")) if mode == "consecutive" else F.col("events")
    return listed.select("session_key", F.array_join(events, delimiter).alias("full_path"))


def top_paths_from_rows(
    rows: DataFrame,
    *,
    top_n: int = 15,
    min_events: int = 1,
    dedupe: str | None = "none",
    delimiter: str = DEFAULT_DELIMITER,
    max_record: int = DEFAULT_MAX_RECORD,
    **sizes: int,
) -> DataFrame:
    """What ``top_paths`` gives, out of ``session_rows`` with ``keep_unnamed``, for sessions of any length.

    TOTAL_EVENTS is the number of rows of a session, named or not. Digests (four polynomials over the
    hashes of the events, and their number) are put together along the pieces of a session. Text is made
    of one session for each path that reaches the top; such a path has to fit one row of at most
    ``max_record`` bytes. ``sizes`` are those of ``session_pieces``.
    """
    check_top_n(top_n)
    check_delimiter(delimiter)
    check_max_record(max_record)
    mode = check_dedupe(dedupe)
    bytes_of = F.octet_length("event") + len(delimiter.encode("utf-8"))
    totals = rows.groupBy("session_key").agg(
        F.count(F.lit(1)).alias("TOTAL_EVENTS"),
        F.coalesce(F.sum(bytes_of), F.lit(0)).alias("bytes"),
    )
    summaries = totals.join(_path_digests(rows, mode, sizes), "session_key", "left")
    ranked = F.col("digest").isNotNull() & (F.col("TOTAL_EVENTS") >= min_events)
    # One row for each different path and depth; sessions that are not ranked are one group, below all.
    counts = stored_table(
        summaries.select(
            F.when(ranked, F.col("digest")).alias("digest"),
            F.when(ranked, F.col("TOTAL_EVENTS")).alias("TOTAL_EVENTS"),
            F.struct("bytes", "session_key").alias("example"),
        )
        .groupBy("digest", "TOTAL_EVENTS")
        .agg(F.count(F.lit(1)).alias("sessions"), F.min("example").alias("example"))
        .withColumn("n", F.when(F.col("digest").isNotNull(), F.col("sessions")).otherwise(0)),
        "path_counts",
    )
    found, least = _threshold(counts, top_n, [])
    whole = counts.agg(F.sum("sessions")).head()[0]
    message = f"A session path exceeds the record limit of {max_record} bytes"
    fits = F.col("example.bytes") <= max_record
    wanted = counts.where((F.col("n") >= least) & (F.col("n") > 0)).select(
        F.when(fits, F.col("example.session_key"))
        .otherwise(F.raise_error(F.lit(message)))
        .alias("session_key"),
        "TOTAL_EVENTS",
        F.col("n").alias("session_count"),
    )
    if found is not None:
        wanted = F.broadcast(wanted)
    texts = _path_texts(rows, wanted.select("session_key"), mode, delimiter)
    order = [F.desc("session_count"), "full_path", "TOTAL_EVENTS"]
    return (
        texts.join(wanted, "session_key")
        .select("full_path", "TOTAL_EVENTS", "session_count")
        .orderBy(*order)
        .limit(top_n)
        .withColumn("share_percent", share_percent(F.col("session_count"), F.lit(whole)))
    )
