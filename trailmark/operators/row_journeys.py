"""Journeys and searches over sessions of any length, out of the row form.

Each piece of a session also holds the events next to it on both sides, as many as an occurrence of
the wanted subpath can reach, so that matches are found within a piece. Runs of equal events that
go on over a border are one group: pieces count the runs they open, the counts before a piece are its
base, and the parts of a group are added up by (session, number).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmark.functions import journeys
from trailmark.functions.tokens import DEFAULT_DELIMITER, check_delimiter, trim_event
from trailmark.operators.pieces import PIECE_EVENTS, session_pieces
from trailmark.sources.positions import PIECE_ROWS, numbered


def journey_rows(rows: DataFrame, *, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """(session_key, SESSION, position, event): the steps of journeys, trimmed and without blank ones,
    counted from 1."""
    step = F.btrim("event", F.lit(journeys.JOURNEY_BLANKS))
    steps = rows.withColumn("event", step).where(F.col("event") != "")
    return numbered(
        steps.withColumnRenamed("position", "place"), ["session_key"], ["place"], piece_rows=piece_rows
    ).select("session_key", "SESSION", "position", "event")


def _flagged(
    steps: DataFrame, event: str | None, subpath: str | None, delimiter: str, sizes: dict[str, int]
) -> DataFrame:
    """(session_key, part, piece, before, events, flags) of ``journey_rows``."""
    reach = max(len(journeys.subpath_steps(subpath, delimiter)) - 1, 0)
    pieces = session_pieces(steps, overlap=max(reach, 1), ahead=reach, trimmed=False, **sizes)
    whole = F.concat("before", "events", "after")
    flags = journeys.match_flags(whole, event, subpath, delimiter)
    own = F.slice(flags, F.size("before") + 1, F.size("events"))
    return pieces.select("session_key", "part", "piece", "before", "events", own.alias("flags"))


def match_positions_from_rows(
    steps: DataFrame,
    *,
    event: str | None = None,
    subpath: str | None = None,
    delimiter: str = DEFAULT_DELIMITER,
    **sizes: int,
) -> DataFrame:
    """(session_key, position): zero-based places of the matching steps of ``journey_rows``."""
    start = F.col("piece") * sizes.get("piece_events", PIECE_EVENTS)
    found = _flagged(steps, event, subpath, delimiter, sizes)
    places = F.explode(journeys.match_positions(F.col("flags"))).alias("at")
    return found.select("session_key", start.alias("start"), places).select(
        "session_key", (F.col("start") + F.col("at")).alias("position")
    )


def journey_groups_from_rows(
    steps: DataFrame,
    *,
    event: str | None = None,
    subpath: str | None = None,
    delimiter: str = DEFAULT_DELIMITER,
    **sizes: int,
) -> DataFrame:
    """(session_key, position, name, count, matched): the runs of equal steps of ``journey_rows``.

    ``position`` numbers the groups of a session from 0; a group is matched when any of its steps is.
    """
    found = _flagged(steps, event, subpath, delimiter, sizes)
    groups = journeys.compress_journey(F.col("events"), F.col("flags"))
    goes_on = F.get("before", F.size("before") - 1).eqNullSafe(F.get("events", F.lit(0)))
    pieces = found.select(
        "session_key", "part", "piece", groups.alias("groups"),
        F.when(goes_on, 1).otherwise(0).alias("continued"),
    )
    # The runs that earlier pieces have opened: within the part, which is one group of the shuffle,
    # and over the parts, of which a session has few.
    opened = F.size("groups") - F.col("continued")
    in_part = Window.partitionBy("session_key", "part").orderBy("piece")
    pieces = pieces.withColumn("own", opened).withColumn("up_to", F.sum("own").over(in_part))
    parts = pieces.groupBy("session_key", "part").agg(F.sum("own").alias("runs"))
    by_part = Window.partitionBy("session_key").orderBy("part")
    bases = parts.select("session_key", "part", (F.sum("runs").over(by_part) - F.col("runs")).alias("base"))
    placed = pieces.join(bases, ["session_key", "part"]).select(
        "session_key",
        (F.col("base") + F.col("up_to") - F.col("own") - F.col("continued")).alias("first"),
        F.posexplode("groups").alias("at", "g"),
    )
    return (
        placed.groupBy("session_key", (F.col("first") + F.col("at")).alias("position"))
        .agg(
            F.any_value("g.name").alias("name"),
            F.sum("g.count").alias("count"),
            F.max("g.matched").alias("matched"),
        )
    )


def journey_previews_from_rows(
    groups: DataFrame, shown: int = journeys.PREVIEW_GROUPS
) -> DataFrame:
    """(session_key, groups, preview, hidden_groups) of ``journey_groups_from_rows``.

    ``groups`` is their number. ``preview`` holds the first groups and, behind an overflow marker, the
    first matching one beyond them; that is all an aggregate keeps of a session.
    """
    group = F.struct("name", "count", "matched", F.lit(False).alias("overflow"))
    head = F.col("position") < shown
    beyond = F.col("position") >= shown
    listed = groups.groupBy("session_key").agg(
        F.count(F.lit(1)).alias("groups"),
        F.sort_array(F.collect_list(F.when(head, F.struct("position", group.alias("group"))))).alias("head"),
        F.min(F.when(beyond & F.col("matched"), F.struct("position", group.alias("group")))).alias("match"),
    )
    skipped = F.col("match.position") - shown
    marker = F.struct(
        F.lit(None).cast("string").alias("name"),
        skipped.alias("count"),
        F.lit(False).alias("matched"),
        F.lit(True).alias("overflow"),
    )
    tail = (
        F.when(F.col("match").isNull(), F.slice(F.array("match.group"), F.lit(1), F.lit(0)))
        .when(skipped == 0, F.array("match.group"))
        .otherwise(F.array(marker, F.col("match.group")))
    )
    seen = F.size("head") + F.when(F.col("match").isNull(), 0).otherwise(1)
    return listed.select(
        "session_key",
        "groups",
        F.concat(F.col("head").getField("group"), tail).alias("preview"),
        F.greatest(F.col("groups") - seen, F.lit(0)).alias("hidden_groups"),
    )


class _Automaton:
    """All wanted token sequences in one: the state is the longest end of what was read that begins one.

    ``following[state * letters + letter]`` is the next state; letter 0 is any other token.
    ``ending[state]`` lists the sequences that end there.
    """

    def __init__(self, wanted: list[list[str]]):
        self.alphabet = sorted({token for sequence in wanted for token in sequence})
        number = {token: i + 1 for i, token in enumerate(self.alphabet)}
        prefixes = {(): 0}
        for sequence in wanted:
            for size in range(1, len(sequence) + 1):
                prefixes.setdefault(tuple(sequence[:size]), len(prefixes))
        letters = len(self.alphabet) + 1

        def longest(read: tuple[str, ...]) -> tuple[str, ...]:
            return next(read[at:] for at in range(len(read) + 1) if read[at:] in prefixes)

        self.following = [0] * (letters * len(prefixes))
        self.ending = [[] for _ in prefixes]
        for prefix, state in prefixes.items():
            for token in self.alphabet:
                self.following[state * letters + number[token]] = prefixes[longest((*prefix, token))]
            self.ending[state] = [
                i for i, sequence in enumerate(wanted) if prefix[len(prefix) - len(sequence) :] == tuple(sequence)
            ]

    @staticmethod
    def _numbers(values: list[int]) -> Column:
        return F.split(F.lit(",".join(map(str, values))), ",").cast("array<int>")

    def found(self, events: Column) -> Column:
        """The numbers of the sequences that occur in ``events``."""
        alphabet = F.array(*[F.lit(token) for token in self.alphabet])
        letters = F.transform(events, lambda event: F.array_position(alphabet, event).cast("int"))
        following = self._numbers(self.following)

        def step(read: Column, letter: Column) -> Column:
            state = F.get(following, read["state"] * (len(self.alphabet) + 1) + letter)
            kept = F.when(
                F.array_contains(read["seen"], state), read["seen"]
            ).otherwise(F.concat(read["seen"], F.array(state)))
            return F.struct(state.alias("state"), kept.alias("seen"))

        start = F.struct(F.lit(0).alias("state"), F.array(F.lit(0)).alias("seen"))
        states = F.aggregate(letters, start, step)["seen"]
        lists = F.array(*[self._numbers(e) if e else F.array().cast("array<int>") for e in self.ending])
        return F.array_distinct(F.flatten(F.transform(states, lambda state: F.get(lists, state))))


def search_rows(
    rows: DataFrame,
    *,
    events: Sequence[str] = (),
    subpaths: Sequence[str] = (),
    min_events: int = 1,
    delimiter: str = DEFAULT_DELIMITER,
    **sizes: int,
) -> DataFrame:
    """(session_key, SESSION, TOTAL_EVENTS, found_events, found_subpaths) of ``session_rows``.

    One scan for any number of wanted events and subpaths: each session comes once, with the numbers (from
    0) of those it holds; sessions that hold none do not come. An event must equal a whole trimmed one,
    a subpath must occur as a run of whole events, blanks included. TOTAL_EVENTS is the number of rows.
    """
    check_delimiter(delimiter)
    if not events and not subpaths:
        raise ValueError("Name at least one event or subpath to search for.")
    sequences = [subpath.split(delimiter) for subpath in subpaths]
    reach = max([len(s) for s in sequences], default=1) - 1
    names = rows.groupBy("session_key").agg(
        F.any_value("SESSION").alias("SESSION"),
        F.count(F.lit(1)).alias("TOTAL_EVENTS"),
        *[
            F.max(F.coalesce(trim_event(F.col("event")) == name, F.lit(False))).alias(f"e{i}")
            for i, name in enumerate(events)
        ],
    )
    hits = F.array_compact(F.array(*[F.when(F.col(f"e{i}"), F.lit(i)) for i in range(len(events))]))
    hits = hits if events else F.array()
    found = names.select(
        "session_key", "SESSION", "TOTAL_EVENTS", hits.cast("array<int>").alias("found_events")
    )
    none = F.array().cast("array<int>")
    if sequences:
        pieces = session_pieces(rows, overlap=reach, trimmed=False, **sizes)
        numbers = _Automaton(sequences).found(F.concat("before", "events"))
        matched = pieces.select("session_key", F.explode(numbers).alias("number")).groupBy("session_key").agg(
            F.sort_array(F.collect_set("number")).alias("found_subpaths")
        )
        found = found.join(matched, "session_key", "left")
        found = found.withColumn("found_subpaths", F.coalesce("found_subpaths", none))
    else:
        found = found.withColumn("found_subpaths", none)
    any_hit = (F.size("found_events") > 0) | (F.size("found_subpaths") > 0)
    return found.where(any_hit & (F.col("TOTAL_EVENTS") >= min_events))
