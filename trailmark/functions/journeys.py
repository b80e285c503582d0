"""Column functions behind the session explorer: run-length journeys and match marks.

All are linear in the journey length and keep every step; only ``preview_groups`` shortens,
because a preview is its purpose.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from trailmark.functions.tokens import (
    DEFAULT_DELIMITER,
    SPACE_SEPARATORS,
    drop_blank_events,
    let,
    tokenize_path,
)

# What a browser's string trim removes on top of the space separators, and the
# number of groups a preview shows.
JOURNEY_BLANKS = "\t\n\u000b\u000c\r" + SPACE_SEPARATORS + "\u2028\u2029\ufeff"
PREVIEW_GROUPS = 8


def journey_steps(path: Column, delimiter: str = DEFAULT_DELIMITER) -> Column:
    """Trimmed, non-blank steps; an empty array for a NULL path."""
    steps = drop_blank_events(tokenize_path(path, delimiter, JOURNEY_BLANKS))
    return F.coalesce(steps, F.array().cast("array<string>"))


def subpath_steps(subpath: str | None, delimiter: str) -> list[str]:
    tokens = (subpath or "").strip(JOURNEY_BLANKS).split(delimiter)
    return [step for step in (t.strip(JOURNEY_BLANKS) for t in tokens) if step]


def match_flags(
    steps: Column,
    event: str | None = None,
    subpath: str | None = None,
    delimiter: str = DEFAULT_DELIMITER,
) -> Column:
    """One boolean per step: it equals ``event`` or lies in an occurrence of ``subpath``.

    Occurrences are contiguous, compared step by step, and may overlap.
    """
    wanted = (event or "").strip(JOURNEY_BLANKS)
    parts = subpath_steps(subpath, delimiter)

    def flags(v: Column) -> Column:
        by_event = lambda step: step == F.lit(wanted) if wanted else F.lit(False)
        if not parts:
            return F.transform(v, by_event)
        starts = F.transform(
            v,
            lambda step, i: reduce(
                and_,
                [F.get(v, i + j).eqNullSafe(F.lit(part)) for j, part in enumerate(parts[1:], 1)],
                step == F.lit(parts[0]),
            ),
        )
        # A step is covered when an occurrence starts at it or at one of the steps just before.
        return let(
            starts,
            lambda begun: F.transform(
                v,
                lambda step, i: reduce(
                    or_,
                    [F.coalesce(F.get(begun, i - j), F.lit(False)) for j in range(len(parts))],
                    by_event(step),
                ),
            ),
        )

    return let(steps, flags)


def match_positions(flags: Column) -> Column:
    """Zero-based positions of the matching steps, ascending, from ``match_flags``."""
    return F.array_compact(F.transform(flags, lambda hit, i: F.when(hit, i)))


def compress_journey(steps: Column, flags: Column) -> Column:
    """Adjacent equal steps as ``array<struct<name, count, matched>>``.

    A group is matched when any of its steps is. ``flags`` come from ``match_flags``.
    """

    def group_starts(v: Column) -> Column:
        return F.array_compact(
            F.transform(v, lambda s, i: F.when((i == 0) | (s != F.get(v, i - 1)), i))
        )

    def groups(v: Column, hit: Column, start: Column) -> Column:
        def group(at: Column, j: Column) -> Column:
            length = F.coalesce(F.get(start, j + 1), F.size(v)) - at
            return F.struct(
                F.get(v, at).alias("name"),
                length.alias("count"),
                F.when(length == 1, F.get(hit, at))
                .otherwise(F.array_contains(F.slice(hit, at + 1, length), True))
                .alias("matched"),
            )

        return F.transform(start, group)

    return let(
        steps,
        lambda v: let(flags, lambda hit: let(group_starts(v), lambda at: groups(v, hit, at))),
    )


def preview_groups(groups: Column, shown: int = PREVIEW_GROUPS) -> Column:
    """The first groups and, beyond them, the first matching one behind an overflow marker.

    Result: ``array<struct<name, count, matched, overflow>>``. The marker carries the number of
    groups skipped and is left out when nothing is skipped.
    """

    def visible(g: Column, overflow: bool) -> Column:
        return F.struct(
            g.getField("name").alias("name"),
            g.getField("count").alias("count"),
            g.getField("matched").alias("matched"),
            F.lit(overflow).alias("overflow"),
        )

    def preview(all_groups: Column) -> Column:
        everything = F.transform(all_groups, lambda g: visible(g, False))
        return F.when(F.size(all_groups) <= shown, everything).otherwise(shortened(all_groups))

    def shortened(all_groups: Column) -> Column:
        head = F.transform(F.slice(all_groups, 1, shown), lambda g: visible(g, False))
        hidden = F.slice(all_groups, F.lit(shown + 1), F.size(all_groups))
        # 1-based place of the first match among the hidden groups, 0 when there is none
        at = F.array_position(hidden.getField("matched"), True).cast("int")

        def with_match(place: Column) -> Column:
            marker = F.array(
                F.struct(
                    F.lit(None).cast("string").alias("name"),
                    (place - 1).alias("count"),
                    F.lit(False).alias("matched"),
                    F.lit(True).alias("overflow"),
                )
            )
            match = F.transform(F.slice(hidden, place, F.lit(1)), lambda g: visible(g, False))
            return (
                F.when(place == 0, head)
                .when(place == 1, F.concat(head, match))
                .otherwise(F.concat(head, marker, match))
            )

        return let(at, with_match)

    return let(groups, preview)


def hidden_group_count(groups: Column, preview: Column) -> Column:
    """How many groups a preview leaves out."""
    shown = F.size(F.filter(preview, lambda g: ~g.getField("overflow")))
    return F.greatest(F.size(groups) - shown, F.lit(0))
