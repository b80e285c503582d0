"""Column functions that turn an event path into an array of event names.

Everything here is an expression over one row: no shuffle, no Python worker.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The Unicode space separators (category Zs) stripped around an event name.
# Tabs and line breaks are not in this set and stay part of the name.
SPACE_SEPARATORS = (
    "\u0020\u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u202f\u205f\u3000"
)

# The dedupe modes, and the delimiters in order of detection priority.
DEDUPE_MODES = ("none", "consecutive", "unique")
KNOWN_DELIMITERS = ("->", ",", ">", "|")
DEFAULT_DELIMITER = "->"


def check_delimiter(delimiter: str) -> str:
    if not isinstance(delimiter, str) or delimiter == "":
        raise ValueError("The path delimiter cannot be empty.")
    return delimiter


def check_dedupe(mode: str | None) -> str:
    mode = mode or "none"
    if mode not in DEDUPE_MODES:
        raise ValueError(
            f"Unknown dedupe mode: {mode}. Use one of {', '.join(DEDUPE_MODES)}."
        )
    return mode


def check_top_n(n: int, name: str = "top_n") -> int:
    if isinstance(n, bool) or not isinstance(n, int) or n < 1:
        raise ValueError(f"{name} must be a positive integer, got {n!r}.")
    return n


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row.

    A lambda that captures a computed array would evaluate it again for every element;
    binding it as a lambda variable first keeps the work linear in the path length.
    """
    return F.get(F.transform(F.array(value), lambda bound: body(bound)), F.lit(0))


def literal_pattern(text: str) -> str:
    """A regular expression that matches ``text`` literally.

    Escaping character by character (not ``\\Q..\\E``) has no forbidden text and lets the JVM
    use its plain string splitter for one-character delimiters.
    """
    return "".join(
        ch if ch.isalnum() or ch == "_" or not ch.isascii() or ch.isspace() else "\\" + ch
        for ch in text
    )


def splits_cleanly(delimiter: str, blanks: str) -> bool:
    """Whether removing blanks around the delimiter can never move a token boundary.

    True when the delimiter holds no blank and no proper prefix of it is also a suffix
    (all usual delimiters): then two occurrences cannot overlap.
    """
    overlaps = any(delimiter[:k] == delimiter[-k:] for k in range(1, len(delimiter)))
    return not overlaps and not set(delimiter) & set(blanks)


def split_path(path: Column, delimiter: str = DEFAULT_DELIMITER) -> Column:
    """Tokens between literal delimiters, untrimmed; inner and trailing blanks are kept."""
    return F.split(path, literal_pattern(check_delimiter(delimiter)))


def trim_event(event: Column, blanks: str = SPACE_SEPARATORS) -> Column:
    return F.btrim(event, F.lit(blanks))


def tokenize_path(
    path: Column, delimiter: str = DEFAULT_DELIMITER, blanks: str = SPACE_SEPARATORS
) -> Column:
    """The trimmed event names of a path, in order; NULL for a NULL path.

    Blanks around delimiters are removed from the string before it is split, and only for rows
    that can hold any: built-in string functions stay inside whole-stage code generation, which
    a lambda over the tokens would leave.
    """
    check_delimiter(delimiter)
    if not splits_cleanly(delimiter, blanks):
        return F.transform(split_path(path, delimiter), lambda t: trim_event(t, blanks))
    may_hold_blank = F.length(path) != F.octet_length(path)
    for ch in filter(str.isascii, blanks):
        may_hold_blank = may_hold_blank | path.contains(ch)
    # The look-behind starts a run of blanks only at its first one: linear on any text.
    around = f"(?:(?<![{blanks}])[{blanks}]++)?{literal_pattern(delimiter)}[{blanks}]*+"
    tidy = trim_event(
        F.regexp_replace(path, around, delimiter.replace("\\", "\\\\").replace("$", "\\$")),
        blanks,
    )
    return split_path(F.when(may_hold_blank, tidy).otherwise(path), delimiter)


def first_event(path: Column, delimiter: str = DEFAULT_DELIMITER) -> Column:
    return trim_event(F.substring_index(path, check_delimiter(delimiter), 1))


def last_event(path: Column, delimiter: str = DEFAULT_DELIMITER) -> Column:
    if splits_cleanly(check_delimiter(delimiter), ""):
        return trim_event(F.substring_index(path, delimiter, -1))
    return trim_event(F.element_at(split_path(path, delimiter), -1))


def drop_blank_events(events: Column) -> Column:
    return F.array_remove(events, "")


def dedupe_consecutive(events: Column) -> Column:
    """Runs of one event collapse to a single event."""
    return let(
        events,
        lambda v: F.filter(v, lambda event, i: (i == 0) | (event != F.get(v, i - 1))),
    )


def dedupe_unique(events: Column) -> Column:
    """Each event once, at its first occurrence."""
    return F.array_distinct(events)


def dedupe_events(events: Column, mode: str | None) -> Column:
    mode = check_dedupe(mode)
    if mode == "consecutive":
        return dedupe_consecutive(events)
    if mode == "unique":
        return dedupe_unique(events)
    return events


def sanitize_path(
    path: Column, mode: str | None = "consecutive", delimiter: str = DEFAULT_DELIMITER
) -> Column:
    """The path string after dedupe; mode ``none`` returns the string as it is, untrimmed."""
    if check_dedupe(mode) == "none":
        return path
    return F.array_join(dedupe_events(tokenize_path(path, delimiter), mode), delimiter)
