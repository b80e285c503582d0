"""Detection of the delimiter used in event paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.functions.tokens import DEFAULT_DELIMITER, KNOWN_DELIMITERS, trim_event


def _filled_paths(sessions: DataFrame) -> DataFrame:
    path = F.col("EVENT_PATH")
    return sessions.where(path.isNotNull() & (trim_event(path) != "")).select("EVENT_PATH")


def delimiter_of(sessions: DataFrame) -> DataFrame:
    """One row (delimiter): the first known delimiter that occurs in any path.

    Blank paths are skipped; without any delimiter the answer is ``->``.
    """
    found = F.lit(DEFAULT_DELIMITER)
    for delimiter in reversed(KNOWN_DELIMITERS):
        occurs = F.bool_or(F.col("EVENT_PATH").contains(delimiter))
        found = F.when(occurs, delimiter).otherwise(found)
    return _filled_paths(sessions).agg(found.alias("delimiter"))


def detect_delimiter(sessions: DataFrame) -> str:
    """The first known delimiter that occurs in any path of ``sessions``."""
    return delimiter_of(sessions).head()["delimiter"]
