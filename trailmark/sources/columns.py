"""Mapping of export headers onto the session schema, and its validation.

Works on column names and types only; no job runs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailmark.errors import SessionDataError


@dataclass(frozen=True)
class _Meaning:
    """How a header is recognised, on its name in capitals without separators."""

    aliases: frozenset[str]
    reads_like: Callable[[str], bool]

    def accepts(self, plain: str) -> bool:
        return plain in self.aliases or self.reads_like(plain)


# The session schema and the header names and wordings understood for it.
SESSION_COLUMNS = {
    "SESSION": _Meaning(
        frozenset({"SESSION", "SESSIONID", "VEHICLESESSION", "VEHICLESESSIONID"}),
        lambda name: name.endswith("SESSION") and "PATH" not in name,
    ),
    "EVENT_PATH": _Meaning(
        frozenset({"EVENTPATH", "SESSIONPATH", "SESSIONPATHCAPPEDATTWOREPEATS"}),
        lambda name: "PATH" in name,
    ),
    "TOTAL_EVENTS": _Meaning(
        frozenset({"TOTALEVENTS", "EVENTCOUNT", "STEPCOUNT", "STEPCOUNTAFTERREPEATCAP"}),
        lambda name: "COUNT" in name and ("STEP" in name or "EVENT" in name),
    ),
}


def plain_name(header: str) -> str:
    """Capitals and digits only: ``Vehicle session-id`` reads ``VEHICLESESSIONID``."""
    return "".join(ch for ch in header.upper() if ch.isascii() and ch.isalnum())


def _header_for(column: str, headers: list[str]) -> str:
    same_name = [h for h in headers if plain_name(h) == plain_name(column)]
    if len(same_name) == 1:
        return same_name[0]
    found = [h for h in headers if SESSION_COLUMNS[column].accepts(plain_name(h))]
    if len(found) == 1:
        return found[0]
    if found:
        raise SessionDataError(
            f"The dataset has ambiguous columns for {column}: {', '.join(found)}",
            hint=f"Rename the one that is meant to {column}.",
        )
    raise SessionDataError(
        f"No column of the dataset reads as {column}",
        hint=f"Found {', '.join(headers)}; rename the header that holds it.",
    )


def map_columns(headers: Iterable[str]) -> dict[str, str]:
    """{session column: header}. A header may carry only one meaning."""
    headers = list(headers)
    mapping = {column: _header_for(column, headers) for column in SESSION_COLUMNS}
    for column, header in mapping.items():
        others = [c for c, h in mapping.items() if h == header and c != column]
        if others:
            raise SessionDataError(
                f"The dataset has ambiguous columns for {column}: {header} reads as {others[0]} too",
                hint=f"Rename the headers to {', '.join(SESSION_COLUMNS)}.",
            )
    return mapping


def to_session_columns(df: DataFrame) -> DataFrame:
    """``df`` with mapped headers renamed, in place; other columns and their order are kept.

    Whole-number depths become bigint and the two text columns strings.
    """
    renamed = {header: column for column, header in map_columns(df.columns).items()}
    types = {field.name: field.dataType for field in df.schema}

    def projected(header: str):
        quoted = F.col("`" + header.replace("`", "``") + "`")
        column = renamed.get(header)
        if column in ("SESSION", "EVENT_PATH"):
            quoted = quoted.cast("string")
        elif column == "TOTAL_EVENTS" and isinstance(types[header], T.IntegralType):
            quoted = quoted.cast("bigint")
        return quoted.alias(column or header)

    return df.select([projected(header) for header in df.columns])


def validate_schema(df: DataFrame) -> dict[str, str]:
    """{column: type} of a session table; raises when a required column is missing or wrong."""
    types = {field.name: field.dataType for field in df.schema}
    for column in SESSION_COLUMNS:
        if column not in types:
            raise SessionDataError(
                f"No column of the dataset reads as {column}", hint=f"Found {', '.join(types)}."
            )
    if not isinstance(types["TOTAL_EVENTS"], T.NumericType):
        raise SessionDataError(
            "TOTAL_EVENTS must be numeric",
            hint="Remove the non-numeric values from TOTAL_EVENTS or export it again.",
        )
    return {name: kind.simpleString() for name, kind in types.items()}


def as_sessions(df: DataFrame) -> DataFrame:
    """Map and validate any DataFrame that holds one row per session."""
    sessions = to_session_columns(df)
    validate_schema(sessions)
    return sessions
