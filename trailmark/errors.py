"""Errors a caller can act on."""

from __future__ import annotations


class SessionDataError(ValueError):
    """The input cannot be analysed. ``hint``, if there is one, says what to change."""

    hint: str | None

    def __init__(self, reason: str, *, hint: str | None = None) -> None:
        self.hint = hint
        super().__init__(reason)


class RowLimitError(ValueError):
    """A free SQL query returned more rows than the caller allowed."""
