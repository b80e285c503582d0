"""Token ids by a public tokenizer file, remembering words within a worker process.

A text is cut where the tokenizer cuts in any case, each different piece goes through the library
once, and its result is kept for the next texts of the same worker. The memory is bounded: a full
memo is emptied.
"""

from __future__ import annotations

import itertools
import os
import re
from collections.abc import Callable

MEMO_ENTRIES = 1_200_000
SEPARATORS = " \t\n\r"
#: White space other than the separators, by any library's reading of the word.
OTHER_SPACE = re.compile(
    "[%s]"
    % "".join(
        map(chr, (11, 12, *range(28, 32), 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200C)))
    )
    + "|[%s]" % "".join(map(chr, (0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)))
)
#: White space and the word after it. A token never spans the end of a word and the space behind it.
SPACED_WORD = re.compile(f"[{SEPARATORS}]*[^{SEPARATORS}]+|[{SEPARATORS}]+")
WORD = re.compile(f"[^{SEPARATORS}]+")

_LOADED: dict[str, object] = {}
_MEMOS: dict[tuple, dict] = {}


def tokenizer(path: str):
    """The tokenizer of a .json file, loaded once per process."""
    if path not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark gives each task one core
        from tokenizers import Tokenizer

        _LOADED[path] = Tokenizer.from_file(path)
    return _LOADED[path]


def remembered(path: str, use: str, pieces: list[list[str]], value: Callable) -> dict:
    """piece -> value(its encoding) for all ``pieces``."""
    memo = _MEMOS.setdefault((path, use), {})
    if len(memo) > MEMO_ENTRIES:
        memo.clear()
    unseen = list(set(itertools.chain.from_iterable(pieces)).difference(memo))
    if unseen:
        encodings = tokenizer(path).encode_batch_fast(unseen, add_special_tokens=False)
        memo.update(zip(unseen, map(value, encodings)))
    return memo
