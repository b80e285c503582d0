"""Token counts (operator 3): overlapping chunks, spliced where both agree for certain.

A text longer than ``chunk`` characters is encoded in overlapping chunks with offsets. Two
neighbouring chunks are spliced at a position where both start a pre-token. Why that is right: the
pre-tokenizer reads from left to right and looks ahead, never back, and a token never leaves its
pre-token. The left chunk starts at a proven boundary, so its boundaries are those of the whole
text, except near its end, where what follows is unseen; those are not used. From a common
boundary on, the right chunk reads what the whole text's run would read. Without a common boundary
the overlap is widened, at last to the whole left chunk, and then the left chunk itself grows.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

from trailmark.llm import token_memo
from trailmark.llm.workers import map_batches, slices

CHUNK, OVERLAP = 32_768, 512
#: Longer than any special string, which a cut inside would hide.
UNSEEN = 64
SCHEMA = "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean"


def boundaries(encoding) -> dict[int, int]:
    """Character offset -> first token, for each token that starts a pre-token after another one."""
    offsets, words = encoding.offsets, encoding.word_ids
    return {
        offsets[i][0]: i
        for i in range(1, len(offsets))
        if words[i] is not None
        and words[i - 1] is not None
        and words[i] != words[i - 1]
        and offsets[i][0] == offsets[i - 1][1]
    }


def count_by_chunks(tokenizer, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Number of tokens of ``text``, never encoding more than a few chunks at once."""

    def encode(start: int, end: int):
        return tokenizer.encode(text[start:end], add_special_tokens=False)

    total, start, size = 0, 0, chunk
    end = min(size, len(text))
    left = encode(0, end)
    skipped = 0  # tokens of the left chunk before its proven start
    proven = 0  # where the left chunk is proven from
    while end < len(text):
        shared = overlap
        splice = None
        while splice is None:
            begin = max(proven, end - shared)
            right_end = min(end + size, len(text))
            right = encode(begin, right_end)
            ours, theirs = boundaries(left), boundaries(right)
            last = left.offsets[-1][0] + start if left.offsets else start
            common = [
                at
                for at in (a + start for a in ours)
                if proven < at < min(last, end - UNSEEN) and at - begin in theirs
            ]
            if common:
                splice = max(common)
            elif begin > proven:
                shared *= 4
            else:  # nothing in common over the whole chunk: take a longer one
                size *= 2
                start, skipped = proven, 0
                end = min(proven + size, len(text))
                left = encode(start, end)
                if end == len(text):
                    return total + len(left.ids)
                shared = overlap
        total += ours[splice - start] - skipped
        skipped = theirs[splice - begin]
        left, start, proven, end, size = right, begin, splice, right_end, chunk
    return total + len(left.ids) - skipped


def _counter(vocabulary: str, limit: int, chunk: int, overlap: int):
    def run(batches):
        tokenizer = token_memo.tokenizer(vocabulary)
        for part in slices(batches):
            texts = [text or "" for text in part.column("text").to_pylist()]
            counts = [0] * len(texts)
            pieces: dict[int, list[str]] = {}
            for i, text in enumerate(texts):
                if len(text) > chunk:
                    counts[i] = count_by_chunks(tokenizer, text, chunk, overlap)
                elif token_memo.OTHER_SPACE.search(text):
                    counts[i] = len(tokenizer.encode(text, add_special_tokens=False).ids)
                else:
                    pieces[i] = token_memo.SPACED_WORD.findall(text)
            memo = token_memo.remembered(vocabulary, "count", list(pieces.values()), len)
            for i, words in pieces.items():
                counts[i] = sum(map(memo.__getitem__, words))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array([len(t.encode()) for t in texts], pa.int64()),
                    pa.array(counts, pa.int64()),
                    pa.array([n > limit for n in counts], pa.bool_()),
                ],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return run


def count_tokens(
    docs: DataFrame,
    vocabulary: str,
    *,
    limit: int = 512,
    chunk: int = CHUNK,
    overlap: int = OVERLAP,
) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit of every row of ``docs`` (doc_id, text).

    ``vocabulary`` is the path of a byte-level .json tokenizer file. Texts up to ``chunk``
    characters are counted word by word: white space starts a pre-token there, so the counts of
    the pieces add up. Special strings in a text count as the library counts them by default. A
    null or empty text has no tokens; repeated rows give repeated rows; other columns are not read.
    Narrow: no shuffle.
    """
    narrow = docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text")
    return map_batches(narrow, _counter(vocabulary, limit, chunk, overlap), SCHEMA)
