"""Benchmark decontamination (operator 4): a prefix-filtered set join of windows and documents.

A window is ``window`` consecutive words of a benchmark item, as a set of shingles of two
neighbouring words. To hold a window, a document must hold all its shingles, so the rarest one is
a prefix long enough to join on. Its place gives the only place the window can have (positional
bound), which must lie inside the document (length bound); then the words are compared.

The index of windows is broadcast in blocks of at most ``block_windows`` windows, one pass over
the documents for each block: a small benchmark takes one.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.llm.workers import map_batches, slices, stored

WINDOW = 10
BLOCK_WINDOWS = 200_000
#: ASCII letters (lower-cased), digits, and all bytes of characters beyond ASCII.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

SCHEMA = (
    "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, "
    "contaminated boolean"
)


def words_of(text: str | None) -> list[bytes]:
    return WORD.findall(text.encode().lower()) if text else []


def windows_of(words: list[bytes], window: int) -> set[tuple[bytes, ...]]:
    if not words:
        return set()
    return {tuple(words[at : at + window]) for at in range(max(1, len(words) - window + 1))}


def shingles_of(window: tuple[bytes, ...]) -> list[tuple[bytes, ...]]:
    """The shingle at each place; a window of one word has that word."""
    return list(zip(window, window[1:])) or [window]


class Index:
    """Windows by their rarest shingle."""

    def __init__(self, windows: dict[tuple[bytes, ...], list[str]], seen: Counter):
        self.singles: dict[bytes, list[str]] = {}
        self.pairs: dict[bytes, dict[bytes, list]] = defaultdict(dict)
        for window, items in sorted(windows.items()):
            if len(window) == 1:
                self.singles[window[0]] = items
                continue
            shingles = shingles_of(window)
            place = min(range(len(shingles)), key=lambda i: (seen[shingles[i]], shingles[i], i))
            first, second = shingles[place]
            self.pairs[first].setdefault(second, []).append((place, window, items))
        self.pairs = dict(self.pairs)

    def occurrences(self, words: list[bytes]):
        """(start, end, items) of every window in ``words``."""
        if self.singles:
            for at, word in enumerate(words):
                if word in self.singles:
                    yield at, at + 1, self.singles[word]
        pairs, length = self.pairs, len(words)
        for at in [at for at, word in enumerate(words) if word in pairs]:
            if at + 1 == length:
                continue
            for place, window, items in pairs[words[at]].get(words[at + 1], ()):
                start = at - place
                end = start + len(window)
                if start >= 0 and end <= length and tuple(words[start:end]) == window:
                    yield start, end, items


def _windows(items: DataFrame, window: int, block: int, blocks: int) -> dict:
    """window -> sorted item ids, of one block of the benchmark."""
    chosen = items.selectExpr("CAST(item_id AS STRING) AS item", "text").where("text IS NOT NULL")
    if blocks > 1:
        chosen = chosen.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block)
    found: dict[tuple[bytes, ...], set[str]] = defaultdict(set)
    for row in chosen.collect():
        for taken in windows_of(words_of(row["text"]), window):
            found[taken].add(row["item"] or "")
    return {taken: sorted(names) for taken, names in found.items()}


def _shingle_counts(docs: DataFrame, wanted: set[tuple[bytes, ...]]) -> Counter:
    """How often each wanted pair of words occurs in all documents."""
    by_number = sorted(wanted)
    numbers: dict[bytes, dict[bytes, int]] = defaultdict(dict)
    for number, (first, second) in enumerate(by_number):
        numbers[first][second] = number
    numbers = dict(numbers)

    def run(batches):
        seen: Counter = Counter()
        for part in slices(batches):
            for text in part.column("text").to_pylist():
                words = words_of(text)
                if words:
                    after = words[1:]
                    seen.update(
                        number
                        for at, word in enumerate(words[:-1])
                        if word in numbers
                        and (number := numbers[word].get(after[at])) is not None
                    )
        yield pa.RecordBatch.from_arrays(
            [pa.array(seen.keys(), pa.int64()), pa.array(seen.values(), pa.int64())],
            ["number", "n"],
        )

    counts = map_batches(docs.select("text"), run, "number bigint, n bigint")
    total = counts.groupBy("number").agg(F.sum("n").alias("n")).collect()
    return Counter({by_number[row["number"]]: row["n"] for row in total})


def _block_count(items: DataFrame, window: int, block_windows: int) -> int:
    """Blocks so that none has more than about ``block_windows`` windows."""
    bound = F.greatest(F.length("text"), F.lit(1))  # no item has more windows than characters
    letters = items.agg(F.sum(bound)).head()[0] or 0
    return max(1, math.ceil(letters / (4 * block_windows)))


def _indexes(docs: DataFrame, items: DataFrame, window: int, block_windows: int) -> list[Index]:
    blocks = _block_count(items, window, block_windows)
    found = []
    for block in range(blocks):
        windows = _windows(items, window, block, blocks)
        if windows:
            wanted = {pair for taken in windows for pair in shingles_of(taken) if len(pair) == 2}
            found.append(Index(windows, _shingle_counts(docs, wanted)))
    return found


def _judge(words: list[bytes], spans, items: set[str]) -> tuple:
    hit = bytearray(len(words))
    for start, end in spans:
        hit[start:end] = b"\x01" * (end - start)
    n_hit = sum(hit)
    digest = hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
    return len(words), n_hit, len(items), digest, n_hit > 0


def find_contamination(
    docs: DataFrame,
    items: DataFrame,
    *,
    window: int = WINDOW,
    block_windows: int = BLOCK_WINDOWS,
) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row of ``docs``.

    ``docs`` has doc_id and text, ``items`` item_id and text. An item with fewer words than
    ``window`` is one window; one without words (null, empty, only punctuation) has none. Items of
    the same id are one item; a null item_id counts as an empty id. A null text has no words.
    Repeated rows give repeated rows; empty tables give no rows or no hits; other columns are not
    read. Narrow: the documents are not shuffled, and one block of the benchmark is held at a time.
    """
    indexes = _indexes(docs, items, window, block_windows)
    narrow = docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text")
    if len(indexes) < 2:
        return map_batches(narrow, _scan(indexes[0] if indexes else None), SCHEMA)
    for index in indexes:
        narrow = stored(map_batches(narrow, _gather(index), GATHERED), "contamination")
    return map_batches(narrow, _scan(None), SCHEMA)


GATHERED = "doc_id bigint, text string, starts array<int>, ends array<int>, items array<string>"


def _found(part: pa.RecordBatch, index: Index | None):
    """(words, spans, items) of each row, with what earlier passes have gathered."""
    texts = part.column("text").to_pylist()
    if "starts" in part.schema.names:
        earlier = list(zip(*[part.column(c).to_pylist() for c in ("starts", "ends", "items")]))
    else:
        earlier = [((), (), ())] * len(texts)
    for text, (starts, ends, names) in zip(texts, earlier):
        words, spans, items = words_of(text), set(zip(starts, ends)), set(names)
        if index:
            for start, end, owners in index.occurrences(words):
                spans.add((start, end))
                items.update(owners)
        yield text, words, spans, items


def _scan(index: Index | None):
    def run(batches):
        for part in slices(batches):
            rows = [_judge(words, spans, items) for _, words, spans, items in _found(part, index)]
            columns = list(zip(*rows)) if rows else [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), *[pa.array(c, k) for c, k in zip(columns, kinds)]],
                ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
            )

    return run


def _gather(index: Index):
    def run(batches):
        for part in slices(batches):
            rows = [(t, sorted(s), sorted(i)) for t, _, s, i in _found(part, index)]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array([r[0] for r in rows], pa.string()),
                    pa.array([[s for s, _ in r[1]] for r in rows], pa.list_(pa.int32())),
                    pa.array([[e for _, e in r[1]] for r in rows], pa.list_(pa.int32())),
                    pa.array([r[2] for r in rows], pa.list_(pa.string())),
                ],
                ["doc_id", "text", "starts", "ends", "items"],
            )

    return run


def drop_contaminated(
    docs: DataFrame,
    items: DataFrame,
    *,
    window: int = WINDOW,
    block_windows: int = BLOCK_WINDOWS,
) -> DataFrame:
    """The rows of ``docs`` that hold no window of any item, with all their columns as they are."""
    indexes = _indexes(docs, items, window, block_windows)
    for number, index in enumerate(indexes, start=1):

        def run(batches, index=index):
            for part in slices(batches):
                clean = [
                    next(index.occurrences(words_of(text)), None) is None
                    for text in part.column("text").to_pylist()
                ]
                yield part.filter(pa.array(clean, pa.bool_()))

        docs = map_batches(docs, run, docs.schema)
        if number < len(indexes):
            docs = stored(docs, "clean")
    return docs
