"""Cross-tokenizer alignment (operator 11): the tokens of two tokenizers merged in lockstep.

Both tokenizers cut one and the same byte string, a space and the text. A lane is a pair of pointers,
one into the tokens of each side; a batch is one vector of lanes, and each step moves all of them at
once: it links the two tokens pointed at, notes a cut where both end at the same byte, and moves
the pointer whose token ends first, or both. Lanes that are done are dropped from the vector. A long
document has several lanes, each for a run of its A tokens and starting at the B token that the run
starts in, so that it takes no more steps than a short one.

How many documents hold a pair of ids linked is counted over all documents: tasks add up the pairs
of their documents before they are shuffled. The counts then go to the documents in blocks of
at most ``pair_block`` pairs, one pass over the (stored) pairs of the documents for each block.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.llm.token_memo import OTHER_SPACE, SPACED_WORD
from trailmark.llm.workers import map_batches, slices, stored

#: A tokens of a lane, and characters that are aligned together.
LANE, BATCH_CHARS = 64, 1_500_000
#: Pairs whose counts are sent to tasks at a time (16 bytes each), and pairs a task adds up at a time.
PAIR_BLOCK, COUNT_BLOCK = 4_000_000, 4_000_000
#: Words remembered by a worker process for each tokenizer, and the longest one.
MEMO_ENTRIES, MEMO_CHARS = 800_000, 64
SPACE_MARK = "▁"

#: A run of spaces and what follows it up to the next space.
SPACED_RUN = re.compile("[ ]+[^ ]*")


def byte_characters() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones of Latin-1
    stand for themselves, the other bytes follow in order from U+0100 on."""
    own = {b for b in range(256) if 33 <= b <= 126 or (161 <= b and b != 173)}
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


class Side:
    """One tokenizer: the ids of texts behind a space, and the bytes of each id.

    Texts are cut where the tokenizer cuts in any case; short pieces are remembered.
    """

    token_bytes: list[bytes]

    def __init__(self) -> None:
        self.memo: dict[str, bytes | None] = {}

    def measure(self) -> None:
        self.widths = np.array([len(b) for b in self.token_bytes], dtype=np.int64)

    def pieces(self, spaced: str) -> list[str]:
        raise NotImplementedError

    def encode(self, spaced: list[str]) -> list[list[int]]:
        """Ids of strings that all start as a text, or a piece of one, may start."""
        raise NotImplementedError

    def checked(self, spaced: str, ids: list[int]) -> bytes | None:
        """The ids as 32-bit numbers, if their bytes are those of the string."""
        if b"".join(map(self.token_bytes.__getitem__, ids)) != spaced.encode():
            return None
        return np.asarray(ids, dtype="<u4").tobytes()

    def ids(self, texts: list[str]) -> list[np.ndarray | None]:
        """The ids of each text behind a space; None where their bytes are not those of the text."""
        if len(self.memo) > MEMO_ENTRIES:
            self.memo.clear()
        cut = [self.pieces(" " + text) for text in texts]
        unseen = list({piece for found in cut for piece in found}.difference(self.memo))
        self.memo.update((p, self.checked(p, ids)) for p, ids in zip(unseen, self.encode(unseen)))
        found = []
        for text, pieces in zip(texts, cut):
            parts = list(map(self.memo.__getitem__, pieces))
            if None in parts:  # the pieces may make up for each other
                whole = self.checked(" " + text, self.encode([" " + text])[0])
            else:
                whole = b"".join(parts)
            found.append(None if whole is None else np.frombuffer(whole, dtype="<u4"))
        for piece in unseen:
            if len(piece) > MEMO_CHARS:
                del self.memo[piece]
        return found


class ByteLevelSide(Side):
    """A byte-level .json vocabulary; special strings in a text are plain text."""

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark gives each task one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        known = byte_characters()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.token_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, number in vocabulary.items():
            self.token_bytes[number] = bytes(known[c] for c in token if c in known)
        self.measure()

    def pieces(self, spaced: str) -> list[str]:
        return [spaced] if OTHER_SPACE.search(spaced) else SPACED_WORD.findall(spaced)

    def encode(self, spaced: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(spaced, add_special_tokens=False)]


class PieceSide(Side):
    """A sentencepiece .model that puts a space before a text.

    No token continues after other characters with the mark of a space (looked up here), so that
    what stands between a run of spaces and the next is encoded on its own.
    """

    def __init__(self, path: str):
        super().__init__()
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        numbers = range(self.processor.get_piece_size())
        names = [self.processor.id_to_piece(i) for i in numbers]
        is_byte = [self.processor.is_byte(i) for i in numbers]
        self.token_bytes = [
            bytes([int(name[3:5], 16)]) if single else name.replace(SPACE_MARK, " ").encode()
            for name, single in zip(names, is_byte)
        ]
        self.splits = SPACE_MARK in names and not any(
            SPACE_MARK in name.lstrip(SPACE_MARK) for name, single in zip(names, is_byte) if not single
        )
        self.lone_space = [names.index(SPACE_MARK)] if self.splits else []
        self.measure()

    def pieces(self, spaced: str) -> list[str]:
        return SPACED_RUN.findall(spaced) if self.splits else [spaced]

    def encode(self, spaced: list[str]) -> list[list[int]]:
        # The library adds the first space, but not to an empty text.
        found = self.processor.encode([text[1:] for text in spaced], num_threads=1)
        return [ids or self.lone_space for ids in found]


_LOADED: dict[str, Side] = {}


def side(path: str) -> Side:
    """The tokenizer of a file, loaded once per process."""
    if path not in _LOADED:
        _LOADED[path] = (PieceSide if path.endswith(".model") else ByteLevelSide)(path)
    return _LOADED[path]


@dataclass
class Alignment:
    """The tokens of a batch of documents, one after the other, and how they lie to each other.

    Tokens are numbered over the whole batch. Document d has the A tokens a_from[d] to a_from[d + 1]
    and likewise of B, and the cuts cut_from[d] to cut_from[d + 1]. A cut is the last token of each
    side before it. Links come in the order of the steps that found them.
    """

    a_ids: np.ndarray
    b_ids: np.ndarray
    a_from: np.ndarray
    b_from: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray
    cut_a: np.ndarray
    cut_b: np.ndarray
    cut_from: np.ndarray

    def link_owner(self) -> np.ndarray:
        """The document of each link."""
        return np.repeat(np.arange(len(self.a_from) - 1), np.diff(self.a_from))[self.link_a]

    def sorted_links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(link_a, link_b, link_from) by document and place."""
        order = np.argsort(self.link_a + self.link_b)  # each link moves one pointer at least
        a, b = self.link_a[order], self.link_b[order]
        return a, b, np.searchsorted(a, self.a_from)


def merge_in_lockstep(a_ends: np.ndarray, b_ends: np.ndarray, a_starts: np.ndarray, a_stops: np.ndarray):
    """(link_a, link_b, cut_a, cut_b) of lanes over the A tokens a_starts[i] to a_stops[i].

    ``a_ends`` and ``b_ends`` are the last bytes of the tokens, rising over the whole batch.
    """
    first_byte = np.where(a_starts > 0, a_ends[a_starts - 1], 0)
    a, stop = a_starts, a_stops
    b = np.searchsorted(b_ends, first_byte, side="right")
    links_a, links_b, cuts_a, cuts_b = [], [], [], []
    while len(a):
        links_a.append(a)
        links_b.append(b)
        a_end, b_end = a_ends[a], b_ends[b]
        both = a_end == b_end
        cuts_a.append(a[both])
        cuts_b.append(b[both])
        a = a + (a_end <= b_end)
        b = b + (b_end <= a_end)
        open_lanes = a < stop
        if not open_lanes.all():
            a, b, stop = a[open_lanes], b[open_lanes], stop[open_lanes]
    return [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (links_a, links_b, cuts_a, cuts_b)]


def align(texts: list[str | None], a_side: Side, b_side: Side, lane: int = LANE) -> Alignment:
    """The alignment of a batch of texts. A text without common bytes has no tokens."""
    present = [text or "" for text in texts]
    pairs = [
        (a, b) if text and a is not None and b is not None else (_NOTHING, _NOTHING)
        for text, a, b in zip(present, a_side.ids(present), b_side.ids(present))
    ]
    a_from = np.cumsum([0, *[len(a) for a, _ in pairs]])
    b_from = np.cumsum([0, *[len(b) for _, b in pairs]])
    a_ids = np.concatenate([a for a, _ in pairs] or [_NOTHING]).astype(np.int64)
    b_ids = np.concatenate([b for _, b in pairs] or [_NOTHING]).astype(np.int64)
    # Documents follow each other without a gap, so that their borders are common cuts.
    a_ends, b_ends = np.cumsum(a_side.widths[a_ids]), np.cumsum(b_side.widths[b_ids])
    lanes = -(-np.diff(a_from) // lane)
    within = np.arange(lanes.sum()) - np.repeat(np.cumsum(lanes) - lanes, lanes)
    starts = np.repeat(a_from[:-1], lanes) + within * lane
    stops = np.minimum(starts + lane, np.repeat(a_from[1:], lanes))
    link_a, link_b, cut_a, cut_b = merge_in_lockstep(a_ends, b_ends, starts, stops)
    cut_a, cut_b = np.sort(cut_a), np.sort(cut_b)
    cut_from = np.searchsorted(cut_a, a_from)
    return Alignment(a_ids, b_ids, a_from, b_from, link_a, link_b, cut_a, cut_b, cut_from)


_NOTHING = np.zeros(0, dtype="<u4")


def digit_table(size: int) -> tuple[np.ndarray, np.ndarray]:
    """(characters, shown): the decimal digits of 0 to size - 1, to the right, and room for a mark."""
    places = len(str(max(size - 1, 1)))
    powers = 10 ** np.arange(places - 1, -1, -1)
    numbers = np.arange(size)[:, None]
    characters = np.full((size, places + 1), ord("0"), dtype=np.uint8)
    characters[:, :-1] += (numbers // powers % 10).astype(np.uint8)
    shown = np.ones((size, places + 1), dtype=bool)
    shown[:, :-2] = numbers >= powers[:-1]
    return characters, shown


def group_texts(found: Alignment, digits: tuple[np.ndarray, np.ndarray]) -> list[bytes]:
    """For each document its groups, as ``a1,a2|b1;a3|b2,b3`` in decimal ids."""
    n_a, n_b = len(found.a_ids), len(found.b_ids)
    ends_a, ends_b = np.zeros(n_a, dtype=bool), np.zeros(n_b, dtype=bool)
    ends_a[found.cut_a], ends_b[found.cut_b] = True, True
    group_a, group_b = np.cumsum(ends_a) - ends_a, np.cumsum(ends_b) - ends_b
    # The tokens in the order in which they are written: of each group those of A, then those of B.
    place_a = np.arange(n_a) + np.concatenate([[0], found.cut_b + 1])[group_a]
    place_b = np.arange(n_b) + (found.cut_a + 1)[group_b]
    ids = np.empty(n_a + n_b, dtype=np.int64)
    marks = np.full(n_a + n_b, ord(","), dtype=np.uint8)
    ids[place_a], ids[place_b] = found.a_ids, found.b_ids
    marks[place_a[ends_a]], marks[place_b[ends_b]] = ord("|"), ord(";")
    characters, shown = digits
    written, kept = characters[ids], shown[ids]
    written[:, -1] = marks
    text = written[kept].tobytes()
    until = np.concatenate([[0], np.cumsum(kept.sum(axis=1))])
    borders = until[found.a_from + found.b_from].tolist()
    return [text[a : b - 1] if b > a else b"" for a, b in zip(borders, borders[1:])]


def _batches(batches, chars: int) -> Iterator[pa.RecordBatch]:
    """Rows with about ``chars`` characters together, or a longer one alone."""
    for part in slices(batches, 4_096):
        lengths = np.array([len(t or "") for t in part.column("text").to_pylist()])
        start, total = 0, 0
        for at, length in enumerate(lengths.tolist()):
            if at > start and total + length > chars:
                yield part.slice(start, at - start)
                start, total = at, 0
            total += length
        yield part.slice(start, len(lengths) - start)


def _lists(values: np.ndarray, offsets: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))


ALIGNED = (
    "doc_id bigint, a_ids array<int>, b_ids array<int>, cuts array<struct<a: int, b: int>>, "
    "links array<struct<a: int, b: int>>"
)


def align_documents(docs: DataFrame, a_path: str, b_path: str, *, lane: int = LANE) -> DataFrame:
    """doc_id, a_ids, b_ids, cuts, links of every row of ``docs`` (doc_id, text).

    A cut (a, b) says that the first a tokens of A and the first b tokens of B have the same bytes. A
    link (a, b) says that the bytes of the a-th and the b-th token overlap, counted from 0. Nulls,
    empty texts and repeated rows are treated as in ``alignment_figures``. Narrow: no shuffle.
    """

    def run(batches):
        a_side, b_side = side(a_path), side(b_path)
        for part in _batches(batches, BATCH_CHARS):
            found = align(part.column("text").to_pylist(), a_side, b_side, lane)
            link_a, link_b, link_from = found.sorted_links()
            n_links, n_cuts = np.diff(link_from), np.diff(found.cut_from)

            def within(values, starts, counts):
                return values - np.repeat(starts[:-1], counts)

            def pairs(a, b, offsets):
                both = [pa.array(x, pa.int32()) for x in (a, b)]
                return pa.ListArray.from_arrays(
                    pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(both, ["a", "b"])
                )

            cuts = pairs(
                within(found.cut_a, found.a_from, n_cuts) + 1,
                within(found.cut_b, found.b_from, n_cuts) + 1,
                found.cut_from,
            )
            links = pairs(
                within(link_a, found.a_from, n_links),
                within(link_b, found.b_from, n_links),
                link_from,
            )
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), _lists(found.a_ids, found.a_from),
                 _lists(found.b_ids, found.b_from), cuts, links],
                ["doc_id", "a_ids", "b_ids", "cuts", "links"],
            )

    return map_batches(docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text"), run, ALIGNED)


#: Rows a partition can number.
ROWS = 1 << 36
MERGED = (
    "row bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, "
    "groups_sha256 string, pairs binary, times binary"
)


def _merger(a_path: str, b_path: str, lane: int):
    """Figures of each document, with its different pairs and how often it links each."""

    def run(batches):
        a_side, b_side = side(a_path), side(b_path)
        width = len(b_side.widths)
        digits = digit_table(max(len(a_side.widths), width))
        all_pairs = len(a_side.widths) * width
        row = TaskContext.get().partitionId() * ROWS
        for part in _batches(batches, BATCH_CHARS):
            found = align(part.column("text").to_pylist(), a_side, b_side, lane)
            owner = found.link_owner()
            n_links = np.bincount(owner, minlength=part.num_rows)
            digests = [hashlib.sha256(t).hexdigest() if t else "" for t in group_texts(found, digits)]
            places = owner * all_pairs + found.a_ids[found.link_a] * width + found.b_ids[found.link_b]
            places.sort()
            at = np.flatnonzero(np.diff(places, prepend=-1))  # where another pair or document starts
            times = np.diff(np.append(at, len(places))).astype("<u4")
            owner, codes = np.divmod(places[at], all_pairs)
            codes = codes.astype("<i8")
            borders = np.searchsorted(owner, np.arange(part.num_rows + 1)).tolist()
            spans = list(zip(borders, borders[1:]))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(row + np.arange(part.num_rows)),
                    part.column("doc_id"),
                    pa.array(np.diff(found.a_from)),
                    pa.array(np.diff(found.b_from)),
                    pa.array(np.diff(found.cut_from)),
                    pa.array(n_links),
                    pa.array(digests, pa.string()),
                    pa.array([codes[a:b].tobytes() for a, b in spans], pa.binary()),
                    pa.array([times[a:b].tobytes() for a, b in spans], pa.binary()),
                ],
                ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"],
            )
            row += part.num_rows

    return run


def _add_up(held: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    codes, numbers = np.concatenate(held), np.concatenate(counts)
    order = np.argsort(codes, kind="stable")
    codes = codes[order]
    at = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    return codes[at], np.add.reduceat(numbers[order], at)


def _pair_counter(batches):
    """pair, n: the documents of a task that hold each pair, added up in blocks of bounded size."""
    held, counts, size = [], [], 0

    def drained():
        codes, numbers = _add_up(held, counts)
        return pa.RecordBatch.from_arrays([pa.array(codes), pa.array(numbers)], ["pair", "n"])

    for part in slices(batches):
        codes = np.frombuffer(b"".join(part.column("pairs").to_pylist()), dtype="<i8")
        if not len(codes):
            continue
        held.append(codes)
        counts.append(np.ones(len(codes), dtype=np.int64))
        size += len(codes)
        if size > COUNT_BLOCK:
            codes, numbers = _add_up(held, counts)
            held, counts, size = [codes], [numbers], len(codes)
            if size > COUNT_BLOCK // 2:
                yield drained()
                held, counts, size = [], [], 0
    if size:
        yield drained()


def pair_counts(merged: DataFrame, width: int) -> DataFrame:
    """pair (A id * width + B id), n documents that hold it linked, best: none of its A id has more."""
    added = map_batches(merged.select("pairs"), _pair_counter, "pair bigint, n bigint")
    counted = stored(added.groupBy("pair").agg(F.sum("n").alias("n")), "pairs")
    first = F.floor(F.col("pair") / width).cast("bigint")
    most = counted.groupBy(first.alias("a")).agg(F.max("n").alias("most"))
    return counted.withColumn("a", first).join(most, "a").selectExpr("pair", "n", "n = most AS best")


def _scorer(block):
    """row, n_best, count_sum of the pairs of each row that are in the block."""

    def run(batches):
        known, numbers, best = block.value
        for part in slices(batches):
            pairs, times = part.column("pairs").to_pylist(), part.column("times").to_pylist()
            sizes = [len(p) // 8 for p in pairs]
            codes = np.frombuffer(b"".join(pairs), dtype="<i8")
            often = np.frombuffer(b"".join(times), dtype="<u4").astype(np.int64)
            at = np.minimum(np.searchsorted(known, codes), len(known) - 1)
            often = np.where(known[at] == codes, often, 0)
            until = np.concatenate([[0], np.cumsum(sizes)])
            sums = [np.concatenate([[0], np.cumsum(often * x[at])]) for x in (best, numbers)]
            found = [pa.array(x[until[1:]] - x[until[:-1]], pa.int64()) for x in sums]
            kept = [part.column(name) for name in KEPT]
            yield pa.RecordBatch.from_arrays([*kept, *found], [*KEPT, "n_best", "count_sum"])

    return run


KEPT = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
SCORED = (
    "row bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, "
    "groups_sha256 string, n_best bigint, count_sum bigint"
)


def alignment_figures(
    docs: DataFrame,
    a_path: str,
    b_path: str,
    *,
    lane: int = LANE,
    pair_block: int = PAIR_BLOCK,
) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row of ``docs``.

    ``docs`` has doc_id and text; ``a_path`` and ``b_path`` are files of a byte-level .json vocabulary
    or of a sentencepiece .model. A pair's count is the number of rows that hold it linked;
    ``n_best`` are the links whose pair no other pair of their A id exceeds, ``count_sum`` is the sum
    over links. A null or empty text, and one whose tokens do not have its bytes, has no tokens:
    zeros and an empty ``groups_sha256``. Repeated rows give repeated rows and count as documents of
    their own; a null doc_id stays null; other columns are not read; an empty table gives no rows. A
    text of any length is aligned in one task, with about a hundred bytes a token.
    """
    narrow = docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text")
    merged = stored(map_batches(narrow, _merger(a_path, b_path, lane), MERGED), "aligned")
    counts = stored(pair_counts(merged, len(side(b_path).widths)), "pair_counts")
    blocks = max(1, -(-counts.count() // pair_block))
    passes = []
    for number in range(blocks):
        own = counts.where(F.pmod(F.xxhash64("pair"), F.lit(blocks)) == number)
        found = own.orderBy("pair").toArrow()
        columns = [found.column(name).to_numpy() for name in ("pair", "n", "best")]
        if not len(columns[0]):
            columns = [np.array([-1]), np.array([0]), np.array([False])]
        block = docs.sparkSession.sparkContext.broadcast(columns)
        passes.append(map_batches(merged.select(*KEPT, "pairs", "times"), _scorer(block), SCORED))
    scored = passes[0]
    if blocks > 1:
        for more in passes[1:]:
            scored = scored.unionAll(more)
        sums = [F.sum(name).alias(name) for name in ("n_best", "count_sum")]
        scored = scored.groupBy(*KEPT).agg(*sums)
    return scored.select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    )
