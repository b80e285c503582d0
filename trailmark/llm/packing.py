"""Packing (operator 10): sum-of-squares online packing into windows of a fixed number of tokens.

Each partition of the input packs its own documents as they come. Full windows are cut off a long
document first; what is left of it goes to the fill level that keeps the sum of the squared
numbers of open windows per level lowest. The numbers are tracked in one array over levels. At the
end, and when more than ``max_open`` windows are open, the emptiest windows are cut up to fill the
fullest, so that a partition pads one window at most.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from trailmark.llm import token_memo
from trailmark.llm.workers import map_batches, slices

WINDOW, END_ID, MAX_OPEN = 2048, 1, 4096
COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
SCHEMA = ", ".join(f"{name} bigint" for name in COLUMNS)
ID_BYTES = 4
#: Sequences a partition can number.
SEQUENCES = 1 << 36


class Packer:
    """Open windows of one partition. A piece is (doc_id, start, ids as bytes, doc_tokens)."""

    def __init__(self, window: int, first_sequence: int, max_open: int):
        self.window, self.sequence, self.max_open = window, first_sequence, max_open
        self.counts = np.zeros(window + 1, dtype=np.int64)  # open windows per fill level
        self.open: dict[int, list[list[tuple]]] = {}
        self.n_open = 0
        self.rows: list[tuple] = []

    def close(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc_id, start, ids, doc_tokens in pieces:
            length = len(ids) // ID_BYTES
            self.rows.append((doc_id, start, length, zlib.crc32(ids), doc_tokens, self.sequence, offset))
            offset += length
        self.sequence += 1

    def best_level(self, size: int) -> int:
        """Fill level of the window to take, 0 for a new one; the fullest of equally good ones."""
        counts, room = self.counts, self.window - size
        levels = np.flatnonzero(counts[1 : room + 1]) + 1
        if not len(levels):
            return 0
        change = 2 * (counts[levels + size] - counts[levels]) + 2
        if levels[-1] == room:  # the window is full then and no longer counted
            change[-1] = 1 - 2 * counts[room]
        best = len(change) - 1 - int(np.argmin(change[::-1]))
        return int(levels[best]) if change[best] <= 2 * counts[size] + 1 else 0

    def put(self, level: int, pieces: list[tuple]) -> None:
        self.counts[level] += 1
        self.open.setdefault(level, []).append(pieces)
        self.n_open += 1

    def take(self, level: int) -> list[tuple]:
        self.counts[level] -= 1
        pieces = self.open[level].pop()
        if not self.open[level]:
            del self.open[level]
        self.n_open -= 1
        return pieces

    def add(self, doc_id, ids: bytes) -> None:
        total = len(ids) // ID_BYTES
        whole = total - total % self.window
        step = self.window * ID_BYTES
        for start in range(0, whole, self.window):
            self.close([(doc_id, start, ids[start * ID_BYTES : start * ID_BYTES + step], total)])
        size = total - whole
        if not size:
            return
        piece = (doc_id, whole, ids[whole * ID_BYTES :], total)
        level = self.best_level(size)
        pieces = [*self.take(level), piece] if level else [piece]
        if level + size == self.window:
            self.close(pieces)
        else:
            self.put(level + size, pieces)
            if self.n_open > self.max_open:
                self.fill_up(self.max_open // 2)

    def fill_up(self, keep: int) -> None:
        """Fill the fullest windows with the pieces of the emptiest until ``keep`` are open."""
        levels = sorted(self.open)
        while self.n_open > max(keep, 1):
            while levels[-1] not in self.open:
                levels.pop()
            filled = levels[-1]
            window = self.take(filled)
            while filled < self.window and self.n_open:
                low = next(level for level in levels if level in self.open)
                donor = self.take(low)
                while donor and filled < self.window:
                    doc_id, start, ids, total = donor.pop()
                    length, room = len(ids) // ID_BYTES, self.window - filled
                    if length > room:  # the head goes, the tail stays with its window
                        donor.append((doc_id, start + room, ids[room * ID_BYTES :], total))
                        ids, length = ids[: room * ID_BYTES], room
                    window.append((doc_id, start, ids, total))
                    filled += length
                    low -= length
                if donor:
                    self.put(low, donor)
                    levels = sorted(self.open)
            if filled == self.window:
                self.close(window)
            else:
                self.put(filled, window)
                break

    def finish(self) -> None:
        self.fill_up(0)
        for level in sorted(self.open):
            for pieces in self.open[level]:
                self.close(pieces)
        self.open, self.n_open = {}, 0

    def drain(self) -> pa.RecordBatch:
        columns = zip(*self.rows) if self.rows else [[] for _ in COLUMNS]
        batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], COLUMNS)
        self.rows = []
        return batch


#: A run of letters at the start of a word, whole, or what remains of a word; for text in lower case.
LETTERS = re.compile("[a-z\xdf-\xf6\xf8-\xff]++(?![\xaa\xb5\xba])|[^ \t\n\r]+")


def pieces_of(text: str) -> list[str]:
    """``text`` cut where the tokenizer cuts in any case.

    White space is dropped, and case with it. In Latin-1 text, which holds no combining mark, a run
    of letters that starts a word ends where the letters end; what follows starts anew. Elsewhere,
    and where case could decide on a special string, words stay whole and as they are.
    """
    if "<|" not in text:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            pass
        else:
            return LETTERS.findall(text.lower())
    return token_memo.WORD.findall(text)


def id_bytes(vocabulary: str, texts: list[str | None]) -> list[bytes]:
    """Little-endian 32-bit ids of each text, without any end mark."""
    pieces = [pieces_of(text or "") for text in texts]
    memo = token_memo.remembered(
        vocabulary, "ids", pieces, lambda e: np.asarray(e.ids, dtype="<u4").tobytes()
    )
    return [b"".join(map(memo.__getitem__, found)) for found in pieces]


def _packer(vocabulary: str, window: int, end_id: int, max_open: int):
    def run(batches):
        packer = Packer(window, TaskContext.get().partitionId() * SEQUENCES, max_open)
        end = int(end_id).to_bytes(ID_BYTES, "little")
        for part in slices(batches):
            ids = part.column("doc_id").to_pylist()
            for doc_id, found in zip(ids, id_bytes(vocabulary, part.column("text").to_pylist())):
                packer.add(doc_id, found + end)
            yield packer.drain()
        packer.finish()
        yield packer.drain()

    return run


def pack(
    docs: DataFrame,
    vocabulary: str,
    *,
    window: int = WINDOW,
    end_id: int = END_ID,
    max_open: int = MAX_OPEN,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``vocabulary`` is the path of a .json tokenizer file that drops white space. Each row of
    ``docs`` (doc_id, text) is a document of its own, its ids followed by ``end_id``; a null or
    empty text is the end mark alone. Repeated rows are packed each; a null doc_id stays null;
    other columns are not read. An empty table gives no rows.

    Narrow: no shuffle. Sequence numbers come from the input's partition, and a repeated task packs
    the same rows in the same order to the same sequences, as long as ``docs`` is read from files
    (or sorted within partitions). Memory: ``max_open`` windows.
    """
    narrow = docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text")
    return map_batches(narrow, _packer(vocabulary, window, end_id, max_open), SCHEMA)
