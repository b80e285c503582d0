"""Ranked lexical search (operator 13): an Aho-Corasick automaton of all item terms reads the documents.

The terms of the items, each between two guarding spaces, form one automaton. A text whose separators
are spaces goes through it whole, so that each output is an occurrence of a whole term, and outputs lead
to the items that hold the term. Nothing is indexed and no document is shuffled: the first pass adds up
the corpus figures (documents, terms, documents per term), the second scores every document for
every item and keeps the best of each task, which are ranked at the end.

Items are taken in blocks of at most about ``block_items`` items and ``block_terms`` terms; what is sent
to tasks is the automaton of one block, and each block takes its own two passes.
"""

from __future__ import annotations

import math
from collections import Counter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailmark.llm.workers import map_batches, slices

TOP = 50
BLOCK_ITEMS, BLOCK_TERMS = 2_000, 100_000
#: Candidates a task holds before it drops those that cannot be among the best.
HELD = 200_000
#: Parts in which the best rows of an item are ranked before all of them are.
PARTS = 32

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Each byte of a text as the automaton reads it: separators are spaces, A-Z are lower-cased, letters,
#: digits and the bytes of characters beyond ASCII stay.
READ_AS = bytes(
    ord(chr(b).lower()) if b < 128 and chr(b).isalnum() else b if b >= 128 else 32 for b in range(256)
)


def read(text: str | None) -> bytes:
    return (text or "").encode().translate(READ_AS)


def guarded(words: bytes) -> str:
    """Bytes between guards, one character a byte."""
    return f" {words.decode('latin-1')} "


def term_rows(items: DataFrame) -> DataFrame:
    """item_id, term: the different terms of each item; rows of one id are one item."""
    lowered = F.translate("text", UPPER, LOWER)
    terms = F.array_distinct(F.regexp_extract_all(lowered, F.lit(TERM), F.lit(0)))
    return items.select("item_id", F.explode(terms).alias("term")).distinct()


class Block:
    """The automaton of a block of items. Term t belongs to ``owners[until[t] : until[t + 1]]``."""

    def __init__(self, rows: pa.Table):
        encoded = rows.column("item_id").combine_chunks().dictionary_encode(null_encoding="encode")
        self.item_ids = encoded.dictionary
        terms = rows.column("term").combine_chunks().dictionary_encode()
        self.terms = terms.dictionary.to_pylist()
        number = terms.indices.to_numpy()
        self.owners = encoded.indices.to_numpy()[np.argsort(number, kind="stable")].astype(np.int64)
        self.until = np.concatenate([[0], np.cumsum(np.bincount(number, minlength=len(self.terms)))])
        self.automaton = ahocorasick.Automaton()
        for at, term in enumerate(self.terms):
            self.automaton.add_word(guarded(term.encode()), at)
        self.automaton.make_automaton()

    def occurrences(self, words: bytes) -> list[int]:
        """The term of each occurrence."""
        return [term for _, term in self.automaton.iter(guarded(words))]


#: In place of a term: documents with a term, and terms of all documents.
N_DOCS, N_TERMS = -1, -2


def _counter(block):
    def run(batches):
        index = block.value
        seen: Counter = Counter()
        for part in slices(batches):
            for text in part.column("text").to_pylist():
                words = read(text)
                n = len(words.split())
                if n:
                    seen[N_DOCS] += 1
                    seen[N_TERMS] += n
                    seen.update(set(index.occurrences(words)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(seen.keys(), pa.int64()), pa.array(seen.values(), pa.int64())], ["term", "n"]
        )

    return run


def weights(n_docs: int, holding: np.ndarray) -> np.ndarray:
    return np.array(
        [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) for df in holding.tolist()], dtype=np.int64
    )


class Best:
    """The best (score, document) of each item among those shown so far."""

    def __init__(self, n_items: int, k: int):
        self.k = k
        self.least = np.ones(n_items, dtype=np.int64)  # scores below are of no use
        self.held: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, scores: np.ndarray, ids: np.ndarray, named: np.ndarray) -> None:
        """``scores[item, document]`` of some documents."""
        item, at = np.nonzero(scores >= self.least[:, None])
        self.held.append((item, scores[item, at], ids[at], named[at]))
        self.size += len(item)
        if self.size > max(HELD, 2 * self.k * len(self.least)):
            self.cut()

    def cut(self) -> tuple[np.ndarray, ...]:
        """(item, score, id, named) of what is kept, by item and rank."""
        item, score, ids, named = (np.concatenate(x) for x in zip(*self.held))
        order = np.lexsort((ids, ~named, -score, item))
        sorted_items = item[order]
        rank = np.arange(len(order)) - np.searchsorted(sorted_items, sorted_items)
        last = order[rank == self.k - 1]
        self.least[item[last]] = score[last]
        order = order[rank < self.k]
        kept = item[order], score[order], ids[order], named[order]
        self.held, self.size = [kept], len(order)
        return kept


def _ranker(block, figures, k: int):
    def run(batches):
        index = block.value
        n_docs, n_terms, weight = figures
        n_items, all_terms = len(index.item_ids), len(index.terms)
        degree = np.diff(index.until)
        best = Best(n_items, k)
        for part in slices(batches):
            words = [read(text) for text in part.column("text").to_pylist()]
            lengths = np.array([len(w.split()) for w in words], dtype=np.int64)
            met = [index.occurrences(w) for w in words]
            doc = np.repeat(np.arange(len(met)), [len(m) for m in met])
            places, tf = np.unique(
                doc * all_terms + np.fromiter((t for m in met for t in m), np.int64, len(doc)),
                return_counts=True,
            )
            doc, term = np.divmod(places, all_terms)
            m = 100 - 50 + (50 * lengths * n_docs) // max(n_terms, 1)
            gain = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[doc]))
            # Each output counts for every item that holds its term.
            times = degree[term]
            owner = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            item = index.owners[owner + np.repeat(index.until[term], times)]
            scores = np.zeros((n_items, len(words)), dtype=np.int64)
            np.add.at(scores, (item, np.repeat(doc, times)), np.repeat(gain, times))
            ids = part.column("doc_id")
            named = ids.is_valid().to_numpy(zero_copy_only=False)
            best.add(scores, ids.fill_null(0).to_numpy(), named)
        if best.size:
            item, score, ids, named = best.cut()
            yield pa.RecordBatch.from_arrays(
                [index.item_ids.take(pa.array(item)), pa.array(ids, mask=~named), pa.array(score)],
                ["item_id", "doc_id", "score"],
            )

    return run


def _blocks(terms: DataFrame, block_items: int, block_terms: int) -> int:
    n_terms, n_items = terms.agg(F.count("*"), F.count_distinct(F.struct("item_id"))).head()
    return max(1, math.ceil(n_terms / block_terms), math.ceil(n_items / block_items))


def _ranked(found: DataFrame, k: int, *within: Column) -> DataFrame:
    order = Window.partitionBy(F.col("item_id"), *within).orderBy(
        F.desc("score"), F.asc_nulls_last("doc_id")
    )
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def rank_documents(
    docs: DataFrame,
    items: DataFrame,
    *,
    k: int = TOP,
    block_items: int = BLOCK_ITEMS,
    block_terms: int = BLOCK_TERMS,
) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best rows of ``docs`` (doc_id, text) for each item.

    ``items`` has item_id and text. Terms are runs of letters, digits and characters beyond ASCII, with A-Z
    lower-cased. A term counts once for an item; its weight is the floor of 1000 ln((2N+2)/(2df+1)) with N
    documents that have a term, and a document's score adds weight * (10^9 tf div (1000 tf + 20 m)), where
    m grows with its length against the mean. Only scores above 0 are ranked, equal ones by doc_id.

    A null or empty text has no terms. Rows of ``items`` with one id, or with none, are one item with the
    terms of all; an item without terms has no rows. Each row of ``docs`` stands for itself, also where it
    repeats a doc_id; a row without doc_id comes last among equal scores. Empty tables give no rows; other
    columns are not read.
    """
    terms = term_rows(items)
    n_blocks = _blocks(terms, block_items, block_terms)
    narrow = docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text")
    schema = T.StructType(
        [items.schema["item_id"], *[T.StructField(name, T.LongType()) for name in ("doc_id", "score")]]
    )
    found = docs.sparkSession.createDataFrame([], schema)
    for number in range(n_blocks):
        own = terms.where(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == number)
        rows = own.orderBy("item_id", "term").toArrow()
        if not rows.num_rows:
            continue
        index = Block(rows)
        block = docs.sparkSession.sparkContext.broadcast(index)
        counts = map_batches(narrow.select("text"), _counter(block), "term bigint, n bigint")
        totals = dict(counts.groupBy("term").agg(F.sum("n")).collect())
        n_docs = totals.get(N_DOCS, 0)
        holding = np.array([totals.get(t, 0) for t in range(len(index.terms))])
        figures = n_docs, totals.get(N_TERMS, 0), weights(n_docs, holding)
        found = found.unionAll(map_batches(narrow, _ranker(block, figures, k), schema))
    part = F.pmod(F.spark_partition_id(), F.lit(PARTS))
    some = _ranked(found.withColumn("part", part), k, F.col("part")).drop("part", "rank")
    return _ranked(some, k).select("item_id", "rank", "doc_id", "score")
