"""SimHash near-duplicates (operator 6) with a Gray-order hierarchical index.

Distinct fingerprints are what is compared; copies of a text share one. Two fingerprints that
differ in at most four bits agree on at least one of five bands, so each fingerprint is rotated
five times with another band in front, and the band in front is the root of an index: a cell.
Inside a cell the fingerprints are sorted by Gray rank. Leaves of neighbours keep the bits that
all their members share (mask and pattern), upper nodes those that all their leaves share. A pair
of nodes whose shared bits differ in more than four places is left out with all that is below;
differences found above are carried down and added to.

A cell with more than ``cell_limit`` fingerprints gets a second band level, by the same argument
on its other bits; what is still larger is dealt into parts, and the parts meet two at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailmark.llm import local_links
from trailmark.llm.components import connected_components
from trailmark.llm.workers import map_batches, slices, stored

SHINGLE, SEED, MAX_BITS = 4, 42, 4
BITS = 64
BANDS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))  # (first bit from the top, width)
INNER_WIDTH = 10  # of the bands inside a cell; the last takes what remains
CELL_LIMIT = 2048
LEAF, FANOUT = 32, 16
PAIRS = 1 << 19  # compared at a time

#: For each byte value, which of its eight bits are set.
BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint, unsigned. A bit is set if more than half of the shingle hashes have it."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z and ASCII white space count
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(word) + 1 for word in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    hash64 = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [hash64(joined, SEED)]
    else:
        hashes = [hash64(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist())]
    octets = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
    # How often each value occurs at each of the eight places, then how often each bit is set.
    places = octets.astype(np.int64) + np.arange(0, 2048, 256)
    counts = np.bincount(places.ravel(), minlength=2048).reshape(8, 256) @ BYTE_BITS
    bits = (2 * counts > len(hashes)).ravel()
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")


def _signed(values) -> np.ndarray:
    return np.array(values, dtype=np.uint64).view(np.int64)


def fingerprints(docs: DataFrame, *, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fingerprint as a signed whole number) of every row of ``docs``."""

    def run(batches):
        for part in slices(batches):
            found = [fingerprint(text, shingle) for text in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(_signed(found))], ["doc_id", "code"]
            )

    narrow = docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text")
    return map_batches(narrow, run, "doc_id bigint, code bigint")


def _rotated(code: Column, first: int) -> Column:
    if not first:
        return code
    return F.shiftleft(code, first).bitwiseOR(F.shiftrightunsigned(code, BITS - first))


def gray_ranks(*words: Column) -> list[Column]:
    """Where a code (its words from the top) comes when all are listed so that neighbours differ in one bit."""
    ranks: list[Column] = []
    for rank in words:
        for step in (1, 2, 4, 8, 16, 32):
            rank = rank.bitwiseXOR(F.shiftrightunsigned(rank, step))
        if ranks:  # an odd number of bits above turns the order round
            rank = rank.bitwiseXOR(F.negate(ranks[-1].bitwiseAND(F.lit(1).cast("bigint"))))
        ranks.append(rank)
    return ranks


def _top_bits(code: Column, first: int, width: int) -> Column:
    return F.shiftrightunsigned(code, BITS - first - width).bitwiseAND(F.lit((1 << width) - 1))


def _cells(codes: DataFrame) -> DataFrame:
    """A row per code and band: cell (band and its bits), rotated code."""
    entries = []
    for number, (first, width) in enumerate(BANDS):
        turned = _rotated(F.col("code"), first)
        cell = _top_bits(turned, 0, width) + (number << 13)
        entries.append(F.struct(cell.cast("bigint").alias("cell"), turned.alias("turned")))
    return codes.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def _inner_cells(cells: DataFrame) -> DataFrame:
    """Rows of large cells, five times each: the cell with one of five bands of its other bits."""
    last = len(BANDS) - 1

    def inner_cell(number: int, width: int) -> Column:
        first = width + number * INNER_WIDTH
        own = INNER_WIDTH if number < last else BITS - first
        return (F.col("cell") + 1) * (1 << 16) + (number << 13) + _top_bits(F.col("turned"), first, own)

    in_last = F.shiftright("cell", 13) == last
    entries = [
        F.when(in_last, inner_cell(number, BANDS[last][1]))
        .otherwise(inner_cell(number, BANDS[0][1]))
        .cast("bigint")
        for number in range(len(BANDS))
    ]
    return cells.select(F.explode(F.array(*entries)).alias("inner"), "cell", "turned")


class Nodes:
    """Leaves or upper nodes over sorted codes (words, codes): the bits all codes of a node share.

    A node has up to ``size`` neighbours of one group below it.
    """

    def __init__(self, all_set: np.ndarray, any_set: np.ndarray, group: np.ndarray, size: int):
        opens = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        place = np.arange(len(group)) - np.repeat(opens, np.diff(np.append(opens, len(group))))
        self.starts = np.flatnonzero(place % size == 0)
        self.counts = np.diff(np.append(self.starts, len(group)))
        self.group = group[self.starts]
        self.all_set = np.bitwise_and.reduceat(all_set, self.starts, axis=1)
        self.any_set = np.bitwise_or.reduceat(any_set, self.starts, axis=1)
        self.mask = ~(self.all_set ^ self.any_set)


def _bits(words: np.ndarray) -> np.ndarray:
    return np.bitwise_count(words).sum(axis=0, dtype=np.int64)


def _pairs_of_group(group: np.ndarray):
    """(a, b) arrays, a <= b, of all pairs of nodes of one group. Groups lie together."""
    at = np.arange(len(group))
    yield at, at
    step = 0
    while len(at):
        step += 1
        at = at[at + step < len(group)]
        at = at[group[at] == group[at + step]]
        yield at, at + step


def _expand(nodes: Nodes, a: np.ndarray, b: np.ndarray):
    """All pairs (first <= second) of what is below the pairs of nodes, each with its place in ``a``."""
    many = nodes.counts[a] * nodes.counts[b]
    part = np.cumsum(many) // PAIRS
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(a)]
    for first, last in zip(cuts, cuts[1:]):
        some = many[first:last]
        parent = np.repeat(np.arange(first, last), some)
        at = np.arange(len(parent)) - np.repeat(np.cumsum(some) - some, some)
        row, column = np.divmod(at, np.repeat(nodes.counts[b[first:last]], some))
        left, right = nodes.starts[a[parent]] + row, nodes.starts[b[parent]] + column
        keep = left <= right
        yield left[keep], right[keep], parent[keep]


def close_pairs(codes: np.ndarray, max_bits: int = MAX_BITS, group: np.ndarray | None = None):
    """(i, j) arrays, i < j, of all pairs of ``codes`` of one group within ``max_bits``.

    ``codes`` is one row of 64-bit words, or several, (words, codes), for longer codes. They come sorted
    by group and then by Gray rank; without ``group`` they are one. Each group has an index of its own.
    """
    codes = np.atleast_2d(codes)
    if codes.shape[1] < 2:
        return
    group = np.zeros(codes.shape[1], dtype=np.int64) if group is None else group
    leaves = Nodes(codes, codes, group, LEAF)
    upper = Nodes(leaves.all_set, leaves.any_set, leaves.group, FANOUT)
    for a, b in _pairs_of_group(upper.group):
        shared = upper.mask[:, a] & upper.mask[:, b]
        differing = _bits((upper.all_set[:, a] ^ upper.all_set[:, b]) & shared)
        near = differing <= max_bits
        a, b, shared, differing = a[near], b[near], shared[:, near], differing[near]
        for left, right, parent in _expand(upper, a, b):
            fresh = leaves.mask[:, left] & leaves.mask[:, right] & ~shared[:, parent]
            total = differing[parent] + _bits((leaves.all_set[:, left] ^ leaves.all_set[:, right]) & fresh)
            near = total <= max_bits
            for i, j, _ in _expand(leaves, left[near], right[near]):
                different = i < j
                i, j = i[different], j[different]
                near = _bits(codes[:, i] ^ codes[:, j]) <= max_bits
                if near.any():
                    yield i[near], j[near]


def _linker(max_bits: int):
    def run(batches):
        for rows in local_links.runs(batches, ["inner", "cell", "deal"]):
            turned = rows.column("turned").to_numpy().view(np.uint64)
            if len(turned) < 2:
                continue
            side = rows.column("side").to_numpy()
            labels = np.arange(len(turned))
            for i, j in close_pairs(turned, max_bits):
                meets = (side[i] == 0) | (side[i] != side[j])
                labels = local_links.merge(labels, i[meets], j[meets])
            linked = np.flatnonzero(labels != np.arange(len(turned)))
            if len(linked):
                first = BANDS[int(rows.column("cell")[0].as_py()) >> 13][0]
                codes = (turned >> np.uint64(first)) | (turned << np.uint64((BITS - first) % BITS))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(codes[at].view(np.int64)) for at in (linked, labels[linked])],
                    ["a", "b"],
                )

    return run


def _dealt(inner: DataFrame, still: DataFrame, cell_limit: int) -> DataFrame:
    """Rows of cells too large for one task, in parts that meet two at a time."""
    parts = F.ceil(F.col("n") / (cell_limit // 2)).cast("bigint")
    rows = inner.join(still, ["inner", "cell"]).select(
        "inner", "cell", "turned", parts.alias("parts"), F.pmod(F.xxhash64("turned"), parts).alias("own")
    )
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") == low, 1).otherwise(2)
    return rows.select("inner", "cell", "turned", (low * F.col("parts") + high).alias("deal"), side.alias("side"))


def links(codes: DataFrame, *, max_bits: int = MAX_BITS, cell_limit: int = CELL_LIMIT) -> DataFrame:
    """Edges (a, b) that connect every two distinct codes within ``max_bits``, directly or not.

    ``codes`` has one column ``code`` of distinct signed 64-bit numbers and is read twice. Each cell
    gives a spanning forest of the links inside it, so there are never more rows than entries.
    """
    cells = _cells(codes)
    sizes = cells.groupBy("cell").agg(F.count("*").alias("n"))
    large = stored(sizes.where(F.col("n") > cell_limit), "cells")
    nothing, whole = F.lit(0).cast("bigint"), F.lit(0)
    if large.isEmpty():
        entries = cells.select(nothing.alias("inner"), "cell", "turned", nothing.alias("deal"), whole.alias("side"))
    else:
        usual = cells.join(large, "cell", "left_anti")
        inner = _inner_cells(cells.join(large, "cell", "left_semi"))
        still = inner.groupBy("inner", "cell").agg(F.count("*").alias("n")).where(F.col("n") > cell_limit)
        still = stored(still, "cells")
        entries = usual.select(nothing.alias("inner"), "cell", "turned", nothing.alias("deal"), whole.alias("side"))
        entries = entries.unionAll(
            inner.join(still, ["inner", "cell"], "left_anti").select(
                "inner", "cell", "turned", nothing.alias("deal"), whole.alias("side")
            )
        )
        if not still.isEmpty():
            entries = entries.unionAll(_dealt(inner, still, cell_limit))
    sorted_cells = (
        entries.withColumn("rank", *gray_ranks(F.col("turned")))
        .repartition("inner", "cell", "deal")
        .sortWithinPartitions("inner", "cell", "deal", "rank")
        .drop("rank")
    )
    return map_batches(sorted_cells, _linker(max_bits), "a bigint, b bigint")


def near_duplicates(
    docs: DataFrame,
    *,
    shingle: int = SHINGLE,
    max_bits: int = MAX_BITS,
    cell_limit: int = CELL_LIMIT,
) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row of ``docs`` (doc_id, text).

    ``component_id`` is the smallest doc_id reachable by links of at most ``max_bits`` differing
    bits (at most four, or the bands would miss pairs). A text with fewer words than ``shingle`` is
    one shingle; one without words, null or empty, has fingerprint zero and is linked like any
    other. Repeated rows give repeated rows. A row without doc_id links others but names no
    component; a component of such rows only has a null component_id. An empty table gives no
    rows; other columns are not read.
    """
    if not 0 <= max_bits < len(BANDS):
        raise ValueError(f"max_bits must be below {len(BANDS)}")
    prints = stored(fingerprints(docs, shingle=shingle), "fingerprints")
    nodes = stored(prints.groupBy("code").agg(F.min("doc_id").alias("first_id")), "codes")
    found = connected_components(links(nodes.select("code"), max_bits=max_bits, cell_limit=cell_limit))
    members = found.join(nodes, found["node"] == nodes["code"]).select("code", "component", "first_id")
    ids = members.groupBy("component").agg(F.min("first_id").alias("least_id"))
    linked = members.join(ids, "component").select("code", "least_id")
    component = F.coalesce("least_id", "first_id").alias("component_id")
    # Stored, so that the join with all documents stands alone and a code with very many of them
    # can be split by adaptive execution.
    labels = stored(nodes.join(linked, "code", "left").select("code", component), "labels")
    return prints.join(labels, "code").select(
        "doc_id", F.lower(F.lpad(F.hex("code"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_first(
    docs: DataFrame,
    *,
    shingle: int = SHINGLE,
    max_bits: int = MAX_BITS,
    cell_limit: int = CELL_LIMIT,
) -> DataFrame:
    """The rows of ``docs`` with the smallest doc_id of their group of near-duplicates, columns as they are.

    Of rows that repeat a doc_id with one fingerprint the first by all columns stays; different
    fingerprints under one doc_id all stay. Rows without doc_id stay only where no row of their group
    has one.
    """
    judged = near_duplicates(docs, shingle=shingle, max_bits=max_bits, cell_limit=cell_limit)
    judged = stored(judged, "near_duplicates")
    name, place = "fingerprint", "place"
    while name in docs.columns:
        name += "_"
    while place in [*docs.columns, name]:
        place += "_"
    own = _with_fingerprint(docs, name, shingle)

    def matching(other: DataFrame) -> Column:
        return own["doc_id"].eqNullSafe(other["first_id"]) & (own[name] == other["code"])

    rows = judged.selectExpr("doc_id AS first_id", "fingerprint AS code", "component_id")
    kept = rows.where("first_id <=> component_id").select("first_id", "code").distinct()
    # The same plan at every size: a list of rows to keep grows with the documents and is no broadcast.
    first = own.join(kept.hint("merge"), matching(kept), "left_semi")
    counts = rows.where("first_id IS NOT NULL").groupBy("first_id", "code").agg(F.count("*").alias("n"))
    repeated = stored(counts.where("n > 1").select("first_id", "code"), "repeated")
    if repeated.isEmpty():
        return first.select(*docs.columns)
    sortable = [f"`{f.name}`" for f in docs.schema if not isinstance(f.dataType, T.MapType)]
    in_order = Window.partitionBy(name, "doc_id").orderBy(*sortable)
    again = first.join(repeated, matching(repeated), "left_semi").withColumn(
        place, F.row_number().over(in_order)
    )
    once = first.join(repeated, matching(repeated), "left_anti").select(*docs.columns)
    return once.unionByName(again.where(F.col(place) == 1).select(*docs.columns))


def _with_fingerprint(rows: DataFrame, name: str, shingle: int) -> DataFrame:
    """``rows`` with a column ``name`` after their own."""

    def run(batches):
        for part in slices(batches):
            found = [f"{fingerprint(text, shingle):016x}" for text in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(found, pa.string())], [*part.schema.names, name]
            )

    return map_batches(rows, run, T.StructType([*rows.schema, T.StructField(name, T.StringType())]))
