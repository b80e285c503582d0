"""Exact top-k search by inner product (operator 12) with a bit-sliced index.

Components are quantised to whole numbers. The rows of a block are the bits of bitmaps: for each
component and each of its binary digits one slice says which rows have that digit set. The scores of
a query over a block are added up by bitmap arithmetic: each signed binary digit of a query component
adds the component's slices, shifted (or their complements, and a constant); slices of one weight are
added three at a time to a sum and a carry. From the most significant slice of the scores downward, rows
are taken or left until k are left; of the rows with the boundary score those with the smallest ids
are taken. Each block gives the k best rows of each query, with exact scores, and the best of these are
the answer.

Queries meet blocks on a grid: blocks are laid out once for each cell of queries and queries once
for each block, and both are shuffled by (block, cell).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailmark.llm.workers import map_batches, stored

SCALE, TOP, QUERY_STEP = 64, 20, 20
#: Rows of a block, and the most queries that meet a block in one task.
BLOCK_ROWS, CELL_QUERIES = 32_768, 4_096
#: Rows a partition can number.
ROWS = 1 << 36
#: Whole numbers up to this size give scores that fit 64 bits, for up to 1,024 components.
LARGEST = 1 << 26
WORD = 64

QUANTISED = "row bigint, vec_id bigint, parts array<int>"
BLOCKS = (
    "block bigint, rows binary, ids binary, named binary, lows binary, widths binary, slices binary"
)
FOUND = "query_row bigint, query_id bigint, row bigint, vec_id bigint, score bigint"


def _quantiser(scale: int):
    def run(batches):
        row = TaskContext.get().partitionId() * ROWS
        for batch in batches:
            vectors = batch.column("embedding")
            offsets = vectors.offsets.to_numpy()
            known = vectors.is_valid().to_numpy(zero_copy_only=False)
            flat = vectors.values.to_numpy(zero_copy_only=False).astype(np.float64)  # null: not a number
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
            usable = known & (bad[offsets[1:]] == bad[offsets[:-1]])
            with np.errstate(invalid="ignore", over="ignore"):
                whole = np.floor(scale * flat)
            lengths = np.where(usable, np.diff(offsets), 0)
            taken = np.repeat(offsets[:-1] - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
            whole = whole[taken]
            if len(whole) and np.abs(whole).max() > LARGEST:
                raise ValueError(f"Components beyond {LARGEST // scale} have no score of 64 bits")
            until = np.concatenate([[0], np.cumsum(lengths[usable])])
            parts = pa.ListArray.from_arrays(pa.array(until, pa.int32()), pa.array(whole.astype(np.int32)))
            ids = batch.column("vec_id").filter(pa.array(usable))
            yield pa.RecordBatch.from_arrays(
                [pa.array(row + np.flatnonzero(usable)), ids, parts], ["row", "vec_id", "parts"]
            )
            row += batch.num_rows

    return run


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """row, vec_id, parts: floor(scale * x) of each component; rows that take no part are left out."""
    narrow = vectors.selectExpr(
        "CAST(vec_id AS BIGINT) AS vec_id", "CAST(embedding AS ARRAY<DOUBLE>) AS embedding"
    )
    return map_batches(narrow, _quantiser(scale), QUANTISED)


def padded(parts: pa.Array) -> np.ndarray:
    """Rows of numbers as a matrix; what a shorter row lacks is 0."""
    offsets = parts.offsets.to_numpy()
    lengths = np.diff(offsets)
    matrix = np.zeros((len(lengths), int(lengths.max(initial=0))), dtype=np.int64)
    matrix[np.arange(matrix.shape[1]) < lengths[:, None]] = parts.flatten().to_numpy()
    return matrix


class Block:
    """The slices of one block of rows, and where each component's are.

    ``slices[s]`` is a bitmap of 64-bit words; those of component d begin at ``starts[d]``, least digit
    first, and hold what exceeds ``lows[d]``. Rows are in order of id, those without one last.
    """

    def __init__(self, lows: np.ndarray, widths: np.ndarray, slices: np.ndarray, n_rows: int):
        self.lows, self.widths, self.n_rows = lows, widths, n_rows
        self.starts = np.cumsum(widths) - widths
        self.slices = slices
        self.either = np.concatenate([slices, ~slices])  # a slice, or its complement
        bits = np.zeros(slices.shape[1] * WORD, dtype=np.uint8)
        bits[:n_rows] = 1
        self.present = np.packbits(bits, bitorder="little").view(np.uint64)

    @classmethod
    def of(cls, matrix: np.ndarray) -> "Block":
        n_rows, parts = matrix.shape
        words = -(-max(n_rows, 1) // WORD)
        lows = matrix.min(axis=0, initial=LARGEST) if n_rows else np.zeros(parts, np.int64)
        above = matrix - lows
        widths = np.array([int(x).bit_length() for x in above.max(axis=0, initial=0)], dtype=np.int64)
        slices = np.zeros((int(widths.sum()), words), dtype=np.uint64)
        bits = np.zeros(words * WORD, dtype=np.uint8)
        at = 0
        for d, width in enumerate(widths.tolist()):
            for digit in range(width):
                bits[:n_rows] = above[:, d] >> digit & 1
                slices[at] = np.packbits(bits, bitorder="little").view(np.uint64)
                at += 1
        return cls(lows, widths, slices, n_rows)

    def scores(self, query: np.ndarray) -> tuple[list[np.ndarray], int]:
        """(slices of what each row's score exceeds the constant by, the constant)."""
        shared = min(len(query), len(self.widths))
        query, lows, widths = query[:shared], self.lows[:shared], self.widths[:shared]
        part, shift, negative = signed_digits(query)
        constant = int((query * lows).sum())
        constant -= int((((1 << widths[part]) - 1) << shift)[negative].sum())
        # A digit adds the slices of its component, each shifted by the digit's place.
        counts = widths[part]
        digit = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        rows = np.repeat(self.starts[part] + negative * len(self.slices), counts) + digit
        weights = np.repeat(shift, counts) + digit
        order = np.argsort(weights, kind="stable")
        return self.add(rows[order], np.bincount(weights)), constant

    def add(self, rows: np.ndarray, per_weight: np.ndarray) -> list[np.ndarray]:
        """The sum of slices, ``per_weight[p]`` of them with the weight 2 ** p, least digit first."""
        total, carried, at, weight = [], [], 0, 0
        while weight < len(per_weight) or carried:
            n = int(per_weight[weight]) if weight < len(per_weight) else 0
            terms = np.concatenate([self.either[rows[at : at + n]], *carried])
            at, weight, carried = at + n, weight + 1, []
            while len(terms) > 2:
                third, rest = divmod(len(terms), 3)
                x, y, z = terms[:third], terms[third : 2 * third], terms[2 * third : 3 * third]
                differ = x ^ y
                x &= y
                carried.append(x | (differ & z))
                np.bitwise_xor(differ, z, out=x)
                if rest:
                    terms[third : third + rest] = terms[3 * third :]
                terms = terms[: third + rest]
            if len(terms) == 2:
                carried.append(terms[:1] & terms[1:])
                total.append(terms[0] ^ terms[1])
            else:
                total.append(terms[0] if len(terms) else np.zeros_like(self.present))
        return total

    def best(self, query: np.ndarray, k: int, own: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, scores) of the k best rows without the row at ``own`` (-1: none), unordered."""
        slices, constant = self.scores(query)
        open_rows = self.present.copy()
        if own >= 0:
            open_rows[own // WORD] &= ~np.uint64(1 << own % WORD)
        taken, n_taken = np.zeros_like(open_rows), 0
        for digit in reversed(slices):
            higher = open_rows & digit
            n = n_taken + int(np.bitwise_count(higher).sum())
            if n > k:
                open_rows = higher
            else:
                taken |= higher
                n_taken = n
                open_rows &= ~digit
        places = _places(taken)
        if n_taken < k:  # all rows still open have one score: the smallest ids are first
            places = np.concatenate([places, _places(open_rows)[: k - n_taken]])
        word, bit = places // WORD, (places % WORD).astype(np.uint64)
        scores = np.full(len(places), constant, dtype=np.int64)
        for weight, digit in enumerate(slices):
            scores += ((digit[word] >> bit) & np.uint64(1)).astype(np.int64) << weight
        return places, scores


def _places(bitmap: np.ndarray) -> np.ndarray:
    """The numbers of the set bits, rising."""
    words = np.flatnonzero(bitmap)
    bits = np.unpackbits(bitmap[words].view(np.uint8), bitorder="little").reshape(-1, WORD)
    word, bit = np.nonzero(bits)
    return words[word] * WORD + bit


def signed_digits(query: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(component, place, negative) of the binary digits 1 and -1 of whole numbers, no two in a row."""
    left, shift, found = query.copy(), 0, []
    while left.any():
        odd = np.flatnonzero(left & 1)
        digit = 2 - (left[odd] & 3)  # 1 or -1, so that the next digit is 0
        left[odd] -= digit
        found.append((odd, np.full(len(odd), shift), digit < 0))
        left >>= 1
        shift += 1
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    return tuple(np.concatenate(x) for x in zip(*found))


def _indexer(block_rows: int):
    """Each partition's rows as blocks."""

    def packed(number: int, batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(batches).combine_chunks()
        ids = table.column("vec_id").combine_chunks()
        named = ids.is_valid().to_numpy(zero_copy_only=False)
        numbers = ids.fill_null(0).to_numpy()
        rows = table.column("row").to_numpy()
        order = np.lexsort((rows, numbers, ~named))
        block = Block.of(padded(table.column("parts").combine_chunks())[order])
        columns = [rows[order], numbers[order], named[order], block.lows, block.widths, block.slices]
        return pa.RecordBatch.from_arrays(
            [pa.array([number]), *[pa.array([x.tobytes()], pa.binary()) for x in columns]],
            ["block", "rows", "ids", "named", "lows", "widths", "slices"],
        )

    def run(batches):
        held, size = [], 0
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                piece = batch.slice(at, min(2 * block_rows - size, batch.num_rows - at))
                held.append(piece)
                at, size = at + piece.num_rows, size + piece.num_rows
                if size == 2 * block_rows:
                    yield packed(number, held)
                    held, size, number = [], 0, number + 1
        if held:
            yield packed(number, held)

    return run


def index(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The bit-sliced index of ``quantised`` rows: a row per block of about ``block_rows``."""
    n_blocks = max(1, -(-rows.count() // block_rows))
    return map_batches(rows.repartition(n_blocks), _indexer(block_rows), BLOCKS)


def _searcher(k: int):
    """The k best rows of a block for each query of a cell."""

    def run(blocks: pa.Table, queries: pa.Table) -> pa.Table:
        found = []
        for row in blocks.to_pylist() if queries.num_rows else []:
            rows, ids, lows, widths = (
                np.frombuffer(row[name], dtype=np.int64) for name in ("rows", "ids", "lows", "widths")
            )
            named = np.frombuffer(row["named"], dtype=bool)
            words = -(-len(rows) // WORD)
            slices = np.frombuffer(row["slices"], dtype=np.uint64).reshape(-1, words)
            block = Block(lows, widths, slices, len(rows))
            matrix = padded(queries.column("parts").combine_chunks())
            numbers = queries.column("row").to_numpy()
            by_row = np.argsort(rows)
            near = by_row[np.minimum(np.searchsorted(rows, numbers, sorter=by_row), len(rows) - 1)]
            own = np.where(rows[near] == numbers, near, -1).tolist()
            answers = [block.best(query, k, at) for query, at in zip(matrix, own)]
            places = np.concatenate([p for p, _ in answers])
            of = np.repeat(np.arange(len(answers)), [len(p) for p, _ in answers])
            found.append(
                [
                    pa.array(numbers[of]),
                    queries.column("vec_id").combine_chunks().take(pa.array(of)),
                    pa.array(rows[places]),
                    pa.array(ids[places], mask=~named[places]),
                    pa.array(np.concatenate([s for _, s in answers])),
                ]
            )
        names = ["query_row", "query_id", "row", "vec_id", "score"]
        if not found:
            return pa.table({name: pa.array([], pa.int64()) for name in names})
        return pa.concat_tables([pa.table(columns, names) for columns in found])

    return run


def top_matches(
    vectors: DataFrame,
    *,
    k: int = TOP,
    query_step: int = QUERY_STEP,
    scale: int = SCALE,
    block_rows: int = BLOCK_ROWS,
    cell_queries: int = CELL_QUERIES,
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best rows for each query of ``vectors`` (vec_id, embedding).

    Queries are the rows whose vec_id is divisible by ``query_step``, candidates all rows but the
    query's own. Scores are inner products of floor(scale * x); equal ones go to the smaller vec_id. A
    vector that is null or holds a null or non-finite component takes no part; what a shorter one lacks
    counts as 0. Each row stands for itself: a repeated vec_id is asked for, and found, once for each of
    its rows. A row without vec_id asks nothing and comes last among equal scores. Fewer rows than
    ``k`` are all returned; an empty table gives none; other columns are not read. Components beyond
    2 ** 26 / scale are refused, since scores are numbers of 64 bits.
    """
    rows = stored(quantised(vectors, scale), "quantised")
    blocks = stored(index(rows, block_rows), "slices")
    queries = rows.where(F.col("vec_id") % query_step == 0)
    n_blocks, n_queries = blocks.count(), queries.count()
    if not n_blocks or not n_queries:
        return rows.limit(0).selectExpr(
            "vec_id AS query_id", "CAST(0 AS INT) AS rank", "vec_id", "CAST(0 AS BIGINT) AS score"
        )
    # As many cells as bound the queries of one, and on small tables as keep all cores busy.
    cores = rows.sparkSession.sparkContext.defaultParallelism
    cells = max(-(-n_queries // cell_queries), min(-(-3 * cores // n_blocks), -(-n_queries // 64)))
    every_cell = F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("cell")
    numbers = [r["block"] for r in blocks.select("block").collect()]
    every_block = F.explode(F.lit(numbers).cast("array<bigint>")).alias("block")
    cell = F.pmod(F.xxhash64("row"), F.lit(cells)).cast("int").alias("cell")
    asked = queries.select("row", "vec_id", "parts", cell, every_block)
    laid = blocks.select("*", every_cell)
    parts = n_blocks * cells
    met = (
        laid.repartition(parts, "block", "cell")
        .groupBy("block", "cell")
        .cogroup(asked.repartition(parts, "block", "cell").groupBy("block", "cell"))
        .applyInArrow(_searcher(k), FOUND)
    )
    order = Window.partitionBy("query_row").orderBy(
        F.desc("score"), F.asc_nulls_last("vec_id"), "row"
    )
    return (
        met.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
