"""Positions of rows within their key, for keys of any size.

A window by key sorts a whole key in one task. Here a key with more rows than a piece should have
is cut into pieces by ranges of its order: split points come from a sample of its own rows, each
piece is counted, and the counts of the pieces before it are the base of its positions. A window
then runs within (key, piece). Other keys are one piece, and where no key is large nothing changes.

Sizes, sample and piece counts read the key and order columns of the input only; the rows are
read once and shuffled once. A piece has at least a set share of all rows, so that there are never more
than ``PIECES`` split points for each shuffle partition: that bounds what is broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trailmark.session import INITIAL_PARTITIONS
from trailmark.sources.storage import stored_table

#: Fewest rows of a piece, most pieces for each shuffle partition, sampled rows for each piece.
PIECE_ROWS, PIECES, SAMPLED = 20_000, 8, 32
#: Columns added on the way; no input column may have these names.
POINTS, ORDER, PIECE, BASE = "_points", "_order", "_piece", "_base"


def shuffle_partitions(spark: SparkSession) -> int:
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return int(spark.conf.get(INITIAL_PARTITIONS, None) or usual)


def _by_key(left: DataFrame, right: DataFrame, key: Sequence[str], how: str) -> DataFrame:
    """A join on ``key`` where NULL equals NULL; ``right`` is small by construction."""
    renamed = right.withColumnsRenamed({name: f"_{name}" for name in key})
    same = [left[name].eqNullSafe(renamed[f"_{name}"]) for name in key]
    joined = left.join(F.broadcast(renamed), same, how)
    return joined.drop(*[f"_{name}" for name in key])


def _with_piece(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """The number of split points at or before each row, by halving steps; 0 without points."""
    most = PIECES * shuffle_partitions(rows.sparkSession)

    def step(found: Column, size: Column) -> Column:
        reached = F.get(POINTS, found + size - 1) <= F.col(ORDER)
        return F.when(reached, found + size).otherwise(found)

    steps = F.array(*[F.lit(1 << i) for i in reversed(range(most.bit_length()))])
    piece = F.when(F.col(POINTS).isNotNull(), F.aggregate(steps, F.lit(0), step)).otherwise(0)
    placed = rows.withColumn(ORDER, F.struct(*order)).withColumn(PIECE, piece)
    return placed.drop(POINTS, ORDER)


def split_points(
    rows: DataFrame, key: Sequence[str], order: Sequence[str], piece_rows: int = PIECE_ROWS
) -> DataFrame | None:
    """(key, points) of the keys with more rows than a piece should have; None if there is none.

    A piece has ``piece_rows`` or, in large tables, its share of all rows, so that all keys together
    have at most ``PIECES`` pieces for each shuffle partition.
    """
    spark = rows.sparkSession
    sizes = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_rows"))
    total, largest = sizes.agg(F.sum("_rows"), F.max("_rows")).head()
    size = max(piece_rows, math.ceil((total or 0) / (PIECES * shuffle_partitions(spark))))
    if (largest or 0) <= size:
        return None
    hot = sizes.where(F.col("_rows") > size).select(*key)
    every = max(1, size // SAMPLED)
    sampled = _by_key(rows.select(*key, *order), hot, key, "inner").where(
        F.pmod(F.xxhash64(*key, *order), F.lit(every)) == 0
    )
    # A set: rows of one place cannot be told apart, so that they never make the sample large.
    places = sampled.groupBy(*key).agg(F.sort_array(F.collect_set(F.struct(*order))).alias("_places"))
    chosen = F.filter("_places", lambda _, i: i % SAMPLED == SAMPLED - 1)
    return stored_table(places.select(*key, chosen.alias(POINTS)), "points")


def in_pieces(
    rows: DataFrame,
    points: DataFrame | None,
    key: Sequence[str],
    order: Sequence[str],
    *,
    only_cut: bool = False,
) -> DataFrame:
    """``rows`` with the number of their piece, 0 for keys without points; with ``only_cut`` only the
    rows of keys that are cut."""
    if points is None:
        return rows.withColumn(PIECE, F.lit(0))
    return _with_piece(_by_key(rows, points, key, "inner" if only_cut else "left"), order)


def given_back(rows: DataFrame, carried: DataFrame, key: Sequence[str]) -> DataFrame:
    """``rows`` of ``in_pieces`` with what ``carried`` says of their piece; NULL for other keys.

    ``carried`` has a row for each piece of the keys that are cut.
    """
    return _by_key(rows, carried, [*key, PIECE], "left")


def numbered(
    rows: DataFrame, key: Sequence[str], order: Sequence[str], *, piece_rows: int = PIECE_ROWS
) -> DataFrame:
    """``rows`` with ``position``, their place in their key by ``order``, counted from 1.

    Rows that agree in all of ``order`` are numbered in any sequence. NULL keys are one key.
    """
    points = split_points(rows, key, order, piece_rows)
    cut = in_pieces(rows, points, key, order)
    place = F.row_number().over(Window.partitionBy(*key, PIECE).orderBy(*order)).cast("bigint")
    if points is None:
        return cut.withColumn("position", place).drop(PIECE)
    pieces = in_pieces(rows.select(*key, *order), points, key, order, only_cut=True)
    sizes = pieces.groupBy(*key, PIECE).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*key).orderBy(PIECE)) - F.col("_n")
    bases = stored_table(sizes.select(*key, PIECE, before.alias(BASE)), "bases")
    base = F.coalesce(BASE, F.lit(0).cast("bigint"))
    return given_back(cut, bases, key).withColumn("position", place + base).drop(PIECE, BASE)
