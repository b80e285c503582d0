"""Embedding near-duplicates (operator 7): an epsilon grid order join.

Unit vectors are turned to principal axes. Cells as wide as the largest distance of a link, on the
leading axes, give the grid order; equal ranges of it are units, and a unit is packed into leaves
of neighbours with the box of their leading coordinates. The join goes down a tree of intervals of
that sequence: pairs of intervals whose boxes are provably too distant are left out with all that
is below. Pairs of units that remain meet in one task each, which goes on to pairs of leaves and
compares those by one matrix product in double precision.

Turning never changes a distance, and leaving axes out never lengthens one, so no link is lost.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.llm import local_links
from trailmark.llm.components import connected_components
from trailmark.llm.workers import map_batches, stored

THRESHOLD = 0.95
GRID_AXES, BOX_AXES = 4, 16
UNIT_VALUES = 262_144  # numbers in the vectors of a unit: 4,096 vectors of 64
LEAF_ROWS = 512
FANOUT = 8  # units under a node of the interval tree, and nodes under each above
SAMPLE_VALUES = 2_000_000  # numbers in the sample the axes are fitted on
#: Cosines nearer to the threshold than this are computed again without rounding in between.
BORDER = 1e-9

HITS = "vec_id bigint, root bigint, links bigint"


def usable(vector: Column) -> Column:
    """True for a vector that can link: no null, no number that is not finite, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0.0), F.lit(False))


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def exact_cosine(x: np.ndarray, y: np.ndarray) -> float:
    return math.fsum(x * y) / math.sqrt(math.fsum(x * x)) / math.sqrt(math.fsum(y * y))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, size)


def principal_axes(distinct: DataFrame, size: int, rows: int) -> np.ndarray:
    """Columns are axes by falling variance, fitted on a bounded sample of the vectors."""
    wanted = max(1, SAMPLE_VALUES // size)
    share = min(1.0, wanted / max(rows, 1))
    sample = distinct.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < share * (1 << 30))
    found = np.array([row[0] for row in sample.select("vector").collect()], dtype=np.float64)
    if len(found) < 2:
        return np.eye(size)
    _, axes = np.linalg.eigh(np.cov(unit_rows(found).T).reshape(size, size))
    return axes[:, ::-1]


def _projector(axes: np.ndarray, epsilon: float, n_grid: int, n_box: int):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            units = unit_rows(_matrix(batch.column("vector"), len(axes)))
            places = units @ axes[:, :n_box]
            cells = np.floor(places[:, :n_grid] / epsilon).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id"),
                    batch.column("copies"),
                    batch.column("vector"),
                    pa.array(list(places), pa.list_(pa.float64())),
                    *[pa.array(cells[:, i]) for i in range(n_grid)],
                ],
                ["vec_id", "copies", "vector", "place", *[f"cell{i}" for i in range(n_grid)]],
            )

    return run


def _packer(size: int, leaf_rows: int):
    """Rows in grid order to leaves: as bytes, with the box of their places."""

    def leaf(partition: int, rows: pa.Table) -> pa.RecordBatch:
        vectors = _matrix(rows.column("vector").combine_chunks(), size)
        with np.errstate(over="ignore"):
            short = vectors.astype("<f4")
        if np.array_equal(short, vectors):  # half as much to send, and nothing lost
            vectors = short
        ids = rows.column("vec_id").to_numpy()
        copies = rows.column("copies").to_numpy()
        places = np.array(rows.column("place").to_pylist())
        values = {
            "range": pa.array([partition], pa.int32()),
            "ids": pa.array([ids.tobytes()], pa.binary()),
            "copies": pa.array([copies.tobytes()], pa.binary()),
            "vectors": pa.array([vectors.tobytes()], pa.binary()),
            "low": pa.array([places.min(axis=0).tolist()], pa.list_(pa.float64())),
            "high": pa.array([places.max(axis=0).tolist()], pa.list_(pa.float64())),
        }
        return pa.RecordBatch.from_arrays(list(values.values()), list(values))

    def run(batches):
        partition = TaskContext.get().partitionId()
        held: list[pa.RecordBatch] = []
        n_held = 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                taken = batch.slice(at, leaf_rows - n_held)
                held.append(taken)
                n_held += taken.num_rows
                at += taken.num_rows
                if n_held == leaf_rows:
                    yield leaf(partition, pa.Table.from_batches(held))
                    held, n_held = [], 0
        if held and n_held:
            yield leaf(partition, pa.Table.from_batches(held))

    return run


def _too_far(a: str, b: str, axes: int, epsilon: float) -> Column:
    """Whether the boxes of two intervals are further apart than ``epsilon``."""
    total = F.lit(0.0)
    for i in range(axes):
        gap = F.greatest(
            F.col(f"{a}.low")[i] - F.col(f"{b}.high")[i],
            F.col(f"{b}.low")[i] - F.col(f"{a}.high")[i],
            F.lit(0.0),
        )
        total = total + gap * gap
    return total > epsilon * epsilon


def _unit_pairs(leaves: DataFrame, axes: int, epsilon: float) -> DataFrame:
    """(a, b), a <= b, of units that may hold a link, from the root of the interval tree down."""
    boxes = [F.array(*[f(F.col(side)[i]) for i in range(axes)]).alias(side)
             for side, f in (("low", F.min), ("high", F.max))]
    level = stored(leaves.groupBy(F.col("unit").alias("id")).agg(*boxes), "units")
    tree = [level]
    while level.agg(F.max("id")).head()[0]:
        level = level.groupBy(F.floor(F.col("id") / FANOUT).alias("id")).agg(*boxes)
        level = stored(level, "units")
        tree.append(level)
    pairs = tree[-1].select(F.col("id").alias("a"), F.col("id").alias("b"))
    for level in reversed(tree[:-1]):
        nodes = level.withColumn("above", F.floor(F.col("id") / FANOUT))
        pairs = (
            pairs.join(nodes.alias("x"), F.col("a") == F.col("x.above"))
            .join(nodes.alias("y"), F.col("b") == F.col("y.above"))
            .where((F.col("x.id") <= F.col("y.id")) & ~_too_far("x", "y", axes, epsilon))
            .select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
        )
    return stored(pairs, "unit_pairs")


class Leaf:
    def __init__(self, row: dict, size: int, first: int):
        self.ids = np.frombuffer(row["ids"], dtype=np.int64)
        self.copies = np.frombuffer(row["copies"], dtype=np.int64)
        width = len(row["vectors"]) // (len(self.ids) * size)
        vectors = np.frombuffer(row["vectors"], dtype=f"<f{width}").reshape(-1, size)
        self.vectors = unit_rows(vectors.astype(np.float64))
        self.low, self.high = np.array(row["low"]), np.array(row["high"])
        self.first = first  # number of its first vector in this task

    def is_far(self, other: Leaf, epsilon: float) -> bool:
        gap = np.maximum(np.maximum(self.low - other.high, other.low - self.high), 0.0)
        return float(gap @ gap) > epsilon * epsilon


def _linked(a: Leaf, b: Leaf, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a and of b that link; each pair once."""
    cosines = a.vectors @ b.vectors.T
    if a is b:
        cosines = np.triu(cosines, 1)  # a threshold at or below zero is refused
    i, j = np.nonzero(cosines >= threshold - BORDER)
    close = np.flatnonzero(cosines[i, j] < threshold + BORDER)
    if len(close):
        wrong = [k for k in close if exact_cosine(a.vectors[i[k]], b.vectors[j[k]]) < threshold]
        i, j = np.delete(i, wrong), np.delete(j, wrong)
    return i, j


def _joiner(size: int, threshold: float, epsilon: float):
    def run(batches):
        for rows in local_links.runs(batches, ["a", "b"]):
            leaves: tuple[list[Leaf], list[Leaf]] = ([], [])
            total = 0
            for row in rows.to_pylist():
                leaf = Leaf(row, size, total)
                leaves[row["side"]].append(leaf)
                total += len(leaf.ids)
            left, right = leaves
            one_unit = rows.column("a")[0] == rows.column("b")[0]
            links = np.zeros(total, dtype=np.int64)
            labels = np.arange(total)
            for number, a in enumerate(left):
                for b in left[number:] if one_unit else right:
                    if a.is_far(b, epsilon):
                        continue
                    i, j = _linked(a, b, threshold)
                    if len(i):
                        np.add.at(links, a.first + i, b.copies[j])
                        np.add.at(links, b.first + j, a.copies[i])
                        labels = local_links.merge(labels, a.first + i, b.first + j)
            found = np.flatnonzero(links)
            if len(found):
                ids = np.concatenate([leaf.ids for leaf in sorted([*left, *right], key=lambda x: x.first)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[found]), pa.array(ids[labels[found]]), pa.array(links[found])],
                    ["vec_id", "root", "links"],
                )

    return run


def _hits(distinct: DataFrame, size: int, threshold: float, unit_values: int, leaf_rows: int) -> DataFrame:
    """For each pair of units: its linked vectors, a member of their component, links found."""
    spark = distinct.sparkSession
    rows = distinct.count()
    epsilon = math.sqrt(2 - 2 * threshold) + 1e-6
    n_grid, n_box = min(GRID_AXES, size), min(BOX_AXES, size)
    axes = principal_axes(distinct, size, rows)
    unit_rows_wanted = max(64, unit_values // size)
    order = [*[f"cell{i}" for i in range(n_grid)], "vec_id"]
    schema = "vec_id bigint, copies bigint, vector array<double>, place array<double>, " + ", ".join(
        f"cell{i} int" for i in range(n_grid)
    )
    placed = map_batches(distinct, _projector(axes, epsilon, n_grid, n_box), schema)
    ranges = max(1, math.ceil(rows / unit_rows_wanted))
    leaves = stored(
        map_batches(
            placed.repartitionByRange(ranges, *order).sortWithinPartitions(*order),
            _packer(size, leaf_rows),
            "range int, ids binary, copies binary, vectors binary, low array<double>, high array<double>",
        ),
        "leaves",
    )
    # A range may hold fewer rows than asked for: neighbouring small ones make one unit.
    made = (leaves.agg(F.max("range")).head()[0] or 0) + 1
    merged = max(1, made * unit_rows_wanted // max(rows, 1))
    leaves = leaves.withColumn("unit", F.floor(F.col("range") / merged))
    pairs = _unit_pairs(leaves, n_box, epsilon)
    payload = ["a", "b", "side", "ids", "copies", "vectors", "low", "high"]
    meeting = leaves.join(pairs, leaves["unit"] == pairs["a"]).withColumn("side", F.lit(0)).select(payload)
    meeting = meeting.unionAll(
        leaves.join(pairs.where("a < b"), leaves["unit"] == pairs["b"])
        .withColumn("side", F.lit(1))
        .select(payload)
    )
    tasks = max(1, min(pairs.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    dealt = meeting.repartition(tasks, "a", "b").sortWithinPartitions("a", "b", "side")
    return map_batches(dealt, _joiner(size, threshold, epsilon), HITS)


def near_vectors(
    vectors: DataFrame,
    *,
    threshold: float = THRESHOLD,
    unit_values: int = UNIT_VALUES,
    leaf_rows: int = LEAF_ROWS,
) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``vectors`` (vec_id, embedding).

    Two vectors link when their cosine is ``threshold`` or more (above zero). Vectors that are
    null, empty, zero, or hold null or non-finite numbers, and rows without vec_id, link with
    nothing; vectors of different length never link. Equal vectors are compared once and count as
    often as they occur, so repeated rows link with each other and give repeated rows. Rows that share a
    vec_id and differ in their vector are judged each by its own. ``kept``
    is false where vec_id is null. An empty table gives no rows; other columns are not read.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    rows = vectors.select(
        F.col("vec_id").cast("bigint").alias("vec_id"),
        F.col("embedding").cast("array<double>").alias("vector"),
    )
    fit = rows.where(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    # Different vectors may share a vec_id, so each has a number of its own, fixed once it is stored.
    distinct = stored(
        fit.groupBy("vector")
        .agg(F.min("vec_id").alias("first_id"), F.count("*").alias("copies"))
        .withColumn("number", F.monotonically_increasing_id()),
        "vectors",
    )
    sizes = sorted(r[0] for r in distinct.select(F.size("vector")).distinct().collect())
    numbered = distinct.select(F.col("number").alias("vec_id"), "copies", "vector")
    hits = None
    for size in sizes:
        found = _hits(numbered.where(F.size("vector") == size), size, threshold, unit_values, leaf_rows)
        hits = found if hits is None else hits.unionAll(found)
    if hits is None:
        hits = vectors.sparkSession.createDataFrame([], HITS)
    hits = stored(hits, "vector_links")
    links = hits.groupBy(F.col("vec_id").alias("number")).agg(F.sum("links").alias("links"))
    groups = connected_components(hits.select("vec_id", "root"))
    members = groups.select(F.col("node").alias("number"), F.col("component").alias("group"))
    members = stored(members.join(distinct.select("number", "first_id"), "number"), "vector_groups")
    least = members.groupBy("group").agg(F.min("first_id").alias("least"))
    named = members.join(least, "group").select("number", "least")
    judged = (
        distinct.join(links, "number", "left")
        .join(named, "number", "left")
        .select(
            F.col("vector").alias("same"),
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("least", "first_id").alias("component"),
        )
    )
    own = F.when(F.col("vec_id").isNotNull(), F.col("vector"))
    component = F.when(F.col("component").isNull(), F.col("vec_id")).otherwise(F.col("component"))
    return (
        rows.withColumn("own", own)
        .join(judged, F.col("own") == F.col("same"), "left")
        .select(
            "vec_id",
            F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"),
            component.alias("component_id"),
            F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
        )
    )
