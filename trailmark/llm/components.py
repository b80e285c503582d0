"""Connected components of an edge table, by alternating stars.

Each round hangs the larger neighbours of every node on the smallest one (large star), then the
node itself and its smaller neighbours (small star). Minimum ids are aggregated before anything is
joined, a node with very many edges is an ordinary skewed join key, and no group is collected. The
rounds grow with the logarithm of the size of a component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.llm.workers import stored


def _mark(pairs: DataFrame) -> tuple:
    """Tells two edge tables apart."""
    place = F.xxhash64("u", "v")
    row = pairs.agg(F.count("*"), F.bit_xor(place), F.sum(F.pmod(place, F.lit(1 << 31)))).head()
    return tuple(row)


def _large_star(pairs: DataFrame) -> DataFrame:
    both = pairs.unionAll(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(pairs: DataFrame) -> DataFrame:
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    moved = pairs.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges``: its two columns are nodes of one type.

    ``component`` is the smallest node reachable. Direction, repeated edges and edges from a node
    to itself make no difference; edges with a null end are left out. Nodes without an edge to
    another node are not in the result; an empty table gives no rows.
    """
    a, b = (F.col(name) for name in edges.columns)
    pairs = stored(
        edges.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(),
        "edges",
    )
    mark = _mark(pairs)
    while mark[0]:
        pairs = stored(_small_star(_large_star(pairs)), "edges")
        before, mark = mark, _mark(pairs)
        if mark == before:
            break
    roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots)
