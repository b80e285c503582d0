"""Event-to-event flow: transition pairs, matrices, heatmap cells and flow-diagram links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.functions.tokens import DEFAULT_DELIMITER, check_top_n
from trailmark.operators.edges import edge_counts
from trailmark.sources.storage import stored_table

# Upper bounds of the heatmap bands, size and link limit of the flow diagram.
HEAT_BANDS = ((0.15, "low"), (0.40, "medium"), (0.70, "high"))
TOP_HEAT_BAND, EMPTY_HEAT_BAND = "peak", "none"
MIN_CELL_OPACITY = 0.15
FLOW_EVENTS, FLOW_LINKS = 10, 24

# A matrix of up to this many events has its cells broadcast, about a million small rows; larger
# ones are joined. The bound is on top_n, which bounds the rows; results are the same.
BROADCAST_EVENTS = 1_000


def rank_transitions(edges: DataFrame, top_n: int) -> DataFrame:
    """Top transitions out of ``edge_counts`` rows; pairs that touch a blank are dropped."""
    source, target = F.col("source_event"), F.col("target_event")
    return (
        edges.where(
            F.col("previous").isNotNull() & (F.col("previous") != "") & (F.col("event") != "")
        )
        .select(
            F.col("previous").alias("source_event"),
            F.col("event").alias("target_event"),
            F.col("n").alias("transition_count"),
        )
        .orderBy(F.desc("transition_count"), "source_event", "target_event")
        .limit(check_top_n(top_n))
        .select(
            F.concat(source, F.lit(" -> "), target).alias("transition"),
            source,
            target,
            "transition_count",
        )
    )


def transition_pairs(
    sessions: DataFrame,
    *,
    delimiter: str = DEFAULT_DELIMITER,
    top_n: int = 20,
    dedupe: str | None = "none",
) -> DataFrame:
    """(transition, source_event, target_event, transition_count) of neighbouring events.

    Blank events keep their place: a pair that touches one is dropped, not bridged.
    """
    return rank_transitions(edge_counts(sessions, delimiter, dedupe), top_n)


def _top_event_names(edges: DataFrame, top_n: int) -> DataFrame:
    """One row holding the most frequent event names in rank order, at most ``top_n``."""
    top = (
        edges.groupBy("event")
        .agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "event")
        .limit(check_top_n(top_n))
    )
    ranked = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("order"), "event")))
    return top.agg(ranked.getField("event").alias("names"))


def matrix_from_edges(edges: DataFrame, top_n: int) -> DataFrame:
    """The matrix out of ``edge_counts`` rows.

    Top events and cells read one aggregate, whose exchange Spark runs once. The list of names,
    bounded by ``top_n``, is a scalar subquery.
    """
    names = _top_event_names(edges, top_n)

    def rank(event: str) -> Column:
        return F.coalesce(F.array_position(names.scalar(), F.col(event)), F.lit(0)).cast("int")

    # Edges outside the top events gather under rank 0: at most (top_n + 1)^2 rows in all. A
    # filter here would be pushed below the aggregate and make it a second scan.
    cells = (
        edges.select(rank("previous").alias("source_rank"), rank("event").alias("target_rank"), "n")
        .groupBy("source_rank", "target_rank")
        .agg(F.sum("n").alias("n"))
    )
    lines = names.select("names", F.posexplode("names").alias("row", "source_event"))
    if top_n > BROADCAST_EVENTS:  # else one task would make all cells
        lines = lines.repartition("row")
    grid = (
        lines.select("row", "source_event", F.posexplode("names").alias("column", "target_event"))
        .select(
            "source_event",
            "target_event",
            (F.col("row") + 1).alias("source_rank"),
            (F.col("column") + 1).alias("target_rank"),
        )
    )
    if top_n <= BROADCAST_EVENTS:
        cells = F.broadcast(cells)
    return (
        grid.join(cells, ["source_rank", "target_rank"], "left")
        .select(
            "source_event",
            "target_event",
            F.coalesce("n", F.lit(0)).alias("transition_count"),
            F.col("source_rank").cast("bigint").alias("source_rank"),
            F.col("target_rank").cast("bigint").alias("target_rank"),
        )
        .orderBy("source_rank", "target_rank")
    )


def transition_matrix(
    sessions: DataFrame,
    *,
    delimiter: str = DEFAULT_DELIMITER,
    top_n: int = 8,
    dedupe: str | None = "none",
) -> DataFrame:
    """All cells among the ``top_n`` most frequent events, 0 where no transition occurs.

    Columns (source_event, target_event, transition_count, source_rank, target_rank). Blank
    events are removed before dedupe and pairing. Ranks are by count, then by name.
    """
    return matrix_from_edges(edge_counts(sessions, delimiter, dedupe, drop_blanks=True), top_n)


def transition_matrix_wide(
    sessions: DataFrame,
    *,
    delimiter: str = DEFAULT_DELIMITER,
    top_n: int = 8,
    dedupe: str | None = "none",
) -> DataFrame:
    """The matrix as a square: ``source_event`` and one column per target, both in rank order.

    Column names are data, so the cells, at most ``top_n`` squared, are stored by one job, and
    their names reach the driver. The key column gets underscores if an event has its name.
    Without events the result has no rows and no target columns.
    """
    edges = edge_counts(sessions, delimiter, dedupe, drop_blanks=True)
    matrix = stored_table(matrix_from_edges(edges, top_n), "matrix")
    ranks = matrix.where("target_rank = 1").select("source_rank", "source_event").collect()
    names = [row["source_event"] for row in sorted(ranks)]
    key = "source_event"
    while key in names:
        key += "_"
    rows = matrix.withColumnRenamed("source_event", key)
    if not names:
        return rows.select(key).limit(0)
    return (
        rows.groupBy("source_rank", key)
        .pivot("target_event", names)
        .agg(F.sum("transition_count"))
        .orderBy("source_rank")
        .select(key, *[F.col("`" + name.replace("`", "``") + "`") for name in names])
    )


def heatmap_cells(matrix: DataFrame) -> DataFrame:
    """Matrix cells with their share of the largest cell, a band and an opacity for display."""
    largest = matrix.agg(F.max("transition_count")).scalar()
    count = F.col("transition_count")
    ratio = count / F.greatest(largest, F.lit(1))
    band = F.when(count == 0, EMPTY_HEAT_BAND)
    for limit, name in HEAT_BANDS:
        band = band.when(F.col("ratio") < limit, name)
    return (
        matrix.withColumn("ratio", ratio)
        .withColumn("band", band.otherwise(TOP_HEAT_BAND))
        .withColumn(
            "opacity",
            F.when(count > 0, F.greatest(F.lit(MIN_CELL_OPACITY), F.col("ratio"))).otherwise(0.0),
        )
        .orderBy("source_rank", "target_rank")
    )


def flow_links(matrix: DataFrame, *, limit: int = FLOW_LINKS) -> DataFrame:
    """The strongest transitions of a matrix; equal counts keep the matrix order."""
    return (
        matrix.where(F.col("transition_count") > 0)
        .orderBy(F.desc("transition_count"), "source_rank", "target_rank")
        .limit(check_top_n(limit, "limit"))
        .select("source_event", "target_event", F.col("transition_count").alias("value"))
    )


def flow_nodes(links: DataFrame) -> DataFrame:
    """(side, event_name, total): outgoing total per source, incoming total per target."""
    ends = F.array(
        F.struct(F.lit("source").alias("side"), F.col("source_event").alias("event_name")),
        F.struct(F.lit("target").alias("side"), F.col("target_event").alias("event_name")),
    )
    return (
        links.select(F.explode(ends).alias("end"), "value")
        .groupBy("end.side", "end.event_name")
        .agg(F.sum("value").alias("total"))
    )
