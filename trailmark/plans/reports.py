"""The multi-table jobs: insights, analysis and the full run from an export to its reports."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trailmark.functions.tokens import DEFAULT_DELIMITER
from trailmark.operators.edges import (
    edge_counts,
    edges_from_neighbours,
    end_counts,
    neighbour_counts,
)
from trailmark.operators.flows import (
    matrix_from_edges,
    rank_transitions,
)
from trailmark.operators.funnels import (
    MAX_AUTO_STEPS,
    funnel,
    funnel_report,
)
from trailmark.operators.metrics import (
    frequencies_from_edges,
    path_ends,
    rank_ends,
    session_kpis,
)
from trailmark.operators.paths import top_paths
from trailmark.sources.convert import Conversion, convert_if_stale, inspect_dataset
from trailmark.sources.delimiter import detect_delimiter
from trailmark.sources.readers import read_parquet
from trailmark.sources.storage import publish, stored_table

INSIGHT_ROWS, REPORT_PATHS, REPORT_ENDS = 5, 10, 10


@dataclass(frozen=True)
class Report:
    """Named result tables, each lazy and bounded by its own top-n."""

    tables: dict[str, DataFrame]

    def long(self) -> DataFrame:
        """All tables as one: (section, rank, label, value)."""
        parts = [_long_form(name, table) for name, table in self.tables.items()]
        return reduce(DataFrame.unionByName, parts)

    def write(self, output_dir: str) -> dict[str, str]:
        """One Parquet table per section in a new version of ``output_dir``; {section: path}.

        All of them change at once, when the last one is written.
        """
        spark = next(iter(self.tables.values())).sparkSession
        folder = publish(spark, output_dir, self.write_into)
        return {name: f"{folder}/{name}" for name in self.tables}

    def write_into(self, folder: str) -> None:
        for name, table in self.tables.items():
            table.write.option("compression", "zstd").parquet(f"{folder}/{name}")


def _long_form(section: str, table: DataFrame) -> DataFrame:
    def rows(order: Sequence[Column | str], label: Column | str, value: str) -> DataFrame:
        # At most top-n rows are numbered here.
        rank = F.row_number().over(Window.orderBy(*order))
        return table.select(
            F.lit(section).alias("section"),
            rank.alias("rank"),
            (F.col(label) if isinstance(label, str) else label).alias("label"),
            F.col(value).cast("double").alias("value"),
        )

    columns = table.columns
    if section == "kpis":
        pairs = F.array(
            *[
                F.struct(F.lit(c).alias("label"), F.col(c).cast("double").alias("value"))
                for c in columns
            ]
        )
        return table.select(
            F.lit(section).alias("section"), F.posexplode(pairs).alias("rank", "pair")
        ).select("section", (F.col("rank") + 1).alias("rank"), "pair.label", "pair.value")
    if "step_number" in columns:
        return rows(["step_number"], "step_name", "session_count")
    if "source_rank" in columns:
        cell = F.concat("source_event", F.lit(" -> "), "target_event")
        return rows(["source_rank", "target_rank"], cell, "transition_count")
    if "transition" in columns:
        order = [F.desc("transition_count"), "source_event", "target_event"]
        return rows(order, "transition", "transition_count")
    if "full_path" in columns:
        order = [F.desc("session_count"), "full_path", "TOTAL_EVENTS"]
        return rows(order, "full_path", "session_count")
    count = next(c for c in columns if c.endswith("_count"))
    return rows([F.desc(count), "event_name"], "event_name", count)


def insights_report(
    sessions: DataFrame, *, delimiter: str = DEFAULT_DELIMITER, top_n: int = INSIGHT_ROWS
) -> Report:
    """KPIs with the most frequent entry and exit events.

    The ends of all paths are counted here, in one pass, and stored for both tables.
    """
    ends = stored_table(path_ends(sessions, delimiter), "ends")

    def table(end: str) -> DataFrame:
        counts = ends.groupBy(F.col(end).alias("event_name")).agg(F.sum("n").alias("n"))
        return rank_ends(counts, end, top_n)

    return Report(
        {
            "kpis": session_kpis(sessions),
            "entry_points": table("entry"),
            "exit_points": table("exit"),
        }
    )


def analyze_report(
    sessions: DataFrame,
    *,
    delimiter: str = DEFAULT_DELIMITER,
    top_n: int = 15,
    dedupe: str | None = "consecutive",
    steps: Sequence[str] | None = None,
) -> Report:
    """Event frequencies, transitions, top paths and, with ``steps``, an ordered funnel.

    Frequencies and transitions come from the same edge counts, which are made here and stored,
    so that the paths are split once however the tables are read.
    """
    edges = stored_table(edge_counts(sessions, delimiter, dedupe), "edges")
    tables = {
        "events": frequencies_from_edges(edges, top_n),
        "transitions": rank_transitions(edges, top_n),
        "paths": top_paths(sessions, top_n=REPORT_PATHS, dedupe=dedupe, delimiter=delimiter),
    }
    if steps:
        tables["funnel"] = funnel(sessions, steps, delimiter=delimiter, dedupe=dedupe)
    return Report(tables)


def session_report(
    sessions: DataFrame,
    *,
    delimiter: str = DEFAULT_DELIMITER,
    top_n: int = 15,
    steps: Sequence[str] | None = None,
    dedupe: str | None = "consecutive",
    matrix_dedupe: str | None = "none",
    neighbours: DataFrame | None = None,
) -> Report:
    """All tables of the full run.

    Given steps make an ordered funnel; without them the most frequent events, at most eight,
    make a reach funnel. ``neighbours`` is the stored result of ``neighbour_counts``: with it,
    the paths are read for the funnel and the top paths only.
    """
    if neighbours is None:
        neighbours = neighbour_counts(sessions, delimiter)

    def edges(mode: str | None, drop_blanks: bool) -> DataFrame:
        if mode == "unique":
            return edge_counts(sessions, delimiter, mode, drop_blanks=drop_blanks)
        return edges_from_neighbours(neighbours, mode, drop_blanks=drop_blanks)

    sequential = bool(steps)
    if not steps:
        top = frequencies_from_edges(edges(dedupe, False), min(top_n, MAX_AUTO_STEPS))
        steps = [row["event_name"] for row in top.select("event_name").collect()]
    tables = {
        "kpis": session_kpis(sessions),
        "entry_points": rank_ends(end_counts(neighbours, "entry"), "entry", REPORT_ENDS),
        "exit_points": rank_ends(end_counts(neighbours, "exit"), "exit", REPORT_ENDS),
        "paths": top_paths(sessions, top_n=REPORT_PATHS, delimiter=delimiter),
        "matrix": matrix_from_edges(edges(matrix_dedupe, True), top_n),
    }
    if steps:
        tables["funnel"] = funnel_report(
            funnel(sessions, steps, delimiter=delimiter, sequential=sequential, dedupe=dedupe)
        )
    return Report(tables)


@dataclass(frozen=True)
class RunSummary:
    conversion: Conversion | None
    total_rows: int | str
    columns: list[tuple[str, str]]
    delimiter: str
    outputs: dict[str, str] = field(default_factory=dict)


def run_all(
    spark: SparkSession,
    csv_path: str,
    parquet_path: str,
    output_dir: str,
    *,
    delimiter: str | None = None,
    top_n: int = 15,
    steps: Sequence[str] | None = None,
    dedupe: str | None = "consecutive",
    compression: str = "ZSTD",
    force: bool = False,
    **csv_options,
) -> RunSummary:
    """Convert an export unless its Parquet copy is up to date, then write every report table.

    Without a ``delimiter`` it is detected in all paths; a given one is obeyed. ``csv_options`` are
    those of ``read_csv``. The counts of neighbouring events are written first, as ``neighbours``;
    most tables are made from them. All tables are published at once, as a new version of ``output_dir``.
    """
    conversion = convert_if_stale(
        spark, csv_path, parquet_path, force=force, compression=compression, **csv_options
    )
    found = inspect_dataset(spark, parquet_path, limit=3)
    sessions = read_parquet(spark, parquet_path)
    if delimiter is None:
        delimiter = detect_delimiter(sessions)
    names: list[str] = []

    def write(place: str) -> None:
        neighbours_path = f"{place}/neighbours"
        counts = neighbour_counts(sessions, delimiter)
        counts.write.option("compression", "zstd").parquet(neighbours_path)
        report = session_report(
            sessions,
            delimiter=delimiter,
            top_n=top_n,
            steps=steps,
            dedupe=dedupe,
            neighbours=spark.read.schema(counts.schema).parquet(neighbours_path),
        )
        report.write_into(place)
        names.extend(report.tables)

    folder = publish(spark, output_dir, write)
    outputs = {name: f"{folder}/{name}" for name in names}
    return RunSummary(conversion, found.total_rows, found.columns, delimiter, outputs)
