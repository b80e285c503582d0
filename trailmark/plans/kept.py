"""Counts kept per input file, so that a changed folder of exports is not counted anew.

``update_counts`` reads the files that are new or have another size or time than at the last update and
takes the others from the state it left. The state is a published folder of two tables:

* ``files``: one row per file with its version, its key figures and its depths as weighted points;
* ``neighbours``: the neighbouring events of each file, counted (``neighbour_counts``), all places and
  first places.

Counts of files add up, so frequencies, transitions, matrices, entries and exits are sums over the state, and
key figures come from its small rows; no session is read. The neighbours also say which events a file holds,
so that a search opens only files that can have a match. Names of files come to the driver, as they do
whenever Spark lists a folder; counts do not.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailmark.errors import SessionDataError
from trailmark.functions.rates import rate_percent
from trailmark.functions.tokens import (
    DEFAULT_DELIMITER,
    SPACE_SEPARATORS,
    check_dedupe,
    check_delimiter,
    splits_cleanly,
)
from trailmark.operators.edges import edges_from_neighbours, end_counts, neighbour_counts
from trailmark.operators.flows import matrix_from_edges, rank_transitions
from trailmark.operators.metrics import PERCENTILES, frequencies_from_edges, rank_ends
from trailmark.operators.search import match_sessions
from trailmark.plans.reports import REPORT_ENDS, Report
from trailmark.sources.columns import as_sessions
from trailmark.sources.readers import is_parquet, read_csv
from trailmark.sources.storage import current_path, path_exists, publish, stored_table

#: A file with more different depths than this keeps about two points for each of SLICES slices of its rows.
EXACT_DEPTHS, SLICES = 1_024, 256
SLICE_ACCURACY = 10 * SLICES
#: How far the rank of a percentile may be off, as a share of all sessions, where files have so many depths.
RANK_ERROR = 1 / SLICES + 2 / SLICE_ACCURACY
#: Ranges of the merged points, of which only those that hold a percentile are sorted.
POINT_RANGES = 64

_VERSION = ["file", "size", "modified"]


@dataclass(frozen=True)
class Update:
    """What ``update_counts`` did, as sorted names of files."""

    read: list[str]
    removed: list[str]
    kept: list[str]


def _file(address: Column) -> Column:
    """The address of a file in one form: a scan names an empty host, a listing does not."""
    return F.regexp_replace(address, "^([A-Za-z][A-Za-z0-9+.-]*):///", "$1:/").alias("file")


def _listing(spark: SparkSession, path: str) -> DataFrame:
    """(file, size, modified) of the files Spark reads at ``path``; their content is not touched."""
    place = current_path(spark, path)
    if not path_exists(spark, place):
        raise FileNotFoundError(f"File not found: {path}")
    return (
        spark.read.format("binaryFile")
        .load(place)
        .select(
            _file(F.col("_metadata.file_path")),
            F.col("_metadata.file_size").alias("size"),
            F.col("_metadata.file_modification_time").alias("modified"),
        )
    )


def _read(spark: SparkSession, path: str, files: list[str], options: dict) -> DataFrame:
    """The sessions of some files of ``path``."""
    # Names are encoded as in addresses, and Spark takes paths for patterns.
    places = [re.sub(r"([\[\]{}*?\\])", r"\\\1", unquote(file)) for file in files]
    if is_parquet(path):
        return as_sessions(spark.read.parquet(*places))
    return read_csv(spark, places, **options)


def _state(spark: SparkSession, state_path: str, table: str) -> DataFrame:
    place = f"{current_path(spark, state_path)}/{table}"
    if not path_exists(spark, place):
        raise FileNotFoundError(f"No counts are kept at {state_path}: run update_counts first.")
    return spark.read.parquet(place)


def _figures(sessions: DataFrame) -> DataFrame:
    """One row per file of (file, depth): its key figures, and its depths as points (low, high, n).

    A point stands for n sessions with depths from low to high. Where a file has at most EXACT_DEPTHS
    different depths each has its own point; else so does each bound between slices of the file's rows,
    and the depths between two bounds are one point.
    """
    shares = [i / SLICES for i in range(1, SLICES)]
    bounds = sessions.groupBy("file").agg(
        F.percentile_approx("depth", shares, SLICE_ACCURACY).alias("bounds")
    )
    counts = stored_table(
        sessions.groupBy("file", "depth").agg(F.count(F.lit(1)).alias("n")), "depth_counts"
    )
    depth, n = F.col("depth"), F.col("n")
    whole = isinstance(sessions.schema["depth"].dataType, T.IntegralType)
    summed = F.sum(depth.cast("decimal(19,0)") * n.cast("decimal(18,0)")) if whole else F.sum(depth * n)
    figures = stored_table(
        counts.groupBy("file")
        .agg(
            F.sum("n").alias("sessions"),
            F.sum(F.when(depth == 1, n).otherwise(0)).alias("bounces"),
            F.sum(F.when(depth.isNotNull(), n).otherwise(0)).alias("depth_rows"),
            summed.alias("depth_sum"),
            F.max("depth").alias("max_depth"),
            F.count("depth").alias("different"),
        )
        .join(bounds, "file"),
        "file_figures",
    )
    own = (F.col("different") <= EXACT_DEPTHS) | F.array_contains("bounds", depth)
    below = F.size(F.filter("bounds", lambda bound: bound < depth))
    points = (
        counts.where(depth.isNotNull())
        .join(figures.select("file", "different", "bounds"), "file")
        .groupBy("file", F.when(own, depth).alias("own"), F.when(~own, below).alias("below"))
        .agg(F.min("depth").alias("low"), F.max("depth").alias("high"), F.sum("n").alias("n"))
        .groupBy("file")
        .agg(F.sort_array(F.collect_list(F.struct("high", "low", "n"))).alias("points"))
    )
    return figures.drop("different", "bounds").join(points, "file", "left")


def update_counts(
    spark: SparkSession,
    sessions_path: str,
    state_path: str,
    *,
    delimiter: str = DEFAULT_DELIMITER,
    **csv_options,
) -> Update:
    """Bring the counts at ``state_path`` up to date with the files at ``sessions_path``.

    Only files that are new, or have another size or time of change, are read. What they counted for before,
    and what files that are gone counted for, is left out. The new state is published at once; when
    nothing changed, none is made. A file that changes while it is read is read again by the next update.
    State of another delimiter, or of another type of depth, is refused. For CSV exports ``csv_options`` are those of ``read_csv``.
    """
    check_delimiter(delimiter)
    now = stored_table(_listing(spark, sessions_path), "listing")
    known = path_exists(spark, f"{current_path(spark, state_path)}/files")
    before = _state(spark, state_path, "files") if known else None
    current = [tuple(row) for row in now.select(*_VERSION).collect()]
    old: list[tuple] = []
    if before is not None:
        other = before.where(F.col("delimiter") != delimiter).head()
        if other is not None:
            raise ValueError(f"The counts at {state_path} are of paths delimited by {other['delimiter']!r}.")
        old = [tuple(row) for row in before.select(*_VERSION).collect()]
    same = set(current) & set(old)
    changed = sorted(row[0] for row in set(current) - same)
    names = {row[0] for row in current}
    done = Update(
        changed, sorted({row[0] for row in old} - names), sorted(row[0] for row in same)
    )
    if known and not done.read and not done.removed:
        return done

    def write(place: str) -> None:
        kept = now.join(before, _VERSION, "left_semi") if known else now.limit(0)
        files = before.join(kept, _VERSION, "left_semi") if known else None
        neighbours = (
            _state(spark, state_path, "neighbours").join(kept, "file", "left_semi") if known else None
        )
        if changed:
            new_files, new_neighbours = _counted(
                spark, sessions_path, changed, now, delimiter, csv_options
            )
            if files is not None:
                _check_type(files, new_files)
            files = new_files if files is None else files.unionByName(new_files)
            neighbours = new_neighbours if neighbours is None else neighbours.unionByName(new_neighbours)
        if files is None:
            raise SessionDataError(f"No files of sessions at {sessions_path}")
        files.write.option("compression", "zstd").parquet(f"{place}/files")
        # Rows of one event lie together, so that looking one up skips most of the table.
        neighbours.sortWithinPartitions("event", "previous").write.option("compression", "zstd").parquet(
            f"{place}/neighbours"
        )

    publish(spark, state_path, write)
    return done


def _check_type(files: DataFrame, new_files: DataFrame) -> None:
    kinds = [table.schema["max_depth"].dataType for table in (files, new_files)]
    if kinds[0] != kinds[1]:
        raise SessionDataError(
            f"TOTAL_EVENTS was {kinds[0].simpleString()} in the files counted so far "
            f"and is {kinds[1].simpleString()} in new ones",
            hint="Give its type for all of them, or count them all anew.",
        )


def _counted(
    spark: SparkSession, path: str, files: list[str], now: DataFrame, delimiter: str, options: dict
) -> tuple[DataFrame, DataFrame]:
    """The two tables of the state for ``files``."""
    sessions = _read(spark, path, files, options).select(
        _file(F.input_file_name()), "EVENT_PATH", "TOTAL_EVENTS"
    )
    figures = stored_table(
        _figures(sessions.select("file", F.col("TOTAL_EVENTS").alias("depth"))), "figures"
    )
    strange = figures.join(now, "file", "left_anti").head()
    if strange is not None:
        raise RuntimeError(f"Sessions come from a file that was not listed: {strange['file']}")
    listed = now.where(F.col("file").isin(files)) if len(files) <= 100 else now.join(
        spark.createDataFrame([(file,) for file in files], "file string"), "file", "left_semi"
    )
    # A file without sessions is known as well.
    table = listed.select(*_VERSION, F.lit(delimiter).alias("delimiter")).join(figures, "file", "left")
    zero = {name: F.coalesce(name, F.lit(0).cast("bigint")) for name in ("sessions", "bounces", "depth_rows")}
    places = [
        neighbour_counts(sessions, delimiter, unique=unique, by=["file"]).withColumn("firsts", F.lit(unique))
        for unique in (False, True)
    ]
    return table.withColumns(zero), places[0].unionByName(places[1])


# Answers from the state ----------------------------------------------------------------------


def kept_neighbours(spark: SparkSession, state_path: str, *, unique: bool = False) -> DataFrame:
    """What ``neighbour_counts`` gives over all files, summed up from the state."""
    rows = _state(spark, state_path, "neighbours").where(F.col("firsts") == unique)
    return rows.groupBy("blanks", "deep", "previous", "event").agg(F.sum("n").alias("n"))


def kept_edges(
    spark: SparkSession, state_path: str, dedupe: str | None = "none", *, drop_blanks: bool = False
) -> DataFrame:
    """What ``edge_counts`` gives over all files, in every mode."""
    unique = check_dedupe(dedupe) == "unique"
    counts = kept_neighbours(spark, state_path, unique=unique)
    return edges_from_neighbours(counts, "none" if unique else dedupe, drop_blanks=drop_blanks)


def _percentiles(points: DataFrame) -> list:
    """The discrete PERCENTILES of depths given as points (high, n).

    Sums of POINT_RANGES ranges say which of them hold a percentile; only those are sorted.
    """
    merged = stored_table(points.groupBy("high").agg(F.sum("n").alias("n")), "depth_points")
    shares = [i / POINT_RANGES for i in range(1, POINT_RANGES)]
    found = merged.agg(F.percentile_approx("high", shares, 10 * POINT_RANGES).alias("bounds"))
    kind = merged.schema["high"].dataType
    bounds = [F.lit(bound).cast(kind) for bound in found.head()["bounds"] or []]
    if not bounds:
        return [None] * len(PERCENTILES)
    place = F.size(F.filter(F.array(*bounds), lambda bound: bound < F.col("high")))
    ranged = merged.withColumn("place", place)
    sums = {row["place"]: row["n"] for row in ranged.groupBy("place").agg(F.sum("n").alias("n")).collect()}
    total = sum(sums.values())
    wanted: list[tuple[int, int]] = []
    for percent in PERCENTILES.values():
        left = max(1, -(-total * percent // 100))
        for at in sorted(sums):
            if left <= sums[at]:
                break
            left -= sums[at]
        wanted.append((at, left))
    in_range = Window.partitionBy("place").orderBy("high")
    sorted_ranges = ranged.where(F.col("place").isin([at for at, _ in wanted])).withColumn(
        "upto", F.sum("n").over(in_range)
    )
    reached: list[Column] = [
        F.min(F.when((F.col("place") == at) & (F.col("upto") >= left), F.col("high"))) for at, left in wanted
    ]
    return list(sorted_ranges.agg(*reached).head())


def kept_kpis(spark: SparkSession, state_path: str) -> DataFrame:
    """What ``session_kpis`` gives, from one small row per file.

    Percentiles are exact as long as no file has more than EXACT_DEPTHS different depths. Otherwise a
    reported depth has a rank at most RANK_ERROR of all sessions above the one asked for, never below it.
    """
    files = _state(spark, state_path, "files")
    points = files.select(F.explode("points").alias("point")).select("point.high", "point.n")
    found = _percentiles(points)
    kind = files.schema["max_depth"].dataType
    sums = files.agg(
        F.coalesce(F.sum("sessions"), F.lit(0)).alias("total_sessions"),
        F.coalesce(F.sum("bounces"), F.lit(0)).alias("single_event_bounces"),
        F.sum("depth_rows").alias("depth_rows"),
        F.sum("depth_sum").cast("double").alias("depth_sum"),
        F.max("max_depth").alias("max_events"),
    )
    mean = F.col("depth_sum") / F.nullif(F.col("depth_rows"), F.lit(0))
    return sums.select(
        "total_sessions",
        "single_event_bounces",
        rate_percent(F.col("single_event_bounces"), F.col("total_sessions")).alias("bounce_rate_pct"),
        F.round(mean, 2).alias("avg_events_per_session"),
        *[F.lit(value).cast(kind).alias(name) for name, value in zip(PERCENTILES, found)],
        "max_events",
    )


def kept_report(
    spark: SparkSession,
    state_path: str,
    *,
    top_n: int = 15,
    dedupe: str | None = "consecutive",
    matrix_dedupe: str | None = "none",
) -> Report:
    """Key figures, entries, exits, event frequencies, transitions and the matrix, without reading a session."""
    neighbours = stored_table(kept_neighbours(spark, state_path), "neighbours")
    edges = stored_table(kept_edges(spark, state_path, dedupe), "edges")
    return Report(
        {
            "kpis": kept_kpis(spark, state_path),
            "entry_points": rank_ends(end_counts(neighbours, "entry"), "entry", REPORT_ENDS),
            "exit_points": rank_ends(end_counts(neighbours, "exit"), "exit", REPORT_ENDS),
            "events": frequencies_from_edges(edges, top_n),
            "transitions": rank_transitions(edges, top_n),
            "matrix": matrix_from_edges(
                kept_edges(spark, state_path, matrix_dedupe, drop_blanks=True), top_n
            ),
        }
    )


def files_to_search(
    spark: SparkSession,
    sessions_path: str,
    state_path: str,
    *,
    event: str | None = None,
    subpath: str | None = None,
    min_events: int = 1,
) -> list[str]:
    """The files at ``sessions_path`` that can hold a match, sorted.

    A file is left out only where the state has counted this very version of it and it lacks an event that
    every match has, or has no session as deep. New and changed files are always searched.
    """
    listed = _listing(spark, sessions_path)
    files = _state(spark, state_path, "files")
    current = listed.join(files, _VERSION, "left_semi").select("file")
    delimiter = (files.select("delimiter").head() or [DEFAULT_DELIMITER])[0]
    wanted = {event} if event else set()
    if subpath and splits_cleanly(delimiter, SPACE_SEPARATORS):
        wanted |= {token.strip(SPACE_SEPARATORS) for token in subpath.split(delimiter)}
    deep = files.where(F.col("max_depth") >= min_events).select("file")
    able = current.join(deep, "file", "left_semi")
    if wanted:
        holds = (
            _state(spark, state_path, "neighbours")
            .where(F.col("event").isin(sorted(wanted)) & ~F.col("firsts") & (F.col("blanks") != "dropped"))
            .groupBy("file")
            .agg(F.count_distinct("event").alias("events"))
            .where(F.col("events") == len(wanted))
        )
        able = able.join(holds, "file", "left_semi")
    new = listed.join(files, _VERSION, "left_anti").select("file")
    return sorted(row["file"] for row in able.unionAll(new).collect())


def kept_search(
    spark: SparkSession,
    sessions_path: str,
    state_path: str,
    *,
    event: str | None = None,
    subpath: str | None = None,
    min_events: int = 1,
    **csv_options,
) -> DataFrame:
    """What ``match_sessions`` gives for the sessions at ``sessions_path``, reading only files that can have a match."""
    files = files_to_search(
        spark, sessions_path, state_path, event=event, subpath=subpath, min_events=min_events
    )
    delimiter = (_state(spark, state_path, "files").select("delimiter").head() or [DEFAULT_DELIMITER])[0]
    if not files:
        whole = [row["file"] for row in _listing(spark, sessions_path).select("file").limit(1).collect()]
        return _search(_read(spark, sessions_path, whole, csv_options).limit(0), event, subpath, min_events, delimiter)
    return _search(
        _read(spark, sessions_path, files, csv_options), event, subpath, min_events, delimiter
    )


def _search(
    sessions: DataFrame, event: str | None, subpath: str | None, min_events: int, delimiter: str
) -> DataFrame:
    return match_sessions(
        sessions, event=event, subpath=subpath, min_events=min_events, delimiter=delimiter
    )
