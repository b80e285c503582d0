"""Every operator as a query over the given tables: name -> f(spark, sf_dir) -> DataFrame.

Sessions are built from the whole ``events`` (or ``conversations`` or ``orders``) table first.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import trailmark as tm
from trailmark.functions import tokens
from trailmark.operators import edges, flows, metrics
from trailmark.plans.reports import Report
from trailmark.sources.storage import scratch_path, stored_once, stored_path

Query = Callable[[SparkSession, str], DataFrame]

FUNNEL_STEPS = ["view", "click", "purchase"]
REPEAT_STEPS = ["click", "click", "view"]
_JOURNEY = {"event": "view", "subpath": "click->purchase"}
ORDER_STEPS = ["1-URGENT", "3-MEDIUM", "5-LOW"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def sessionize_events(spark: SparkSession, sf_dir: str, delimiter: str = "->") -> DataFrame:
    return tm.sessionize_events(table(spark, sf_dir, "events"), delimiter=delimiter)


def sessionize_events_untidy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events, some without a timestamp or a user."""
    events = table(spark, sf_dir, "events")
    return tm.sessionize_events(
        events.withColumns(
            {
                "ts": F.when(F.col("event_id") % 7 != 0, F.col("ts")),
                "user_id": F.when(F.col("event_id") % 5 != 0, F.col("user_id")),
            }
        )
    )


def conversation_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tm.conversation_paths(table(spark, sf_dir, "conversations"))


def order_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tm.order_paths(table(spark, sf_dir, "orders"))


def generate_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tm.walk_sessions(table(spark, sf_dir, "events"), "event_id")


def _place(name: str, sf_dir: str) -> str:
    return f"{name}-{hashlib.sha1(os.path.abspath(sf_dir).encode()).hexdigest()[:12]}"


def _stored(name: str, build: Query) -> Query:
    """Session tables are prepared once and then analysed, like a converted export."""

    def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
        return stored_once(spark, _place(name, sf_dir), lambda: build(spark, sf_dir))

    return sessions


event_sessions = _stored("events", sessionize_events)
talk_sessions = _stored("conversations", conversation_paths)
order_sessions = _stored("orders", order_paths)
walk_sessions = _stored("walks", generate_sessions)


def delimited_sessions(name: str, delimiter: str) -> Query:
    return _stored(
        f"events_{name}", lambda spark, sf_dir: sessionize_events(spark, sf_dir, delimiter)
    )


def untidy_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event sessions with what real exports contain: blank and padded events, missing
    paths, and missing, zero and too small depths."""
    path = F.replace(F.col("EVENT_PATH"), F.lit("error"), F.lit(""))
    path = F.replace(path, F.lit("signup"), F.lit(" signup  "))
    path = F.replace(path, F.lit("purchase"), F.lit("\u3000buy now\u00a0"))
    return event_sessions(spark, sf_dir).select(
        "SESSION",
        F.nullif(path, F.lit("click")).alias("EVENT_PATH"),
        F.nullif(F.col("TOTAL_EVENTS") - 2, F.lit(5)).alias("TOTAL_EVENTS"),
    )


#: Event types of the given events under the names of the presets' steps.
STEP_NAMES = {
    "view": "Search",
    "click": "Product_View",
    "signup": "Add_To_Cart",
    "purchase": "Checkout",
    "error": "Home",
}


def named_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event sessions with their events renamed to steps of the presets."""
    path = F.col("EVENT_PATH")
    for event, step in STEP_NAMES.items():
        path = F.replace(path, F.lit(event), F.lit(step))
    return event_sessions(spark, sf_dir).withColumn("EVENT_PATH", path)


def _kept(build: Callable[..., DataFrame], source: Query = event_sessions, name: str = "events") -> Query:
    """Analyses of the counts kept per file, brought up to date with the stored sessions first."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        source(spark, sf_dir)
        sessions = stored_path(spark, _place(name, sf_dir))
        state = stored_path(spark, _place(f"{name}_counts", sf_dir))
        tm.update_counts(spark, sessions, state)
        return build(spark, sessions, state)

    return query


def _kept_edges(build: Callable[..., DataFrame], mode: str, top_n: int) -> Query:
    return _kept(lambda spark, _, state: build(tm.kept_edges(spark, state, mode), top_n))


def _kept_ends(end: str) -> Query:
    def build(spark: SparkSession, _: str, state: str) -> DataFrame:
        return metrics.rank_ends(edges.end_counts(tm.kept_neighbours(spark, state), end), end, 10)

    return _kept(build)


def _from_rows(build: Callable[[DataFrame], DataFrame], **options) -> Query:
    """Analyses of the row form of the sessions, which needs no record limit."""
    return lambda spark, sf_dir: build(tm.session_rows(table(spark, sf_dir, "events"), **options))


def talk_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tm.conversation_rows(table(spark, sf_dir, "conversations"))


def order_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tm.order_rows(table(spark, sf_dir, "orders"))


def event_journeys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tm.journey_rows(tm.session_rows(table(spark, sf_dir, "events")))


def row_match_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = event_journeys(spark, sf_dir)
    names = steps.groupBy("session_key").agg(F.any_value("SESSION").alias("SESSION"))
    found = tm.match_positions_from_rows(steps, **_JOURNEY).join(names, "session_key")
    return found.select("SESSION", F.col("position").cast("int").alias("position"))


def _row_groups(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    steps = event_journeys(spark, sf_dir)
    names = steps.groupBy("session_key").agg(F.any_value("SESSION").alias("SESSION"))
    return tm.journey_groups_from_rows(steps, **_JOURNEY), names


def row_journeys(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups, names = _row_groups(spark, sf_dir)
    return groups.join(names, "session_key").select(
        "SESSION",
        F.col("position").cast("int").alias("position"),
        "name",
        F.col("count").cast("int").alias("count"),
        "matched",
    )


def row_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups, names = _row_groups(spark, sf_dir)
    previews = tm.journey_previews_from_rows(groups).join(names, "session_key")
    items = previews.select("SESSION", F.posexplode("preview").alias("position", "item"))
    return items.select(
        "SESSION", "position", "item.name", F.col("item.count").cast("int").alias("count"),
        "item.matched", "item.overflow",
    )


#: All pairs of different events: twenty subpaths in one search.
MANY_SUBPATHS = [
    f"{a}->{b}"
    for a in ("view", "click", "signup", "purchase", "error")
    for b in ("view", "click", "signup", "purchase", "error")
    if a != b
]


def row_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tm.session_rows(table(spark, sf_dir, "events"), keep_unnamed=True)
    found = tm.search_rows(rows, events=["purchase"], subpaths=["view->click"])
    both = (F.size("found_events") == 1) & (F.size("found_subpaths") == 1)
    return found.where(both).select("SESSION", "TOTAL_EVENTS")


def row_search_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tm.session_rows(table(spark, sf_dir, "events"), keep_unnamed=True)
    found = tm.search_rows(rows, subpaths=MANY_SUBPATHS, min_events=3)
    names = F.array(*[F.lit(subpath) for subpath in MANY_SUBPATHS])
    number = F.explode("found_subpaths").alias("number")
    return found.select("SESSION", number).select("SESSION", F.get(names, F.col("number")).alias("subpath"))


def _row_ends(rows: DataFrame, end: str) -> DataFrame:
    return metrics.rank_ends(tm.ends_from_rows(rows, end), end, 10)


def _row_frequencies(rows: DataFrame, dedupe: str) -> DataFrame:
    return metrics.frequencies_from_edges(tm.edges_from_rows(rows, dedupe), 20)


def _row_matrix(rows: DataFrame, dedupe: str, top_n: int) -> DataFrame:
    return flows.matrix_from_edges(tm.edges_from_rows(rows, dedupe), top_n)


def _on(source: Callable[..., DataFrame], operator: Callable[..., DataFrame], *args, **kw) -> Query:
    return lambda spark, sf_dir: operator(source(spark, sf_dir), *args, **kw)


def _events(column: Callable[[F.Column], F.Column] | None = None, source=event_sessions) -> Query:
    """(SESSION, position, event) of the tokenised paths after ``column``."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        events = tokens.tokenize_path(F.col("EVENT_PATH"))
        if column:
            events = column(events)
        return source(spark, sf_dir).select("SESSION", F.posexplode(events).alias("position", "event"))

    return query


def _sanitized(mode: str) -> Query:
    return lambda spark, sf_dir: untidy_sessions(spark, sf_dir).select(
        "SESSION", tokens.sanitize_path(F.col("EVENT_PATH"), mode).alias("clean_path")
    )


# Sources and schema -------------------------------------------------------------------------


def _csv_copy(spark: SparkSession, sessions: DataFrame) -> str:
    path = scratch_path(spark, "sessions_csv")
    sessions.write.option("header", True).option("escape", '"').csv(path)
    return path


def _parquet_copy(spark: SparkSession, sessions: DataFrame) -> str:
    path = scratch_path(spark, "sessions") + ".parquet"
    sessions.write.parquet(path)
    return path


def scan_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tm.read_csv(spark, _csv_copy(spark, event_sessions(spark, sf_dir)))


def scan_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tm.read_sessions(spark, _parquet_copy(spark, event_sessions(spark, sf_dir)))


def map_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    exported = event_sessions(spark, sf_dir).select(
        F.col("SESSION").alias("VEHICLESESSION"),
        F.col("TOTAL_EVENTS").cast("int").alias("STEP_COUNT_AFTER_REPEAT_CAP"),
        F.col("EVENT_PATH").alias("SESSION_PATH_CAPPED_AT_TWO_REPEATS"),
        F.split_part("SESSION", F.lit("_"), F.lit(1)).alias("VEHICLE"),
    )
    return tm.as_sessions(exported)


def _schema_rows(sessions: DataFrame, types: dict[str, str]) -> DataFrame:
    columns = F.array(
        *[
            F.struct(F.lit(name).alias("column_name"), F.lit(kind).alias("column_type"))
            for name, kind in types.items()
        ]
    )
    return (
        sessions.agg(F.count(F.lit(1)).alias("total_rows"))
        .select("total_rows", F.explode(columns).alias("column"))
        .select("column.column_name", "column.column_type", "total_rows")
    )


def validate_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    sessions = event_sessions(spark, sf_dir)
    return _schema_rows(sessions, tm.validate_schema(sessions))


def convert_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    csv_path = _csv_copy(spark, event_sessions(spark, sf_dir))
    parquet_path = scratch_path(spark, "converted") + ".parquet"
    done = tm.convert_dataset(spark, csv_path, parquet_path)
    return tm.read_parquet(spark, parquet_path).withColumn(
        "row_count", F.lit(done.row_count).cast("bigint")
    )


def inspect_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _parquet_copy(spark, event_sessions(spark, sf_dir))
    found = tm.inspect_dataset(spark, path)
    return _schema_rows(spark.read.parquet(path), dict(found.columns))


# Journeys -----------------------------------------------------------------------------------

def _journeys(column: str, *fields: str, source=event_sessions) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = tm.session_journeys(source(spark, sf_dir), **_JOURNEY).select(
            "SESSION", F.posexplode(column).alias("position", "item")
        )
        return rows.select("SESSION", "position", *[f"item.{name}" for name in fields])

    return query


def match_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tm.session_journeys(event_sessions(spark, sf_dir), **_JOURNEY).select(
        "SESSION", F.explode("match_positions").alias("position")
    )


def hidden_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tm.session_journeys(event_sessions(spark, sf_dir), **_JOURNEY).select(
        "SESSION", F.size("groups").alias("groups"), "hidden_groups"
    )


# Flow diagrams and reports ------------------------------------------------------------------


def _matrix10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tm.transition_matrix(event_sessions(spark, sf_dir), top_n=10, dedupe="consecutive")


def sankey_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tm.flow_links(_matrix10(spark, sf_dir))


def sankey_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tm.flow_nodes(sankey_links(spark, sf_dir))


def heatmap_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tm.heatmap_cells(
        tm.transition_matrix(event_sessions(spark, sf_dir), dedupe="consecutive")
    )


def funnel_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tm.funnel_report(tm.funnel(event_sessions(spark, sf_dir), FUNNEL_STEPS))


DEPTH_SQL = """
    SELECT TOTAL_EVENTS, count(*) AS sessions,
           CAST(max(length(EVENT_PATH)) AS BIGINT) AS longest_path
    FROM data GROUP BY TOTAL_EVENTS
"""


neighbour_table = _stored(
    "neighbours", lambda spark, sf_dir: tm.neighbour_counts(untidy_sessions(spark, sf_dir))
)


def _neighbours(mode: str) -> Query:
    """Event frequencies, transitions, matrix and ends out of the one-pass summary."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        counts = neighbour_table(spark, sf_dir)
        kept = edges.edges_from_neighbours(counts, mode)
        filled = edges.edges_from_neighbours(counts, mode, drop_blanks=True)
        return Report(
            {
                "events": metrics.frequencies_from_edges(kept, 20),
                "transitions": flows.rank_transitions(kept, 20),
                "matrix": flows.matrix_from_edges(filled, 8),
                "entry_points": metrics.rank_ends(edges.end_counts(counts, "entry"), "entry", 10),
                "exit_points": metrics.rank_ends(edges.end_counts(counts, "exit"), "exit", 10),
            }
        ).long()

    return query


def run_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    csv_path = _csv_copy(spark, event_sessions(spark, sf_dir))
    summary = tm.run_all(
        spark, csv_path, scratch_path(spark, "run") + ".parquet", scratch_path(spark, "reports")
    )
    return Report({name: spark.read.parquet(path) for name, path in summary.outputs.items()}).long()


def build() -> dict[str, Query]:
    found: dict[str, Query] = {
        # sources and schema
        "scan_csv": scan_csv,
        "scan_parquet": scan_parquet,
        "map_columns": map_columns,
        "validate_schema": validate_schema,
        "convert_dataset": convert_dataset,
        "inspect_dataset": inspect_dataset,
        "detect_delimiter": _on(event_sessions, tm.delimiter_of),
        "detect_delimiter_comma": _on(delimited_sessions("comma", ","), tm.delimiter_of),
        "generate_sessions": generate_sessions,
        # input adapters
        "sessionize_events": sessionize_events,
        "sessionize_events_untidy": sessionize_events_untidy,
        "conversation_paths": conversation_paths,
        "order_paths": order_paths,
        # path arrays
        "tokenize_path": _events(),
        "tokenize_path_untidy": _events(source=untidy_sessions),
        "dedupe_none": _events(lambda e: tokens.dedupe_events(e, "none"), untidy_sessions),
        "dedupe_consecutive": _events(tokens.dedupe_consecutive, untidy_sessions),
        "dedupe_unique": _events(tokens.dedupe_unique, untidy_sessions),
        "drop_blank_events": _events(tokens.drop_blank_events, untidy_sessions),
        "sanitize_path_none": _sanitized("none"),
        "sanitize_path_consecutive": _sanitized("consecutive"),
        "sanitize_path_unique": _sanitized("unique"),
        # journeys
        "compress_journey": _journeys("groups", "name", "count", "matched"),
        "compress_journey_untidy": _journeys(
            "groups", "name", "count", "matched", source=untidy_sessions
        ),
        "match_positions": match_positions,
        "preview_journey": _journeys("preview", "name", "count", "matched", "overflow"),
        "hidden_groups": hidden_groups,
        # rankings that take no dedupe mode
        "entry_events": _on(event_sessions, tm.entry_events),
        "exit_events": _on(event_sessions, tm.exit_events),
        "entry_events_untidy": _on(untidy_sessions, tm.entry_events),
        "exit_events_untidy": _on(untidy_sessions, tm.exit_events),
        "order_entry_events": _on(order_rows, _row_ends, "entry"),
        "order_exit_events": _on(order_rows, _row_ends, "exit"),
        "session_kpis": _on(event_sessions, tm.session_kpis),
        "session_kpis_approximate": _on(event_sessions, tm.session_kpis, approximate=True),
        "session_kpis_untidy": _on(untidy_sessions, tm.session_kpis),
        "conversation_kpis": _on(talk_sessions, tm.session_kpis),
        "order_kpis": _on(order_sessions, tm.session_kpis),
        "transition_matrix_wide": _on(
            event_sessions, tm.transition_matrix_wide, top_n=5, dedupe="consecutive"
        ),
        # the row form
        "session_rows_entry_events": _from_rows(
            lambda rows: metrics.rank_ends(tm.ends_from_rows(rows, "entry"), "entry", 10)
        ),
        "session_rows_funnel_reach": _from_rows(
            lambda rows: tm.funnel_from_rows(rows, FUNNEL_STEPS, sequential=False),
            keep_unnamed=True,
        ),
        "session_rows_exit_events": _from_rows(
            lambda rows: metrics.rank_ends(tm.ends_from_rows(rows, "exit"), "exit", 10)
        ),
        "session_rows_match_positions": row_match_positions,
        "session_rows_compress_journey": row_journeys,
        "session_rows_preview_journey": row_previews,
        "session_rows_search_combined": row_search,
        "session_rows_search_many": row_search_many,
        # funnels
        "funnel_reach": _on(event_sessions, tm.funnel, FUNNEL_STEPS, sequential=False),
        "funnel_reach_untidy": _on(
            untidy_sessions, tm.funnel, ["click", "buy now", "signup"], sequential=False
        ),
        "funnel_auto_topn": _on(event_sessions, tm.funnel_auto),
        "funnel_preset_top": _on(event_sessions, tm.funnel_preset, "top"),
        "funnel_preset_checkout": _on(walk_sessions, tm.funnel_preset, "checkout"),
        "funnel_preset_checkout_fallback": _on(event_sessions, tm.funnel_preset, "checkout"),
        "funnel_preset_search": _on(walk_sessions, tm.funnel_preset, "search"),
        "funnel_preset_search_fallback": _on(event_sessions, tm.funnel_preset, "search"),
        "funnel_report": funnel_report,
        "order_funnel": _on(order_sessions, tm.funnel, ORDER_STEPS),
        "funnel_preset_checkout_named": _on(named_sessions, tm.funnel_preset, "checkout"),
        "funnel_preset_search_named": _on(named_sessions, tm.funnel_preset, "search"),
        # search and SQL
        "search_event": _on(event_sessions, tm.search_sessions, event="purchase", min_events=3),
        "search_subpath": _on(event_sessions, tm.search_sessions, subpath="view->click"),
        "search_combined": _on(
            event_sessions,
            tm.search_sessions,
            event="purchase",
            subpath="view->click",
            min_events=10,
            limit=20,
        ),
        "search_all_matches": _on(
            event_sessions, tm.match_sessions, event="purchase", subpath="view->click"
        ),
        "search_untidy": _on(untidy_sessions, tm.match_sessions, event="signup"),
        "search_untidy_subpath": _on(untidy_sessions, tm.match_sessions, subpath="click->view"),
        "sql_on_data": _on(event_sessions, tm.sql_on_data, DEPTH_SQL),
        "sql_on_data_capped": _on(event_sessions, tm.sql_on_data, DEPTH_SQL, max_rows=10_000),
        # flow data
        "sankey_links": sankey_links,
        "sankey_nodes": sankey_nodes,
        "heatmap_cells": heatmap_cells,
        # jobs
        "insights_report": lambda spark, sf_dir: tm.insights_report(
            event_sessions(spark, sf_dir)
        ).long(),
        "analyze_report": lambda spark, sf_dir: tm.analyze_report(
            event_sessions(spark, sf_dir), steps=FUNNEL_STEPS
        ).long(),
        "session_report": lambda spark, sf_dir: tm.session_report(
            event_sessions(spark, sf_dir), steps=FUNNEL_STEPS
        ).long(),
        "run_all": run_all,
        "neighbour_summary_none": _neighbours("none"),
        "neighbour_summary_consecutive": _neighbours("consecutive"),
    }
    found |= {
        "kept_kpis": _kept(lambda spark, _, state: tm.kept_kpis(spark, state)),
        "kept_conversation_kpis": _kept(
            lambda spark, _, state: tm.kept_kpis(spark, state), talk_sessions, "conversations"
        ),
        "kept_entry_events": _kept_ends("entry"),
        "kept_exit_events": _kept_ends("exit"),
        "kept_search": _kept(
            lambda spark, sessions, state: tm.kept_search(
                spark, sessions, state, event="purchase", subpath="view->click"
            )
        ),
    }
    for mode in tokens.DEDUPE_MODES:
        found |= {
            f"event_frequencies_{mode}": _on(event_sessions, tm.event_frequencies, dedupe=mode),
            f"event_frequencies_untidy_{mode}": _on(
                untidy_sessions, tm.event_frequencies, dedupe=mode
            ),
            f"generated_frequencies_{mode}": _on(
                walk_sessions, tm.event_frequencies, dedupe=mode
            ),
            f"top_paths_{mode}": _on(event_sessions, tm.top_paths, dedupe=mode),
            f"top_paths_untidy_{mode}": _on(untidy_sessions, tm.top_paths, dedupe=mode),
            f"generated_top_paths_{mode}": _on(
                walk_sessions, tm.top_paths, dedupe=mode, min_events=2
            ),
            f"transition_pairs_{mode}": _on(event_sessions, tm.transition_pairs, dedupe=mode),
            f"transition_pairs_untidy_{mode}": _on(
                untidy_sessions, tm.transition_pairs, dedupe=mode
            ),
            f"transition_matrix_{mode}": _on(event_sessions, tm.transition_matrix, dedupe=mode),
            f"transition_matrix_untidy_{mode}": _on(
                untidy_sessions, tm.transition_matrix, top_n=3, dedupe=mode
            ),
            f"funnel_sequential_{mode}": _on(
                event_sessions, tm.funnel, FUNNEL_STEPS, dedupe=mode
            ),
            f"funnel_repeat_{mode}": _on(event_sessions, tm.funnel, REPEAT_STEPS, dedupe=mode),
            f"funnel_untidy_{mode}": _on(
                untidy_sessions, tm.funnel, ["signup", "buy now", "click"], dedupe=mode
            ),
            # by rows, which no long session, conversation or customer can fail
            f"conversation_frequencies_{mode}": _on(talk_rows, _row_frequencies, mode),
            f"order_frequencies_{mode}": _on(order_rows, _row_frequencies, mode),
            f"order_transition_matrix_{mode}": _on(order_rows, _row_matrix, mode, 4),
            f"session_rows_frequencies_{mode}": _from_rows(
                lambda rows, m=mode: metrics.frequencies_from_edges(tm.edges_from_rows(rows, m), 20)
            ),
            f"session_rows_transition_pairs_{mode}": _from_rows(
                lambda rows, m=mode: flows.rank_transitions(tm.edges_from_rows(rows, m), 20)
            ),
            f"session_rows_funnel_{mode}": _from_rows(
                lambda rows, m=mode: tm.funnel_from_rows(rows, FUNNEL_STEPS, dedupe=m),
                keep_unnamed=True,
            ),
            f"session_rows_funnel_repeat_{mode}": _from_rows(
                lambda rows, m=mode: tm.funnel_from_rows(rows, REPEAT_STEPS, dedupe=m),
                keep_unnamed=True,
            ),
            # from counts kept per file, without reading a session again
            f"kept_frequencies_{mode}": _kept_edges(metrics.frequencies_from_edges, mode, 20),
            f"kept_transition_pairs_{mode}": _kept_edges(flows.rank_transitions, mode, 20),
            f"kept_matrix_{mode}": _kept(
                lambda spark, _, state, m=mode: flows.matrix_from_edges(
                    tm.kept_edges(spark, state, m, drop_blanks=True), 8
                )
            ),
            f"session_rows_top_paths_{mode}": _from_rows(
                lambda rows, m=mode: tm.top_paths_from_rows(rows, dedupe=m), keep_unnamed=True
            ),
        }
    for name, mark in (("comma", ","), ("pipe", "|"), ("spaced", " / "), ("dashes", "--")):
        found[f"transition_pairs_{name}"] = _on(
            delimited_sessions(name, mark),
            tm.transition_pairs,
            delimiter=mark,
            dedupe="consecutive",
        )
    return found
