"""Session-path and funnel analytics on Spark DataFrames."""

from trailmark.errors import RowLimitError, SessionDataError
from trailmark.operators.edges import (
    edge_counts,
    edges_from_rows,
    ends_from_rows,
    neighbour_counts,
)
from trailmark.operators.flows import (
    flow_links,
    flow_nodes,
    heatmap_cells,
    transition_matrix,
    transition_matrix_wide,
    transition_pairs,
)
from trailmark.operators.funnels import (
    funnel,
    funnel_auto,
    funnel_from_rows,
    funnel_preset,
    funnel_report,
)
from trailmark.operators.metrics import (
    entry_events,
    event_frequencies,
    exit_events,
    session_kpis,
)
from trailmark.operators.paths import top_paths, top_paths_from_rows
from trailmark.operators.pieces import first_places, session_pieces
from trailmark.operators.row_journeys import (
    journey_groups_from_rows,
    journey_previews_from_rows,
    journey_rows,
    match_positions_from_rows,
    search_rows,
)
from trailmark.operators.search import match_sessions, search_sessions, session_journeys
from trailmark.operators.sql import sql_on_data
from trailmark.plans.kept import (
    files_to_search,
    kept_edges,
    kept_kpis,
    kept_neighbours,
    kept_report,
    kept_search,
    update_counts,
)
from trailmark.plans.reports import analyze_report, insights_report, run_all, session_report
from trailmark.session import build_session
from trailmark.sources.adapters import (
    conversation_paths,
    conversation_rows,
    keyed_paths,
    keyed_rows,
    keyed_sessions,
    order_paths,
    order_rows,
    session_rows,
    sessionize_events,
)
from trailmark.sources.columns import as_sessions, map_columns, validate_schema
from trailmark.sources.convert import (
    convert_dataset,
    convert_if_stale,
    inspect_dataset,
    is_fresh,
)
from trailmark.sources.delimiter import delimiter_of, detect_delimiter
from trailmark.sources.readers import is_parquet, read_csv, read_parquet, read_sessions
from trailmark.sources.storage import current_path
from trailmark.sources.synthetic import generate_sessions, walk_sessions

__all__ = [name for name in dir() if not name.startswith("_")]
