"""SQL for DuckDB that answers each registered query on the same tables.

Written on its own terms: paths are lists, pairs come from list positions, funnels from chained
positions, journeys from gaps and islands.
"""

from __future__ import annotations

from registry import (
    DEPTH_SQL,
    FUNNEL_STEPS,
    MANY_SUBPATHS,
    ORDER_STEPS,
    REPEAT_STEPS,
    STEP_NAMES,
)
from trailmark.functions.tokens import DEDUPE_MODES
from trailmark.operators.funnels import PRESET_STEPS
from trailmark.sources.synthetic import FOLLOW_UPS, LENGTH_WEIGHTS, SHOP_EVENTS, START_EVENTS

# Session tables ------------------------------------------------------------------------------


def events_cte(delimiter: str = "->", source: str = "events") -> str:
    # Events without a user have nothing in common: each is a group of its own.
    group = "user_id, CASE WHEN user_id IS NULL THEN event_id END"
    return f"""
    gaps AS (
        SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY {group} ORDER BY ts, event_id)
                       <= INTERVAL 1 DAY THEN 0 ELSE 1 END AS opens
        FROM {source}),
    numbered AS (
        SELECT *, sum(opens) OVER (PARTITION BY {group} ORDER BY ts, event_id
                                   ROWS UNBOUNDED PRECEDING) AS sid
        FROM gaps),
    sess AS (
        SELECT user_id::VARCHAR || '_' || sid::BIGINT::VARCHAR AS SESSION,
               string_agg(event_type, '{delimiter}' ORDER BY ts, event_id) AS EVENT_PATH,
               count(*)::BIGINT AS TOTAL_EVENTS
        FROM numbered GROUP BY {group}, sid)"""


EVENTS = events_cte()

TALKS = """
    sess AS (
        SELECT conv_id::VARCHAR AS SESSION, string_agg(role, '->' ORDER BY turn) AS EVENT_PATH,
               count(*)::BIGINT AS TOTAL_EVENTS
        FROM conversations GROUP BY conv_id)"""

ORDERS = """
    sess AS (
        SELECT o_custkey::VARCHAR AS SESSION,
               string_agg(o_orderpriority, '->' ORDER BY o_orderdate, o_orderkey) AS EVENT_PATH,
               count(*)::BIGINT AS TOTAL_EVENTS
        FROM orders GROUP BY o_custkey)"""

UNTIDY = EVENTS.replace("sess AS (", "tidy AS (") + """,
    sess AS (
        SELECT SESSION,
               nullif(replace(replace(replace(EVENT_PATH, 'error', ''), 'signup', ' signup  '),
                              'purchase', chr(12288) || 'buy now' || chr(160)),
                      'click') AS EVENT_PATH,
               nullif(TOTAL_EVENTS - 2, 5) AS TOTAL_EVENTS
        FROM tidy)"""


def _named_cte() -> str:
    path = "EVENT_PATH"
    for event, step in STEP_NAMES.items():
        path = f"replace({path}, '{event}', '{step}')"
    return EVENTS.replace("sess AS (", "plain AS (") + f""",
    sess AS (SELECT SESSION, {path} AS EVENT_PATH, TOTAL_EVENTS FROM plain)"""


NAMED = _named_cte()


def _walk_cte() -> str:
    def names(values) -> str:
        return "[" + ", ".join(f"'{v}'" for v in values) + "]"

    def draw(k: int) -> str:
        return f"('0x' || substr(digits, {7 * k + 1}, 7))::BIGINT"

    bounds = [sum(LENGTH_WEIGHTS[: i + 1]) for i in range(len(LENGTH_WEIGHTS))]
    length = (
        "CASE "
        + " ".join(f"WHEN roll < {b} THEN {i + 1}" for i, b in enumerate(bounds))
        + " END"
    )
    steps, previous = [], "w1"
    for n in range(2, len(LENGTH_WEIGHTS) + 1):
        options = (
            "CASE e"
            + str(n - 1)
            + " "
            + " ".join(f"WHEN '{k}' THEN {names(v)}" for k, v in FOLLOW_UPS.items())
            + f" ELSE {names(SHOP_EVENTS)} END"
        )
        steps.append(
            f"o{n} AS (SELECT *, {options} AS opts{n} FROM {previous}), "
            f"w{n} AS (SELECT *, opts{n}[1 + {draw(n)} % len(opts{n})] AS e{n} FROM o{n})"
        )
        previous = f"w{n}"
    walk = ", ".join(f"e{i + 1}" for i in range(len(LENGTH_WEIGHTS)))
    code = (
        "((event_id & 16777215) * 25214903917"
        " + ((((event_id >> 24) & 16777215) * 25214903917) % 16777216) * 16777216)"
        " % 281474976710656"
    )
    return f"""
    d AS (SELECT event_id, md5('42:' || event_id::VARCHAR || ':a')
                 || md5('42:' || event_id::VARCHAR || ':b') AS digits FROM events),
    w0 AS (SELECT *, {draw(0)} % {sum(LENGTH_WEIGHTS)} AS roll FROM d),
    w1 AS (SELECT *, {length} AS n, {names(START_EVENTS)}[1 + {draw(1)} % {len(START_EVENTS)}] AS e1
           FROM w0),
    {", ".join(steps)},
    sess AS (SELECT 'SESS_' || lpad(upper(to_hex({code})), 12, '0') AS SESSION,
                    array_to_string([{walk}][1:n], '->') AS EVENT_PATH, n::BIGINT AS TOTAL_EVENTS
             FROM {previous})"""


WALKS = _walk_cte()

# Lists ---------------------------------------------------------------------------------------


def dedupe(events: str, mode: str) -> str:
    if mode == "consecutive":
        return f"list_filter({events}, lambda x, i: i = 1 OR x <> {events}[i - 1])"
    if mode == "unique":
        return f"list_filter({events}, lambda x, i: list_position({events}, x) = i)"
    return events


def lists_cte(mode: str = "none", delimiter: str = "->", blanks: bool = True) -> str:
    """raw(e) holds the trimmed tokens, lists(e) the deduplicated ones; NULL paths stay out."""
    tokens = f"list_transform(string_split(EVENT_PATH, '{delimiter}'), lambda x: trim(x))"
    if not blanks:
        tokens = f"list_filter({tokens}, lambda x: x <> '')"
    return f"""
    raw AS (SELECT SESSION, EVENT_PATH, TOTAL_EVENTS, {tokens} AS e FROM sess
            WHERE EVENT_PATH IS NOT NULL),
    lists AS (SELECT SESSION, EVENT_PATH, TOTAL_EVENTS, {dedupe("e", mode)} AS e FROM raw)"""


def event_rows(base: str, mode: str = "none", blanks: bool = True) -> str:
    return f"""WITH {base}, {lists_cte(mode, blanks=blanks)}
    SELECT SESSION, unnest(range(len(e)))::INTEGER AS position, unnest(e) AS event FROM lists"""


def frequencies(base: str, mode: str, top_n: int = 20) -> str:
    return f"""WITH {base}, {lists_cte(mode)},
    counted AS (SELECT event_name, count(*)::BIGINT AS occurrence_count
                FROM (SELECT unnest(e) AS event_name FROM lists) WHERE event_name <> ''
                GROUP BY event_name)
    SELECT event_name, occurrence_count,
           round(occurrence_count * 100.0 / sum(occurrence_count) OVER (), 2)::DOUBLE AS percentage
    FROM counted ORDER BY occurrence_count DESC, event_name LIMIT {top_n}"""


def paths(base: str, mode: str, top_n: int = 15, min_events: int = 1) -> str:
    text = "EVENT_PATH" if mode == "none" else "array_to_string(e, '->')"
    return f"""WITH {base}, {lists_cte(mode)}
    SELECT {text} AS full_path, TOTAL_EVENTS, count(*)::BIGINT AS session_count,
           round(count(*) * 100.0 / (SELECT count(*) FROM sess), 2)::DOUBLE AS share_percent
    FROM lists WHERE TOTAL_EVENTS >= {min_events}
    GROUP BY ALL ORDER BY session_count DESC, full_path, TOTAL_EVENTS LIMIT {top_n}"""


def pairs(base: str, mode: str, top_n: int = 20, delimiter: str = "->") -> str:
    return f"""WITH {base}, {lists_cte(mode, delimiter)},
    hops AS (SELECT e[i] AS source_event, e[i + 1] AS target_event
             FROM lists, generate_series(1, len(e) - 1) AS t(i))
    SELECT source_event || ' -> ' || target_event AS transition, source_event, target_event,
           count(*)::BIGINT AS transition_count
    FROM hops WHERE source_event <> '' AND target_event <> ''
    GROUP BY source_event, target_event
    ORDER BY transition_count DESC, source_event, target_event LIMIT {top_n}"""


def matrix_ctes(base: str, mode: str, top_n: int) -> str:
    return f"""WITH {base}, {lists_cte(mode, blanks=False)},
    ranked AS (SELECT event_name, row_number() OVER (ORDER BY n DESC, event_name) AS event_rank
               FROM (SELECT event_name, count(*) AS n
                     FROM (SELECT unnest(e) AS event_name FROM lists) GROUP BY event_name)
               QUALIFY event_rank <= {top_n}),
    hops AS (SELECT e[i] AS s, e[i + 1] AS t, count(*) AS n
             FROM lists, generate_series(1, len(e) - 1) AS p(i) GROUP BY ALL),
    matrix AS (SELECT a.event_name AS source_event, b.event_name AS target_event,
                      coalesce(n, 0)::BIGINT AS transition_count,
                      a.event_rank::BIGINT AS source_rank, b.event_rank::BIGINT AS target_rank
               FROM ranked a, ranked b LEFT JOIN hops ON s = a.event_name AND t = b.event_name)"""


def matrix(base: str, mode: str, top_n: int = 8) -> str:
    return f"{matrix_ctes(base, mode, top_n)} SELECT * FROM matrix ORDER BY 4, 5"


def ends(base: str, kind: str, top_n: int = 10) -> str:
    event = "e[1]" if kind == "entry" else "e[len(e)]"
    return f"""WITH {base}, {lists_cte()},
    valid AS (SELECT {event} AS event_name FROM lists WHERE TOTAL_EVENTS > 0)
    SELECT event_name, count(*)::BIGINT AS {kind}_count,
           round(count(*) * 100.0 / (SELECT count(*) FROM valid), 2)::DOUBLE AS {kind}_share_pct
    FROM valid WHERE event_name <> ''
    GROUP BY event_name ORDER BY 2 DESC, 1 LIMIT {top_n}"""


def kpis(base: str) -> str:
    return f"""WITH {base}
    SELECT count(*)::BIGINT AS total_sessions,
           count(*) FILTER (WHERE TOTAL_EVENTS = 1)::BIGINT AS single_event_bounces,
           round_even(count(*) FILTER (WHERE TOTAL_EVENTS = 1) / count(*) * 100, 2)
               AS bounce_rate_pct,
           round(avg(TOTAL_EVENTS), 2) AS avg_events_per_session,
           quantile_disc(TOTAL_EVENTS, 0.50)::BIGINT AS median_events,
           quantile_disc(TOTAL_EVENTS, 0.75)::BIGINT AS p75_events,
           quantile_disc(TOTAL_EVENTS, 0.90)::BIGINT AS p90_events,
           max(TOTAL_EVENTS) AS max_events
    FROM sess"""


# Funnels -------------------------------------------------------------------------------------


def _quoted(name: str) -> str:
    return "'" + name.replace("'", "''") + "'"


def funnel_ctes(base: str, steps: str, mode: str, sequential: bool = True) -> str:
    """``steps`` is a query (step_number, step_name). Positions are chained step by step."""
    if sequential:
        reach = """
    chain AS (
        SELECT 1 AS step_number, SESSION, e, list_position(e, step_name) AS pos
        FROM everyone, steps WHERE step_number = 1
        UNION ALL
        SELECT c.step_number + 1, SESSION, e,
               CASE WHEN list_position(e[pos + 1:], s.step_name) > 0
                    THEN pos + list_position(e[pos + 1:], s.step_name) END
        FROM chain c JOIN steps s ON s.step_number = c.step_number + 1 WHERE pos > 0),
    counted AS (SELECT step_number, step_name, count(pos) AS n
                FROM steps LEFT JOIN chain USING (step_number) GROUP BY ALL)"""
    else:
        reach = """
    counted AS (SELECT step_number, step_name,
                       count(*) FILTER (WHERE list_contains(e, step_name)) AS n
                FROM steps, everyone GROUP BY ALL)"""
    return f"""WITH RECURSIVE {base}, {lists_cte(mode)},
    everyone AS (SELECT sess.SESSION, e FROM sess LEFT JOIN lists USING (SESSION)),
    steps AS ({steps}),{reach},
    rated AS (
        SELECT step_number::BIGINT AS step_number, step_name, n::BIGINT AS session_count,
               coalesce(CASE WHEN step_number = 1
                             THEN round_even(n / greatest((SELECT count(*) FROM sess), 1) * 100, 2)
                             WHEN lag(n) OVER w > 0 THEN round_even(n / lag(n) OVER w * 100, 2)
                        END, 0.0) AS step_conversion_pct,
               CASE WHEN first_value(n) OVER w > 0
                    THEN round_even(n / first_value(n) OVER w * 100, 2) ELSE 0.0 END
                   AS overall_conversion_pct
        FROM counted WINDOW w AS (ORDER BY step_number)),
    funnel AS (SELECT step_number, step_name, session_count, step_conversion_pct,
                      round_even(100.0 - step_conversion_pct, 2) AS step_dropoff_pct,
                      overall_conversion_pct
               FROM rated)"""


def step_list(names) -> str:
    rows = ", ".join(f"({i + 1}, {_quoted(n)})" for i, n in enumerate(names))
    return f"SELECT * FROM (VALUES {rows}) AS v(step_number, step_name)"


def frequent(mode: str, top_n: int) -> str:
    """The most frequent events as steps; reads the lists of the enclosing query."""
    return f"""SELECT row_number() OVER (ORDER BY n DESC, step_name) AS step_number, step_name
        FROM (SELECT step_name, count(*) AS n
              FROM (SELECT unnest({dedupe("e", mode)}) AS step_name FROM raw)
              WHERE step_name <> '' GROUP BY step_name)
        ORDER BY 1 LIMIT {top_n}"""


def preset(names, mode: str, fallback: int) -> str:
    listed = step_list(names)
    return f"""WITH pool AS ({frequent(mode, 20)}),
        named AS (SELECT row_number() OVER (ORDER BY v.step_number) AS step_number, v.step_name
                  FROM ({listed}) v WHERE v.step_name IN (SELECT step_name FROM pool))
        SELECT * FROM named UNION ALL
        SELECT * FROM pool WHERE step_number <= {fallback} AND NOT EXISTS (FROM named)"""


def funnel(base: str, steps: str, mode: str = "none", sequential: bool = True) -> str:
    return (
        funnel_ctes(base, steps, mode, sequential) + " SELECT * FROM funnel ORDER BY step_number"
    )


# Journeys ------------------------------------------------------------------------------------


def journey_ctes(base: str) -> str:
    """Event view, subpath click -> purchase: marks and run-length groups per session."""
    return f"""WITH {base}, {lists_cte(blanks=False)},
    placed AS (SELECT SESSION, unnest(range(len(e))) AS pos, unnest(e) AS name FROM lists),
    near AS (SELECT *, lag(name) OVER w AS before, lead(name) OVER w AS after
             FROM placed WINDOW w AS (PARTITION BY SESSION ORDER BY pos)),
    marked AS (SELECT SESSION, pos, name,
                      coalesce(name = 'view' OR (name = 'click' AND after = 'purchase')
                               OR (name = 'purchase' AND before = 'click'), false) AS hit,
                      CASE WHEN before = name THEN 0 ELSE 1 END AS opens
               FROM near),
    islands AS (SELECT *, sum(opens) OVER (PARTITION BY SESSION ORDER BY pos) - 1 AS position
                FROM marked),
    grouped AS (SELECT SESSION, position::INTEGER AS position, any_value(name) AS name,
                       count(*)::INTEGER AS count, bool_or(hit) AS matched
                FROM islands GROUP BY SESSION, position),
    hidden AS (SELECT SESSION, min(position) AS first_match FROM grouped
               WHERE position >= 8 AND matched GROUP BY SESSION)"""


# Reports -------------------------------------------------------------------------------------


def section(name: str, query: str, order: str, label: str, value: str) -> str:
    return f"""SELECT '{name}' AS section, row_number() OVER (ORDER BY {order})::INTEGER AS rank,
        {label} AS label, {value}::DOUBLE AS value FROM ({query})"""


KPI_NAMES = (
    "total_sessions", "single_event_bounces", "bounce_rate_pct", "avg_events_per_session",
    "median_events", "p75_events", "p90_events", "max_events",
)


def kpi_section(base: str) -> str:
    rows = " UNION ALL ".join(
        f"SELECT 'kpis' AS section, {i + 1}::INTEGER AS rank, '{name}' AS label, "
        f"{name}::DOUBLE AS value FROM k"
        for i, name in enumerate(KPI_NAMES)
    )
    return f"SELECT * FROM (WITH k AS ({kpis(base)}) {rows})"


def end_sections(base: str, top_n: int) -> list[str]:
    return [
        section(f"{kind}_points", ends(base, kind, top_n), f"{kind}_count DESC, event_name",
                "event_name", f"{kind}_count")
        for kind in ("entry", "exit")
    ]


def path_section(query: str) -> str:
    return section("paths", query, "session_count DESC, full_path, TOTAL_EVENTS", "full_path",
                   "session_count")


def funnel_section(query: str) -> str:
    return section("funnel", query, "step_number", "step_name", "session_count")


def build() -> dict[str, str]:
    session_rows = f"WITH {EVENTS} SELECT SESSION, EVENT_PATH, TOTAL_EVENTS FROM sess"
    schema_rows = f"""WITH {EVENTS}
        SELECT column_name, column_type, (SELECT count(*) FROM sess)::BIGINT AS total_rows
        FROM (VALUES ('SESSION', 'string'), ('EVENT_PATH', 'string'), ('TOTAL_EVENTS', 'bigint'))
             AS v(column_name, column_type)"""

    def delimiter(base: str) -> str:
        return f"""WITH {base}
        SELECT CASE WHEN bool_or(contains(EVENT_PATH, '->')) THEN '->'
                    WHEN bool_or(contains(EVENT_PATH, ',')) THEN ','
                    WHEN bool_or(contains(EVENT_PATH, '>')) THEN '>'
                    WHEN bool_or(contains(EVENT_PATH, '|')) THEN '|' ELSE '->' END AS delimiter
        FROM sess WHERE trim(EVENT_PATH) <> ''"""

    def clean(mode: str) -> str:
        text = "EVENT_PATH" if mode == "none" else f"array_to_string({dedupe('e', mode)}, '->')"
        tokens = "list_transform(string_split(EVENT_PATH, '->'), lambda x: trim(x))"
        return f"""WITH {UNTIDY}
        SELECT SESSION, CASE WHEN EVENT_PATH IS NOT NULL THEN {text} END AS clean_path
        FROM (SELECT *, {tokens} AS e FROM sess)"""

    def search(base: str, event: str = "", subpath: str = "", low: int = 1, limit: int = 0) -> str:
        tests = [f"TOTAL_EVENTS >= {low}"]
        if event:
            tests.append(
                "list_contains(list_transform(string_split(EVENT_PATH, '->'), "
                f"lambda x: trim(x)), '{event}')"
            )
        if subpath:
            tests.append(f"strpos('->' || EVENT_PATH || '->', '->{subpath}->') > 0")
        tail = f"ORDER BY SESSION, EVENT_PATH LIMIT {limit}" if limit else ""
        return f"""WITH {base} SELECT SESSION, EVENT_PATH, TOTAL_EVENTS FROM sess
        WHERE {" AND ".join(tests)} {tail}"""

    links = f"""{matrix_ctes(EVENTS, "consecutive", 10)},
    links AS (SELECT source_event, target_event, transition_count AS value FROM matrix
              WHERE transition_count > 0
              ORDER BY transition_count DESC, source_rank, target_rank LIMIT 24)"""
    square = ["click", "error", "purchase", "signup", "view"]
    wide = ", ".join(
        f"sum(transition_count) FILTER (WHERE target_event = '{e}')::BIGINT AS \"{e}\""
        for e in square
    )
    groups = "SELECT SESSION, position, name, count, matched FROM grouped"
    top_funnel = funnel(EVENTS, frequent("consecutive", 8), "consecutive", sequential=False)
    data_sql = DEPTH_SQL.replace("FROM data", "FROM sess")

    found = {
        "scan_csv": session_rows,
        "scan_parquet": session_rows,
        "map_columns": f"""WITH {EVENTS} SELECT SESSION, EVENT_PATH, TOTAL_EVENTS,
            string_split(SESSION, '_')[1] AS VEHICLE FROM sess""",
        "validate_schema": schema_rows,
        "convert_dataset": f"""WITH {EVENTS} SELECT *, count(*) OVER ()::BIGINT AS row_count
            FROM sess""",
        "inspect_dataset": schema_rows,
        "detect_delimiter": delimiter(EVENTS),
        "detect_delimiter_comma": delimiter(events_cte(",")),
        "generate_sessions": f"WITH {WALKS} SELECT * FROM sess",
        "sessionize_events": session_rows,
        "sessionize_events_untidy": f"""WITH unsure AS (
                SELECT event_id, event_type,
                       CASE WHEN event_id % 7 <> 0 THEN ts END AS ts,
                       CASE WHEN event_id % 5 <> 0 THEN user_id END AS user_id
                FROM events),
            {events_cte(source="unsure")}
            SELECT * FROM sess""",
        "conversation_paths": f"WITH {TALKS} SELECT * FROM sess",
        "order_paths": f"WITH {ORDERS} SELECT * FROM sess",
        "tokenize_path": event_rows(EVENTS),
        "tokenize_path_untidy": event_rows(UNTIDY),
        "drop_blank_events": event_rows(UNTIDY, blanks=False),
        "compress_journey": f"{journey_ctes(EVENTS)} {groups}",
        "compress_journey_untidy": f"{journey_ctes(UNTIDY)} {groups}",
        "match_positions": f"""{journey_ctes(EVENTS)}
            SELECT SESSION, pos::INTEGER AS position FROM marked WHERE hit""",
        "preview_journey": f"""{journey_ctes(EVENTS)}
            SELECT SESSION, position, name, count, matched, false AS overflow
            FROM grouped WHERE position < 8
            UNION ALL
            SELECT SESSION, 8::INTEGER, NULL, (first_match - 8)::INTEGER, false, true
            FROM hidden WHERE first_match > 8
            UNION ALL
            SELECT SESSION, CASE WHEN first_match > 8 THEN 9 ELSE 8 END::INTEGER, name, count,
                   matched, false
            FROM hidden JOIN grouped USING (SESSION) WHERE position = first_match""",
        "hidden_groups": f"""{journey_ctes(EVENTS)}
            SELECT SESSION, count(*)::INTEGER AS groups,
                   greatest(count(*) - 8 - max(CASE WHEN first_match IS NULL THEN 0 ELSE 1 END), 0)
                       ::INTEGER AS hidden_groups
            FROM grouped LEFT JOIN hidden USING (SESSION) GROUP BY SESSION""",
        "entry_events": ends(EVENTS, "entry"),
        "exit_events": ends(EVENTS, "exit"),
        "entry_events_untidy": ends(UNTIDY, "entry"),
        "exit_events_untidy": ends(UNTIDY, "exit"),
        "order_entry_events": ends(ORDERS, "entry"),
        "order_exit_events": ends(ORDERS, "exit"),
        "kept_entry_events": ends(EVENTS, "entry"),
        "kept_exit_events": ends(EVENTS, "exit"),
        "kept_kpis": kpis(EVENTS),
        "kept_conversation_kpis": kpis(TALKS),
        "kept_search": search(EVENTS, "purchase", "view->click"),
        "session_rows_entry_events": ends(EVENTS, "entry"),
        "session_rows_exit_events": ends(EVENTS, "exit"),
        "session_rows_funnel_reach": funnel(EVENTS, step_list(FUNNEL_STEPS), sequential=False),
        "session_kpis": kpis(EVENTS),
        "session_kpis_approximate": kpis(EVENTS),
        "session_kpis_untidy": kpis(UNTIDY),
        "conversation_kpis": kpis(TALKS),
        "order_kpis": kpis(ORDERS),
        "transition_matrix_wide": f"""{matrix_ctes(EVENTS, "consecutive", 5)}
            SELECT source_event, {wide} FROM matrix GROUP BY source_event""",
        "funnel_reach": funnel(EVENTS, step_list(FUNNEL_STEPS), sequential=False),
        "funnel_reach_untidy": funnel(
            UNTIDY, step_list(["click", "buy now", "signup"]), sequential=False
        ),
        "funnel_auto_topn": top_funnel,
        "funnel_preset_top": funnel(EVENTS, frequent("consecutive", 4)),
        "funnel_preset_checkout": funnel(
            WALKS, preset(PRESET_STEPS["checkout"], "consecutive", 4), "consecutive"
        ),
        "funnel_preset_checkout_fallback": funnel(
            EVENTS, preset(PRESET_STEPS["checkout"], "consecutive", 4), "consecutive"
        ),
        "funnel_preset_search": funnel(
            WALKS, preset(PRESET_STEPS["search"], "consecutive", 3), "consecutive"
        ),
        "funnel_preset_search_fallback": funnel(
            EVENTS, preset(PRESET_STEPS["search"], "consecutive", 3), "consecutive"
        ),
        "funnel_preset_checkout_named": funnel(
            NAMED, preset(PRESET_STEPS["checkout"], "consecutive", 4), "consecutive"
        ),
        "funnel_preset_search_named": funnel(
            NAMED, preset(PRESET_STEPS["search"], "consecutive", 3), "consecutive"
        ),
        "funnel_report": f"""{funnel_ctes(EVENTS, step_list(FUNNEL_STEPS), "none")}
            SELECT *, session_count / (SELECT greatest(max(session_count), 1) FROM funnel
                                       WHERE step_number = 1) AS bar_share,
                   CASE WHEN step_number = 1 THEN 'start' WHEN step_dropoff_pct < 40 THEN 'ok'
                        WHEN step_dropoff_pct < 70 THEN 'warn' ELSE 'alert' END AS severity
            FROM funnel""",
        "order_funnel": funnel(ORDERS, step_list(ORDER_STEPS)),
        "search_event": search(EVENTS, "purchase", low=3, limit=50),
        "search_subpath": search(EVENTS, subpath="view->click", limit=50),
        "search_combined": search(EVENTS, "purchase", "view->click", 10, 20),
        "search_all_matches": search(EVENTS, "purchase", "view->click"),
        "search_untidy": search(UNTIDY, "signup"),
        "search_untidy_subpath": search(UNTIDY, subpath="click->view"),
        "sql_on_data": f"WITH {EVENTS} {data_sql}",
        "sql_on_data_capped": f"WITH {EVENTS} {data_sql}",
        "sankey_links": f"{links} SELECT * FROM links",
        "sankey_nodes": f"""{links}
            SELECT 'source' AS side, source_event AS event_name, sum(value)::BIGINT AS total
            FROM links GROUP BY source_event
            UNION ALL
            SELECT 'target', target_event, sum(value)::BIGINT FROM links GROUP BY target_event""",
        "heatmap_cells": f"""{matrix_ctes(EVENTS, "consecutive", 8)},
            shares AS (SELECT *, transition_count / greatest(max(transition_count) OVER (), 1)
                              AS ratio FROM matrix)
            SELECT *, CASE WHEN transition_count = 0 THEN 'none' WHEN ratio < 0.15 THEN 'low'
                           WHEN ratio < 0.40 THEN 'medium' WHEN ratio < 0.70 THEN 'high'
                           ELSE 'peak' END AS band,
                   CASE WHEN transition_count > 0 THEN greatest(0.15::DOUBLE, ratio)
                        ELSE 0.0 END AS opacity
            FROM shares""",
        "insights_report": " UNION ALL ".join([kpi_section(EVENTS), *end_sections(EVENTS, 5)]),
        "analyze_report": " UNION ALL ".join(
            [
                section("events", frequencies(EVENTS, "consecutive", 15),
                        "occurrence_count DESC, event_name", "event_name", "occurrence_count"),
                section("transitions", pairs(EVENTS, "consecutive", 15),
                        "transition_count DESC, source_event, target_event", "transition",
                        "transition_count"),
                path_section(paths(EVENTS, "consecutive", 10)),
                funnel_section(funnel(EVENTS, step_list(FUNNEL_STEPS), "consecutive")),
            ]
        ),
        "session_report": " UNION ALL ".join(
            [
                kpi_section(EVENTS),
                *end_sections(EVENTS, 10),
                path_section(paths(EVENTS, "none", 10)),
                section("matrix", matrix(EVENTS, "none", 15), "source_rank, target_rank",
                        "source_event || ' -> ' || target_event", "transition_count"),
                funnel_section(funnel(EVENTS, step_list(FUNNEL_STEPS), "consecutive")),
            ]
        ),
        "run_all": " UNION ALL ".join(
            [
                kpi_section(EVENTS),
                *end_sections(EVENTS, 10),
                path_section(paths(EVENTS, "none", 10)),
                section("matrix", matrix(EVENTS, "none", 15), "source_rank, target_rank",
                        "source_event || ' -> ' || target_event", "transition_count"),
                funnel_section(top_funnel),
            ]
        ),
    }
    for name in ("match_positions", "compress_journey", "preview_journey"):
        found[f"session_rows_{name}"] = found[name]
    both = search(EVENTS, "purchase", "view->click")
    found["session_rows_search_combined"] = f"SELECT SESSION, TOTAL_EVENTS FROM ({both})"
    found["session_rows_search_many"] = f"""WITH {EVENTS},
        wanted AS (SELECT unnest({MANY_SUBPATHS}) AS subpath)
        SELECT SESSION, subpath FROM sess, wanted
        WHERE TOTAL_EVENTS >= 3 AND strpos('->' || EVENT_PATH || '->', '->' || subpath || '->') > 0"""
    for mode in ("none", "consecutive"):
        found[f"neighbour_summary_{mode}"] = " UNION ALL ".join(
            [
                section("events", frequencies(UNTIDY, mode, 20),
                        "occurrence_count DESC, event_name", "event_name", "occurrence_count"),
                section("transitions", pairs(UNTIDY, mode, 20),
                        "transition_count DESC, source_event, target_event", "transition",
                        "transition_count"),
                section("matrix", matrix(UNTIDY, mode, 8), "source_rank, target_rank",
                        "source_event || ' -> ' || target_event", "transition_count"),
                *end_sections(UNTIDY, 10),
            ]
        )
    for mode in DEDUPE_MODES:
        found |= {
            f"dedupe_{mode}": event_rows(UNTIDY, mode),
            f"sanitize_path_{mode}": clean(mode),
            f"event_frequencies_{mode}": frequencies(EVENTS, mode),
            f"event_frequencies_untidy_{mode}": frequencies(UNTIDY, mode),
            f"conversation_frequencies_{mode}": frequencies(TALKS, mode),
            f"order_frequencies_{mode}": frequencies(ORDERS, mode),
            f"generated_frequencies_{mode}": frequencies(WALKS, mode),
            f"top_paths_{mode}": paths(EVENTS, mode),
            f"top_paths_untidy_{mode}": paths(UNTIDY, mode),
            f"generated_top_paths_{mode}": paths(WALKS, mode, min_events=2),
            f"transition_pairs_{mode}": pairs(EVENTS, mode),
            f"transition_pairs_untidy_{mode}": pairs(UNTIDY, mode),
            f"transition_matrix_{mode}": matrix(EVENTS, mode),
            f"transition_matrix_untidy_{mode}": matrix(UNTIDY, mode, 3),
            f"order_transition_matrix_{mode}": matrix(ORDERS, mode, 4),
            f"funnel_sequential_{mode}": funnel(EVENTS, step_list(FUNNEL_STEPS), mode),
            f"funnel_repeat_{mode}": funnel(EVENTS, step_list(REPEAT_STEPS), mode),
            f"funnel_untidy_{mode}": funnel(
                UNTIDY, step_list(["signup", "buy now", "click"]), mode
            ),
            f"session_rows_frequencies_{mode}": frequencies(EVENTS, mode),
            f"session_rows_transition_pairs_{mode}": pairs(EVENTS, mode),
            f"kept_frequencies_{mode}": frequencies(EVENTS, mode),
            f"kept_transition_pairs_{mode}": pairs(EVENTS, mode),
            f"kept_matrix_{mode}": matrix(EVENTS, mode),
            f"session_rows_funnel_{mode}": funnel(EVENTS, step_list(FUNNEL_STEPS), mode),
            f"session_rows_funnel_repeat_{mode}": funnel(EVENTS, step_list(REPEAT_STEPS), mode),
            f"session_rows_top_paths_{mode}": paths(EVENTS, mode),
        }
    for name, mark in (("comma", ","), ("pipe", "|"), ("spaced", " / "), ("dashes", "--")):
        found[f"transition_pairs_{name}"] = pairs(events_cte(mark), "consecutive", delimiter=mark)
    return found
