"""Command line: ``python -m trailmark <command>``, or through spark-submit on a cluster."""

from __future__ import annotations

import argparse
import sys

import trailmark as tm
from trailmark.functions.tokens import DEDUPE_MODES, DEFAULT_DELIMITER
from trailmark.sources.convert import CODECS
from trailmark.sources.readers import DEFAULT_MAX_RECORD

ALL_ROWS = 2**31 - 2


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="trailmark", description=tm.__doc__)
    parser.add_argument("--master", help="Spark master; spark-submit's own is used if omitted")
    commands = parser.add_subparsers(dest="command", required=True)

    def command(name: str, help_text: str, *parents: argparse.ArgumentParser):
        return commands.add_parser(name, help=help_text, parents=parents)

    csv = argparse.ArgumentParser(add_help=False)
    csv.add_argument("--max-record", type=int, default=DEFAULT_MAX_RECORD, help="characters of a CSV field")
    csv.add_argument("--multi-line", action="store_true", help="CSV fields may hold line breaks")
    dataset = argparse.ArgumentParser(add_help=False, parents=[csv])
    dataset.add_argument("path", help="session table, CSV or Parquet")
    dataset.add_argument("-d", "--delimiter", default=DEFAULT_DELIMITER)
    dedupe = argparse.ArgumentParser(add_help=False)
    dedupe.add_argument("-u", "--dedupe", choices=DEDUPE_MODES, default="consecutive")
    steps = argparse.ArgumentParser(add_help=False)
    steps.add_argument("-f", "--funnel", help="steps separated by commas")
    steps.add_argument("--step", action="append", help="one step; repeat for more")

    sub = command("generate", "write synthetic sessions as CSV")
    sub.add_argument("output")
    sub.add_argument("-r", "--rows", type=int, default=50_000)
    sub.add_argument("--seed", type=int, default=42)

    sub = command("inspect", "columns, row count, size and first rows", csv)
    sub.add_argument("path")
    sub.add_argument("-l", "--limit", type=int, default=5)

    sub = command("convert", "convert a CSV export to Parquet", csv)
    sub.add_argument("csv")
    sub.add_argument("output")
    sub.add_argument("-c", "--compression", default="ZSTD", choices=CODECS)

    sub = command("analyze", "frequencies, transitions, paths, funnel", dataset, dedupe, steps)
    sub.add_argument("-t", "--top", type=int, default=15)

    sub = command("search", "sessions by event, subpath and depth", dataset)
    sub.add_argument("-e", "--event")
    sub.add_argument("-s", "--subpath")
    sub.add_argument("-m", "--min-events", type=int, default=1)
    sub.add_argument("-l", "--limit", type=int, default=20)
    sub.add_argument("--journeys", action="store_true", help="show run-length journeys")

    sub = command("query", "Spark SQL over the view data", dataset)
    sub.add_argument("--sql", required=True)
    sub.add_argument("--max-rows", type=int, default=10_000, help="a larger result is an error")

    command("insights", "KPIs, entry and exit events", dataset)

    sub = command("heatmap", "transition matrix and its bands", dataset, dedupe)
    sub.add_argument("-t", "--top", type=int, default=8)
    sub.add_argument("--links", action="store_true", help="show the strongest links instead")

    sub = command("funnel", "ordered, reach, preset or automatic funnel", dataset, dedupe, steps)
    sub.add_argument("--reach", action="store_true", help="any order")
    sub.add_argument("--preset", choices=("top", "checkout", "search"))
    sub.add_argument("-t", "--top", type=int, default=15)

    sub = command("run-all", "convert, then write every report table", dedupe, steps, csv)
    sub.add_argument("csv")
    sub.add_argument("-o", "--output", required=True, help="Parquet session table")
    sub.add_argument("-r", "--reports", required=True, help="folder for the report tables")
    sub.add_argument("-d", "--delimiter", help="detected if omitted")
    sub.add_argument("-t", "--top", type=int, default=15)
    sub.add_argument("-c", "--compression", default="ZSTD", choices=CODECS)
    sub.add_argument("--force", action="store_true")
    return parser


def _steps(args: argparse.Namespace) -> list[str] | None:
    if args.step:
        return args.step
    return args.funnel.split(",") if args.funnel else None


def _print_facts(record) -> None:
    for name, value in vars(record).items():
        print(f"{name}: {value}")


def _csv_options(args: argparse.Namespace) -> dict:
    return {"max_record": args.max_record, "multi_line": args.multi_line}


def _show(table) -> None:
    """All rows: every table but a query's is bounded by the ranking it comes from, and a query's by
    its row limit."""
    table.show(ALL_ROWS, False)


def run(spark, args: argparse.Namespace) -> None:
    if args.command == "generate":
        rows = tm.generate_sessions(spark, args.rows, args.seed)
        rows.write.mode("errorifexists").option("header", True).csv(args.output)
        return
    if args.command == "inspect":
        options = {} if tm.is_parquet(args.path) else _csv_options(args)
        found = tm.inspect_dataset(spark, args.path, limit=args.limit, **options)
        _print_facts(found)
        _show(found.sample)
        return
    if args.command == "convert":
        _print_facts(
            tm.convert_dataset(
                spark,
                args.csv,
                args.output,
                compression=args.compression,
                **_csv_options(args),
            )
        )
        return
    if args.command == "run-all":
        summary = tm.run_all(
            spark,
            args.csv,
            args.output,
            args.reports,
            delimiter=args.delimiter,
            top_n=args.top,
            steps=_steps(args),
            dedupe=args.dedupe,
            compression=args.compression,
            force=args.force,
            **_csv_options(args),
        )
        _print_facts(summary)
        return

    options = {} if tm.is_parquet(args.path) else _csv_options(args)
    sessions = tm.read_sessions(spark, args.path, **options)
    tables = {
        "analyze": _analyze,
        "search": _search,
        "query": _query,
        "insights": _insights,
        "heatmap": _heatmap,
        "funnel": _funnel,
    }[args.command](sessions, args)
    for name, table in tables.items():
        print(f"\n{name}")
        _show(table)


def _analyze(sessions, args):
    return tm.analyze_report(
        sessions,
        delimiter=args.delimiter,
        top_n=args.top,
        dedupe=args.dedupe,
        steps=_steps(args),
    ).tables


def _search(sessions, args):
    found = tm.search_sessions(
        sessions,
        event=args.event,
        subpath=args.subpath,
        min_events=args.min_events,
        limit=args.limit,
        delimiter=args.delimiter,
    )
    if args.journeys:
        found = tm.session_journeys(
            found, event=args.event, subpath=args.subpath, delimiter=args.delimiter
        )
    return {"sessions": found}


def _query(sessions, args):
    return {"result": tm.sql_on_data(sessions, args.sql, max_rows=args.max_rows)}


def _insights(sessions, args):
    return tm.insights_report(sessions, delimiter=args.delimiter).tables


def _heatmap(sessions, args):
    matrix = tm.transition_matrix(
        sessions, delimiter=args.delimiter, top_n=args.top, dedupe=args.dedupe
    )
    return {"links": tm.flow_links(matrix)} if args.links else {"cells": tm.heatmap_cells(matrix)}


def _funnel(sessions, args):
    options = {"delimiter": args.delimiter, "dedupe": args.dedupe}
    if args.preset:
        rows = tm.funnel_preset(sessions, args.preset, **options)
    elif _steps(args):
        rows = tm.funnel(sessions, _steps(args), sequential=not args.reach, **options)
    else:
        rows = tm.funnel_auto(sessions, top_n=args.top, **options)
    return {"funnel": tm.funnel_report(rows)}


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    spark = tm.build_session(master=args.master)
    try:
        run(spark, args)
    except (tm.SessionDataError, tm.RowLimitError, FileNotFoundError) as error:
        hint = getattr(error, "hint", None)
        print(f"{error}\n{hint}" if hint else error, file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
