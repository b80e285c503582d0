"""Every command once, on a small export."""

from __future__ import annotations

import pytest

from trailmark.__main__ import main


@pytest.fixture(scope="module")
def export(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("cli")
    assert main(["generate", str(folder / "in.csv"), "--rows", "500"]) == 0
    assert main(["convert", str(folder / "in.csv"), str(folder / "out.parquet")]) == 0
    return folder


@pytest.mark.parametrize(
    "arguments, shown",
    [
        (["inspect", "{pq}"], "total_rows: 500"),
        (["analyze", "{pq}", "--funnel", "Home,Product_View"], "Product_View"),
        (["search", "{csv}", "-e", "Checkout", "-m", "3"], "Checkout"),
        (["search", "{pq}", "-e", "Checkout", "--journeys"], "match_positions"),
        (["query", "{pq}", "--sql", "SELECT count(*) AS n FROM data"], "500"),
        (["insights", "{pq}"], "bounce_rate_pct"),
        (["heatmap", "{pq}", "-t", "3"], "peak"),
        (["heatmap", "{pq}", "--links"], "value"),
        (["funnel", "{pq}", "--step", "Home", "--step", "Search"], "severity"),
        (["funnel", "{pq}", "--preset", "checkout"], "Order_Confirmation"),
        (["funnel", "{pq}", "--top", "3"], "overall_conversion_pct"),
        (["run-all", "{csv}", "-o", "{dir}/all.parquet", "-r", "{dir}/reports"], "entry_points"),
    ],
)
def test_command(export, capsys, arguments, shown):
    places = {"pq": export / "out.parquet", "csv": export / "in.csv", "dir": export}
    assert main([a.format(**places) for a in arguments]) == 0
    assert shown in capsys.readouterr().out


def test_errors_give_a_message_and_a_status(export, capsys):
    assert main(["query", str(export / "out.parquet"), "--sql", "SELECT * FROM data",
                 "--max-rows", "3"]) == 2
    assert "row limit" in capsys.readouterr().err
    assert main(["inspect", str(export / "none.parquet")]) == 2


def test_nothing_printed_is_cut(export, capsys):
    steps = [f"--step={name}" for name in ["Home", "Search"] * 10]
    assert main(["funnel", str(export / "out.parquet"), *steps]) == 0
    assert "|20         |" in capsys.readouterr().out
    assert main(["analyze", str(export / "out.parquet"), "-t", "2", "-f", "Home,Search,Cart"]) == 0
    shown = capsys.readouterr().out
    assert "|3          |Cart" in shown
    paths = shown.split("\npaths\n")[1].split("\nfunnel\n")[0]
    assert paths.count("|") // 5 >= 11 - 1
    query = "SELECT * FROM data"
    assert main(["query", str(export / "out.parquet"), "--sql", query, "--max-rows", "500"]) == 0
    assert capsys.readouterr().out.count("\n|") == 501


def test_csv_options_hold_for_every_command(export, tmp_path, capsys):
    path = tmp_path / "broken.csv"
    path.write_text('SESSION,EVENT_PATH,TOTAL_EVENTS,NOTE\ns1,A->B,2,"two\nlines"\n')
    assert main(["inspect", str(path), "--multi-line"]) == 0
    assert main(["insights", str(path), "--multi-line", "--max-record", "3000000"]) == 0
    assert main(["run-all", str(path), "--multi-line", "-o", str(tmp_path / "o.parquet"),
                 "-r", str(tmp_path / "r")]) == 0
    assert "entry_points" in capsys.readouterr().out
