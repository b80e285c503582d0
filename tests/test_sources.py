"""Reading, mapping, validating, converting and inspecting exports."""

from __future__ import annotations

import glob
import os
import tempfile
import time
from datetime import datetime

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import trailmark as tm
from conftest import SESSION_SCHEMA, rows
from trailmark.sources.columns import plain_name
from trailmark.sources.storage import scratch_path

HEADER = "SESSION,EVENT_PATH,TOTAL_EVENTS\n"


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_semantic_headers(spark, tmp_path):
    path = write(
        tmp_path / "v.csv",
        "VEHICLESESSION,STEP_COUNT_AFTER_REPEAT_CAP,SESSION_PATH_CAPPED_AT_TWO_REPEATS,VEHICLE_TYPE\n"
        "vehicle-1,3,Start->Drive->Stop,car\n",
    )
    sessions = tm.read_csv(spark, path)
    assert sessions.columns == ["SESSION", "TOTAL_EVENTS", "EVENT_PATH", "VEHICLE_TYPE"]
    assert rows(sessions, "SESSION", "EVENT_PATH", "TOTAL_EVENTS", "VEHICLE_TYPE") == [
        ("vehicle-1", "Start->Drive->Stop", 3, "car")
    ]
    found = tm.event_frequencies(sessions)
    assert {r.event_name for r in found.collect()} == {"Start", "Drive", "Stop"}


@pytest.mark.parametrize(
    "headers, expected",
    [
        (["session id", "Event-Path", "event count"], ["session id", "Event-Path", "event count"]),
        (["SESSION", "USER_SESSION", "path", "step_count"], ["SESSION", "path", "step_count"]),
        (["usersession", "click_path", "n_events_count"],
         ["usersession", "click_path", "n_events_count"]),
        (["SESSION", "EVENT_PATH", "EVENT_PATH_COUNT"],
         ["SESSION", "EVENT_PATH", "EVENT_PATH_COUNT"]),
    ],
)
def test_header_meanings(headers, expected):
    assert list(tm.map_columns(headers).values()) == expected


@pytest.mark.parametrize(
    "headers, text",
    [
        (["SESSION", "EVENT_PATH"], "reads as TOTAL_EVENTS"),
        (["VEHICLESESSION", "USER_SESSION", "STEP_COUNT", "SESSION_PATH"],
         "ambiguous columns for SESSION"),
        (["SESSION", "session", "EVENT_PATH", "TOTAL_EVENTS"], "ambiguous columns for SESSION"),
        (["SESSION", "EVENT_PATH_COUNT"], "ambiguous columns for EVENT_PATH"),
        (["SESSION", "a_path", "b_path", "TOTAL_EVENTS"], "ambiguous columns for EVENT_PATH"),
    ],
)
def test_refused_headers(headers, text):
    with pytest.raises(tm.SessionDataError, match=text) as error:
        tm.map_columns(headers)
    assert error.value.hint and error.value.hint not in str(error.value)


def test_plain_name():
    assert plain_name("Vehicle session-id") == "VEHICLESESSIONID"


def test_text_depth_is_refused(spark, tmp_path):
    path = write(tmp_path / "t.csv", HEADER + "s,A->B,two\n")
    with pytest.raises(tm.SessionDataError, match="TOTAL_EVENTS must be numeric"):
        tm.read_csv(spark, path)


def test_parquet_headers_are_mapped_and_checked(spark, tmp_path):
    path = str(tmp_path / "x.parquet")
    spark.createDataFrame([(7, "A", 2)], "`Session Id` int, SESSION_PATH string, steps int").write \
        .parquet(path)
    with pytest.raises(tm.SessionDataError, match="reads as TOTAL_EVENTS"):
        tm.read_sessions(spark, path)
    path = str(tmp_path / "y.PQ")
    spark.createDataFrame([(7, "A", 2)], "`Session Id` int, SESSION_PATH string, step_count int") \
        .write.parquet(path)
    sessions = tm.read_sessions(spark, path)
    assert sessions.dtypes == [("SESSION", "string"), ("EVENT_PATH", "string"),
                               ("TOTAL_EVENTS", "bigint")]


def test_csv_values(spark, tmp_path):
    path = write(
        tmp_path / "v.csv",
        "SESSION,EVENT_PATH,TOTAL_EVENTS,flag,score,day,seen,note\n"
        '001,"A, ""x""->B",2,true,1.5,2024-02-29,2024-02-29 10:11:12.5,\n'
        '002,,,false,2,2024-03-01,2024-03-01T00:00:00,"a,b"\n'
        '003,"",1,,,,,z\n',
    )
    sessions = tm.read_csv(spark, path)
    assert dict(sessions.dtypes) == {
        "SESSION": "string", "EVENT_PATH": "string", "TOTAL_EVENTS": "bigint",
        "flag": "boolean", "score": "double", "day": "date", "seen": "timestamp_ntz",
        "note": "string",
    }
    found = rows(sessions.orderBy("SESSION"), "SESSION", "EVENT_PATH", "TOTAL_EVENTS")
    assert found[0] == ("001", 'A, "x"->B', 2)
    assert found[1] == ("002", None, None)
    assert found[2] == ("003", None, 1)
    assert rows(sessions.orderBy("SESSION"), "seen")[0] == (datetime(2024, 2, 29, 10, 11, 12, 500000),)


def test_blank_csv_fields_are_null(spark, tmp_path):
    path = write(tmp_path / "b.csv", HEADER + 's1,,1\ns2,"",1\n')
    assert tm.read_csv(spark, path).where("EVENT_PATH IS NULL").count() == 2


def test_fractional_depth_stays_fractional(spark, tmp_path):
    path = write(tmp_path / "f.csv", HEADER + "a,A,1\nb,B,2.5\n")
    sessions = tm.read_csv(spark, path)
    assert dict(sessions.dtypes)["TOTAL_EVENTS"] == "double"
    assert tm.session_kpis(sessions).head().max_events == 2.5


def test_export_without_rows(spark, tmp_path):
    sessions = tm.read_csv(spark, write(tmp_path / "e.csv", HEADER))
    assert tm.session_kpis(sessions).head().total_sessions == 0


BAD_RECORDS = {
    "line break": 's1,"A->\nB",2\n',
    "short": "s1,A\n",
    "long": "s1,A,1,x,y\n",
}


@pytest.mark.parametrize("name", BAD_RECORDS)
@pytest.mark.parametrize(
    "analysis",
    [
        lambda s: s.count(),
        lambda s: tm.session_kpis(s).collect(),
        lambda s: tm.event_frequencies(s).collect(),
        lambda s: tm.exit_events(s).collect(),
        lambda s: tm.search_sessions(s, event="A").collect(),
    ],
    ids=["count", "kpis", "frequencies", "exits", "search"],
)
def test_no_analysis_passes_over_a_malformed_record(spark, tmp_path, name, analysis):
    path = write(tmp_path / "bad.csv", HEADER + "s0,A,1\n" + BAD_RECORDS[name] + "s2,C,1\n")
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        analysis(tm.read_csv(spark, path, types={"TOTAL_EVENTS": "bigint"}))


def test_no_analysis_passes_over_a_value_of_another_type(spark, tmp_path):
    path = write(tmp_path / "bad.csv", HEADER + "s0,A,1\ns1,B,many\n")
    with pytest.raises(tm.SessionDataError, match="TOTAL_EVENTS"):
        tm.read_csv(spark, path, types={"TOTAL_EVENTS": "bigint"})
    with pytest.raises(tm.SessionDataError, match="TOTAL_EVENTS"):
        tm.read_csv(spark, path)


def test_types_hold_every_value(spark, tmp_path):
    path = write(
        tmp_path / "t.csv",
        "SESSION,EVENT_PATH,TOTAL_EVENTS,id19,id25,zip,mixed,big_mixed,note\n"
        "a,A,007,9007199254740993123,1234567890123456789012345,01234,1,9007199254740993,5\n"
        "b,B,12,1,2,5,2.5,0.5,6\n"
        "c,C,,,,,,,n/a\n",
    )
    out = str(tmp_path / "t.parquet")
    tm.convert_dataset(spark, path, out)
    found = tm.read_parquet(spark, out).orderBy("SESSION")
    types = dict(found.dtypes)
    assert types["TOTAL_EVENTS"] == "bigint" and types["id19"] == "bigint"
    assert types["id25"] == "decimal(38,0)" and types["mixed"] == "double"
    assert types["zip"] == types["big_mixed"] == types["note"] == "string"
    first = found.head()
    assert first.TOTAL_EVENTS == 7 and int(first.id19) == 9007199254740993123
    assert int(first.id25) == 1234567890123456789012345
    assert first.zip == "01234" and first.big_mixed == "9007199254740993"


def test_a_late_value_of_another_kind_makes_a_column_text(spark, tmp_path):
    lines = "".join(f"s{i},A,1,{i}\n" for i in range(30_000)) + "s,A,1,n/a\n"
    path = write(tmp_path / "late.csv", "SESSION,EVENT_PATH,TOTAL_EVENTS,NOTE\n" + lines)
    sessions = tm.read_csv(spark, path)
    assert dict(sessions.dtypes)["NOTE"] == "string"
    assert tm.session_kpis(sessions).head().total_sessions == 30_001


def one_row(spark, name):
    return spark.createDataFrame([(name, name, 1)], SESSION_SCHEMA)


def table_names(spark, path):
    return [r.SESSION for r in tm.read_parquet(spark, path).collect()]


def test_a_publication_that_fails_keeps_the_table(spark, tmp_path, monkeypatch):
    from trailmark.sources import storage

    out = str(tmp_path / "out.parquet")
    storage.publish_parquet(one_row(spark, "a"), out, {})
    before = sorted(os.listdir(out))
    with monkeypatch.context() as broken:
        broken.setattr(storage, "_mark", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            storage.publish_parquet(one_row(spark, "b"), out, {})
    assert table_names(spark, out) == ["a"] and sorted(os.listdir(out)) == before
    storage.publish_parquet(one_row(spark, "b"), out, {})
    assert table_names(spark, out) == ["b"]


def test_readers_between_all_steps_of_a_publication(spark, tmp_path, monkeypatch):
    """Every reader finds the old version or the new one, and at the end the new one is there."""
    from trailmark.sources import storage

    out, csv = str(tmp_path / "out.parquet"), write(tmp_path / "in.csv", HEADER + "x,A,1\n")
    storage.publish_parquet(one_row(spark, "v0"), out, {})
    real, seen = storage._hadoop, []
    inside = []

    def reading(session, path):
        if not inside:  # a step of the publication: all readers come first
            inside.append(path)
            seen.append(table_names(spark, out)[0])
            tm.inspect_dataset(spark, out)
            tm.is_fresh(spark, csv, out)
            inside.clear()
        return real(session, path)

    for number in range(1, 5):
        with monkeypatch.context() as watched:
            watched.setattr(storage, "_hadoop", reading)
            storage.publish_parquet(one_row(spark, f"v{number}"), out, {})
        assert table_names(spark, out) == [f"v{number}"]
    assert seen == sorted(seen) and len(set(seen)) == 5 and len(seen) > 20
    assert len([n for n in os.listdir(out) if n.startswith("version-")]) == 2


def test_two_writers_lose_no_version(spark, tmp_path):
    """The second writer starts and ends while the first one writes."""
    from trailmark.sources import storage

    out = str(tmp_path / "out.parquet")
    storage.publish_parquet(one_row(spark, "old"), out, {})
    found = []

    def first(place):
        one_row(spark, "first").write.parquet(place)
        storage.publish_parquet(one_row(spark, "second"), out, {})
        found.extend(table_names(spark, out))

    storage.publish(spark, out, first)
    assert found == ["second"] and table_names(spark, out) == ["first"]
    kept = storage.publish(spark, out, lambda place: one_row(spark, "late").write.parquet(place), replace=False)
    assert kept == tm.current_path(spark, out) and table_names(spark, out) == ["first"]


def test_a_version_that_is_being_read_outlives_its_successor(spark, tmp_path):
    from trailmark.sources import storage

    out = str(tmp_path / "out.parquet")
    storage.publish_parquet(one_row(spark, "a"), out, {})
    reading = tm.read_parquet(spark, out)
    storage.publish_parquet(one_row(spark, "b"), out, {})
    assert [r.SESSION for r in reading.collect()] == ["a"]


def test_plain_files_give_way_to_a_version(spark, tmp_path):
    from trailmark.sources import storage

    out = str(tmp_path / "out.parquet")
    one_row(spark, "plain").write.parquet(out)
    assert tm.current_path(spark, out) == out and table_names(spark, out) == ["plain"]
    storage.publish_parquet(one_row(spark, "new"), out, {})
    assert table_names(spark, out) == ["new"] and not glob.glob(out + "/part-*")
    with pytest.raises(FileExistsError):
        storage.publish_parquet(one_row(spark, "new"), write(tmp_path / "file.parquet", "x"), {})


def test_line_breaks_in_fields_on_request(spark, tmp_path):
    path = write(tmp_path / "m.csv", HEADER + 's1,"A->\nB",2\ns2,C,1\n')
    assert tm.read_csv(spark, path, multi_line=True).count() == 2


def test_convert(spark, tmp_path):
    csv = write(tmp_path / "in.csv", HEADER + "one,A->B->A,3\ntwo,A->B,2\n")
    out = str(tmp_path / "out.parquet")
    done = tm.convert_dataset(spark, csv, out)
    assert done.row_count == 2
    assert done.parquet_size_mb >= 0 and done.rows_per_second > 0
    assert rows(tm.read_parquet(spark, out).orderBy("SESSION")) == [
        ("one", "A->B->A", 3), ("two", "A->B", 2),
    ]
    assert not [n for n in os.listdir(tmp_path) if "partial" in n]


@pytest.mark.parametrize("codec", ["ZSTD", "SNAPPY", "GZIP", "UNCOMPRESSED"])
def test_convert_codec_and_row_groups(spark, tmp_path, codec):
    csv = str(tmp_path / "in")
    tm.generate_sessions(spark, 5_000, partitions=1).write.option("header", True).csv(csv)
    out = str(tmp_path / "out.parquet")
    tm.convert_dataset(spark, csv, out, compression=codec, row_group_rows=1_000)
    sizes = []
    for name in glob.glob(tm.current_path(spark, out) + "/*.parquet"):
        meta = pq.ParquetFile(name).metadata
        sizes += [meta.row_group(i).num_rows for i in range(meta.num_row_groups)]
        assert meta.row_group(0).column(0).compression == codec
    assert sum(sizes) == 5_000 and max(sizes) <= 1_000


def test_convert_refuses_unknown_codec_and_missing_input(spark, tmp_path):
    with pytest.raises(ValueError, match="Unsupported compression"):
        tm.convert_dataset(spark, "x.csv", "y.parquet", compression="rar")
    with pytest.raises(FileNotFoundError):
        tm.convert_dataset(spark, str(tmp_path / "none.csv"), str(tmp_path / "y.parquet"))


def test_large_record(spark, tmp_path):
    csv = write(tmp_path / "large.csv", HEADER + "large," + "A" * 2_100_000 + ",1\n")
    out = str(tmp_path / "large.parquet")
    with pytest.raises(tm.SessionDataError, match="max_record=2000000"):
        tm.convert_dataset(spark, csv, out, max_record=2_000_000)
    assert not os.path.exists(out)
    assert tm.convert_dataset(spark, csv, out).row_count == 1
    assert rows(tm.read_parquet(spark, out).select(F.length("EVENT_PATH"))) == [(2_100_000,)]


@pytest.mark.parametrize("limit", [1_999_999, 268_435_457, True, "64MB"])
def test_record_limit_bounds(spark, tmp_path, limit):
    with pytest.raises(ValueError, match="max_record"):
        tm.read_csv(spark, "x.csv", max_record=limit)


def test_bad_record_fails_and_keeps_the_previous_output(spark, tmp_path):
    out = str(tmp_path / "out.parquet")
    good = write(tmp_path / "good.csv", HEADER + "one,A,1\n")
    tm.convert_dataset(spark, good, out)
    lines = "".join(f"s{i},A,{i}\n" for i in range(50)) + "bad,B,many\n"
    bad = write(tmp_path / "bad.csv", HEADER + lines)
    with pytest.raises(tm.SessionDataError, match="TOTAL_EVENTS is to be bigint and holds 'many'"):
        tm.convert_dataset(spark, bad, out, types={"TOTAL_EVENTS": "bigint"})
    bad = write(tmp_path / "short.csv", HEADER + "s1,A,1\nshort,B\n")
    with pytest.raises(tm.SessionDataError, match="(?s)CSV conversion failed.*short"):
        tm.convert_dataset(spark, bad, out)
    assert tm.read_parquet(spark, out).count() == 1
    assert not [n for n in os.listdir(tmp_path) if "partial" in n]


def test_convert_if_stale(spark, tmp_path):
    csv = write(tmp_path / "in.csv", HEADER + "one,A,1\n")
    out = str(tmp_path / "out.parquet")
    assert tm.convert_if_stale(spark, csv, out) is not None
    assert tm.convert_if_stale(spark, csv, out) is None
    assert tm.convert_if_stale(spark, csv, out, force=True) is not None
    later = time.time() + 60
    os.utime(csv, (later, later))
    assert not tm.is_fresh(spark, csv, out)


def test_inspect(spark, tmp_path, base):
    out = str(tmp_path / "b.parquet")
    base.write.parquet(out)
    found = tm.inspect_dataset(spark, out, limit=2)
    assert found.total_rows == 4
    assert found.columns[0] == ("SESSION", "string")
    assert found.sample.count() == 2
    csv = write(tmp_path / "c.csv", HEADER + "one,A,1\n")
    assert tm.inspect_dataset(spark, csv).total_rows == "Calculated during conversion"
    with pytest.raises(FileNotFoundError):
        tm.inspect_dataset(spark, str(tmp_path / "none.parquet"))


@pytest.mark.parametrize(
    "paths, expected",
    [
        (["A->B,C"], "->"), (["A,B>C"], ","), (["A>B|C"], ">"), (["A|B"], "|"), (["A"], "->"),
        ([None, "  ", "a|b"], "|"), ([], "->"), ([None], "->"),
    ],
)
def test_detect_delimiter(spark, paths, expected):
    table = spark.createDataFrame(
        [("s", p, 1) for p in paths], "SESSION string, EVENT_PATH string, TOTAL_EVENTS bigint"
    )
    assert tm.detect_delimiter(table) == expected


def test_run_all(spark, tmp_path):
    csv = write(
        tmp_path / "in.csv",
        HEADER + 'one,"A|B|A",3\ntwo,A|B,2\nthree,B,1\n',
    )
    out, reports = str(tmp_path / "out.parquet"), str(tmp_path / "reports")
    summary = tm.run_all(spark, csv, out, reports)
    assert summary.delimiter == "|" and summary.total_rows == 3
    assert summary.conversion.row_count == 3
    assert set(summary.outputs) == {"kpis", "entry_points", "exit_points", "paths", "matrix",
                                    "funnel"}
    funnel = spark.read.parquet(summary.outputs["funnel"]).orderBy("step_number")
    assert rows(funnel, "step_name", "session_count") == [("A", 2), ("B", 3)]
    again = tm.run_all(spark, csv, out, reports, steps=["A", "B"])
    assert again.conversion is None
    funnel = spark.read.parquet(again.outputs["funnel"]).orderBy("step_number")
    assert rows(funnel, "step_name", "session_count") == [("A", 2), ("B", 2)]


def test_the_delimiter_is_taken_from_all_paths_or_obeyed(spark, tmp_path):
    lines = "".join(f"s{i},A,1\n" for i in range(10)) + "".join(f"t{i},A|B,2\n" for i in range(50))
    csv = write(tmp_path / "in.csv", HEADER + lines)
    out, reports = str(tmp_path / "out.parquet"), str(tmp_path / "reports")
    assert tm.run_all(spark, csv, out, reports).delimiter == "|"
    given = tm.run_all(spark, csv, out, reports, delimiter="->")
    assert given.delimiter == "->"
    found = spark.read.parquet(given.outputs["entry_points"]).orderBy("event_name")
    assert rows(found, "event_name") == [("A",), ("A|B",)]


def test_reports_change_together_or_not_at_all(spark, tmp_path, monkeypatch):
    csv = write(tmp_path / "in.csv", HEADER + "one,A->B,2\n")
    out, reports = str(tmp_path / "out.parquet"), str(tmp_path / "reports")
    first = tm.run_all(spark, csv, out, reports)
    kept = tmp_path / "reports" / "notes.txt"
    kept.write_text("mine")
    from trailmark.plans import reports as module

    monkeypatch.setattr(module.Report, "write_into", lambda self, folder: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        tm.run_all(spark, csv, out, reports)
    for path in first.outputs.values():
        assert spark.read.parquet(path).count() > 0
    assert kept.read_text() == "mine"


def test_scratch_folder_comes_from_the_session(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    first, second = scratch_path(spark, "x"), scratch_path(spark, "x")
    assert first != second
    assert first.startswith(named or tempfile.gettempdir())
