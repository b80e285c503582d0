from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from trailmark.session import build_session  # noqa: E402

SESSION_SCHEMA = "SESSION string, EVENT_PATH string, TOTAL_EVENTS bigint"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[8]",
        {
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make(spark):
    """Session table from (EVENT_PATH, TOTAL_EVENTS) pairs or full rows."""

    def build(*rows):
        full = [r if len(r) == 3 else (f"s{i}", *r) for i, r in enumerate(rows)]
        return spark.createDataFrame(full, SESSION_SCHEMA)

    return build


@pytest.fixture(scope="session")
def base(make):
    return make(("one", "A->B->A", 3), ("two", "A->B->C", 3), ("three", "A->A->B", 3),
                ("four", "B->A", 2))


@pytest.fixture(scope="session")
def edge(make):
    return make(
        ("e1", None, 1), ("e2", "", 1), ("e3", "A", 1), ("e4", "A->->A", 2), ("e5", "A->B->", 2),
        ("e6", " A -> B ", 2), ("e7", "A->B", 0), ("e8", "A->B", None), ("e9", "A->A->B", 3),
        ("e10", "A->B", 2),
    )


def rows(frame, *columns):
    return [tuple(r) for r in (frame.select(*columns) if columns else frame).collect()]


def mapping(frame, key, value):
    return {r[key]: r[value] for r in frame.collect()}
