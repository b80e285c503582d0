"""Arrow batches through Python on the executors, and tables that cut the lineage."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from trailmark.sources.storage import scratch_path

PACKAGE_HOME = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def map_batches(frame: DataFrame, function: Callable, schema: str) -> DataFrame:
    """``frame`` through ``function`` (Arrow batches in, Arrow batches out), one call per partition.

    Workers import this package from where the driver did, unless it is installed for them.
    """
    environment = frame.sparkSession.sparkContext.environment
    known = environment.get("PYTHONPATH", "")
    if PACKAGE_HOME not in known.split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, [PACKAGE_HOME, known]))
    return frame.mapInArrow(function, schema)


def slices(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Small parts of the batches, so that the Python objects of one part stay few."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def stored(frame: DataFrame, name: str) -> DataFrame:
    """``frame`` written once to the shared scratch folder and read from there.

    What reads the table neither repeats the work nor depends on the executors that did it.
    """
    path = scratch_path(frame.sparkSession, name)
    frame.write.option("compression", "zstd").parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)
