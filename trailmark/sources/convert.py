"""Conversion of CSV exports to Parquet session tables, and inspection of either."""

from __future__ import annotations

import re
import time
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from trailmark.errors import SessionDataError
from trailmark.sources.readers import DEFAULT_MAX_RECORD, is_parquet, read_csv
from trailmark.sources.storage import current_path, file_facts, publish_parquet

# Compression codecs offered, rows per row group, text shown for uncounted rows.
CODECS = ("ZSTD", "SNAPPY", "GZIP", "UNCOMPRESSED")
ROW_GROUP_ROWS = 122_880
ROWS_NOT_COUNTED = "Calculated during conversion"


@dataclass(frozen=True)
class Conversion:
    csv_path: str
    parquet_path: str
    csv_size_mb: float
    parquet_size_mb: float
    compression_ratio_percent: float
    row_count: int
    elapsed_seconds: float
    rows_per_second: int


@dataclass(frozen=True)
class Inspection:
    """What ``inspect_dataset`` found; ``sample`` is lazy."""

    file_path: str
    total_rows: int | str
    file_size_mb: float
    columns: list[tuple[str, str]]
    sample: DataFrame


def convert_dataset(
    spark: SparkSession,
    csv_path: str,
    parquet_path: str,
    *,
    compression: str = "ZSTD",
    row_group_rows: int = ROW_GROUP_ROWS,
    **csv_options,
) -> Conversion:
    """Write a CSV export as a validated Parquet session table.

    One pass reads, counts and writes. Output appears at ``parquet_path`` only when all of it
    is written; a bad record fails the conversion and publishes nothing. The Parquet files are in a
    folder of their own for each version; ``read_parquet`` and ``current_path`` find the current one.
    """
    codec = compression.upper()
    if codec not in CODECS:
        raise ValueError(f"Unsupported compression: {compression}. Use {', '.join(CODECS)}.")
    source = file_facts(spark, csv_path)
    if source is None:
        raise FileNotFoundError(f"CSV file not found: {csv_path}")
    started = time.perf_counter()
    rows = Observation()
    try:
        sessions = read_csv(spark, csv_path, **csv_options).observe(
            rows, F.count(F.lit(1)).alias("rows")
        )
        publish_parquet(
            sessions,
            parquet_path,
            {"compression": codec.lower(), "parquet.block.row.count.limit": row_group_rows},
        )
    except (PySparkException, Py4JJavaError) as error:
        raise _conversion_error(error, csv_options.get("max_record", DEFAULT_MAX_RECORD)) from error
    elapsed = time.perf_counter() - started
    count = rows.get["rows"]
    written = file_facts(spark, current_path(spark, parquet_path))
    size = written.size_bytes if written else 0
    saved = (1 - size / source.size_bytes) * 100 if source.size_bytes else 0.0
    return Conversion(
        csv_path,
        parquet_path,
        source.size_mb,
        written.size_mb if written else 0.0,
        round(saved, 2),
        count,
        round(elapsed, 2),
        int(count / elapsed) if elapsed > 0 else 0,
    )


def _first_condition(error: Exception) -> str:
    """What Spark said first: the innermost message of the chain of causes that names a condition
    or a record, with the file it was in."""
    found, file = [], ""
    cause = getattr(error, "java_exception", None) or getattr(error, "_origin", None)
    for _ in range(20):
        if cause is None:
            break
        message = str(cause.getMessage() or "")
        place = re.search(r"(?:file|while reading)[: ]+((?:[a-z0-9]+:/)?/\S+?)[.,]?(?:\s|$)", message)
        file = file or (place.group(1) if place else "")
        found.append(message.strip().split("\n")[0])
        cause = cause.getCause()
    named = [message for message in found if re.search(r"\[[A-Z_.]+\]|record|Malformed", message)]
    text = (named or [m for m in found if m] or [str(error).strip().split("\n")[0]])[-1]
    return f"{text} (in {file})" if file and file not in text else text


def _conversion_error(error: Exception, max_record: int) -> SessionDataError:
    said = f"{error} {_first_condition(error)}"
    if "maxCharsPerColumn" in said or "Length of parsed input" in said:
        return SessionDataError(
            f"CSV conversion failed: a field is longer than max_record={max_record} characters",
            hint="A quote that never closes makes such fields too; else raise max_record.",
        )
    return SessionDataError(
        f"CSV conversion failed: {_first_condition(error)}",
        hint="multi_line=True reads fields that hold line breaks; types={header: type} sets a type.",
    )


def is_fresh(spark: SparkSession, source_path: str, output_path: str) -> bool:
    """Whether the output exists and is at least as new as its source."""
    output = file_facts(spark, current_path(spark, output_path))
    if output is None:
        return False
    source = file_facts(spark, source_path)
    return source is not None and output.newest >= source.newest


def convert_if_stale(
    spark: SparkSession, csv_path: str, parquet_path: str, *, force: bool = False, **options
) -> Conversion | None:
    """Convert unless an up-to-date output exists; None when it was reused."""
    if not force and is_fresh(spark, csv_path, parquet_path):
        return None
    return convert_dataset(spark, csv_path, parquet_path, **options)


def inspect_dataset(
    spark: SparkSession, path: str, *, limit: int = 5, **csv_options
) -> Inspection:
    """Columns, row count, size and first rows of an export.

    Rows are counted from Parquet footers; a CSV, read with ``csv_options``, is not counted.
    """
    place = current_path(spark, path)
    facts = file_facts(spark, place)
    if facts is None:
        raise FileNotFoundError(f"File not found: {path}")
    if is_parquet(path):
        table = spark.read.parquet(place)
        total: int | str = table.count()
    else:
        table = read_csv(spark, path, **csv_options)
        total = ROWS_NOT_COUNTED
    return Inspection(path, total, facts.size_mb, table.dtypes, table.limit(limit))
