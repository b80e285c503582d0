"""CSV and Parquet scans of session exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.errors import SessionDataError
from trailmark.sources.columns import as_sessions, map_columns
from trailmark.sources.storage import current_path

# Limits of one CSV record, and the file endings read as Parquet.
DEFAULT_MAX_RECORD = 32 * 1024 * 1024
MIN_MAX_RECORD = 2_000_000
MAX_MAX_RECORD = 256 * 1024 * 1024
PARQUET_ENDINGS = (".parquet", ".pq")

_WHOLE = r"^[+-]?(0|[1-9][0-9]*)$"
_LONG_WHOLE = r"^[+-]?(0|[1-9][0-9]{0,37})$"
_POINT = r"^[+-]?((0|[1-9][0-9]*)\.[0-9]*|\.[0-9]+)([eE][+-]?[0-9]{1,3})?$|^[+-]?[1-9][0-9]*[eE][+-]?[0-9]{1,3}$"
#: Whole numbers below this are the same as doubles.
_DOUBLE_WHOLE = 2**53
#: The only types a depth may have.
_NUMBERS = ("bigint", "decimal(38,0)", "double")


def is_parquet(path: str) -> bool:
    return path.rstrip("/").lower().endswith(PARQUET_ENDINGS)


def check_max_record(max_record: int) -> int:
    if isinstance(max_record, bool) or not isinstance(max_record, int):
        raise ValueError("max_record must be an integer number of characters.")
    if not MIN_MAX_RECORD <= max_record <= MAX_MAX_RECORD:
        raise ValueError(f"max_record must be between {MIN_MAX_RECORD} and {MAX_MAX_RECORD}.")
    return max_record


def _quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _kinds(value: Column) -> dict[str, Column]:
    """For each type of a CSV column, most specific first, whether ``value`` is one without loss.

    A whole number is a bigint, or a decimal(38,0) when it has more digits; it is a double only
    beside numbers with a point, and only if it is small enough to stay the same. Text with
    leading zeros is no number.
    """
    whole = value.rlike(_WHOLE)
    bigint = value.try_cast("bigint")
    return {
        "bigint": whole & bigint.isNotNull(),
        "decimal(38,0)": value.rlike(_LONG_WHOLE),
        "double": value.rlike(_POINT) | (whole & (F.abs(value.try_cast("double")) < _DOUBLE_WHOLE)),
        "boolean": value.rlike(r"^(?i:true|false)$"),
        "date": value.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & value.try_cast("date").isNotNull(),
        "timestamp_ntz": value.rlike(
            r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[ T][0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]{1,6})?$"
        )
        & value.try_cast("timestamp_ntz").isNotNull(),
    }


def _types(
    rows: DataFrame, columns: list[str], depth: str, given: dict[str, str]
) -> dict[str, str | None]:
    """Type of each text column that holds all its values, None where it holds none.

    One aggregate over all rows: a value becomes a number with one bit per type it fits, and the
    bits that all values of a column share remain. ``given`` types are checked in the same pass: a
    value that does not fit one raises, as later reads look at the columns they need only.
    """
    checked = {name: kind for name, kind in given.items() if kind != "string"}
    if not columns and not checked:
        return {}

    names = list(_kinds(F.lit("")))

    def fitting(name: str) -> Column:
        value = _quoted(name)
        if name == depth:  # a number, however it is written
            value = F.regexp_replace(value, r"^([+-]?)0+(?=[0-9])", "$1")
        bits = F.lit(0)
        for bit, (kind, fits) in enumerate(_kinds(value).items()):
            if name != depth or kind in _NUMBERS:
                bits = bits + F.when(fits, 1 << bit).otherwise(0)
        # Most values are small whole numbers, which fit every number type: one look decides.
        usual = r"^[+-]?[0-9]{1,15}$" if name == depth else r"^[+-]?(0|[1-9][0-9]{0,14})$"
        numbers = sum(1 << bit for bit, kind in enumerate(names) if kind in _NUMBERS)
        bits = F.when(_quoted(name).rlike(usual), numbers).otherwise(bits)
        return F.bit_and(F.when(value.isNotNull(), bits))

    def misfit(name: str, kind: str) -> Column:
        value = _quoted(name)
        return F.min(F.when(value.try_cast(kind).isNull(), value))

    found = rows.agg(
        *[fitting(name).alias(f"c{i}") for i, name in enumerate(columns)],
        *[misfit(name, kind).alias(f"m{i}") for i, (name, kind) in enumerate(checked.items())],
    ).head()
    for (name, kind), value in zip(checked.items(), found[len(columns) :]):
        if value is not None:
            raise SessionDataError(
                f"Column {name} is to be {kind} and holds {value!r}",
                hint="Give another type, or none to have it taken from the values.",
            )
    types: dict[str, str | None] = {}
    for name, bits in zip(columns, found):
        fits = [] if bits is None else [kind for bit, kind in enumerate(names) if bits & (1 << bit)]
        types[name] = None if bits is None else (fits or ["string"])[0]
    return types


def read_csv(
    spark: SparkSession,
    path: str | list[str],
    *,
    multi_line: bool = False,
    max_record: int = DEFAULT_MAX_RECORD,
    types: dict[str, str] | None = None,
) -> DataFrame:
    """Session rows of a CSV export with a header line, mapped and validated.

    Types of the depth and of extra columns are taken from all their values, in a pass of its own;
    ``types`` gives them by header instead, and that pass checks them. Every record is parsed in
    full whatever columns an analysis reads, and one with too few or too many fields fails the job
    instead of being dropped or counted. Files are split across tasks unless ``multi_line`` says that quoted fields may hold
    line breaks. ``max_record`` bounds the characters of a field.
    """
    reader = (
        spark.read.option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("mode", "FAILFAST")
        .option("columnPruning", False)
        .option("multiLine", multi_line)
        .option("maxCharsPerColumn", check_max_record(max_record))
    )
    as_text = reader.csv(path)
    headers = as_text.columns
    mapping = map_columns(headers)
    depth = mapping["TOTAL_EVENTS"]
    fixed = {mapping["SESSION"]: "string", mapping["EVENT_PATH"]: "string", **(types or {})}
    open_columns = [h for h in headers if h not in fixed]
    kinds = {**_types(as_text, open_columns, depth, types or {}), **fixed}
    # Without any value seen, a depth is taken for a whole number and anything else for text.
    blank = {h: "bigint" if h == depth else "string" for h in headers}
    schema = ", ".join(f"`{h.replace('`', '``')}` {kinds[h] or blank[h]}" for h in headers)
    return as_sessions(reader.schema(schema).option("enforceSchema", False).csv(path))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Session rows of a Parquet file or directory, or of the current version of a published one,
    mapped and validated."""
    return as_sessions(spark.read.parquet(current_path(spark, path)))


def read_sessions(
    spark: SparkSession, path: str, *, file_format: str | None = None, **csv_options
) -> DataFrame:
    """A session table from CSV or Parquet, told apart by the ending unless given."""
    kind = file_format or ("parquet" if is_parquet(path) else "csv")
    if kind == "parquet":
        return read_parquet(spark, path)
    if kind == "csv":
        return read_csv(spark, path, **csv_options)
    raise SessionDataError(f"Unsupported format: {kind}", hint="Use csv or parquet.")
