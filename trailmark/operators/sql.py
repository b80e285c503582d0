"""Free SQL over a session table, which the query sees as the view ``data``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NullType

from trailmark.errors import RowLimitError
from trailmark.sources.storage import stored_table

VIEW_NAME = "data"


def _only_reads(sessions: DataFrame, query: str) -> bool:
    """Whether ``query`` parses to a plan without a command or an insertion anywhere."""
    plan = sessions.sparkSession._jsparkSession.sessionState().sqlParser().parsePlan(query)
    command = plan.getClass().getClassLoader().loadClass(
        "org.apache.spark.sql.catalyst.plans.logical.Command"
    )
    left = [plan]
    while left:
        node = left.pop()
        if command.isInstance(node) or node.getClass().getSimpleName() == "InsertIntoStatement":
            return False
        children = node.children()
        left += [children.apply(i) for i in range(children.size())]
    return True


def sql_on_data(sessions: DataFrame, query: str, *, max_rows: int | None = None) -> DataFrame:
    """The result of ``query`` in Spark SQL, with ``sessions`` registered as ``data``.

    Queries only. With ``max_rows`` the query is run here, once: at most ``max_rows + 1`` rows of its
    result are written to the scratch folder, a larger result raises ``RowLimitError``, and what is
    returned reads the written rows. No row comes to the driver. A view ``data`` of the caller's is
    put back.
    """
    if not query or not query.strip():
        raise ValueError("The SQL query is empty.")
    if max_rows is not None and max_rows < 0:
        raise ValueError("max_rows cannot be negative.")
    spark = sessions.sparkSession
    if not _only_reads(sessions, query):
        raise ValueError("Only queries are accepted, no statements that change or set anything.")
    own = None
    if VIEW_NAME in [t.name for t in spark.catalog.listTables() if t.isTemporary]:
        own = spark.table(VIEW_NAME)
    sessions.createOrReplaceTempView(VIEW_NAME)
    try:
        result = spark.sql(query)
    finally:
        if own is None:
            spark.catalog.dropTempView(VIEW_NAME)
        else:
            own.createOrReplaceTempView(VIEW_NAME)
    if max_rows is None:
        return result
    held = _stored(result.limit(max_rows + 1))
    if held.count() > max_rows:
        raise RowLimitError(f"The result is larger than the {max_rows:,}-row limit")
    return held


def _stored(result: DataFrame) -> DataFrame:
    """``result`` written once, whatever its columns are called; those that are NULL by type stay so."""
    empty = [isinstance(field.dataType, NullType) for field in result.schema]
    numbered = result.toDF(*[f"c{i}" for i in range(len(empty))])
    written = numbered.select(
        *[F.col(name).cast("string" if void else numbered.schema[name].dataType).alias(name)
          for name, void in zip(numbered.columns, empty)]
    )
    held = stored_table(written, "result")
    shown = [F.lit(None) if void else F.col(name) for name, void in zip(held.columns, empty)]
    return held.select(*[c.alias(f"c{i}") for i, c in enumerate(shown)]).toDF(*result.columns)
