"""Spark settings the operators are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}
INITIAL_PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
PARTITIONS_PER_CORE = 16


def build_session(
    app_name: str = "trailmark", master: str | None = None, settings: dict[str, str] | None = None
) -> SparkSession:
    """A session with ``settings``, and defaults for what neither they nor the cluster set.

    On a cluster shuffles start with many small partitions, in proportion to its cores;
    adaptive execution merges those that turn out small, so that only large shuffles keep them.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in (settings or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    context = spark.sparkContext
    given = context.getConf()
    defaults = dict(DEFAULTS)
    if not context.master.startswith("local") and not given.contains("spark.sql.shuffle.partitions"):
        defaults[INITIAL_PARTITIONS] = str(context.defaultParallelism * PARTITIONS_PER_CORE)
    for key, value in defaults.items():
        if not given.contains(key):
            spark.conf.set(key, value)
    return spark
