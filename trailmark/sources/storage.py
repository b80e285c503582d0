"""File facts, scratch space and publishing, through Spark's own view of the file system."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_SETTING = "spark.checkpoint.dir"


@dataclass(frozen=True)
class FileFacts:
    files: int
    size_bytes: int
    newest: datetime | None

    @property
    def size_mb(self) -> float:
        return round(self.size_bytes / 1024**2, 2)


def _hadoop(spark: SparkSession, path: str):
    """(path, file system) of a location, for the few steps Spark's API has no call for."""
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    return location, location.getFileSystem(spark._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    location, files = _hadoop(spark, path)
    return bool(files.globStatus(location))


def file_facts(spark: SparkSession, path: str) -> FileFacts | None:
    """Number, size and latest change of the files under ``path``; None when there are none.

    Only the listing is read: the content column is never selected.
    """
    if not path_exists(spark, path):
        return None
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(path)
        .select("length", "modificationTime")
    )
    row = files.agg(
        F.count(F.lit(1)).alias("files"),
        F.coalesce(F.sum("length"), F.lit(0)).alias("size_bytes"),
        F.max("modificationTime").alias("newest"),
    ).head()
    return FileFacts(row["files"], row["size_bytes"], row["newest"]) if row["files"] else None


def scratch_base(spark: SparkSession) -> str:
    """The shared folder the cluster names for intermediate tables.

    Without that setting only a local session gets one, in the machine's temporary folder.
    """
    base = spark.conf.get(CHECKPOINT_SETTING, None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"Set {CHECKPOINT_SETTING} to a folder all executors can reach.")
        base = tempfile.gettempdir()
    return f"{base.rstrip('/')}/trailmark"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path for an intermediate table."""
    return f"{scratch_base(spark)}/{name}-{uuid.uuid4().hex}"


def stored_path(spark: SparkSession, name: str) -> str:
    """Where ``stored_once`` publishes the table ``name``."""
    return f"{scratch_base(spark)}/{spark.sparkContext.applicationId}/{name}.parquet"


def stored_once(spark: SparkSession, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table ``build`` gives, written once per application and read from there after.

    Cuts the lineage: what reads the table neither repeats the work nor depends on executors
    that did it.
    """
    path = stored_path(spark, name)
    if current_path(spark, path) == path:
        publish_parquet(build(), path, {"compression": "zstd"}, replace=False)
    return spark.read.parquet(current_path(spark, path))


def stored_table(table: DataFrame, name: str) -> DataFrame:
    """``table`` written once to the scratch folder and read from there."""
    path = scratch_path(table.sparkSession, name) + ".parquet"
    table.write.option("compression", "zstd").parquet(path)
    return table.sparkSession.read.schema(table.schema).parquet(path)


# Publishing ---------------------------------------------------------------------------------
#
# A published folder holds versions, each in a folder of its own that never moves, and one empty mark
# for each: its name has a rising number and the name of the version. The highest mark is current.
# Making a mark is one step of the file system, so that a reader finds the old version or the new one
# and changes nothing itself; of two writers with the same number one comes first, and no version is lost.

MARK, VERSION = "_current-", "version-"
#: Versions that stay: the current one, and the one before for those who still read it.
KEPT_VERSIONS = 2


def _marks(spark: SparkSession, path: str) -> list[str]:
    """The names of the marks of a published folder, oldest first."""
    if any(mark in path for mark in "*?[{"):
        return []
    pattern, files = _hadoop(spark, f"{path.rstrip('/')}/{MARK}*")
    return sorted(status.getPath().getName() for status in files.globStatus(pattern) or [])


def _version(path: str, mark: str) -> str:
    return f"{path.rstrip('/')}/{VERSION}{mark.rsplit('-', 1)[1]}"


def current_path(spark: SparkSession, path: str) -> str:
    """Where the data of a published folder are; ``path`` itself for anything else."""
    marks = _marks(spark, path)
    return _version(path, marks[-1]) if marks else path


def publish(
    spark: SparkSession, path: str, write: Callable[[str], None], *, replace: bool = True
) -> str:
    """Let ``write`` fill a new version of the folder ``path`` and make it current; its place.

    A failed write leaves what was there. With ``replace=False`` what another writer has published
    meanwhile stays current.
    """
    target, files = _hadoop(spark, path)
    if files.exists(target) and files.getFileStatus(target).isFile():
        raise FileExistsError(f"A file is in the way of a published folder: {path}")
    name = uuid.uuid4().hex
    place = f"{path.rstrip('/')}/{VERSION}{name}"
    try:
        write(place)
        marks = _marks(spark, path)
        if marks and not replace:
            files.delete(_hadoop(spark, place)[0], True)
            return _version(path, marks[-1])
        number = int(marks[-1].split("-")[1]) + 1 if marks else 1
        _mark(spark, path, f"{MARK}{number:012d}-{name}")
    except BaseException:
        files.delete(_hadoop(spark, place)[0], True)
        if files.exists(target) and not files.listStatus(target):
            files.delete(target, False)
        raise
    for old in _marks(spark, path)[:-KEPT_VERSIONS]:
        files.delete(_hadoop(spark, f"{path.rstrip('/')}/{old}")[0], False)
        files.delete(_hadoop(spark, _version(path, old))[0], True)
    return place


def _mark(spark: SparkSession, path: str, name: str) -> None:
    mark, files = _hadoop(spark, f"{path.rstrip('/')}/{name}")
    files.create(mark, False).close()


def publish_parquet(
    table: DataFrame, path: str, options: dict[str, str | int], *, replace: bool = True
) -> None:
    """Write ``table`` as Parquet to ``path``, which changes only when all of it is written.

    Plain Parquet files that were at ``path`` before are no longer read, and are removed.
    """
    spark = table.sparkSession
    publish(
        spark, path, lambda place: table.write.options(**options).parquet(place), replace=replace
    )
    pattern, files = _hadoop(spark, f"{path.rstrip('/')}/part-*")
    for status in files.globStatus(pattern) or []:
        files.delete(status.getPath(), False)
