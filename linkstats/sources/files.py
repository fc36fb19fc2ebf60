"""Result files: ``<root>/<sched_id>/**/<name>-<yyyyMMdd>-<HHmmss>.txt``."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkstats.functions.times import name_timestamp

PING_NAME = "(?:t-)?tcp-ping"
DOWNLOAD_NAME = "(?:t-)?dwnl-test"
METADATA_NAME = "metadata"
POLICY_LOG_NAME = "policyd"
PING_GLOB = "*tcp-ping-[0-9]*-[0-9]*.txt*"
DOWNLOAD_GLOB = "*dwnl-test-[0-9]*-[0-9]*.txt*"


def _name_pattern(name: str) -> str:
    # Fixed value: day and clock digits after the tool name. The rest of the
    # name is open, so rotated copies of a file are accepted as well.
    return rf"/(\d+)/(?:.*/)?{name}-(\d+)-(\d+).txt[^/]*$"


def _run_identity(name: str, path: str, on_bad_time: str = "fail") -> dict[str, Column]:
    def group(number: int):
        return F.regexp_extract(F.col(path), _name_pattern(name), number)

    day, clock = group(2), group(3)
    when = name_timestamp(day, clock)
    if on_bad_time == "fail":
        problem = F.concat(F.lit("no valid time in file name: "), F.col(path))
        when = F.coalesce(when, F.raise_error(problem).cast("timestamp"))
    return {"sched_id": group(1).cast("int"), "run_dtm": when}


def with_run_identity(files: DataFrame, name: str, path: str = "path",
                      on_bad_time: str = "fail") -> DataFrame:
    """Keep files of one tool; add ``sched_id`` and ``run_dtm`` from their path.

    ``name`` is a regular expression matched from the start of the file name.
    ``on_bad_time='null'`` keeps files whose digits are no valid time.
    """
    is_run = F.col(path).rlike(_name_pattern(name))
    columns = _run_identity(name, path, on_bad_time)
    if on_bad_time == "fail":
        # Only for files of this tool, in whatever order Spark tests the conditions.
        columns["run_dtm"] = F.when(is_run, columns["run_dtm"])
    return files.where(is_run).withColumns(columns)


def discover_result_files(spark: SparkSession, root: str, name: str) -> DataFrame:
    """All files of one tool below ``root``; contents are not read."""
    listing = (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
               .select("path"))
    return with_run_identity(listing, name)


def folders_of(spark: SparkSession, root: str, schedules: DataFrame) -> list[str]:
    """Folders of the listed schedules that exist, so that no other is opened."""
    ids = sorted(r[0] for r in schedules.select("sched_id").distinct().collect())
    if not ids:
        raise ValueError("the configs list no schedule")
    fs = spark._jvm.org.apache.hadoop.fs
    pattern = fs.Path(f"{root.rstrip('/')}/*")
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern)
    # One call for all paths; a call for each takes longer than the listing.
    paths = spark._jvm.scala.runtime.ScalaRunTime.genericWrapArray(fs.FileUtil.stat2Paths(found)) if found else None
    by_name: dict[str, list[str]] = {}
    for path in paths.mkString("\0").split("\0") if paths else []:
        by_name.setdefault(path.rsplit("/", 1)[-1], []).append(path)
    return [path for i in ids for path in by_name.get(str(i), [])]


#: Tasks that list the folders of one read. Spark alone takes one for each folder, up to 10,000.
LISTING_TASKS = 200
LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


@contextmanager
def shared_listing(spark: SparkSession) -> Iterator[None]:
    """Readers made in here list many folders in each task."""
    before = spark.conf.get(LISTING)
    spark.conf.set(LISTING, str(min(int(before), LISTING_TASKS)))
    try:
        yield
    finally:
        spark.conf.set(LISTING, before)


#: Files that one task reads at most. Spark alone counts 4 MB for opening a file, which gives a task for a few.
FILES_PER_TASK = 1000
OPEN_COST = "spark.sql.files.openCostInBytes"


@contextmanager
def small_files(spark: SparkSession) -> Iterator[None]:
    """What runs in here reads many small files in each task."""
    before, most = spark.conf.get(OPEN_COST), spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    spark.conf.set(OPEN_COST, str(max(1, most // FILES_PER_TASK)))
    try:
        yield
    finally:
        spark.conf.set(OPEN_COST, before)


@dataclass(frozen=True)
class StoredLines:
    """Lines of result files of several tools, read and kept by ``store_result_lines``."""

    path: str


Root = str | list[str] | StoredLines

#: Folders whose files are listed at a time. The driver holds that listing.
FOLDERS_AT_ONCE = 5_000


def _text_lines(spark: SparkSession, root: str | list[str], glob: str) -> DataFrame:
    with shared_listing(spark):
        return (spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob)
                .text(root).select("value", F.col("_metadata.file_path").alias("path")))


def store_result_lines(spark: SparkSession, folders: list[str], target: str, tools: dict[str, str]) -> StoredLines:
    """Read every file of ``tools`` (glob by name) once, and keep the lines in ``target`` by tool.

    Folders are listed and read some at a time, so the driver does not hold the names of all files.
    """
    tool = F.coalesce(*[F.when(F.col("path").rlike(_name_pattern(name)), F.lit(name)) for name in tools])
    glob = f"{{{','.join(tools.values())}}}"
    for first in range(0, max(1, len(folders)), FOLDERS_AT_ONCE):
        lines = _text_lines(spark, folders[first:first + FOLDERS_AT_ONCE], glob)
        lines.withColumn("tool", tool).write.partitionBy("tool").parquet(f"{target}/first={first}")
    return StoredLines(target)


def read_result_lines(spark: SparkSession, root: Root, name: str, glob: str) -> DataFrame:
    """Text lines of one tool's files with ``path``, ``sched_id`` and ``run_dtm``.

    ``glob`` names the files for the listing, so other tools' files are not opened. A list of
    roots may be empty. Stored lines are taken by ``name``.
    """
    if isinstance(root, StoredLines):
        stored = spark.read.schema("value string, path string, first bigint, tool string").parquet(root.path)
        lines = stored.where(F.col("tool") == name).select("value", "path")
        return lines.withColumns(_run_identity(name, "path"))
    return with_run_identity(_text_lines(spark, root, glob), name)
