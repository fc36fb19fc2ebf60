"""Session helpers shared by jobs, checks and tests."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_LOCAL_FALLBACK: dict[str, str] = {}


def use_utc(spark: SparkSession) -> SparkSession:
    """File names and epochs are UTC, so sessions must render times as UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def remove_scratch(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder, whatever file system it is on."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A new folder below the cluster's shared checkpoint folder.

    ``spark.checkpoint.dir`` decides where. Without it, a local session takes a
    temporary folder; on a cluster, where machines do not share one, this fails.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all machines share (master is {master})")
        app = spark.sparkContext.applicationId
        if app not in _LOCAL_FALLBACK:
            _LOCAL_FALLBACK[app] = tempfile.mkdtemp(prefix="linkstats-")
        base = _LOCAL_FALLBACK[app]
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
