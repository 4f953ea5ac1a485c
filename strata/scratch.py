"""Folders for intermediate tables that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import SparkSession

_own: list[str] = []


def root(spark: SparkSession) -> str:
    """The shared folder: ``spark.checkpoint.dir`` names it. Where that is unset, a local session gets a temporary
    folder, and a cluster its warehouse, unless that is a folder of one machine."""
    held = spark.conf.get("spark.checkpoint.dir", None)
    if held:
        return held.rstrip("/")
    if spark.sparkContext.master.split("[")[0] == "local":
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="strata-"))
        return "file://" + _own[0]
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if "://" not in warehouse or warehouse.startswith("file:"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{warehouse}/_strata_scratch"


def path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver's Python ends."""
    fresh = f"{root(spark)}/strata-{uuid.uuid4().hex}/{name}"
    atexit.register(remove, spark, fresh)
    return fresh


def remove(spark: SparkSession, at: str) -> None:
    """Delete the folder of a path that ``path`` gave."""
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(at)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target.getParent(), True)
    except Exception:  # the session may be gone; the folder then stays for the cluster's own cleaning
        pass
