"""A session with the settings that the plans rely on; every one may be overridden."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def build_session(name: str = "corvina", conf: Mapping[str, str] | None = None) -> SparkSession:
    return SparkSession.builder.appName(name).config(map={**DEFAULTS, **(conf or {})}).getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share; where it is unset, a temporary one on a single machine, an error on a cluster."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is to name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="corvina-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def kept(spark: SparkSession, name: str, source: str, make: Callable[[str], object]) -> str:
    """The folder of what ``make(folder)`` writes from the files at ``source``: made once, in the shared folder, for each state of those files.

    It is made under another name and renamed, so a reader sees it whole; of two that make it at once, one is kept.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(source).getFileSystem(spark._jsc.hadoopConfiguration())
    state, files = [], fs.listFiles(path(source), True)
    while files.hasNext():
        f = files.next()
        state.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    folder = f"{shared_folder(spark)}/{name}-{hashlib.sha256(chr(10).join(sorted(state)).encode()).hexdigest()[:16]}"
    out = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    if not out.exists(path(folder)):
        draft = f"{folder}.{uuid.uuid4().hex}"
        make(draft)
        if not out.rename(path(draft), path(folder)):
            out.delete(path(draft), True)
    return folder
