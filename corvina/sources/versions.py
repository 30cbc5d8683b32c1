"""Numbered states of a store, each a JSON file, switched by one rename: a reader sees a state or the next, nothing between."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """Another writer has committed this version."""


def filesystem(spark: SparkSession, path: str):
    """Hadoop's file system and path object for a path: any store that Spark writes to."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def require(spark: SparkSession, path: str | None) -> str:
    """The path (or pattern), if it is given and there."""
    if path is None:
        raise ValueError("no path is given")
    fs, p = filesystem(spark, path)
    if not fs.globStatus(p):
        raise FileNotFoundError(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    fs, p = filesystem(spark, path)
    fs.delete(p, True)


def names(spark: SparkSession, path: str) -> list[str]:
    """What a folder holds; nothing, if it isn't there."""
    fs, p = filesystem(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def n_bytes(spark: SparkSession, path: str) -> int:
    fs, p = filesystem(spark, path)
    return fs.getContentSummary(p).getLength() if fs.exists(p) else 0


class Versions:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def all(self) -> list[int]:
        return sorted(int(n[:-5]) for n in names(self.spark, self.path) if n.endswith(".json") and n[:-5].isdigit())

    def read(self, version: int | None = None) -> tuple[int, dict]:
        """A version and its state, the last one unless another is named; 0 and nothing, if there is none."""
        version = max(self.all(), default=0) if version is None else version
        if not version:
            return 0, {}
        fs, p = filesystem(self.spark, f"{self.path}/{version:010}.json")
        stream = fs.open(p)
        try:
            return version, json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, version: int, state: dict) -> int:
        """Make ``state`` the version after ``version``, or raise Conflict: of two writers one wins, and the other may start again from its version."""
        jvm, final = self.spark._jvm, f"{self.path}/{version + 1:010}.json"
        fs, draft = filesystem(self.spark, f"{self.path}/.{uuid.uuid4().hex}")
        stream = fs.create(draft, False)
        stream.write(bytearray(json.dumps(state).encode()))
        stream.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(draft, jvm.org.apache.hadoop.fs.Path(final), options)  # atomic; fails if the version is there
        except Exception as e:
            fs.delete(draft, False)
            raise Conflict(f"version {version + 1} is there") from e
        return version + 1
