"""What the operators share: the word pattern, tables kept in the shared folder, joins by checked size."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from corvina.session import shared_folder as shared_root

#: A word is a run of anything but these six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """The words of a text, in order; of null, none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda w: w != "")


class Scratch:
    """Tables written to the shared folder. They cut lineage: a lost executor costs a reread, not a recomputation."""

    def __init__(self, spark: SparkSession, name: str, counted: bool = False):
        """counted: rows are counted as they are written, so that asking for their number takes no job; for operators that ask often."""
        self.spark, self.root, self.n, self.counted = spark, f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}", 0, counted

    def save(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path, seen = f"{self.root}/{self.n}", Observation()
        (df.observe(seen, F.count(F.lit(1)).alias("rows")) if self.counted else df).write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._corvina_path = path
        if self.counted:
            out._corvina_rows = seen.get["rows"]
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Remove tables that nothing still to be run reads."""
        for t in tables:
            remove(self.spark, t._corvina_path)


def filesystem(spark: SparkSession, path: str):
    """Hadoop's file system and path object for a path: any store that Spark writes to."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def remove(spark: SparkSession, path: str) -> None:
    fs, p = filesystem(spark, path)
    fs.delete(p, True)


#: Rows of two or three longs that are sent to every executor; beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000
#: Bytes of a written table, as it is stored, that are sent to every executor.
BROADCAST_BYTES = 12 << 20


def n_rows(df: DataFrame) -> int:
    """The number of rows: of a written table known, of another counted once."""
    if getattr(df, "_corvina_rows", None) is None:
        df._corvina_rows = df.count()
    return df._corvina_rows


def few(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """Whether the table may be sent to every executor: at most ``limit`` rows, and, if it is written, at most BROADCAST_BYTES."""
    if path := getattr(df, "_corvina_path", None):
        if getattr(df, "_corvina_bytes", None) is None:
            fs, p = filesystem(df.sparkSession, path)
            df._corvina_bytes = fs.getContentSummary(p).getLength()
        if df._corvina_bytes > BROADCAST_BYTES:
            return False
    return n_rows(df) <= limit


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only if the (written) table has few rows of a few numbers; otherwise Spark shuffles both sides."""
    return F.broadcast(df) if few(df, limit) else df


def hint(table: DataFrame):
    """A broadcast for what has no more rows than this (written) table, if those are few."""
    return F.broadcast if few(table, BROADCAST_ROWS // 8) else lambda df: df
