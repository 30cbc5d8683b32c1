"""Readers: XML dumps (as XML, or as text with escapes left in), CSV parts, tables that may not be there, word lists."""

from __future__ import annotations

import ast

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvina.functions.text import by_slices

PAGE = "title string, revision struct<text:struct<data:string>>"
PARTS = "title string, raw_text string, infobox string, terms string"


def with_dense_ids(df: DataFrame, name: str = "doc_id") -> DataFrame:
    """Number rows from 0 in file order without gaps. Needs ``_file`` and ``_block`` (path and offset of the split) and drops them.

    Only one row a split is ordered in one place and sent to all tasks (128 MB a split, or a file: some 10,000 for a TB); the rows themselves aren't moved.
    """
    numbered = df.withColumn("_mid", F.monotonically_increasing_id())
    blocks = numbered.groupBy("_file", "_block").agg(F.count("*").alias("_n"), F.min("_mid").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = blocks.select("_file", "_block", (before - F.col("_first")).alias("_shift"))
    out = numbered.join(F.broadcast(starts), ["_file", "_block"]).withColumn(name, (F.col("_mid") + F.col("_shift")).cast("long"))
    return out.select(name, *[c for c in df.columns if c not in ("_file", "_block")])


def _placed(df: DataFrame) -> DataFrame:
    return df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"))


def read_dump_xml(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, title, raw_text of each page, references resolved. A missing text reads as empty, a missing title as null."""
    rows = spark.read.schema(PAGE).format("xml").options(rowTag="page", valueTag="data", ignoreSurroundingSpaces="false", attributePrefix="_").load(path)
    return with_dense_ids(_placed(rows)).select("doc_id", "title", F.coalesce("revision.text.data", F.lit("")).alias("raw_text"))


def cut_files(spark: SparkSession, path: str, tail: int = 1 << 16) -> list[str]:
    """Files whose last page may lack its end, by their last bytes: a few thousand files at most, as dumps have."""
    hadoop = spark._jvm.org.apache.hadoop
    p = hadoop.fs.Path(path)
    fs, found = p.getFileSystem(spark._jsc.hadoopConfiguration()), []
    for top in fs.globStatus(p) or []:
        files = fs.listFiles(top.getPath(), True)
        while files.hasNext():
            f = files.next()
            if f.getPath().getName()[0] in "._":
                continue
            stream = fs.open(f.getPath())
            try:
                stream.seek(max(0, f.getLen() - tail))
                end = bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
            finally:
                stream.close()
            last = end.rfind(b"</page>")
            if b"<page" in end[last + 1 :] or last < 0 and f.getLen() > tail:
                found.append(f.getPath().toString())
    return found


def read_dump_raw(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, title, raw_text with references as they stand. Splits at the pages' ends, so one large file is read by many tasks.

    A last page that is cut off before its end is left out.
    """
    every = _placed(spark.read.option("lineSep", "</page>").text(path))
    if cut := cut_files(spark, path):  # what follows the last end in such a file is no page
        names = [spark._jvm.org.apache.hadoop.fs.Path(c).getName() for c in cut]
        every = every.withColumn("_mid", F.monotonically_increasing_id())
        last = every.where(F.element_at(F.split("_file", "/"), -1).isin(names)).groupBy("_file").agg(F.max_by("_mid", F.struct("_block", "_mid")).alias("_mid"))
        every = every.join(F.broadcast(last.select("_mid")), "_mid", "left_anti").drop("_mid")  # a row a file
    rows = every.where(F.col("value").contains("<page>"))
    page = F.regexp_extract("value", r"(?s)<page>(.*)$", 1)
    return with_dense_ids(rows.withColumn("value", page)).select(
        "doc_id", F.regexp_extract("value", r"(?s)<title>(.*?)</title>", 1).alias("title"), F.regexp_extract("value", r"(?s)<text.*?>(.*?)</text>", 1).alias("raw_text")
    )


def parse_page_xml(page: str = "page") -> Column:
    """title and raw_text of a column of <page> elements."""
    parsed = F.from_xml(page, PAGE, {"valueTag": "data", "ignoreSurroundingSpaces": "false"})
    return F.struct(parsed["title"].alias("title"), F.coalesce(parsed["revision"]["text"]["data"], F.lit("")).alias("raw_text"))


def read_parts(spark: SparkSession, path: str) -> DataFrame:
    """The CSV parts that ``write_parts`` writes."""
    return spark.read.schema(PARTS).options(header=True, multiLine=True, quote='"', escape='"').csv(path)


@F.arrow_udf(T.ArrayType(T.StringType()))
def _listed(texts: pa.Array) -> pa.Array:
    return by_slices(lambda t: [str(x) for x in ast.literal_eval(t)], texts, pa.list_(pa.string()))


def read_terms_csv(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, title, terms of a store kept as CSV, where terms are written as a Python list."""
    rows = spark.read.schema("doc_id long, title string, terms string").options(header=True, multiLine=True, quote='"', escape='"').csv(path)
    return rows.withColumn("terms", _listed("terms"))


def read_or_empty(spark: SparkSession, path: str, schema: str | T.StructType, format: str = "parquet", **options) -> DataFrame:
    """The table at ``path``, or an empty one of the schema where nothing is there yet."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.read.schema(schema).options(**options).format(format).load(path)
    return spark.createDataFrame([], schema)


def read_words(spark: SparkSession, path: str) -> list[str]:
    """A word list, one a line, trimmed: a list of some hundred words for an array literal."""
    return [r[0] for r in spark.read.text(path).select(F.trim("value")).where("trim(value) <> ''").collect()]


def read_lemmas(spark: SparkSession, path: str) -> dict[str, tuple[str, str]]:
    """A dictionary of surface form, lemma and tag, one a line, by tabs; of several of a form, the last. Held by the driver and each worker."""
    rows = spark.read.schema("word string, lemma string, pos string").options(sep="\t", quote="").csv(path).where("pos is not null").collect()
    return {r.word: (r.lemma, r.pos) for r in rows}


def read_title_files(spark: SparkSession, path: str) -> DataFrame:
    """title and the part file that holds it; of several, the last file by name."""
    rows = spark.read.schema(PARTS).options(header=True, multiLine=True, quote='"', escape='"').csv(path).select("title", F.col("_metadata.file_name").alias("file"))
    return rows.groupBy("title").agg(F.max("file").alias("file"))
