"""Five stages over documents: reject poor texts, drop repeated lines, keep one of near-equal texts, mix the sources, encode.

All but the last keep the columns that they are given, whatever other columns are called; an empty table gives no rows in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvina.llm import jaccard, lines, mixing, pieces, quality
from corvina.llm._base import Scratch, small
from corvina.llm.queries import PIECES, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the base rules and the ratio keep, each judged by itself, repeated ones too; null and short texts go."""
    trusted = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return quality.filter_quality(docs, trusted)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without lines of passages that stand earlier (by doc_id); n_chars is the new length, null for a null text. A text may become empty."""
    out = lines.dedup_lines(docs, Scratch(spark, "lines"))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group stays, with all its rows; a null doc_id is in no group and stays; so do texts without words."""
    scratch = Scratch(spark, "jaccard", counted=True)
    gone = scratch.save(jaccard.groups(docs, scratch).where("doc_id <> component_id").select("doc_id").distinct())
    return docs.join(small(gone), "doc_id", "left_anti").select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it: 0 to 2 times. Rows that share a doc_id share the decision; texts without words are taken 0 or more times by
    the whole part of their source's rate; null sources are one source, null doc_ids are told apart by source and text."""
    return mixing.mix(docs, Scratch(spark, "mixing"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, ids, and text as decoded from them; all three null for a null text."""
    both = pieces.encode_and_decode(docs, PIECES)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", "text")


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", jaccard_join),
    ("mixing sources", source_mix),
    ("SentencePiece", sentencepiece),
]

#: The ratio of hashed n-grams, the random rounding and the encoding aren't SQL; the stages are tested against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch.save(docs)
    return docs
