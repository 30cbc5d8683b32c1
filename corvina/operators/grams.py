"""Which titles have a stem as a part of them, by an index instead of a scan: positions of runs of three characters.

A stem of m + 2 characters stands in a title where its m runs follow each other, so the places of its first run, as each of its runs tells them, must
agree m times; no title is read to make sure. Titles end with two filler characters, so that a run begins at each of their characters: a shorter stem
stands where a run begins with it. Stemmed words of infoboxes are looked up whole. Both tables are ranged and sorted by what is looked up.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvina.functions.stem import stem
from corvina.operators.index import FEW_TERMS
from corvina.operators.search import KEY, TITLE, VALUE

LENGTH = 3
FILLER = "\0" * (LENGTH - 1)


def title_grams(stems: DataFrame) -> DataFrame:
    """gram, doc_id, at: each run of the stemmed title ``t`` and where it begins."""
    runs = F.expr(f"transform(sequence(1, length(t)), i -> substring(concat(t, '{FILLER}'), i, {LENGTH}))".replace("\0", "\\0"))
    return stems.where("length(t) > 0").select("doc_id", F.posexplode(runs).alias("at", "gram")).select("gram", "doc_id", "at")


def box_words(stems: DataFrame) -> DataFrame:
    """word, doc_id, kind: stemmed words of an infobox's keys (k) and values (v), each once."""
    both = F.array(F.struct(F.lit("k").alias("kind"), F.array_distinct("k").alias("words")), F.struct(F.lit("v").alias("kind"), F.array_distinct("v").alias("words")))
    return stems.select("doc_id", F.explode(both).alias("b")).select(F.explode("b.words").alias("word"), "doc_id", "b.kind")


#: Tables to keep beside pages, what makes them of the stems, and by what they are looked up.
TABLES = {"grams": (title_grams, ["gram", "doc_id"]), "boxes": (box_words, ["word", "doc_id"])}


def boosts(grams: DataFrame, boxes: DataFrame, terms: Sequence[str]) -> DataFrame:
    """doc_id, boost of the documents that have any: as ``search.boost``, repeats counted."""
    spark = grams.sparkSession
    said = {s: n for s, n in Counter(map(stem, terms)).items() if s}
    long = [(s, s[i : i + LENGTH], i, len(s) - LENGTH + 1) for s in said for i in range(len(s) - LENGTH + 1)]
    found = []
    if long:
        asked = F.broadcast(spark.createDataFrame(long, "stem string, gram string, i int, m int"))  # a row a character of the question
        hits = grams.where(F.col("gram").isin(sorted({x[1] for x in long}))).join(asked, "gram")
        runs = hits.groupBy("stem", "doc_id", (F.col("at") - F.col("i")).alias("start")).agg(F.count(F.lit(1)).alias("n"), F.first("m").alias("m")).where("n = m")
        found.append(runs.select("stem", "doc_id").distinct().withColumn("weight", F.lit(TITLE)))
    for s in (s for s in said if len(s) < LENGTH):
        found.append(grams.where(F.col("gram").startswith(s)).select(F.lit(s).alias("stem"), "doc_id").distinct().withColumn("weight", F.lit(TITLE)))
    words = boxes.where(F.col("word").isin(list(said)) if said else F.lit(False))
    found.append(words.select(F.col("word").alias("stem"), "doc_id", F.when(F.col("kind") == "k", KEY).otherwise(VALUE).alias("weight")))
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    times = F.broadcast(spark.createDataFrame(list(said.items()), "stem string, times int"))
    return every.join(times, "stem").groupBy("doc_id").agg(F.sum(F.col("weight") * F.col("times")).alias("boost"))


def many_boosts(grams: DataFrame, boxes: DataFrame, said: DataFrame) -> DataFrame:
    """query_id, doc_id, boost of the documents that have any, as ``boosts``, for each of many questions. said: query_id, stem, times (written).

    Each stem is looked up once, whatever number of questions has it, and no document is met with a stem that shares nothing with it.
    """
    few = F.broadcast if said.count() <= FEW_TERMS else lambda table: table
    stems = said.select("stem").distinct()
    runs = F.expr(f"transform(sequence(1, length(stem) - {LENGTH - 1}), i -> substring(stem, i, {LENGTH}))")
    long = stems.where(F.length("stem") >= LENGTH).select("stem", (F.length("stem") - LENGTH + 1).alias("m"), F.posexplode(runs).alias("i", "gram"))
    places = grams.join(few(long), "gram").groupBy("stem", "doc_id", (F.col("at") - F.col("i")).alias("start")).agg(F.count(F.lit(1)).alias("n"), F.first("m").alias("m")).where("n = m")
    titles = places.select("stem", "doc_id")
    for n in range(1, LENGTH):
        titles = titles.unionByName(grams.select(F.substring("gram", 1, n).alias("stem"), "doc_id").join(few(stems.where(F.length("stem") == n)), "stem"))
    words = boxes.select(F.col("word").alias("stem"), "doc_id", F.when(F.col("kind") == "k", KEY).otherwise(VALUE).alias("weight")).join(few(stems), "stem")
    every = titles.distinct().withColumn("weight", F.lit(TITLE)).unionByName(words)
    return every.join(few(said), "stem").groupBy("query_id", "doc_id").agg(F.sum(F.col("weight") * F.col("times")).alias("boost"))
