"""Retrieval quality: precision, recall, F1, average precision, precision at k. Each query id is scored by itself.

retrieved: query_id, rank (from 1), doc_id. relevant: query_id, doc_id. What would divide by zero is 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvina.operators.index import written


def _zero(c):
    return F.coalesce(c, F.lit(0.0))


def judged(retrieved: DataFrame, relevant: DataFrame) -> DataFrame:
    """retrieved with hit (0 or 1); a document counts at its first rank."""
    first = retrieved.groupBy("query_id", "doc_id").agg(F.min("rank").alias("rank"))
    good = relevant.select("query_id", "doc_id").distinct().withColumn("hit", F.lit(1))
    return first.join(good, ["query_id", "doc_id"], "left").na.fill(0, ["hit"])


def precision_recall_f1(retrieved: DataFrame, relevant: DataFrame) -> DataFrame:
    """query_id, precision, recall, f1, of every query that has retrieved or relevant documents."""
    got = judged(retrieved, relevant).groupBy("query_id").agg(F.count("*").alias("n"), F.sum("hit").alias("hits"))
    want = relevant.select("query_id", "doc_id").distinct().groupBy("query_id").agg(F.count("*").alias("r"))
    both = got.join(want, "query_id", "full").na.fill(0, ["n", "hits", "r"])
    p, r = _zero(F.try_divide("hits", "n")), _zero(F.try_divide("hits", "r"))
    pr = both.select("query_id", p.alias("precision"), r.alias("recall"))
    return pr.withColumn("f1", _zero(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))))


def average_precision(retrieved: DataFrame, relevant: DataFrame) -> DataFrame:
    """query_id, ap: the precision at each hit's rank, summed, over the number of relevant documents. Their mean is MAP."""
    w = Window.partitionBy("query_id").orderBy("rank")
    at = judged(retrieved, relevant).select("query_id", "hit", (F.sum("hit").over(w.rowsBetween(Window.unboundedPreceding, 0)) / F.row_number().over(w)).alias("p"))
    total = at.where("hit = 1").groupBy("query_id").agg(F.sum("p").alias("s"))
    want = relevant.select("query_id", "doc_id").distinct().groupBy("query_id").agg(F.count("*").alias("r"))
    return want.join(total, "query_id", "left").select("query_id", _zero(F.col("s") / F.col("r")).alias("ap"))


def precision_at(retrieved: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """query_id, precision among the first k ranks; fewer results divide by their own number."""
    return judged(retrieved.where(F.col("rank") <= k), relevant).groupBy("query_id").agg(F.avg("hit").alias("precision"))


def evaluate(retrieved: DataFrame, relevant: DataFrame, ks: Sequence[int] = (5, 10)) -> DataFrame:
    """One row: queries (those with relevant documents), and the means over them of precision, recall, f1, average precision (map) and precision at each k. Each of them reads what was retrieved, so it is written once."""
    retrieved = written(retrieved, "retrieved")
    asked = relevant.select("query_id").distinct()
    each = asked.join(precision_recall_f1(retrieved, relevant), "query_id").join(average_precision(retrieved, relevant), "query_id")
    for k in ks:
        each = each.join(precision_at(retrieved, relevant, k).withColumnRenamed("precision", f"precision_at_{k}"), "query_id", "left").na.fill(0.0)
    return each.agg(F.count(F.lit(1)).alias("queries"), *[F.avg(c).alias("map" if c == "ap" else c) for c in each.columns if c != "query_id"])
