"""The first n without scoring every document: postings by term and block, and the highest part of a score in each block.

A document's score is the root of a sum over the terms it has of w * w / norm2, so the sum of the terms' highest parts in a block bounds every score in it.
Blocks go by the documents' norms (``STEPS`` to a doubling), so the short documents, which score high, lie together and bounds are tight. A question reads
the bounds of its terms (a row a term and block), scores the most promising blocks exactly, and then only those others whose bound reaches the n-th score.
The result is that of ``search``: what is left out can't be among the first n, ties included.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvina.operators.index import FEW_IDS, Index, sent
from corvina.plans.args import Operator

STEPS = 4


@dataclass
class Ranked:
    """postings (term, block, doc_id, part) and bounds (term, block, top, n)."""

    postings: DataFrame
    bounds: DataFrame

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Ranked:
        return cls(*(spark.read.parquet(f"{path}/{t}") for t in ("ranked_postings", "ranked_bounds")))


def write_ranked(index: Index, path: str, row_group: int = 16 << 20) -> None:
    """The two tables under ``path``, ranged and sorted by term and block: filters on both select row groups and pages."""
    block = F.floor(STEPS * F.log2("norm2")).cast("int")
    parts = index.postings.join(sent(index.doc_norm, "doc_id", "norm2", most=FEW_IDS), "doc_id").select("term", block.alias("block"), "doc_id", (F.col("w") * F.col("w") / F.col("norm2")).alias("part"))
    parts.repartitionByRange("term", "block", "doc_id").sortWithinPartitions("term", "block", "doc_id").write.option("parquet.block.size", row_group).parquet(f"{path}/ranked_postings")
    tops = index.postings.sparkSession.read.parquet(f"{path}/ranked_postings").groupBy("term", "block").agg(F.max("part").alias("top"), F.count(F.lit(1)).alias("n"))
    tops.repartitionByRange("term", "block").sortWithinPartitions("term", "block").write.parquet(f"{path}/ranked_bounds")


def search_ranked(ranked: Ranked, terms: Sequence[str], operator: Operator = Operator.AND, n: int = 10, digits: int = 9) -> tuple[DataFrame, dict[str, int]]:
    """rank, doc_id, score as ``search`` has them, and what it took: blocks and postings in all, and those that were scored."""
    spark, terms = ranked.postings.sparkSession, list(set(terms))
    rows = ranked.bounds.where(F.col("term").isin(terms)).collect() if terms else []  # a row a term and block
    known = sorted({r.term for r in rows})
    by: dict[int, list] = {}
    for r in rows:
        by.setdefault(r.block, []).append(r)
    if operator == Operator.AND:
        by = {b: rs for b, rs in by.items() if len(rs) == len(known)}
    bound = {b: sum(r.top for r in rs) for b, rs in by.items()}
    hits = {b: sum(r.n for r in rs) for b, rs in by.items()}
    left, best, read, want = sorted(by, key=lambda b: -bound[b]), [], [], 4 * n
    while left:
        if len(best) >= n:
            least = best[n - 1][1] - 10.0**-digits  # scores are rounded
            chosen = [b for b in left if math.sqrt(bound[b]) >= least]
            left = []
        else:
            size = k = 0
            while k < len(left) and size < want:
                size, k = size + hits[left[k]], k + 1
            chosen, left, want = left[:k], left[k:], want * 4
        if not chosen:
            break
        some = ranked.postings.where(F.col("term").isin(known) & F.col("block").isin(chosen)).groupBy("doc_id").agg(F.sum("part").alias("q"), F.count(F.lit(1)).alias("m"))
        some = some.where(F.col("m") == len(known)) if operator == Operator.AND else some
        found = some.select("doc_id", F.round(F.sqrt("q"), digits).alias("score")).orderBy(F.desc("score"), "doc_id").limit(n).collect()
        best, read = sorted([*best, *map(tuple, found)], key=lambda x: (-x[1], x[0]))[:n], read + chosen
    took = {"blocks": len(by), "scored_blocks": len(read), "postings": sum(hits.values()), "scored_postings": sum(hits[b] for b in read)}
    logging.info("%(scored_blocks)d of %(blocks)d blocks, %(scored_postings)d of %(postings)d postings", took)
    return spark.createDataFrame([(i + 1, *x) for i, x in enumerate(best)], "rank int, doc_id long, score double"), took
