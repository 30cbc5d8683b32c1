"""Connected components by alternating large-star and small-star steps.

Each step takes a minimum by node (combined before the shuffle) and joins it back to the edges (an ordinary equi-join whose
skewed partitions adaptive execution splits), so a node with very many edges is never gathered in one task. Every round is
written to the shared folder. Rounds grow with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from corvina.llm._base import BROADCAST_ROWS, Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """edges: columns a, b (long). Returns (id, component) for each id that isn't the smallest of its component.

    Loops, repeated edges and either direction are accepted, rows with a null are left out; no edges give no rows.
    """
    e, mark = measured(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), scratch)
    while mark["n"]:
        # a minimum a node: at most two rows an edge
        near = F.broadcast if 2 * mark["n"] <= BROADCAST_ROWS else lambda df: df
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = scratch.save(both.join(near(low), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        star = large.join(near(low), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new, now = measured(star.union(low.select("u", F.col("m").alias("v"))).distinct(), scratch)
        scratch.drop(e, large)
        e, before, mark = new, mark, now
        if mark == before:
            break
    return e.select(F.col("u").alias("id"), F.col("v").alias("component"))


def measured(e: DataFrame, scratch: Scratch) -> tuple[DataFrame, dict]:
    """The edges, written, and their number and fingerprint, taken as they are written."""
    seen = Observation()
    table = scratch.save(e.observe(seen, F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.bit_xor(F.xxhash64("v", "u")).alias("y")))
    return table, seen.get
