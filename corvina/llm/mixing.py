"""Mixing sources to target weights by pivotal dependent rounding.

Sources in code-point order (null last) get ``share`` of all words by the weights, repeating; a target stops at ``most`` times its
source's words and what it can't hold is shared again by weight among the others. A document of a source is to be taken
target / words times: the whole part is certain, the rest p is rounded. Pivotal rounding pairs two open documents of a
source and moves words (p times the size) from one to the other, at random by hash so that each p keeps its mean, until one
of them is 0 or 1; the other goes on. So a source's words stay put until its last open document, whose size bounds the error. A group
takes its documents from the largest to the smallest, so what stays open is mostly small; and what the last one's rounding adds or takes is
made good in the last group by turning documents of about that size, which shifts their p's a little from the mean.

The pairing is a reduction tree: leaves of about ``leaf`` documents by hash of doc_id, each leaving one open document at most, then
``fan`` of those together, up to one group a source. A source of a third of all rows only has more leaves. Random numbers
are hashes of ids, and groups are sorted, so a rerun or a retried task decides alike, however rows are partitioned.

Defined cases: null texts have size 0 and take no words; a null source is a source, after all others; rows that repeat a doc_id
follow one decision (of the smallest source and size); rows with a null doc_id are told apart by source and text and rounded like others (equal
ones alike); with no words at all, targets are 0; more than ``most_sources`` sources are an error, as targets are made on the driver; an empty table gives no rows; other columns are ignored by ``plan_mix`` and kept by ``mix``.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvina.llm._base import WORD, Scratch

#: Sources whose targets the driver makes; their rates are broadcast.
MOST_SOURCES = 200_000
OPEN = "source string, leaves long, leaf long, doc_id long, size long, p double, copies int"


def targets(sizes: dict[str | None, int], weights: Sequence[float], share: float, most: float) -> dict[str | None, float]:
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out: dict[str | None, float] = {}
    left, rest = share * sum(sizes.values()), list(order)
    while rest:
        each = left / sum(weight[s] for s in rest)
        full = [s for s in rest if each * weight[s] > most * sizes[s]]
        if not full:
            return out | {s: each * weight[s] for s in rest}
        out |= {s: most * sizes[s] for s in full}
        left -= sum(out[s] for s in full)
        rest = [s for s in rest if s not in out]
    return out


def uniform(a: int, b: int, seed: int) -> float:
    """A number in [0, 1) from two ids."""
    x = (a * 0x9E3779B97F4A7C15 + b * 0xC2B2AE3D27D4EB4F + seed) & 0xFFFFFFFFFFFFFFFF
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = ((x ^ (x >> shift)) * by) & 0xFFFFFFFFFFFFFFFF
    return ((x ^ (x >> 31)) >> 11) / (1 << 53)


def pivotal(ids: Sequence[int], sizes: Sequence[int], ps: Sequence[float], seed: int, last: bool) -> list[float]:
    """The p's after rounding: each 0 or 1, but for one at most that is open unless this is the last group."""
    out, i = list(ps), None
    for j, p in enumerate(ps):
        if not 0 < p < 1:
            continue
        if i is None:
            i = j
            continue
        give = min(sizes[i] * (1 - out[i]), sizes[j] * out[j])  # words that could go from j to i
        take = min(sizes[i] * out[i], sizes[j] * (1 - out[j]))
        moved = give if uniform(ids[i], ids[j], seed) * (give + take) < take else -take
        for n, by in ((i, moved), (j, -moved)):
            out[n] += by / sizes[n]
            out[n] = 0.0 if out[n] < 1e-9 else 1.0 if out[n] > 1 - 1e-9 else out[n]
        i = next((n for n in (i, j) if 0 < out[n] < 1), None)
    if last and i is not None:
        out[i] = float(uniform(ids[i], -1, seed) < out[i])
    return out


def repaired(sizes: Sequence[int], before: Sequence[float], after: Sequence[float]) -> list[float]:
    """The last group's decisions, where those of other documents that were open in it are turned as long as that brings the words nearer to what they were.

    Each turn takes the document whose size is nearest to the words that are missing or too many (ties: the first).
    """
    out = list(after)
    miss = sum(n * (y - x) for n, x, y in zip(sizes, before, after))
    open_ = [i for i, p in enumerate(before) if 0 < p < 1]
    while True:
        turned = min((i for i in open_ if out[i] == (miss > 0)), key=lambda i: abs(sizes[i] - abs(miss)), default=None)
        if turned is None or abs(abs(miss) - sizes[turned]) >= abs(miss):
            return out
        miss += sizes[turned] * (1 - 2 * out[turned])
        out[turned] = 1 - out[turned]


def rounding(seed: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["size", "doc_id"], ascending=[False, True])
        sizes, before, last = group["size"].tolist(), group.p.tolist(), bool(group.leaves.iloc[0] == 1)
        after = pivotal(group.doc_id.tolist(), sizes, before, seed, last)
        return group.assign(p=np.array(repaired(sizes, before, after) if last else after, float))

    return run


def identity() -> Column:
    """The doc_id, or what stands for it where it is null: a hash of source and text."""
    return F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(F.lit("no doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("\0")), F.col("text")))


def plan_mix(docs: DataFrame, scratch: Scratch, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, leaf: int = 4096, fan: int = 256, seed: int = 0, most_sources: int = MOST_SOURCES) -> DataFrame:
    """doc_id, key (``identity``), source, size, source_size, target, copies (int), taken (long). One row is collected for each source."""
    spark = docs.sparkSession
    n_words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    sized = scratch.save(docs.select(F.col("doc_id").cast("long"), identity().alias("key"), F.col("source").cast("string"), n_words.alias("size")))
    sums = sized.groupBy("source").agg(F.sum("size"), F.count("*")).limit(most_sources + 1).collect()
    if len(sums) > most_sources:
        raise ValueError(f"more than {most_sources} sources")
    totals = {s: (n, c) for s, n, c in sums}
    goal = targets({s: n for s, (n, _) in totals.items()}, weights, share, most)
    rates = spark.createDataFrame([(s, n, goal[s], goal[s] / n if n else 0.0, -(-c // leaf)) for s, (n, c) in totals.items()], "source string, source_size long, target double, rate double, leaves long")
    rated = sized.join(F.broadcast(rates.withColumnRenamed("source", "of")), F.col("source").eqNullSafe(F.col("of"))).drop("of")

    ranked = rated.groupBy("key").agg(F.min(F.struct("source", "size", "rate", "leaves")).alias("u")).select(F.col("key").alias("doc_id"), "u.*")
    frac = F.when(F.col("size") > 0, F.col("rate") - F.floor("rate")).otherwise(0.0)
    state = ranked.select("source", "leaves", F.pmod(F.xxhash64("doc_id"), "leaves").alias("leaf"), "doc_id", "size", frac.alias("p"), F.floor("rate").cast("int").alias("copies"))
    done, leaves = [], max((-(-c // leaf) for _, c in totals.values()), default=1)
    while True:
        state = scratch.save(state.groupBy("source", "leaves", "leaf").applyInPandas(rounding(seed), OPEN))
        done.append(state.where("p = 0 or p = 1"))
        if leaves == 1:
            break
        leaves = -(-leaves // fan)
        state = state.where("p > 0 and p < 1").withColumn("leaves", F.ceil(F.col("leaves") / fan)).withColumn("leaf", F.pmod(F.xxhash64("doc_id", "leaf"), "leaves"))
    decided = done[0]
    for d in done[1:]:
        decided = decided.union(d)
    decided = decided.select(F.col("doc_id").alias("key"), (F.col("copies") + F.col("p").cast("int")).alias("copies"))
    out = rated.join(decided, "key")
    return out.select("doc_id", "key", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, scratch: Scratch, **options) -> DataFrame:
    """The table with each document repeated as often as the mix takes it."""
    plan = plan_mix(docs.select("doc_id", "text", "source"), scratch, **options)
    copies = plan.groupBy("key").agg(F.max("copies").alias("copies")).where("copies > 0")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), identity().alias("key"))  # whatever its columns are called
    return rows.join(copies, "key").select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies"))).alias("n")).select("row.*")
