"""Near-duplicate vectors: random-hyperplane sign hashing in several tables, exact cosine, connected components.

Vectors are compared only within a label. Equal vectors are one class with a weight (by hashes, distinct ids counted before the shuffle), so copies
cost nothing. A class's code in a table is the signs of its products with ``bits`` random hyperplanes; classes of one code of a table
meet in a bucket. There, every pair's cosine is computed in double precision; a pair that meets in several tables counts in the first.
A bucket sends out, for each vector, the weight of its links, and a spanning forest of its links instead of the pairs themselves.

Two vectors at cosine c share a code with probability (1 - acos(c) / pi) ** bits. Bits follow the largest label, so that chance fills one bucket in
sixteen however many vectors there are, and tables follow the bits, so that ``recall`` of the pairs at the threshold are found and more
above (48 tables of 17 bits for 8,000 vectors a label). Links are verified, so none is below the threshold. Only hashes of the codes are shuffled to
find the buckets that hold more than one class; vectors are sent to those alone.

A bucket of more than ``block`` classes is dealt out: its classes into blocks by hash, and each two blocks into one group, so every pair
still meets exactly once, in groups of bounded size, whatever share of the rows one bucket has.

Defined cases: vectors that are null, empty or all zero, or hold a null or a non-finite component, and rows with a null label or vec_id,
link with nothing; labels of any type are compared as text; vectors of different lengths don't link; rows that repeat an id and vector are one vector and each give
the row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvina.llm._base import Scratch, n_rows, small
from corvina.llm.components import components

VALID = "vec_id is not null and label is not null and coalesce(size(embedding), 0) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(embedding, x -> x <> 0)"
FOUND = "kind int, a long, b long"


def matrix(column: pa.Array, rows: np.ndarray) -> np.ndarray:
    """Rows of a list column as unit vectors in double precision; all of one length."""
    off = column.offsets.to_numpy().astype(np.int64)
    values = column.values.to_numpy(zero_copy_only=False)
    n = int(off[rows[0] + 1] - off[rows[0]])
    x = values[off[rows][:, None] + np.arange(n)].astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def signatures(bits: int, tables: int, seed: int):
    """rep, weight, label, embedding and codes, an int for each table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        weight = (1 << np.arange(bits)).astype(np.int64)
        for batch in batches:
            e = batch.column("embedding")
            codes = np.zeros((len(batch), tables), np.int32)
            length = np.diff(e.offsets.to_numpy())
            for n in np.unique(length).tolist():
                rows = np.flatnonzero(length == n)
                if n not in planes:
                    planes[n] = np.random.default_rng((seed, n)).standard_normal((n, tables * bits))
                codes[rows] = ((matrix(e, rows) @ planes[n] > 0).reshape(len(rows), tables, bits) @ weight).astype(np.int32)
            lists = pa.ListArray.from_arrays(np.arange(0, codes.size + 1, tables, dtype=np.int32), pa.array(codes.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, "codes"])

    return run


def spread(linked: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each row the smallest id that links reach."""
    low = ids.copy()
    while True:
        new = np.minimum(low, np.where(linked, low[None, :], np.iinfo(np.int64).max).min(axis=1))
        if (new == low).all():
            return low
        low = new


def compared(threshold: float):
    """Kind 0: a vector and the weight of its links here. Kind 1: edges that hold what is linked together."""

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        rep, weight, table = (group.column(c).to_numpy() for c in ("rep", "weight", "t"))
        key = [group.column(c).to_numpy() for c in ("j", "i", "bucket")]
        own = group.column("own").to_numpy()
        embeddings, codes = group.column("embedding").chunk(0), group.column("codes").chunk(0)
        codes = codes.values.to_numpy()[codes.offsets[0].as_py() :].reshape(len(rep), -1)
        order = np.lexsort(key)
        new = np.ones(len(order) + 1, bool)
        new[1:-1] = np.any([k[order][1:] != k[order][:-1] for k in key], axis=0)
        edges = np.flatnonzero(new)
        # most buckets hold two classes by chance: those are left out together
        size, length = np.diff(edges), np.diff(embeddings.offsets.to_numpy())
        near = size > 1
        two = np.flatnonzero(size == 2)
        for n in np.unique(length[order[edges[two]]]).tolist():
            at = two[length[order[edges[two]]] == n]
            near[at] = (matrix(embeddings, order[edges[at]]) * matrix(embeddings, order[edges[at] + 1])).sum(axis=1) > threshold - 1e-9
        out: list[tuple[int, np.ndarray, np.ndarray]] = []
        for a, b in zip(edges[:-1][near].tolist(), edges[1:][near].tolist()):
            rows = order[a:b]
            x = matrix(embeddings, rows)
            linked = x @ x.T >= threshold
            np.fill_diagonal(linked, False)
            i, j = key[1][rows[0]], key[0][rows[0]]
            if i != j:  # two blocks: pairs within one are another group's
                linked &= own[rows][:, None] != own[rows][None, :]
            hit = np.flatnonzero(linked.any(axis=1))
            linked, rows = linked[np.ix_(hit, hit)], rows[hit]
            for c in codes[rows, : table[order[a]]].T:  # met in an earlier table
                linked &= c[:, None] != c[None, :]
            hit = np.flatnonzero(linked.any(axis=1))
            if len(hit):
                linked, rows = linked[np.ix_(hit, hit)], rows[hit]
                out.append((0, rep[rows], (linked * weight[rows][None, :]).sum(axis=1)))
                out.append((1, rep[rows], spread(linked, rep[rows])))
        return pa.table({
            "kind": pa.array(np.concatenate([np.full(len(x), k, np.int32) for k, x, _ in out]) if out else np.zeros(0, np.int32)),
            "a": pa.array(np.concatenate([x for _, x, _ in out]) if out else np.zeros(0, np.int64)),
            "b": pa.array(np.concatenate([y for _, _, y in out]).astype(np.int64) if out else np.zeros(0, np.int64)),
        })

    return run


def bits_for(vectors: int) -> int:
    """So many that chance fills one bucket in sixteen; at most 30, what a code holds (beyond 67 million vectors a label buckets fill up)."""
    return min(30, max(8, math.ceil(math.log2(max(vectors, 1))) + 4))


def tables_for(threshold: float, bits: int, recall: float) -> int:
    """So many that a pair at the threshold shares a code in one of them with probability ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log1p(-((1 - math.acos(threshold) / math.pi) ** bits)))


def near_duplicates(vectors: DataFrame, scratch: Scratch, threshold: float = 0.93, recall: float = 0.997, bits: int | None = None, tables: int | None = None, block: int = 1024, group_rows: int = 20_000, seed: int = 1) -> DataFrame:
    """vec_id, n_links, component_id, kept."""
    v = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("string"), "embedding")
    # equal vectors of a label are known by 128 bits of hash, so vectors themselves are no key of a shuffle
    valid = v.where(VALID).withColumns({"h": F.xxhash64(F.lit(1), "label", "embedding"), "k": F.xxhash64(F.lit(2), "embedding", "label")})
    bits = bits or bits_for(valid.groupBy("label").count().agg(F.max("count")).first()[0] or 0)
    tables = tables or tables_for(threshold, bits, recall)
    groups = valid.groupBy("h", "k").agg(F.min("vec_id").alias("rep"), F.count_distinct("vec_id").alias("weight"))
    # the vector of each class, from one of its rows
    one = valid.withColumnRenamed("vec_id", "rep").join(groups, ["rep", "h", "k"]).groupBy("rep", "h", "k").agg(F.first("label").alias("label"), F.first("embedding").alias("embedding"), F.first("weight").alias("weight"))
    coded = scratch.save(one.mapInArrow(signatures(bits, tables, seed), "rep long, h long, k long, label string, embedding {}, weight long, codes array<int>".format(one.schema["embedding"].dataType.simpleString())))

    met = coded.select("rep", "label", F.size("embedding").alias("n"), F.posexplode("codes").alias("t", "code")).select("rep", "t", F.xxhash64("t", "label", "n", "code").alias("bucket"))
    several = scratch.save(met.groupBy("bucket").agg(F.count("*").alias("c")).where("c > 1").select("bucket", F.expr(f"(c + {block - 1}) div {block}").alias("blocks")))
    met = met.join(small(several), "bucket").withColumn("own", F.pmod(F.xxhash64("rep"), "blocks"))
    # one group a bucket, or one for each two blocks
    dealt = met.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).withColumns({"i": F.least("own", "o"), "j": F.greatest("own", "o")})
    dealt = scratch.save(dealt.select("rep", "t", "bucket", "blocks", "own", "i", "j"))
    dealt_to = max(1, -(-n_rows(dealt) // group_rows))
    sent = dealt.withColumn("g", F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("bucket"), F.lit(dealt_to))).otherwise(F.xxhash64("bucket", "i", "j"))).drop("blocks")
    sent = sent.join(coded.select("rep", "weight", "embedding", "codes"), "rep")
    found = scratch.save(sent.groupBy("g").applyInArrow(compared(threshold), FOUND))
    scratch.drop(several, dealt)

    comp = components(found.where("kind = 1").select("a", "b"), scratch).select(F.col("id").alias("rep"), "component")
    linked = found.where("kind = 0").groupBy(F.col("a").alias("rep")).agg(F.sum("b").alias("w"))
    answer = scratch.save(
        coded.join(linked, "rep", "left").join(comp, "rep", "left")
        .select("h", "k", (F.col("weight") - 1 + F.coalesce("w", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    scratch.drop(coded, found)
    known = valid.select("vec_id", "h", "k").join(answer, ["h", "k"]).select("vec_id", "n_links", "component_id")
    alone = v.where(f"not coalesce({VALID}, false)").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return known.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
