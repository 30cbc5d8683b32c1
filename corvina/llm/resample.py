"""Target-distribution importance resampling: hashed n-gram weights, Gumbel keys, an exact top k by distributed radix selection.

A text's words are runs of letters, digits and anything beyond ASCII, with A to Z lower-cased. Its features, all runs of 1 to ``n`` words,
fall into ``buckets`` by CRC-32. Bucket counts of the whole raw corpus and of the whole target give each bucket a gain (a log ratio in thousandths), and a
document weighs the floored mean of its features' gains. Weight plus Gumbel noise, made from a hash of the doc_id, is the score; the k highest
scores of the eligible documents are a sample without replacement in proportion to the exponential of the weights, and a rerun draws the same.

* Counts: each task adds up its batches in one array of ``buckets`` numbers; one row a bucket and task is shuffled. The gains, bounded by the
  parameter and not by the data, are the model that the scoring tasks get.
* Selection (``kth_key``): keys are columns of longs, read as digits of ``DIGIT`` bits from the highest bit that differs. A round counts the rows by digit
  within the digits found so far (at most 65,536 counts come back), so the k-th key is found exactly, without sorting and without moving a row.
* Only rows up to that key are ranged, sorted and ranked, by the number of rows in the ranges before; the others get no rank. Nothing is joined.

Defined cases: a null or wordless text has no features, weight 0, and isn't eligible (unless ``least_words`` is 0); a very long text is split in
pieces; ties of a score go to the smaller doc_id (null last), then to fewer features; rows that agree in all of that are told apart by a number
given when scores are written, so repeated rows are drawn one by one; a null doc_id hashes as an empty one; an empty corpus gives no rows; an
empty target gives gains against a uniform one; other columns are ignored, whatever they are called.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvina.llm._base import Scratch

#: What each byte becomes: a separator a space, a capital a small letter, the rest itself.
_AS = bytes(b if chr(b).isdigit() or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
#: Bytes of a text that are split at a time, unless one word is longer.
PIECE = 1 << 20
#: Bits of a digit.
DIGIT = 16
_LOW = -(1 << 63)


def word_lists(text: bytes, piece: int = PIECE) -> Iterator[list[bytes]]:
    """The words of a text in order, a long one's in several lists."""
    text, at = text.translate(_AS), 0
    while len(text) - at > piece:
        cut = text.find(b" ", at + piece)
        if cut < 0:
            break
        yield text[at:cut].split()
        at = cut
    yield text[at:].split()


def feature_buckets(text: bytes, n: int, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(words, buckets of the runs that end in them) for each list of words."""
    before: list[bytes] = []
    for words in word_lists(text):
        hashes = list(map(zlib.crc32, words))
        both = before + words
        for k in range(2, n + 1):
            first = max(k - 1, len(before))  # the first word here that ends a run of k
            hashes += [zlib.crc32(b" ".join(both[i - k + 1 : i + 1])) for i in range(first, len(both))]
        before = both[len(both) - n + 1 :] if n > 1 else []
        yield len(words), np.array(hashes, np.int64) % buckets


def texts_of(batch: pa.RecordBatch) -> Iterator[bytes]:
    for x in batch.column("text").cast(pa.large_binary()):
        yield x.as_py() or b""


def bucket_counts(docs: DataFrame, n: int, buckets: int) -> DataFrame:
    """bucket, n: how many features of all texts fall into it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in texts_of(batch):
                for _, b in feature_buckets(text, n, buckets):
                    seen += np.bincount(b, minlength=buckets)
        there = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(seen[there])], names=["bucket", "n"])

    return docs.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: dict[int, int], target: dict[int, int], buckets: int) -> list[int]:
    """Thousandths of the log ratio of the two smoothed shares of each bucket, rounded down."""
    s, t = float(sum(raw.values()) + buckets), float(sum(target.values()) + buckets)
    return [math.floor(1000 * math.log((target.get(b, 0) + 1) * s / ((raw.get(b, 0) + 1) * t))) for b in range(buckets)]


def weights(docs: DataFrame, gain: list[int], n: int) -> DataFrame:
    """doc_id, n_words, n_features, weight of each row."""
    table = np.array(gain, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in texts_of(batch):
                words = features = total = 0
                for w, b in feature_buckets(text, n, len(table)):
                    words, features, total = words + w, features + len(b), total + int(table[b].sum())
                rows.append((words, features, total // features if features else 0))
            columns = [pa.array(c, pa.int64()) for c in (zip(*rows) if rows else ((), (), ()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, rounded down, from a hash of the id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def kth_key(rows: DataFrame, columns: list[str], k: int) -> list[tuple[str, int]]:
    """Bounds (column, value) such that exactly ``k`` rows are at or below them, columns compared in order, smallest first.

    There are at least k rows, k is 1 or more, and no two rows agree in all columns. The list ends early where a tie needn't be broken.
    """
    bounds, at, need = [], rows, k
    for c in columns:
        low, high, n = at.agg(F.min(c), F.max(c), F.count(F.lit(1))).first()
        if n == need:
            return [*bounds, (c, high)]
        # as unsigned numbers, so that shifts cut digits
        u = F.col(c).bitwiseXOR(F.lit(_LOW))
        width = ((low - _LOW) ^ (high - _LOW)).bit_length()
        prefix = (low - _LOW) >> width
        while width:
            shift = max(0, width - DIGIT)
            within = at if width == 64 else at.where(F.shiftrightunsigned(u, width) == prefix)
            digit = F.shiftrightunsigned(u, shift).bitwiseAND(F.lit((1 << (width - shift)) - 1))
            for d, m in sorted(map(tuple, within.groupBy(digit.alias("d")).agg(F.count(F.lit(1)).alias("n")).collect())):
                if need <= m:
                    break
                need -= m
            prefix, width = (prefix << (width - shift)) | d, shift
            if need == m:
                return [*bounds, (c, ((prefix + 1) << width) - 1 + _LOW)]
        bounds.append((c, prefix + _LOW))
        at = at.where(F.col(c) == prefix + _LOW)
    return bounds


def up_to(bounds: list[tuple[str, int]]) -> Column:
    """Whether a row is at or below the bounds."""
    (c, v), *rest = bounds
    return (F.col(c) < v) | ((F.col(c) == v) & up_to(rest)) if rest else F.col(c) <= v


def ranked(rows: DataFrame, columns: list[str], scratch: Scratch, name: str = "rank") -> DataFrame:
    """rows with their place in the order of the columns, from 1: ranged, sorted, and numbered from the sizes of the ranges before."""
    placed = scratch.save(rows.repartitionByRange(*columns).sortWithinPartitions(*columns).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes, before, offset = sorted(map(tuple, placed.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())), {}, 0  # a row a task
    for p, n in sizes:
        before[p], offset = offset, offset + n
    starts = F.broadcast(rows.sparkSession.createDataFrame(list(before.items()), "_part long, _before long"))
    out = placed.withColumn("_part", part).join(starts, "_part")
    return out.withColumn(name, F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_at", "_part", "_before")


def resample(docs: DataFrame, target: DataFrame, scratch: Scratch, n: int = 1, buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: int = 2024) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every row of ``docs`` (doc_id, text); the rank is null for what isn't drawn.

    target: text. Drawn are ``percent`` of 100 of the documents with at least ``least_words`` words, rounded down.
    """
    counts = [{r.bucket: r.n for r in bucket_counts(t, n, buckets).collect()} for t in (docs, target)]  # at most ``buckets`` rows each
    scored = weights(docs, gains(*counts, buckets), n).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    # the selection's key, smallest first
    keys = {"_score": -F.col("score"), "_null": F.col("doc_id").isNull().cast("long"), "_id": F.coalesce("doc_id", F.lit(0)), "_features": F.col("n_features"), "_row": F.monotonically_increasing_id()}
    table = scratch.save(scored.withColumns(keys))
    eligible = F.col("n_words") >= least_words
    k = table.where(eligible).count() * percent // 100
    columns = ["doc_id", "n_words", "n_features", "weight", "score"]
    none = F.lit(None).cast("long").alias("rank")
    if not k:
        return table.select(*columns, none)
    drawn = eligible & up_to(kth_key(table.where(eligible), list(keys), k))
    first = ranked(table.where(drawn), list(keys), scratch)
    return first.select(*columns, "rank").unionByName(table.where(~drawn).select(*columns, none))
