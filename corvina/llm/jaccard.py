"""Exact Jaccard join on word shingles with set-relation skipping, and the groups that its links form.

A set is a document's distinct k-word shingles, as 64-bit hashes. The plan, none of whose steps gathers a key in one task:

1. One pass over the texts gives each set's size and 128-bit fingerprint, and the load of ``buckets`` hashed buckets of
   shingles over all documents. Equal sets become one class (a minimum by fingerprint, combined before the shuffle).
2. Shingles are ordered by their bucket's load above chance, then by hash. Any fixed order gives the same links; this
   one puts widespread shingles last, so index lists are short. A second pass writes each set's prefix in that order:
   two sets at the threshold share a shingle of their prefixes; and the set's parities, a bit for each bucket of about as many as it
   has shingles, whether the bucket holds an odd number of them.
3. The index has a list of (set, size, position) by shingle; lists of one class go, and of lists of the same sets one stays. A list falls
   into blocks by position: the first shingle that two sets share must leave enough after it in both, so a set far back in its own prefix
   skips the whole back block of the list, by the join's key, and other entries by size and position. A pair that is met is then skipped,
   before any set is read, if the parities of the two differ in more buckets than the shingles that may differ.
4. Groups. In each round a list's few leaders are compared with its other sets, links join components, and what a leader has
   answered stays: the leader leaves the list, and sets that are already in one component through it need no comparison with
   each other, however many they are. Lists left with one component end. Rounds take 64 times as many leaders each until no
   list is left, so no pair is dropped that could join two components.
5. All links (``groups(..., counts=True)``), as both ends of a link lie in one component. A component's sets are compared with its
   smallest one, the pivot, and written as the differences to it; the answers of each are derived from those of the pivot. With
   |P| shingles in the pivot, d of them missing and a others present, two sets share |P| - d1 - d2 at least and |P| - max(d1, d2) + min(a1, a2)
   at most. Sets of like d and a form a cell; for most pairs of cells these bounds decide at once for all their sets, whose links are the
   cells' sums. For the rest the shared part is |P| - d1 - d2 + |D1 & D2|, from the differences D, in blocks of sets, each two blocks
   a group of its own, which returns a number for each set, not pairs. Components in which the lists meet fewer pairs than it has
   (chains) take the pairs that the lists meet instead, checked as in step 3.

Verified links decide: 100 * |A & B| >= percent * |A | B|. A link with a class counts once for each of its documents.

Defined cases: null or wordless texts have the empty set and link with nothing; fewer than k words make one shingle of
all; rows that repeat a doc_id count as one document (the union of links), and where their sets differ, each set is compared under an
id of its own above all doc_ids, and has its own n_links; a null doc_id links with nothing; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvina.llm._base import Scratch, hint, n_rows, small
from corvina.llm._bytes import mix, shingle_sets
from corvina.llm.components import components

FINGERPRINTS = "kind int, doc_id long, n long, f1 long, f2 long"


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    return int(mix(s + np.uint64(1)).sum(dtype=np.uint64).view(np.int64)), int(mix(s ^ np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64).view(np.int64))


def fingerprints(k: int, buckets: int):
    """Rows of kind 0: a document's id, set size, fingerprint. Rows of kind 1: a bucket and its shingles in this partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        load = np.zeros(buckets, np.int64)
        for batch in batches:
            n, f1, f2 = [], [], []
            for _, sets in shingle_sets(batch.column("text"), k):
                for s in sets:
                    n.append(len(s))
                    x, y = fingerprint(s)
                    f1.append(x)
                    f2.append(y)
                if sets:
                    load += np.bincount((np.concatenate(sets) % np.uint64(buckets)).astype(np.int64), minlength=buckets)
            yield pa.RecordBatch.from_arrays([pa.array([0] * len(n), pa.int32()), batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64())], names=["kind", "doc_id", "n", "f1", "f2"])
        b = np.flatnonzero(load)
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(b), np.int32)), pa.array(b), pa.array(load[b]), pa.nulls(len(b), pa.int64()), pa.nulls(len(b), pa.int64())], names=["kind", "doc_id", "n", "f1", "f2"])

    return run


def least_overlap(size, percent: int):
    """The smallest number of shingles that a set of this size shares with any set that links with it."""
    return -(-size * percent // 100)


PREFIX = "doc_id long, n long, f1 long, f2 long, bits array<long>, prefix array<long>"
#: Buckets of the parities, at least and at most.
NARROW, WIDE = 1 << 9, 1 << 15


def parities(s: np.ndarray) -> np.ndarray:
    """For each bucket whether it holds an odd number of the set, 64 to a long; a power of two of buckets, at least the set's size."""
    width = min(max(NARROW, 1 << max(len(s) - 1, 0).bit_length()), WIDE)
    odd = np.bincount(((s >> np.uint64(40)) & np.uint64(width - 1)).astype(np.int64), minlength=width).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").view(np.int64)


#: The buckets in which the parities of a and b differ: no more than the shingles that only one of them has. The wider is folded.
APART = """case when size(a_bits) = size(b_bits) then aggregate(zip_with(a_bits, b_bits, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x)
  when size(a_bits) = 2 * size(b_bits) then aggregate(transform(b_bits, (y, i) -> bit_count(y ^ a_bits[i] ^ a_bits[i + size(b_bits)])), 0, (s, x) -> s + x)
  when size(b_bits) = 2 * size(a_bits) then aggregate(transform(a_bits, (x, i) -> bit_count(x ^ b_bits[i] ^ b_bits[i + size(a_bits)])), 0, (s, x) -> s + x)
  else 0 end"""


def listed(parts: list[np.ndarray]) -> pa.ListArray:
    """A list column, a row for each part."""
    return pa.ListArray.from_arrays(np.cumsum([0, *map(len, parts)]).astype(np.int32), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64)))


def prefixes(k: int, heat: np.ndarray, percent: int):
    """PREFIX: the first n - least_overlap + 1 shingles in the order by (heat, hash)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, sets in shingle_sets(batch.column("text"), k):
                out = []
                for s in sets:
                    h = heat[(s % np.uint64(len(heat))).astype(np.int64)]
                    order = np.argsort(h, kind="stable")[: len(s) - least_overlap(len(s), percent) + 1 if len(s) else 0]
                    out.append(s[order].view(np.int64))
                prints = [fingerprint(s) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(row, len(out)), pa.array([len(s) for s in sets], pa.int64()), *[pa.array([f[i] for f in prints], pa.int64()) for i in (0, 1)], listed([parities(s) for s in sets]), listed(out)],
                    names=["doc_id", "n", "f1", "f2", "bits", "prefix"],
                )

    return run


MEMBERS = "doc_id long, n long, f1 long, f2 long, members array<long>"


def whole_sets(k: int):
    """MEMBERS: doc_id, size, fingerprint and the sorted set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, sets in shingle_sets(batch.column("text"), k):
                prints = [[len(s), *fingerprint(s)] for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(row, len(sets)), *[pa.array([f[i] for f in prints], pa.int64()) for i in range(3)], listed([s.view(np.int64) for s in sets])],
                    names=["doc_id", "n", "f1", "f2", "members"],
                )

    return run


def heat_of(load: np.ndarray) -> np.ndarray:
    """The order's first key: 0 for a load that chance explains (six deviations above the mean), then growing with the excess."""
    over = load - (load.mean() + 6 * np.sqrt(load.mean()) + 16)
    return np.where(over > 0, 1 + np.log2(np.maximum(over, 1)), 0).astype(np.uint8)


class Linked(NamedTuple):
    """Written tables: doc_id, n, set_id; doc_id, rep; a, b; id, component; the index: token, doc_id, n, pos; doc_id, n, bits.

    own: doc_id, n, f1, f2, set_id of documents that have several sets, or None. Elsewhere a set_id stands for their doc_id.
    """

    sizes: DataFrame
    copies: DataFrame
    found: DataFrame
    comp: DataFrame
    index: DataFrame
    bits: DataFrame
    own: DataFrame | None


KEY = ["n", "f1", "f2"]


def several(filled: DataFrame, scratch: Scratch) -> DataFrame | None:
    """The sets of documents that have more than one, each with an id above all doc_ids."""
    ranges = [f(c).alias(f"{c}_{i}") for c in KEY for i, f in enumerate((F.min, F.max))]
    many = scratch.save(filled.groupBy("doc_id").agg(*ranges).where(" or ".join(f"{c}_0 < {c}_1" for c in KEY)).select("doc_id"))
    if many.isEmpty():
        return None
    sets = scratch.save(filled.join(small(many), "doc_id").select("doc_id", *KEY).distinct())
    return scratch.save(sets.withColumn("set_id", F.monotonically_increasing_id()))


def named(rows: DataFrame, own: DataFrame | None, name: str = "doc_id") -> DataFrame:
    """The rows (doc_id, n, f1, f2, ...) with a set's own id, if it has one, as ``name``."""
    if own is None:
        return rows.withColumn(name, F.col("doc_id"))
    return rows.join(hint(own)(own), ["doc_id", *KEY], "left").withColumn(name, F.coalesce("set_id", "doc_id")).drop(*{"set_id"} - {name})


def members_of(docs: DataFrame, ids: DataFrame, own: DataFrame | None, k: int) -> DataFrame:
    """doc_id (or set_id) and members of the sets with these ids (a written table)."""
    sets = lambda wanted: docs.join(small(wanted), "doc_id", "left_semi").mapInArrow(whole_sets(k), MEMBERS)
    if own is None:
        return sets(ids).select("doc_id", "members")
    texts = ids.union(own.join(ids.withColumnRenamed("doc_id", "set_id"), "set_id", "left_semi").select("doc_id")).distinct()
    return named(sets(texts), own).join(small(ids), "doc_id", "left_semi").select("doc_id", "members")


def links(docs: DataFrame, scratch: Scratch, k: int = 5, percent: int = 80, buckets: int = 1 << 17) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(documents: doc_id, n; copies: doc_id, rep; links between representatives: a, b; their components: id, component), written tables."""
    at = linked(docs, scratch, k, percent, buckets)
    return at.sizes.select("doc_id", "n"), at.copies, at.found, at.comp


def linked(docs: DataFrame, scratch: Scratch, k: int, percent: int, buckets: int = 1 << 17) -> Linked:
    """The documents, their classes, the links that hold the components, and what they were found with.

    rep is the smallest id with an equal set; copies has the other ids. ``buckets`` numbers are held by driver and workers.
    """
    spark, docs = docs.sparkSession, docs.select(F.col("doc_id").cast("long"), "text")
    first = scratch.save(docs.mapInArrow(fingerprints(k, buckets), FINGERPRINTS))
    load = np.zeros(buckets, np.int64)
    for b, n in first.where("kind = 1").groupBy("doc_id").agg(F.sum("n")).collect():  # one row for each bucket
        load[b] = n
    heat = heat_of(load)

    filled, key = first.where("kind = 0 and n > 0 and doc_id is not null"), KEY
    own = several(filled, scratch)
    if own is not None:
        top = first.where("kind = 0").agg(F.max("doc_id")).first()[0]
        own = scratch.save(own.withColumn("set_id", F.col("set_id") + F.lit(top) + 1))
    sizes = named(first.where("kind = 0").drop("kind"), own, "set_id").select("doc_id", "n", "set_id")
    filled = named(filled, own)
    classes = scratch.save(filled.groupBy(*key).agg(F.min("doc_id").alias("rep"), F.count("*").alias("size")).where("size > 1"))
    copies = scratch.save(filled.join(classes, key).where("doc_id <> rep").select("doc_id", "rep").distinct())
    # equal rows of a representative: each set is to be in a list once, as hashes of what is in it twice cancel
    twice = scratch.save(filled.join(classes, key).where("doc_id = rep").groupBy("doc_id", *key).agg(F.count("*").alias("rows")).where("rows > 1").drop("rows"))

    head = named(docs.where("doc_id is not null").mapInArrow(prefixes(k, heat, percent), PREFIX).where("n > 0"), own)
    prefix = scratch.save(head.join(small(copies.select("doc_id").distinct()), "doc_id", "left_anti"))
    if n_rows(twice):
        near, again = hint(twice), prefix
        once = again.join(near(twice), ["doc_id", *key], "left_semi").dropDuplicates(["doc_id", *key])
        prefix = scratch.save(again.join(near(twice), ["doc_id", *key], "left_anti").unionByName(once))
        scratch.drop(again)
    shared = scratch.save(prefix.select(F.explode("prefix").alias("token")).groupBy("token").agg(F.count("*").alias("c")).where("c > 1").select("token"))
    entries = scratch.save(prefix.select("doc_id", "n", F.posexplode("prefix").alias("pos", "token")).join(small(shared, 2_000_000), "token"))
    same = entries.groupBy("token").agg(F.count("*").alias("c"), F.bit_xor(F.xxhash64("doc_id")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "doc_id")).alias("y"), F.min(F.struct("doc_id", "pos")).alias("at"))
    # of equal lists the one whose shingle comes first in the order, in one set as in all others
    lists = scratch.save(same.groupBy("c", "x", "y").agg(F.min(F.struct("at.pos", "token")).alias("f")).select("f.token"))
    whole = scratch.save(entries.join(hint(lists)(lists), "token").select("token", "doc_id", "n", "pos"))
    bits = scratch.save(prefix.select("doc_id", "n", "bits").join(whole.select("doc_id").distinct(), "doc_id", "left_semi"))
    scratch.drop(shared, prefix, entries, lists, classes, twice)

    found, comp, leaders = None, None, 1
    index = scratch.save(whole.select("*", F.col("doc_id").alias("comp")))
    while True:
        alive = scratch.save(index.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("token"))
        if not n_rows(alive):
            scratch.drop(alive, index)
            break
        held = index.join(hint(alive)(alive), "token")
        # leaders: of each of so many classes by hash, a list's smallest id
        slot = F.pmod(F.xxhash64("doc_id", F.lit(leaders)), F.lit(leaders))
        first_of = held.groupBy("token", slot.alias("slot")).agg(F.min(F.struct("doc_id", "n", "pos", "comp")).alias("l"))
        lead = scratch.save(first_of.select("token", F.col("l.doc_id").alias("a"), F.col("l.n").alias("an"), F.col("l.pos").alias("apos"), F.col("l.comp").alias("acomp")))
        met = meetings(lead, held, percent, hint(lead)).where("acomp <> comp and a <> doc_id")
        pairs = scratch.save(possible(met.select(F.least("a", "doc_id").alias("a"), F.greatest("a", "doc_id").alias("b")).distinct(), bits, percent))
        new = None if not n_rows(pairs) else verified(pairs, docs, scratch, k, percent, own)
        if new is not None and n_rows(new):
            before, gone = comp, [new, *([] if found is None else [found])]
            found = scratch.save(new if found is None else found.union(new))
            comp = scratch.save(components(found, scratch))
            scratch.drop(*gone, *([] if before is None else [before]))
        left = held.join(hint(lead)(lead.select("token", F.col("a").alias("doc_id"))), ["token", "doc_id"], "left_anti")
        if comp is not None:
            left = left.drop("comp").join(hint(comp)(comp.withColumnRenamed("id", "doc_id")), "doc_id", "left").select("token", "doc_id", "n", "pos", F.coalesce("component", "doc_id").alias("comp"))
        old, index = index, scratch.save(left)
        scratch.drop(old, alive, lead, pairs)
        leaders *= 64
    if found is None:
        found, comp = scratch.save(spark.createDataFrame([], "a long, b long")), scratch.save(spark.createDataFrame([], "id long, component long"))
    return Linked(sizes, copies, found, comp, whole, bits, own)


def fits(percent: int) -> str:
    """Nothing is shared before the first shingle that two sets share, so that one leaves enough after it in both."""
    return f"100 * least(an, n) >= {percent} * greatest(an, n) and least(an - apos, n - pos) >= {needed('an + n', percent)}"


def needed(both: str, percent: int) -> str:
    """The shingles that two sets of so many together share at least if they link."""
    return f"(({both}) * {percent} + {99 + percent}) div {100 + percent}"


def meetings(lead: DataFrame, index: DataFrame, percent: int, near=lambda df: df, on: tuple[str, ...] = ("token",)) -> DataFrame:
    """The leaders (a, an, apos) with the entries of their lists that ``fits`` doesn't rule out; of a list only the blocks that may hold some.

    A list has a front block and a back block: an entry is in the back if fewer shingles follow it than it must share with a set of its own size.
    Then it links with larger sets only, so two entries of the back never fit: a leader of the back asks the front block alone.
    """
    back = lambda n, pos: F.expr(f"{pos} * {100 + percent} > {n} * {100 - percent}")
    asked = lead.withColumn("back", F.explode(F.when(back("an", "apos"), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))))
    return index.withColumn("back", back("n", "pos")).join(near(asked), [*on, "back"]).where(fits(percent))


def possible(met: DataFrame, bits: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that the parities don't rule out."""
    near = hint(bits)
    one, two = (bits.select(F.col("doc_id").alias(x), F.col("n").alias(f"{x}_n"), F.col("bits").alias(f"{x}_bits")) for x in "ab")
    return met.join(near(one), "a").join(near(two), "b").where(f"{APART} <= a_n + b_n - 2 * ({needed('a_n + b_n', percent)})").select("a", "b")


#: Pairs of one set that one task takes.
PART = 64


def dealt_out(pairs: DataFrame, members: DataFrame, x: str, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The pairs and the sets with a part to join by, too: a set that has many pairs stands once in each of so many parts."""
    busy = scratch.save(pairs.groupBy(x).agg(F.count("*").alias("c")).where(f"c > {PART}").select(x, F.expr(f"(c + {PART - 1}) div {PART}").alias("parts")))
    other = "b" if x == "a" else "a"
    parted = pairs.join(hint(busy)(busy), x, "left").withColumn(f"{x}_part", F.coalesce(F.pmod(F.xxhash64(other), "parts"), F.lit(0))).drop("parts")
    each = members.withColumnRenamed("doc_id", x).join(hint(busy)(busy), x, "left")
    return parted, each.withColumn(f"{x}_part", F.explode(F.expr("sequence(0L, coalesce(parts, 1L) - 1)"))).drop("parts"), busy


def verified(pairs: DataFrame, docs: DataFrame, scratch: Scratch, k: int, percent: int, own: DataFrame | None) -> DataFrame:
    """The pairs whose sets, made anew from the texts of the documents in question, reach the threshold; a written table."""
    ids = scratch.save(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct())
    members = scratch.save(members_of(docs, ids, own, k))
    parted, at_a, busy_a = dealt_out(pairs, members.withColumnRenamed("members", "x"), "a", scratch)
    parted, at_b, busy_b = dealt_out(parted, members.withColumnRenamed("members", "y"), "b", scratch)
    both = at_b.join(hint(pairs)(parted), ["b", "b_part"]).join(at_a, ["a", "a_part"])
    both = both.select("a", "b", F.size("x").alias("x"), F.size("y").alias("y"), F.size(F.array_intersect("x", "y")).alias("i"))
    out = scratch.save(both.where(f"100 * cast(i as long) >= {percent} * cast(x + y - i as long)").select("a", "b").distinct())
    scratch.drop(ids, members, busy_a, busy_b)
    return out


#: Sets of a block, and shingles that two blocks are compared by at a time.
BLOCK, WIDTH = 128, 8192
#: Cells are so many parts of the pivot wide, and at most so many by d and by a: a bound of the pairs of cells.
FINE, CELLS = 50, 16
#: Of a cell: the least and the most shingles of the pivot that a set lacks, of others that it has, and of all.
CELL = ("d0", "d1", "a0", "a1", "n0", "n1")


def derived(docs: DataFrame, scratch: Scratch, dense: DataFrame, own: DataFrame | None, k: int) -> DataFrame:
    """doc_id, component, size, p (shingles of the pivot), n, d, cd, ca (the cell), change (the shingles that the pivot has or the set, but not both)."""
    sets = scratch.save(members_of(docs, dense.select("doc_id"), own, k).join(hint(dense)(dense), "doc_id"))
    parts = F.expr(f"(m + {PART - 1}) div {PART}")
    pivots = sets.where("doc_id = component").select("component", F.col("members").alias("pivot"), F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"))
    both = sets.withColumn("part", F.pmod(F.xxhash64("doc_id"), parts)).join(pivots, ["component", "part"])
    lacks, has = F.array_except("pivot", "members"), F.array_except("members", "pivot")
    out = both.select("doc_id", "component", "size", F.size("pivot").cast("long").alias("p"), F.size("members").cast("long").alias("n"), lacks.alias("lacks"), has.alias("has"))
    cell = lambda c: F.least(F.lit(CELLS - 1).cast("long"), F.expr(f"cast(size({c}) as long) div greatest(1, p div {FINE})"))
    out = out.select("doc_id", "component", "size", "p", "n", F.size("lacks").cast("long").alias("d"), cell("lacks").alias("cd"), cell("has").alias("ca"), F.concat("lacks", "has").alias("change"))
    out = scratch.save(out.dropDuplicates(["doc_id"]))
    scratch.drop(sets)
    return out


def bounds(percent: int, x: str, y: str) -> tuple[str, str]:
    """Whether all sets of two cells link, and whether none do."""
    surely = f"(p - {x}d1 - {y}d1) * {100 + percent} >= {percent} * ({x}n1 + {y}n1)"
    never = f"(p - greatest({x}d0, {y}d0) + least({x}a1, {y}a1)) * {100 + percent} < {percent} * ({x}n0 + {y}n0)"
    return surely, never


def cells(sets: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """component, cd, ca, CELL, w (documents in the sets that each set of the cell surely links with), itself (whether the cell's own are
    among them), open (whether there are sets that the bounds leave open)."""
    a = F.expr("n - p + d")
    cell = scratch.save(sets.groupBy("component", "cd", "ca").agg(F.first("p").alias("p"), F.sum("size").alias("size"), *[f(c).alias(name) for name, (f, c) in zip(CELL, ((f, c) for c in (F.col("d"), a, F.col("n")) for f in (F.min, F.max)))]))
    other = cell.select("component", "size", "cd", "ca", *CELL).withColumnsRenamed({c: f"o_{c}" for c in ("size", "cd", "ca", *CELL)})
    surely, never = bounds(percent, "", "o_")
    met = cell.join(hint(cell)(other), "component").withColumns({"surely": F.expr(surely), "never": F.expr(never)})
    own = F.col("surely") & (F.col("cd") == F.col("o_cd")) & (F.col("ca") == F.col("o_ca"))
    verdict = met.groupBy("component", "cd", "ca", *CELL).agg(F.sum(F.when(F.col("surely"), F.col("o_size")).otherwise(0)).alias("w"), F.bool_or(own).alias("itself"), F.bool_or(F.expr("not surely and not never")).alias("open"))
    out = scratch.save(verdict)
    scratch.drop(cell)
    return out


def compared(percent: int):
    """The sets of one or two blocks of a component, as changes to its pivot: each one's number of documents in the sets that it links with,
    of the pairs that their cells leave open. Of two blocks, only across."""

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        ids, size, n, d, block, p = (t[c].to_numpy() for c in ("doc_id", "size", "n", "d", "block", "p"))
        d0, d1, a0, a1, n0, n1 = (t[c].to_numpy() for c in CELL)
        both = n[:, None] + n[None, :]
        surely = (p[0] - d1[:, None] - d1[None, :]) * (100 + percent) >= percent * (n1[:, None] + n1[None, :])
        never = (p[0] - np.maximum(d0[:, None], d0[None, :]) + np.minimum(a1[:, None], a1[None, :])) * (100 + percent) < percent * (n0[:, None] + n0[None, :])
        open_ = ~surely & ~never & (block[:, None] != block[None, :] if t["lo"][0].as_py() < t["hi"][0].as_py() else ~np.eye(len(ids), dtype=bool))
        links = np.zeros(len(ids), np.int64)
        if open_.any():
            sets = t["change"].combine_chunks()
            owner = np.repeat(np.arange(len(ids)), sets.value_lengths().to_numpy().astype(np.int64))
            _, token, held = np.unique(sets.flatten().to_numpy(), return_inverse=True, return_counts=True)
            several = held > 1
            owner, token = owner[several[token]], (np.cumsum(several) - 1)[token[several[token]]]
            order = np.argsort(token, kind="stable")
            owner, token = owner[order], token[order]
            common = p[0] - d[:, None] - d[None, :]
            for at in range(0, int(several.sum()), WIDTH):
                lo, hi = np.searchsorted(token, [at, at + WIDTH])
                x = np.zeros((len(ids), min(WIDTH, int(several.sum()) - at)), np.float32)
                x[owner[lo:hi], token[lo:hi] - at] = 1
                common += (x @ x.T).astype(np.int64)
            links = (open_ & (100 * common >= percent * (both - common))) @ size
        return pa.table({"doc_id": pa.array(ids), "links": pa.array(links, pa.int64())})

    return run


def link_counts(docs: DataFrame, scratch: Scratch, at: Linked, k: int, percent: int, block: int = BLOCK) -> DataFrame:
    """rep, n_links of each document of its class: for representatives that have links or copies."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    sizes = scratch.save(at.copies.groupBy("rep").agg((F.count("*") + 1).alias("size")))
    if not n_rows(at.found):  # only copies link
        return scratch.save(sizes.select("rep", (F.col("size") - 1).alias("n_links")))
    comp = at.comp.select(F.col("id").alias("doc_id"), "component")
    comp = scratch.save(comp.union(comp.select("component", "component").distinct()))
    held = at.index.join(hint(comp)(comp), "doc_id").groupBy("token", "component").agg(F.count("*").alias("c"))
    met = held.groupBy("component").agg(F.expr("sum(c * (c - 1) div 2)").alias("met"))
    plan = scratch.save(comp.groupBy("component").agg(F.count("*").alias("m")).join(met, "component", "left").select("component", "m", F.expr("m > 2 and m * (m - 1) div 2 <= coalesce(met, 0)").alias("dense")))
    member = comp.join(hint(plan)(plan), "component").join(hint(sizes)(sizes.withColumnRenamed("rep", "doc_id")), "doc_id", "left")
    member = scratch.save(member.select("doc_id", "component", F.coalesce("size", F.lit(1)).alias("size"), "m", "dense"))

    # pairs are known; or are met in lists
    near = hint(member)
    pairs = at.found.join(near(member.where("m = 2").select(F.col("doc_id").alias("a"))), "a", "left_semi").select("a", "b").distinct()
    loose = scratch.save(at.index.join(near(member.where("m > 2 and not dense").select("doc_id", "component")), "doc_id"))
    if n_rows(loose):
        one = loose.select("token", "component", F.col("doc_id").alias("a"), F.col("n").alias("an"), F.col("pos").alias("apos"))
        pair = meetings(one, loose, percent, on=("token", "component")).where("a < doc_id").select("a", F.col("doc_id").alias("b")).distinct()
        pairs = pairs.union(verified(scratch.save(possible(pair, at.bits, percent)), docs, scratch, k, percent, at.own))
    weight, counts = member.select("doc_id", "size"), []
    for x, y in ("ab", "ba"):
        counts.append(pairs.join(near(weight.withColumnRenamed("doc_id", y)), y).select(F.col(x).alias("doc_id"), F.col("size").alias("links")))

    # derived from the pivot: cell by cell, and in blocks what that leaves open
    dense = scratch.save(member.where("dense").select("doc_id", "component", "size", "m"))
    if n_rows(dense):
        sets = derived(docs, scratch, dense, at.own, k)
        cell = cells(sets, scratch, percent)
        known = sets.join(hint(cell)(cell), ["component", "cd", "ca"])
        counts.append(known.select("doc_id", F.expr("w - if(itself, size, 0)").alias("links")))
        undecided = scratch.save(known.where("open").select("doc_id", "component", "size", "p", "n", "d", "change", *CELL))
        if n_rows(undecided):
            blocks = scratch.save(undecided.groupBy("component").agg(F.count("*").alias("u")).select("component", F.expr(f"(u + {block - 1}) div {block}").alias("blocks")))
            each = undecided.join(hint(blocks)(blocks), "component").withColumn("block", F.expr("pmod(xxhash64(doc_id), blocks)")).withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)")))
            each = each.withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")}).drop("blocks", "other")
            counts.append(each.groupBy("component", "lo", "hi").applyInArrow(compared(percent), "doc_id long, links long"))

    total = counts[0]
    for c in counts[1:]:
        total = total.union(c)
    total = total.groupBy("doc_id").agg(F.sum("links").alias("links"))
    both = total.withColumnRenamed("doc_id", "rep").join(sizes, "rep", "full")
    return scratch.save(both.select("rep", (F.coalesce("links", F.lit(0)) + F.coalesce("size", F.lit(1)) - 1).alias("n_links")))


def groups(docs: DataFrame, scratch: Scratch, k: int = 5, percent: int = 80, counts: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id that links reach); with counts, n_links: other documents that it links with."""
    at = linked(docs, scratch, k, percent)
    copies, comp = at.copies, at.comp
    if at.own is not None:  # a document joins what its sets link with
        sets = at.own.select(F.col("doc_id").alias("a"), F.col("set_id").alias("b"))
        equal = copies.join(sets.select(F.col("b").alias("doc_id")), "doc_id", "left_semi").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
        comp = components(at.found.select("a", "b").union(sets).union(equal), scratch)
        copies = copies.join(sets.select(F.col("b").alias("doc_id")), "doc_id", "left_anti")
    comp = comp.select(F.col("id").alias("rep"), "component")
    member = scratch.save(copies.join(comp, "rep", "left").select("doc_id", F.coalesce("component", "rep").alias("component")).union(comp.select(F.col("rep").alias("doc_id"), "component")))
    out, columns = at.sizes.join(member, "doc_id", "left"), ["doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id")]
    if counts:
        n = link_counts(docs, scratch, at, k, percent)
        n = scratch.save(at.copies.join(hint(n)(n), "rep").select(F.col("doc_id").alias("set_id"), "n_links").union(n))
        out = out.join(hint(n)(n), "set_id", "left")
        columns.append(F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return out.select(*columns)
