"""An index that grows: immutable segments, tombstones for replaced documents, size-tiered merges, published snapshots.

A store is a folder: ``segments/<name>`` (postings, docs, vocab, stored: Parquet, written once), ``dead/<name>`` (tombstones, and what they take from
the counts), ``snapshots/<name>`` (what depends on the whole corpus), and ``versions``, the list of what is alive, switched by a rename.

* ``append`` writes new documents as one segment: postings sorted by (term, field, doc_id) in the task that made them, so each file is the index of its
  documents, a query's terms select pages of each, and no posting is shuffled; documents with their lengths; the vocabulary's df and cf; the pages to show. A document that older segments have is replaced: a tombstone names it and its
  segment, and the df and cf of its postings are written as what is to be taken off. Work grows with the new documents (and, for replaced ones,
  with a scan of the older postings), not with the index.
* Counts are additive: df, cf, the number of documents and lengths are sums over segments less what is dead. Idf needs the whole, so it isn't
  in the postings; it is applied when they are read.
* ``merge`` rewrites ``fan`` or more segments of a tier of sizes, or one of which a third is dead, without their dead documents.
* ``publish`` writes what a search needs of the whole corpus (vocabulary with idf, norms, mean lengths) and switches readers to it. Until it commits, and if
  it is killed, the snapshot before answers, from the segments that it was made of.

Two writers: one commits, the other gets ``Conflict`` and starts again from the new version. Repeated doc_ids in one append are one document.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvina.operators.fielded import FieldIndex
from corvina.operators.index import Index, document_norms, idf_smooth, tallied, tf_sublinear, weighed
from corvina.sources.versions import Versions, filesystem, n_bytes, remove

POSTINGS = "field string, term string, doc_id long, tf long, dl long"
DOCS = "doc_id long, lengths map<string, long>"
VOCAB = "field string, term string, df long, cf long"
TOMBS = "segment string, doc_id long"
MINUS = "segment string, field string, term string, df long, cf long"

#: Ids that are sent to every executor.
FEW = 1_000_000


def whole_text(docs: DataFrame, terms: str = "terms") -> DataFrame:
    """doc_id, field, words of documents that have one field."""
    return docs.select("doc_id", F.lit("terms").alias("field"), F.coalesce(terms, F.array().cast("array<string>")).alias("words"))


@dataclass
class Found:
    """What a version holds: names of segments with the numbers of their documents and dead ones, of tombstone files, and of the snapshot."""

    version: int
    segments: dict[str, dict]
    dead: list[str]
    #: Of each table that the segments hold beside their postings: its schema, and the columns it is sorted by.
    tables: dict[str, dict]
    snapshot: str | None = None

    def state(self, published: dict | None) -> dict:
        return {"segments": self.segments, "dead": self.dead, "tables": self.tables, "published": published}


def columns(schema: str) -> list[tuple[str, str]]:
    return [(f.name, f.dataType.simpleString()) for f in T.StructType.fromJson(json.loads(schema))]


class Segments:
    def __init__(self, spark: SparkSession, path: str, fan: int = 4, least_bytes: int = 1 << 20):
        self.spark, self.path, self.fan, self.least_bytes = spark, path.rstrip("/"), fan, least_bytes
        self.versions = Versions(spark, f"{self.path}/versions")

    # --- versions

    def latest(self) -> tuple[Found, dict | None]:
        """The last version, and the published state in it."""
        v, s = self.versions.read()
        return Found(v, s.get("segments", {}), s.get("dead", []), s.get("tables", {})), s.get("published")

    def published(self) -> Found:
        """What readers see."""
        v, s = self.versions.read()
        if not s.get("published"):
            raise ValueError(f"nothing is published at {self.path}")
        p = s["published"]
        return Found(v, p["segments"], p["dead"], p["tables"], p["snapshot"])

    # --- tables of a version

    def _table(self, at: Found, kind: str, schema: str | T.StructType, live: bool) -> DataFrame:
        """The rows of all segments, and each one's ``segment``; without dead documents if ``live``."""
        if not at.segments:
            return self.spark.createDataFrame([], schema).withColumn("segment", F.lit(""))
        tombs, parts = self.tombs(at), []
        for s, told in at.segments.items():
            rows = self.spark.read.schema(schema).parquet(f"{self.path}/segments/{s}/{kind}")
            if live and told["dead"]:
                gone = tombs.where(F.col("segment") == s).select("doc_id")
                rows = rows.join(F.broadcast(gone) if told["dead"] <= FEW else gone, "doc_id", "left_anti")
            parts.append(rows.withColumn("segment", F.lit(s)))
        return reduce(DataFrame.unionByName, parts)

    def tombs(self, at: Found) -> DataFrame:
        """segment and doc_id of what is dead in the segments that are alive."""
        return self._dead(at, "tombs", TOMBS)

    def _dead(self, at: Found, kind: str, schema: str) -> DataFrame:
        if not at.dead:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/dead/{d}/{kind}" for d in at.dead]).where(F.col("segment").isin(list(at.segments)))

    def postings(self, at: Found) -> DataFrame:
        return self._table(at, "postings", POSTINGS, True).where("term is not null")

    def docs(self, at: Found) -> DataFrame:
        return self._table(at, "docs", DOCS, True)

    def table(self, at: Found, kind: str = "stored") -> DataFrame:
        """What the segments hold of documents: the pages to show, or a table made of them."""
        if kind not in at.tables:
            raise ValueError(f"nothing is kept as {kind}")
        return self._table(at, kind, T.StructType.fromJson(json.loads(at.tables[kind]["schema"])), True).drop("segment")

    def lacking(self, rows: DataFrame, at: Found | None = None) -> DataFrame:
        """The rows whose doc_id the store doesn't have."""
        return rows.join(self.docs(at or self.latest()[0]).select("doc_id"), "doc_id", "left_anti")

    def vocabulary(self, at: Found) -> DataFrame:
        """field, term, df, cf: sums over the segments, less what is dead."""
        v = self._table(at, "vocab", VOCAB, False).drop("segment")
        less = self._dead(at, "minus", MINUS).select("field", "term", (-F.col("df")).alias("df"), (-F.col("cf")).alias("cf"))
        if len(at.segments) == 1 and not at.dead:
            return v.select("field", "term", "df", "cf")  # a segment has each once
        both = v.unionByName(less) if at.dead else v
        return both.groupBy("field", "term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf")).where("df > 0")

    # --- writing

    def _describe(self, name: str, docs: DataFrame, vocab: DataFrame) -> dict:
        """Write docs and vocab of a segment whose postings are written; its figures."""
        at = f"{self.path}/segments/{name}"
        docs.write.parquet(f"{at}/docs")
        vocab.write.parquet(f"{at}/vocab")
        return {"docs": self.spark.read.parquet(f"{at}/docs").count(), "dead": 0, "bytes": n_bytes(self.spark, f"{at}/postings")}

    def _write_postings(self, postings: DataFrame, path: str) -> DataFrame:
        """Postings by term, then field, in each file: what is compared first tells rows apart. They stay with the task that made them."""
        rows = postings.select(*[c.split()[0] for c in POSTINGS.split(", ")])
        rows.sortWithinPartitions("term", "field", "doc_id").write.parquet(path)
        return self.spark.read.schema(POSTINGS).parquet(path)

    def _count(self, words: DataFrame, name: str) -> dict:
        """Postings, docs and vocab of a segment. Texts are analysed once: terms are counted where the text is, and written there.

        Lengths tell whether several rows are one document's: its counts exceed the length of any. Only then are postings added up, which shuffles them.
        """
        path, draft = f"{self.path}/segments/{name}/postings", f"{self.path}/drafts/{name}"
        counted = words.select("doc_id", "field", F.size("words").cast("long").alias("dl"), "words").select("doc_id", "field", "dl", F.explode_outer(tallied("words")).alias("t"))
        postings = self._write_postings(counted.select("field", "t.term", "doc_id", F.coalesce("t.tf", F.lit(0)).alias("tf"), "dl"), path)
        lengths = postings.groupBy("doc_id", "field").agg(F.max("dl").alias("dl"), F.sum("tf").alias("n"))
        lengths.write.parquet(f"{draft}/lengths")
        lengths = self.spark.read.parquet(f"{draft}/lengths")
        if not lengths.where("n > dl").isEmpty():
            fs, at = filesystem(self.spark, path)
            fs.rename(at, filesystem(self.spark, f"{draft}/postings")[1])
            rows = self.spark.read.schema(POSTINGS).parquet(f"{draft}/postings")
            postings = self._write_postings(rows.groupBy("field", "term", "doc_id").agg(F.sum("tf").alias("tf"), F.max("dl").alias("dl")), path)
        docs = lengths.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("field", "dl"))).alias("lengths"))
        told = self._describe(name, docs, postings.where("term is not null").groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf")))
        remove(self.spark, draft)
        return told

    def append(self, words: DataFrame | Callable[[DataFrame], DataFrame], stored: DataFrame | None = None, anew: bool = False, tables: Mapping[str, tuple[Callable[[DataFrame], DataFrame], list[str]]] | None = None) -> int:
        """Commit documents as a segment; those that are there already are replaced. Returns the version.

        words: doc_id, field, words (array), a row for each field of a document; a document without words has a row with an empty array. Or a function that makes
        them from ``stored`` as it was written: doc_id and what is shown of a document. tables: other tables with a doc_id, by name: what makes them of ``stored``, and the
        columns by which they are ranged and sorted. Tables have the same columns in all appends. anew: the new segment is all that the store holds from then on.
        """
        at, published = self.latest()
        name = uuid.uuid4().hex[:12]
        kept: dict[str, dict] = {}
        if stored is not None:
            there = self._keep(stored, name, "stored", ["doc_id"], kept, ranged=False)
            for kind, (make, by) in (tables or {}).items():
                self._keep(make(there), name, kind, by, kept)
            words = words(there) if callable(words) else words
        if at.segments and not anew and {k: columns(t["schema"]) for k, t in kept.items()} != {k: columns(t["schema"]) for k, t in at.tables.items()}:
            raise ValueError("what is stored has other columns than what is there")
        new = {name: self._count(words, name)}
        if anew:
            at = Found(at.version, {}, [], {})
        elif at.segments:
            at = self._bury(at, self.spark.read.parquet(f"{self.path}/segments/{name}/docs").select("doc_id"))
        return self.versions.commit(at.version, Found(at.version, at.segments | new, at.dead, kept).state(published))

    def _keep(self, table: DataFrame, segment: str, kind: str, by: list[str], kept: dict[str, dict], ranged: bool = True) -> DataFrame:
        """Write a table of a segment, and note it. ranged=False: rows stay with the task that makes them, for finding ranges would make them twice."""
        path = f"{self.path}/segments/{segment}/{kind}"
        (table.repartitionByRange(*by) if ranged else table).sortWithinPartitions(*by).write.parquet(path)
        kept[kind] = {"schema": table.schema.json(), "by": by}
        return self.spark.read.schema(table.schema).parquet(path)

    def delete(self, ids: DataFrame) -> int:
        """Commit that the documents with these doc_ids are gone."""
        at, published = self.latest()
        return self.versions.commit(at.version, self._bury(at, ids.select("doc_id")).state(published))

    def _bury(self, at: Found, ids: DataFrame) -> Found:
        """The version with tombstones for these documents, where they are alive."""
        name = uuid.uuid4().hex[:12]
        folder = f"{self.path}/dead/{name}"
        self.docs(at).join(ids.distinct(), "doc_id", "left_semi").select("segment", "doc_id").write.parquet(f"{folder}/tombs")
        tombs = self.spark.read.schema(TOMBS).parquet(f"{folder}/tombs")
        dead = {r.segment: r.n for r in tombs.groupBy("segment").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a segment
        if not dead:
            remove(self.spark, folder)
            return at
        hit = Found(at.version, {s: at.segments[s] for s in dead}, at.dead, at.tables)
        those = self.postings(hit).join(F.broadcast(tombs) if sum(dead.values()) <= FEW else tombs, ["segment", "doc_id"], "left_semi")
        those.groupBy("segment", "field", "term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf")).write.parquet(f"{folder}/minus")
        segments = {s: d | {"dead": d["dead"] + dead.get(s, 0)} for s, d in at.segments.items()}
        return Found(at.version, segments, [*at.dead, name], at.tables)

    def tier(self, size: float) -> int:
        """0 below least_bytes, and one more for each factor of ``fan``."""
        t, edge = 0, self.least_bytes
        while size >= edge:
            t, edge = t + 1, edge * self.fan
        return t

    def plan(self, segments: dict[str, dict]) -> list[list[str]]:
        """The merges: each a list of segments that become one. What a merge fills up to the next tier is merged on, before anything is written."""
        alive = {s: d["bytes"] * (1 - d["dead"] / d["docs"] if d["docs"] else 0) for s, d in segments.items()}
        groups = [[s] for s in segments]
        while True:
            tiers: dict[int, list[list[str]]] = {}
            for g in groups:
                tiers.setdefault(self.tier(sum(alive[s] for s in g)), []).append(g)
            full = next((t for t in sorted(tiers) if len(tiers[t]) >= self.fan), None)
            if full is None:
                return [g for g in groups if len(g) > 1 or 3 * segments[g[0]]["dead"] > segments[g[0]]["docs"]]
            groups = [g for g in groups if g not in tiers[full]] + [[s for g in tiers[full] for s in g]]

    def merge(self) -> int:
        """Merge, and commit if anything changed. Returns the version."""
        at, published = self.latest()
        new, gone = {}, set()
        for group in self.plan(at.segments):
            part, name = Found(at.version, {s: at.segments[s] for s in group}, at.dead, at.tables), f"m{uuid.uuid4().hex[:12]}"
            self._write_postings(self._table(part, "postings", POSTINGS, True), f"{self.path}/segments/{name}/postings")
            for kind, t in at.tables.items():
                self._keep(self.table(part, kind), name, kind, t["by"], {})
            new[name] = self._describe(name, self.docs(part).drop("segment"), self.vocabulary(part))
            gone |= set(group)
        if not gone:
            return at.version
        rest = {s: d for s, d in at.segments.items() if s not in gone}
        dead = at.dead if any(d["dead"] for d in rest.values()) else []
        return self.versions.commit(at.version, Found(at.version, rest | new, dead, at.tables).state(published))

    def publish(self, norms: bool = True) -> int:
        """Write the snapshot of the last version, and switch readers to it. norms: of the field ``terms``, for cosine ranking."""
        at, _ = self.latest()
        name = uuid.uuid4().hex[:12]
        folder = f"{self.path}/snapshots/{name}"
        n_docs = sum(d["docs"] - d["dead"] for d in at.segments.values())
        self.vocabulary(at).withColumn("idf", idf_smooth(F.lit(n_docs), F.col("df"))).repartitionByRange("term", "field").sortWithinPartitions("term", "field").write.parquet(f"{folder}/vocab")
        self.spark.range(1).select(F.lit(n_docs).cast("long").alias("n_docs")).write.parquet(f"{folder}/corpus_stats")
        lengths = self.docs(at).select(F.explode("lengths").alias("field", "dl")).where("dl > 0")
        lengths.groupBy("field").agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avgdl")).write.parquet(f"{folder}/fields")
        if norms:
            vocab = self.spark.read.parquet(f"{folder}/vocab").where("field = 'terms'").drop("field")
            tf = self.postings(at).where("field = 'terms'").select("term", "doc_id", "tf")
            document_norms(weighed(tf, vocab)).write.parquet(f"{folder}/doc_norm")
        state = at.state(None)
        return self.versions.commit(at.version, state | {"published": {k: state[k] for k in ("segments", "dead", "tables")} | {"snapshot": name}})

    def vacuum(self, keep: int = 1) -> None:
        """Drop all versions but the last ``keep``, and what only those name."""
        every = self.versions.all()
        used = lambda vs: {(k, n) for v in vs for s in [self.versions.read(v)[1]] for t in (s, s.get("published") or {}) for k, ns in (("segments", t.get("segments", {})), ("dead", t.get("dead", [])), ("snapshots", [t["snapshot"]] if t.get("snapshot") else [])) for n in ns}
        for kind, name in used(every[:-keep]) - used(every[-keep:]):
            remove(self.spark, f"{self.path}/{kind}/{name}")
        for v in every[:-keep]:
            remove(self.spark, f"{self.path}/versions/{v:010}.json")

    # --- reading what is published

    def _snapshot(self, at: Found, kind: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/snapshots/{at.snapshot}/{kind}")

    def index(self) -> Index:
        """The published index of the field ``terms``: weights are made as postings are read, for the terms that are asked for."""
        at = self.published()
        vocab = self._snapshot(at, "vocab").where("field = 'terms'").drop("field")
        tf = self.postings(at).where("field = 'terms'").select("term", "doc_id", "tf")
        w = tf.join(vocab.select("term", "idf"), "term").select("term", "doc_id", "tf", (tf_sublinear(F.col("tf")) * F.col("idf")).alias("w"))
        return Index(w, vocab, self._snapshot(at, "doc_norm"), self._snapshot(at, "corpus_stats"), tf)

    def field_index(self) -> FieldIndex:
        """The published index of all fields."""
        at = self.published()
        return FieldIndex(self.postings(at).select("field", "term", "doc_id", "tf", "dl"), self._snapshot(at, "fields"), self._snapshot(at, "vocab"))

    def kept(self, kind: str = "stored") -> DataFrame:
        """A published table: the pages to show, or one made of them."""
        return self.table(self.published(), kind)
