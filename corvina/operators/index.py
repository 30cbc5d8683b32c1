"""The inverted index as four tables: counts (of which postings are made), vocabulary, document norms, number of documents."""

from __future__ import annotations

import logging
import time
import uuid
from collections.abc import Sequence
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvina.functions.text import AT_ONCE
from corvina.session import shared_folder


def term_frequencies(docs: DataFrame, terms: str = "terms") -> DataFrame:
    """doc_id, term, tf. Occurrences are counted before the shuffle; later steps never see single occurrences again.

    explode_outer, as for explode Catalyst adds a filter on the array's size below, which would make the terms twice.
    """
    return docs.select("doc_id", F.explode_outer(terms).alias("term")).where("term is not null").groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


#: The runs of equal terms in the sorted array s: p are the places where they begin.
RUNS = """transform(array(sort_array(filter({terms}, x -> x is not null))), s -> if(size(s) = 0, array(), transform(array(
  filter(sequence(0, size(s) - 1), i -> i = 0 or s[i] <> s[i - 1])), p -> transform(p, (x, j) -> struct(s[x] as term, cast(coalesce(get(p, j + 1), size(s)) - x as bigint) as tf)))[0]))[0]"""


def term_counts(docs: DataFrame, terms: str = "terms") -> DataFrame:
    """As ``term_frequencies``. Where no doc_id is repeated (a job over the ids says so), terms are counted where the text is, and no posting is shuffled: those of a document stay together."""
    if not docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return term_frequencies(docs, terms)
    runs = docs.select("doc_id", F.explode_outer(F.expr(RUNS.format(terms=terms))).alias("t"))
    return runs.select("doc_id", F.col("t.term").alias("term"), F.col("t.tf").alias("tf")).where("term is not null")


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("term", T.StringType()), T.StructField("tf", T.LongType())])))
def tallied(words: pa.Array) -> pa.Array:
    """The distinct words of each row and how often it has them, so a row's counts add up to its length; nulls are counted as one. Words stay as Arrow has them, some rows at a time."""
    kind = pa.list_(pa.struct([("term", pa.string()), ("tf", pa.int64())]))
    parts = [pa.array([], kind)]
    for at in range(0, len(words), 8 * AT_ONCE):
        rows = words.slice(at, 8 * AT_ONCE)
        coded = rows.flatten().dictionary_encode(null_encoding="encode")
        size, row = max(1, len(coded.dictionary)), np.asarray(pc.list_parent_indices(rows), "int64")
        keys, counts = np.unique(row * size + np.asarray(coded.indices, "int64"), return_counts=True)
        ends = np.searchsorted(keys // size, np.arange(len(rows) + 1))
        runs = pa.StructArray.from_arrays([coded.dictionary.cast(pa.string()).take(pa.array(keys % size)), pa.array(counts, pa.int64())], fields=list(kind.value_type))
        parts.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), runs, type=kind))
    return pa.concat_arrays(parts)


def vocabulary(tf: DataFrame) -> DataFrame:
    """term, df, cf."""
    return tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def tf_sublinear(tf: Column) -> Column:
    return 1 + F.log10(tf)


def tf_relative(tf: Column, length: Column) -> Column:
    return tf / length


def idf_smooth(n_docs: Column, df: Column) -> Column:
    return F.log10((1.0 + n_docs) / (1 + df)) + 1


def idf_plain(n_docs: Column, df: Column) -> Column:
    return F.log10(n_docs / df)


class Index:
    """postings (term, doc_id, tf, w), vocab (term, df, cf, idf), doc_norm (doc_id, norm2), corpus_stats (n_docs); counts (term, doc_id, tf).

    Where postings aren't given, they are made of counts: all of them by ``postings``, those of a question's terms by ``of`` and ``met``.
    """

    def __init__(self, postings: DataFrame | None, vocab: DataFrame, doc_norm: DataFrame, corpus_stats: DataFrame, counts: DataFrame | None = None):
        self.vocab, self.doc_norm, self.corpus_stats = vocab, doc_norm, corpus_stats
        self.counts = postings.select("term", "doc_id", "tf") if counts is None else counts
        if postings is not None:
            self.postings = postings

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Index:
        tf, *others = (spark.read.parquet(f"{path}/{t}") for t in ("tf", "vocab", "doc_norm", "corpus_stats"))
        return cls(None, *others, tf)

    @cached_property
    def postings(self) -> DataFrame:
        return weighed(self.counts, self.vocab)

    def of(self, terms: Sequence[str]) -> DataFrame:
        """Postings of these terms: the filter selects what is read of counts and of the vocabulary."""
        some = F.col("term").isin(list(set(terms))) if terms else F.lit(False)
        return self._weighed(self.counts.where(some), F.broadcast(self.vocab.where(some).select("term", "idf")))

    def met(self, asked: DataFrame) -> DataFrame:
        """Postings of the terms of a table (term, idf; none twice), which may be hinted."""
        return self._weighed(self.counts, asked)

    @staticmethod
    def _weighed(tf: DataFrame, idf: DataFrame) -> DataFrame:
        return tf.join(idf, "term").select("term", "doc_id", "tf", (tf_sublinear(F.col("tf")) * F.col("idf")).alias("w"))

    def lookup(self, term: str) -> DataFrame:
        """A term's postings; none for a term that isn't there."""
        return self.of([term])


def written(table: DataFrame, name: str) -> DataFrame:
    """The table as it stands in the shared folder."""
    path = f"{shared_folder(table.sparkSession)}/{name}-{uuid.uuid4().hex}"
    table.write.parquet(path)
    return table.sparkSession.read.schema(table.schema).parquet(path)


def build_index(docs: DataFrame, terms: str = "terms") -> Index:
    """From doc_id and an array of terms. Documents without terms count in n_docs. Counts and vocabulary are written to the shared folder, so texts are analysed once; postings of rare terms alone are shuffled for their weights."""
    stats = docs.agg(F.count("*").alias("n_docs"))
    tf = written(term_counts(docs, terms), "tf")
    vocab = written(vocabulary(tf).withColumn("idf", idf_smooth(stats.scalar(), F.col("df"))), "vocab")
    postings = weighed(tf, vocab)
    return Index(postings, vocab, document_norms(postings), stats, tf)


#: Rows of a written table (a term or an id, and a number) that are sent to every executor.
FEW_TERMS, FEW_IDS = 500_000, 4_000_000


def sent(table: DataFrame, *columns: str, most: int | None = None) -> DataFrame:
    """These columns of a written table, with a hint to broadcast them if it has few rows."""
    return F.broadcast(table.select(*columns)) if table.count() <= (most or FEW_TERMS) else table.select(*columns)


#: A term of no more documents is never hot: sending its weight saves less than it costs.
HOT = 4


def frequent(vocab: DataFrame, most: int | None = None) -> int:
    """The df, HOT at least, that at most about ``most`` terms exceed; 0, if there are no more terms."""
    n, most = vocab.count(), most or FEW_TERMS
    return 0 if n <= most else max(HOT, vocab.agg(F.percentile_approx("df", F.lit(1 - most / n), F.lit(10_000))).first()[0])


def weighed_parts(tf: DataFrame, vocab: DataFrame) -> list[DataFrame]:
    """term, doc_id, tf, w, of the most frequent terms, then of the others if there are any. vocab is written. The first are sent to every executor, so that only postings of rare terms are shuffled."""
    weight, least = (tf_sublinear(F.col("tf")) * F.col("idf")).alias("w"), frequent(vocab)
    hot = F.broadcast(vocab.where(F.col("df") > least).select("term", "idf"))
    parts = [tf.join(hot, "term")]
    if least:
        parts.append(tf.join(hot.select("term"), "term", "left_anti").join(vocab.where(F.col("df") <= least).select("term", "idf"), "term"))
    return [p.select("term", "doc_id", "tf", weight) for p in parts]


def weighed(tf: DataFrame, vocab: DataFrame) -> DataFrame:
    """term, doc_id, tf, w. tf and vocab are written."""
    return reduce(DataFrame.unionByName, weighed_parts(tf, vocab))


def write_counts(docs: DataFrame, path: str, terms: str = "terms", mode: str = "error") -> Index:
    """The index's tables, each from what is written already, so texts are analysed once. Counts are sorted by term in the task that made them and shuffled nowhere (unless a
    doc_id is repeated): each file is the index of its documents, and a question's terms select pages of each. Postings are made of counts as they are read.
    """
    spark = docs.sparkSession
    term_counts(docs, terms).select("term", "doc_id", "tf").sortWithinPartitions("term").write.mode(mode).parquet(f"{path}/tf")
    tf = spark.read.parquet(f"{path}/tf")
    docs.agg(F.count("*").alias("n_docs")).write.mode(mode).parquet(f"{path}/corpus_stats")
    n_docs = spark.read.parquet(f"{path}/corpus_stats").first()[0]
    vocabulary(tf).withColumn("idf", idf_smooth(F.lit(n_docs), F.col("df"))).write.mode(mode).parquet(f"{path}/vocab")
    vocab = spark.read.parquet(f"{path}/vocab")
    document_norms(weighed(tf, vocab)).write.mode(mode).parquet(f"{path}/doc_norm")
    return Index.load(spark, path)


def write_index(docs: DataFrame, path: str, terms: str = "terms", mode: str = "error") -> dict[str, float]:
    """Build the index (``write_counts``). Returns n_docs, n_terms, n_postings and seconds."""
    began = time.time()
    i = write_counts(docs, path, terms, mode)
    done = {"n_docs": i.corpus_stats.first()[0], "n_terms": i.vocab.count(), "n_postings": i.counts.count(), "seconds": round(time.time() - began, 3)}
    logging.info("index of %(n_docs)d documents, %(n_terms)d terms, %(n_postings)d postings in %(seconds).1f s", done)
    return done


def document_norms(postings: DataFrame) -> DataFrame:
    """doc_id, norm2: the squared length of the vector that has a weight for each occurrence."""
    return postings.groupBy("doc_id").agg(F.sum(F.col("tf") * F.col("w") * F.col("w")).alias("norm2"))


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def _placed(terms: pa.Array, names: pa.Array, values: pa.Array) -> pa.Array:
    """The value of each term that has one, in the order of the terms; rows are objects ``AT_ONCE`` at a time."""
    parts = [pa.array([], pa.list_(pa.float64()))]
    for at in range(0, len(terms), AT_ONCE):
        rows = zip(*(c.slice(at, AT_ONCE).to_pylist() for c in (terms, names, values)))
        parts.append(pa.array([[of[t] for t in ts or () if t in of] for ts, ns, vs in rows for of in [dict(zip(ns or (), vs or ()))]], pa.list_(pa.float64())))
    return pa.concat_arrays(parts)


def vectors(docs: DataFrame, index: Index, terms: str = "terms") -> DataFrame:
    """doc_id, vector: the normalised weight of each occurrence, in the order of the terms. The documents are those of the index, whose vocabulary is written.

    Terms are dealt out by document once and counted there; weights of frequent terms are sent, those of rare ones come as a list for each document. No row that is shuffled is an
    occurrence. Rows of one doc_id are one document.
    """
    said = docs.groupBy("doc_id").agg(F.flatten(F.collect_list(terms)).alias("terms"))
    runs = said.select("doc_id", F.explode_outer(F.expr(RUNS.format(terms="terms"))).alias("t"))
    made, none = said, F.array().cast("array<struct<term:string,w:double>>")
    parts = weighed_parts(runs.select("doc_id", F.col("t.term").alias("term"), F.col("t.tf").alias("tf")), index.vocab)
    for i, part in enumerate(parts):
        made = made.join(part.groupBy("doc_id").agg(F.collect_list(F.struct("term", "w")).alias(f"v{i}"), F.sum(F.col("tf") * F.col("w") * F.col("w")).alias(f"n{i}")), "doc_id", "left")
    norm = F.sqrt(reduce(Column.__add__, [F.coalesce(f"n{i}", F.lit(0.0)) for i in range(len(parts))]))
    made = made.select("doc_id", "terms", F.concat(*[F.coalesce(f"v{i}", none) for i in range(len(parts))]).alias("v"), norm.alias("norm"))
    every = docs.select("doc_id").join(made, "doc_id", "left")
    return every.select("doc_id", _placed("terms", "v.term", F.transform("v.w", lambda w: w / F.col("norm"))).alias("vector"))
