"""Boolean retrieval, cosine ranking, field boosts, top results."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvina.functions.stem import stem, stem_words, with_stem
from corvina.functions.text import SPACES
from corvina.operators.index import FEW_TERMS, Index, written
from corvina.plans.args import Operator

# What a query term in the title, in a key and in a value of the infobox adds.
TITLE, KEY, VALUE = 0.3, 0.1, 0.15


def known_terms(index: Index, terms: Sequence[str]) -> list[str]:
    """The query's terms that the vocabulary has, in order, repeats kept: at most as many rows as the query has terms come back."""
    found = {r[0] for r in index.vocab.where(F.col("term").isin(list(terms))).select("term").collect()} if terms else set()
    return [t for t in terms if t in found]


def candidates(index: Index, terms: Sequence[str], operator: Operator, and_mode: str = "strict") -> DataFrame:
    """doc_id of the documents with all, or any, of the known terms.

    strict: an intersection. compat: a fold in query order in which a term restarts an intersection that has become empty. The
    two agree unless the strict result is empty, so the fold runs only then, as semi-joins, a term at a time.
    """
    if operator not in (Operator.AND, Operator.OR):
        raise ValueError(f"no such operator: {operator}")
    terms = list(dict.fromkeys(terms))
    docs = index.of(terms).groupBy("doc_id").agg(F.count("*").alias("n"))
    if operator == Operator.OR or not terms:
        return docs.select("doc_id")
    strict = docs.where(F.col("n") == len(terms)).select("doc_id")
    if and_mode == "strict" or not strict.isEmpty():
        return strict
    out = None
    for t in terms:
        have = index.lookup(t).select("doc_id")
        out = have if out is None or out.isEmpty() else out.join(have, "doc_id", "left_semi")
    return out


def cosine(index: Index, terms: Sequence[str], at_least: int = 1) -> DataFrame:
    """doc_id, score: the length of the document's vector along the query's terms (each once), over its whole length.

    Only documents with ``at_least`` so many of the terms: the same aggregation counts them, before norms are looked up.
    """
    along = index.of(terms).groupBy("doc_id").agg(F.sum(F.col("w") * F.col("w")).alias("q2"), F.count("*").alias("n")).where(F.col("n") >= at_least)
    return along.join(index.doc_norm, "doc_id").select("doc_id", F.sqrt(F.col("q2") / F.col("norm2")).alias("score"))


def dot_product(index: Index, terms: Sequence[str]) -> DataFrame:
    """doc_id, dot: over the query's occurrences, query weight times document weight, both normalised. The query weighs as a document does."""
    spark = index.postings.sparkSession
    q = spark.createDataFrame([(t,) for t in terms], "term string").groupBy("term").agg(F.count("*").alias("qtf"))
    q = q.join(index.vocab, "term").select("term", "qtf", ((1 + F.log10("qtf")) * F.col("idf")).alias("qw"))
    norm = q.agg(F.sqrt(F.sum(F.col("qtf") * F.col("qw") * F.col("qw"))).alias("qn"))
    hits = index.of(terms).join(F.broadcast(q), "term").join(index.doc_norm, "doc_id")
    return hits.groupBy("doc_id").agg((F.sum(F.col("qtf") * F.col("qw") * F.col("w")) / F.sqrt(F.first("norm2"))).alias("d")).select("doc_id", (F.col("d") / norm.scalar()).alias("dot"))


def split_words(c: Column) -> Column:
    return F.filter(F.split(F.coalesce(c, F.lit("")), SPACES), lambda x: x != "")


def with_stems(pages: DataFrame) -> DataFrame:
    """Add t (the stemmed title), k and v (stemmed words of the infobox's keys and values): made once, when pages are stored."""
    text = lambda f: split_words(F.array_join(f(F.col("infobox.properties")), " "))
    return pages.withColumns({"t": F.array_join(stem_words(split_words(F.col("title"))), " "), "k": stem_words(text(F.map_keys)), "v": stem_words(text(F.map_values))})


def page_stems(pages: DataFrame) -> DataFrame:
    """doc_id, t, k and v of with_stems."""
    return with_stems(pages.select("doc_id", "title", "infobox")).select("doc_id", "t", "k", "v")


def boost(pages: DataFrame, terms: Sequence[str], stems: DataFrame | None = None) -> DataFrame:
    """doc_id, boost: for each query term (repeats count) whose stem is part of the stemmed title, or a stemmed word of a key or a value.

    stems: page_stems, if they are stored; else they are made here.
    """
    total = F.lit(0.0)
    for s in map(stem, terms):
        for hit, weight in ((F.contains("t", F.lit(s)), TITLE), (F.array_contains("k", s), KEY), (F.array_contains("v", s), VALUE)):
            total = total + F.when(hit, weight).otherwise(0.0)
    return (page_stems(pages) if stems is None else stems).select("doc_id", total.alias("boost"))


def match_count(index: Index, terms: Sequence[str], operator: Operator = Operator.AND, and_mode: str = "strict") -> int:
    """How many documents the query has, of which ``search`` shows the first."""
    return candidates(index, known_terms(index, terms), operator, and_mode).count()


def search(index: Index, terms: Sequence[str], operator: Operator = Operator.AND, n: int = 10, pages: DataFrame | None = None, and_mode: str = "strict", digits: int = 9, stems: DataFrame | None = None, near: Callable[[list[str]], DataFrame] | None = None) -> DataFrame:
    """rank, doc_id, score (and title, infobox_title with ``pages``) of the first ``n``. Ties, after rounding, go by doc_id.

    terms: the preprocessed query. Terms that the vocabulary doesn't have are left out, of the boosts too. Boosts (doc_id, boost) are looked up by ``near``, if it is given, or
    else made of ``stems``, or of the pages.
    """
    if operator not in (Operator.AND, Operator.OR):
        raise ValueError(f"no such operator: {operator}")
    known = known_terms(index, terms)
    if operator == Operator.OR or and_mode == "strict":
        scored = cosine(index, known, 1 if operator == Operator.OR else len(set(known)))
    else:
        scored = cosine(index, known).join(candidates(index, known, operator, and_mode), "doc_id", "left_semi")
    if pages is not None or near:
        boosts = near(known) if near else boost(pages, known, stems)
        scored = scored.join(boosts, "doc_id", "left").select("doc_id", (F.col("score") + F.coalesce("boost", F.lit(0.0))).alias("score"))
    top = scored.select("doc_id", F.round("score", digits).alias("score")).orderBy(F.desc("score"), "doc_id").limit(n)
    out = top.select(F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")).alias("rank"), "doc_id", "score")  # n rows
    return out if pages is None else out.join(pages.select("doc_id", "title", F.col("infobox.name").alias("infobox_title")), "doc_id", "left")


def search_many(index: Index, questions: DataFrame, operator: Operator = Operator.AND, n: int = 10, digits: int = 9, stems: DataFrame | None = None, near: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """query_id, rank, doc_id, score: for each question what ``search`` finds, all in one job. questions: query_id, terms (array; preprocessed), a row a question.

    Questions are sent to the postings (up to FEW_TERMS of their terms), whose rows of asked terms are dealt out by document, so what a document has of each question is
    added up in one place. The first n of each are cut off in every task before they are sent (a window with a limit), so that a question of very many hits brings
    n rows a task. Boosts (query_id, doc_id, boost) of the questions' stems (query_id, stem, times; written) are looked up by ``near``, if it is given, or in what is made of stems
    (page_stems); they go with the norm of their document, so a hit without any costs nothing.
    """
    if operator not in (Operator.AND, Operator.OR):
        raise ValueError(f"no such operator: {operator}")
    if stems is not None and near is None:
        from corvina.operators import grams  # which is made of this module's weights

        near = lambda said: grams.many_boosts(grams.title_grams(stems), grams.box_words(stems), said)
    asked = questions.select("query_id", F.explode("terms").alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))
    few = F.broadcast if asked.count() <= FEW_TERMS else lambda table: table
    known = index.vocab.select("term").join(few(asked), "term")
    if near is not None:
        known = written(known, "known")  # the stemmer's plan is not to be repeated in the search's
    hits = index.met(few(index.vocab.select("term", "idf").join(few(asked.select("term")), "term", "left_semi"))).repartition("doc_id")
    along = hits.join(few(known), "term").groupBy("doc_id", "query_id").agg(F.sum(F.col("w") * F.col("w")).alias("q2"), F.count(F.lit(1)).alias("n"))
    if operator == Operator.AND:
        need = known.groupBy("query_id").agg(F.count(F.lit(1)).alias("need"))
        along = along.join(few(need), "query_id").where("n = need")
    norms, more = index.doc_norm, F.lit(0.0)
    if near is not None:
        said = written(with_stem(known, "term").where("query_id is not null").groupBy("query_id", "stem").agg(F.sum("times").alias("times")), "said")
        boosts = near(said).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("query_id", "boost"))).alias("boosts"))
        norms, more = norms.join(boosts, "doc_id", "left"), F.coalesce(F.try_element_at("boosts", F.col("query_id")), F.lit(0.0))
    scored = along.join(norms.hint("shuffle_hash"), "doc_id").select("query_id", "doc_id", F.round(F.sqrt(F.col("q2") / F.col("norm2")) + more, digits).alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n).select("query_id", "rank", "doc_id", "score")
