"""Search over fields: an index by field and term, clauses that should or must match, and BM25."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvina.config import Config
from corvina.functions.stem import stem, stem_words
from corvina.functions.text import tokenize

#: BM25's usual constants.
K1, B = 1.2, 0.75
FIELDS = ("title", "infobox_name", "infobox_key", "infobox_value")


def field_terms(pages: DataFrame, stop_words: Sequence[str] = ()) -> DataFrame:
    """doc_id, field, words (array): title, infobox name, keys and values as stems of the tokens without stop words, terms as they are."""
    analysed = lambda c: stem_words(F.filter(tokenize(c), lambda x: ~x.isin(list(stop_words))) if stop_words else tokenize(c))
    box = F.col("infobox")
    of = {
        "title": analysed(F.col("title")), "infobox_name": analysed(box["name"]),
        "infobox_key": analysed(F.array_join(F.map_keys(box["properties"]), " ")), "infobox_value": analysed(F.array_join(F.map_values(box["properties"]), " ")),
        "terms": F.col("terms"),
    }
    named = F.array(*[F.struct(F.lit(n).alias("field"), w.alias("words")) for n, w in of.items()])
    return pages.select("doc_id", F.explode(named).alias("f")).select("doc_id", "f.field", "f.words").where("size(words) > 0")


@dataclass
class FieldIndex:
    """postings (field, term, doc_id, tf, dl), fields (field, n_docs, avgdl), and, where it is stored, vocab (field, term, df)."""

    postings: DataFrame
    fields: DataFrame
    vocab: DataFrame | None = None


def build_field_index(words: DataFrame) -> FieldIndex:
    """From field_terms."""
    one = words.select("doc_id", "field", F.size("words").cast("long").alias("dl"), F.explode_outer("words").alias("term")).where("term is not null")
    postings = one.groupBy("field", "term", "doc_id").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))
    fields = words.groupBy("field").agg(F.count("*").alias("n_docs"), F.avg(F.size("words")).alias("avgdl"))
    return FieldIndex(postings, fields)


Clause = tuple[str, str, str, float]


def clauses(tokens: Sequence[str], terms: Sequence[str], boosts: dict[str, float] | None = None, stop_words: Sequence[str] = ()) -> list[Clause]:
    """(field, term, should or must, boost): every raw token in every boosted field, analysed as the field is, and every preprocessed term."""
    boosts = Config().boosts if boosts is None else boosts
    return [(f, stem(t), "should", b) for t in tokens if t not in stop_words for f, b in boosts.items()] + [("terms", t, "must", 1.0) for t in terms]


def field_search(index: FieldIndex, query: Sequence[Clause], n: int = 10, digits: int = 6) -> DataFrame:
    """rank-ordered doc_id, score of documents that match every must clause (any clause, if none must)."""
    spark = index.postings.sparkSession
    # a clause that is said twice counts twice
    said: dict[tuple[str, str, str], float] = {}
    for f, t, o, b in query:
        said[f, t, o] = said.get((f, t, o), 0.0) + b
    asked = F.broadcast(spark.createDataFrame([(*k, b) for k, b in said.items()], "field string, term string, occur string, boost double"))
    must = len({k for k in said if k[2] == "must"})
    names, terms = sorted({k[0] for k in said}), sorted({k[1] for k in said})
    hits = index.postings.where(F.col("field").isin(names) & F.col("term").isin(terms)).join(asked, ["field", "term"])
    # at most a row a clause
    df = hits.groupBy("field", "term").agg(F.count_distinct("doc_id").alias("df")) if index.vocab is None else index.vocab.where(F.col("field").isin(names) & F.col("term").isin(terms)).select("field", "term", "df")
    weighed = hits.join(F.broadcast(df), ["field", "term"]).join(F.broadcast(index.fields), "field")
    score = F.expr(f"boost * ln(1 + (n_docs - df + 0.5D) / (df + 0.5D)) * tf / (tf + {K1}D * (1 - {B}D + {B}D * dl / avgdl))")
    docs = weighed.groupBy("doc_id").agg(F.sum(score).alias("score"), F.count_if(F.col("occur") == "must").alias("m"))
    return docs.where(F.col("m") == must).select("doc_id", F.round("score", digits).alias("score")).orderBy(F.desc("score"), "doc_id").limit(n)
