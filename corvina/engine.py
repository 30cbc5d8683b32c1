"""The engines: build an index from a dump, keep it, answer questions; and the same over fields, from CSV parts or pages."""

from __future__ import annotations

import logging
import sys
import time
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from corvina.config import Config, load_config, setup_logging
from corvina.functions import guess
from corvina.functions.text import Lemmas, dictionary, preprocess, reductions, tokenize
from corvina.operators.fielded import FieldIndex, clauses, field_search, field_terms
from corvina.operators.grams import TABLES, boosts, many_boosts
from corvina.operators.index import Index
from corvina.operators.parse import parse_pages, read_infobox_string
from corvina.operators.results import formatted, infobox_details, load_titles, title_places, with_titles
from corvina.operators.search import match_count, search, search_many, with_stems
from corvina.operators.segments import Segments, whole_text
from corvina.plans.args import Operator, parse_args
from corvina.session import build_session
from corvina.sources.dump import read_dump_raw, read_dump_xml, read_lemmas, read_parts, read_words
from corvina.sources.versions import Versions, remove, require
from corvina.streaming.incremental import preprocess_batch

SAVER = "document_saver"
PARTS_COLUMNS = ("title", "raw_text", "infobox", "terms")


def tagger(spark: SparkSession, config: Config) -> Callable[[], Lemmas]:
    """The dictionary that the configuration names, and what its endings say of other words, if asked for; without one, every word is its own lemma."""
    entries = read_lemmas(spark, config.lemmas_path) if config.lemmas_path else {}
    if not (config.guess_lemmas and entries):
        return dictionary(entries)
    listed = spark.read.schema("word string, lemma string, pos string").options(sep="\t", quote="").csv(config.lemmas_path)
    return guess.tagger(entries, guess.learn(listed))


def question_terms(spark: SparkSession, question: str, config: Config, stop_words: Sequence[str], lemmas: Callable[[], Lemmas]) -> list[str]:
    """A question through the documents' own components."""
    one = spark.createDataFrame([(question,)], "text string")
    return list(preprocess(one, set(config.preprocessor_components) - {SAVER}, stop_words, lemmas).first()["terms"])


def read_pages(spark: SparkSession, path: str, source: str) -> DataFrame:
    return parse_pages({"raw": read_dump_raw, "xml": read_dump_xml}[source](spark, require(spark, path)))


def analysed(pages: DataFrame, config: Config, stop_words: Sequence[str], lemmas: Callable[[], Lemmas], watch: Observation | None = None) -> DataFrame:
    """doc_id, field, words of pages, by the configuration's components. watch: is told what they remove, of the pages that are preprocessed."""
    steps = set(config.preprocessor_components)
    if SAVER in steps:
        return whole_text(preprocess_batch(pages, config.already_processed_path, steps, stop_words, lemmas, text="raw_text", watch=watch))
    return whole_text(preprocess(pages, steps, stop_words, lemmas, text="raw_text", watch=watch))


#: Beside the pages: what boosts are looked up in, and where the page of a title is.
KEPT = {**TABLES, "places": (title_places, ["mark"])}


def take_up(store: Segments, pages: DataFrame, config: Config, stop_words: Sequence[str], lemmas: Callable[[], Lemmas], anew: bool) -> None:
    """Append pages, publish, and keep what the components removed and how long it took as the next of the measures."""
    began, watch = time.time(), Observation()
    store.append(lambda stored: analysed(stored, config, stop_words, lemmas, watch), with_stems(pages), anew=anew, tables=KEPT)
    if not anew:
        store.merge()
    store.publish()
    store.vacuum(keep=2)  # readers of the version before may still be at work
    seen = watch.get
    told = {"pages": seen["rows"], "seconds": round(time.time() - began, 3), "components": [dict(zip(("component", "before", "after", "percent"), x)) for x in reductions(seen)]}
    log = Versions(store.spark, f"{store.path}/measures")
    log.commit(max(log.all(), default=0), told)
    logging.info("%s", told)


@dataclass
class Engine:
    spark: SparkSession
    config: Config
    index: Index
    pages: DataFrame
    stems: DataFrame
    grams: DataFrame
    boxes: DataFrame
    places: DataFrame
    stop_words: Sequence[str]
    lemmas: Callable[[], Lemmas]

    @classmethod
    def build(cls, spark: SparkSession, config: Config, stop_words: Sequence[str] = (), lemmas: Callable[[], Lemmas] | None = None, source: str = "raw") -> Engine:
        """Parse the dump, preprocess, index, and publish all of it under ``index_path``, in the place of what was there; then work on what was saved.

        With document_saver among the components, preprocessed documents are kept at ``already_processed_path`` and not made again. A build that is killed
        leaves the index before as it was.
        """
        lemmas = lemmas or tagger(spark, config)
        take_up(Segments(spark, config.index_path), read_pages(spark, config.dump_path, source), config, stop_words, lemmas, anew=True)
        return cls.load(spark, config, stop_words, lemmas)

    @classmethod
    def update(cls, spark: SparkSession, config: Config, stop_words: Sequence[str] = (), lemmas: Callable[[], Lemmas] | None = None, source: str = "raw", complete: bool = False) -> Engine:
        """Take up a newer dump: new pages are added, those whose text has changed are replaced, the others stay untouched. complete: pages that the dump doesn't have go.

        A page is known by its title and keeps its doc_id; of several of one title in the dump, the first takes it. New pages are numbered on.
        """
        lemmas = lemmas or tagger(spark, config)
        store = Segments(spark, config.index_path)
        draft = f"{config.index_path}/drafts/{uuid.uuid4().hex}"
        read_pages(spark, config.dump_path, source).write.parquet(draft)
        # both sides by hashes of their texts: what is stored isn't read again
        pages, old = spark.read.parquet(draft), store.table(store.latest()[0], "places")
        by_title = lambda places, name: places.groupBy(F.coalesce("title", F.lit("")).alias("name")).agg(F.min(F.struct("doc_id", "text")).alias(name))
        both = by_title(title_places(pages), "new").join(by_title(old, "old"), "name")
        both = both.select(F.col("new.doc_id").alias("doc_id"), F.col("old.doc_id").alias("old_id"), (F.col("old.text") == F.col("new.text")).alias("same"))
        start = (old.agg(F.max("doc_id")).first()[0] or 0) + 1
        changed = pages.join(both, "doc_id", "left").where("same is null or not same")
        changed = changed.withColumn("doc_id", F.coalesce("old_id", F.col("doc_id") + start)).drop("old_id", "same")
        if complete:
            store.delete(old.select("doc_id").join(both.select(F.col("old_id").alias("doc_id")), "doc_id", "left_anti"))
        take_up(store, changed, config, stop_words, lemmas, anew=False)
        remove(spark, draft)
        return cls.load(spark, config, stop_words, lemmas)

    @classmethod
    def load(cls, spark: SparkSession, config: Config, stop_words: Sequence[str] = (), lemmas: Callable[[], Lemmas] | None = None) -> Engine:
        """What was published last."""
        store = Segments(spark, config.index_path)
        pages = store.kept()
        return cls(spark, config, store.index(), pages.drop("t", "k", "v"), pages.select("doc_id", "t", "k", "v"), store.kept("grams"), store.kept("boxes"), store.kept("places"), stop_words, lemmas or tagger(spark, config))

    def query_terms(self, question: str) -> list[str]:
        return question_terms(self.spark, question, self.config, self.stop_words, self.lemmas)

    def search(self, question: str, operator: Operator = Operator.AND, n: int = 10, and_mode: str = "strict") -> DataFrame:
        """rank, doc_id, score, title, infobox_title. Boosts are looked up in the index of titles, and of the pages only the found ones are read."""
        found = search(self.index, self.query_terms(question), operator, n, None, and_mode, near=lambda terms: boosts(self.grams, self.boxes, terms))
        return with_titles(self.pages, found)

    def search_many(self, questions: DataFrame, operator: Operator = Operator.AND, n: int = 10) -> DataFrame:
        """query_id, rank, doc_id, score, title, infobox_title for a table of questions (query_id, question), in one job. Boosts are looked up in the index of titles."""
        asked = preprocess(questions, set(self.config.preprocessor_components) - {SAVER}, self.stop_words, self.lemmas, text="question")
        found = search_many(self.index, asked, operator, n, near=lambda said: many_boosts(self.grams, self.boxes, said))
        return found.join(self.pages.select("doc_id", "title", F.col("infobox.name").alias("infobox_title")), "doc_id", "left").select("query_id", "rank", "doc_id", "score", "title", "infobox_title")

    def details(self, titles: Sequence[str]) -> DataFrame:
        """The stored pages of some titles; only the parts of the files that may hold them are read."""
        return load_titles(list(titles), self.places, self.pages)

    def measures(self) -> list[dict]:
        """Of each build and update: pages, seconds, and what each component removed from the pages that were preprocessed."""
        log = Versions(self.spark, f"{self.config.index_path}/measures")
        return [log.read(v)[1] for v in log.all()]

    def match_count(self, question: str, operator: Operator = Operator.AND, and_mode: str = "strict") -> int:
        return match_count(self.index, self.query_terms(question), operator, and_mode)


@dataclass
class FieldEngine:
    """Search over titles, infoboxes and terms. ``pages``: doc_id, title, raw_text, infobox."""

    spark: SparkSession
    config: Config
    index: FieldIndex
    pages: DataFrame
    stop_words: Sequence[str]
    lemmas: Callable[[], Lemmas]

    @classmethod
    def build(cls, spark: SparkSession, config: Config, parts: str, stop_words: Sequence[str] = (), lemmas: Callable[[], Lemmas] | None = None, replace: bool = False) -> FieldEngine:
        """Index the CSV parts at ``parts`` under ``index_path``. Pages that are indexed already, by title, stay as they are, or are replaced.

        Different rows of one title are different pages; rows that agree in everything are one.
        """
        began, root = time.time(), config.index_path
        store = Segments(spark, f"{root}/fields")
        rows = read_parts(spark, require(spark, parts)).where("title is not null").dropDuplicates()
        box = read_infobox_string("infobox")
        pages = rows.select(F.xxhash64(*PARTS_COLUMNS).alias("doc_id"), "title", "raw_text", F.when(box["properties"].isNotNull(), F.struct(box["name"].alias("name"), box["properties"].alias("properties"))).alias("infobox"), F.filter(F.split(F.coalesce("terms", F.lit("")), " "), lambda x: x != "").alias("terms"))
        at, _ = store.latest()
        if at.segments:
            old = store.table(at).select("doc_id", "title")
            if replace:
                store.delete(old.join(pages.select("title", F.col("doc_id").alias("new_id")), "title").groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("new_id")).alias("same")).where("not same"))
                pages = store.lacking(pages)
            else:
                pages = pages.join(old.select("title").distinct(), "title", "left_anti").select(*pages.columns)
        store.append(lambda pages: field_terms(pages, stop_words), pages)
        store.merge()
        store.publish(norms=False)
        store.vacuum(keep=2)
        logging.info("version %d of %s in %.1f s", store.latest()[0].version, root, time.time() - began)
        return cls.load(spark, config, stop_words, lemmas)

    @classmethod
    def load(cls, spark: SparkSession, config: Config, stop_words: Sequence[str] = (), lemmas: Callable[[], Lemmas] | None = None) -> FieldEngine:
        store = Segments(spark, f"{config.index_path}/fields")
        return cls(spark, config, store.field_index(), store.kept(), stop_words, lemmas or tagger(spark, config))

    def search(self, question: str, n: int = 10) -> DataFrame:
        """rank, doc_id, title, score, infobox_title: raw tokens should stand in the boosted fields, preprocessed terms must be in the text."""
        tokens = self.spark.createDataFrame([(question,)], "q string").select(tokenize(F.col("q"))).first()[0]
        terms = question_terms(self.spark, question, self.config, self.stop_words, self.lemmas)
        found = field_search(self.index, clauses(tokens, terms, self.config.boosts, self.stop_words), n)
        ranked = self.spark.createDataFrame([(i + 1, *r) for i, r in enumerate(found.collect())], "rank int, doc_id long, score double")  # n rows
        return with_titles(self.pages, ranked).select("rank", "doc_id", "title", "score", "infobox_title")


def answer(engine: Engine, line: str) -> tuple[int, DataFrame]:
    """The number of matches and the results that a line of the query language asks for."""
    a = parse_args(line)
    return engine.match_count(a.query, a.boolean_operator), engine.search(a.query, a.boolean_operator, a.results_count)


def main(read: Callable[[str], str] = input) -> None:
    """python -m corvina.engine CONFIG: builds the index if there is none, then answers lines until q; a rank shows that result's infobox."""
    config = load_config(sys.argv[1])
    setup_logging(config.verbose)
    spark = build_session(conf=config.spark)
    stop = read_words(spark, config.stop_words_path)
    there = Segments(spark, config.index_path).latest()[1]
    engine = Engine.load(spark, config, stop) if there else Engine.build(spark, config, stop)
    while (line := read("query> ").strip()) not in ("q", "Q"):
        began = time.time()
        try:
            n, found = answer(engine, line)
        except ValueError as e:
            print(e)
            continue
        rows = found.collect()
        found = spark.createDataFrame(rows, found.schema)
        formatted(found).show(truncate=False)
        print(f"{n} documents, {time.time() - began:.1f} s")
        while (rank := read("rank, or nothing> ").strip()).isdigit():
            infobox_details(found, engine.pages, int(rank)).show(truncate=False)


if __name__ == "__main__":
    main()
