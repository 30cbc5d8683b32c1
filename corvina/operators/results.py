"""What is shown of results: stored fields, links, the infobox of one result, best last."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvina.operators.parse import page_url


def with_titles(pages: DataFrame, results: DataFrame) -> DataFrame:
    """The results (some rows, which are run here) with title and infobox_title. Their doc_ids are a filter on the pages, which are stored in that order."""
    rows = results.collect()
    found = pages.sparkSession.createDataFrame(rows, results.schema)
    shown = pages.where(F.col("doc_id").isin([r.doc_id for r in rows]) if rows else F.lit(False)).select("doc_id", "title", F.col("infobox.name").alias("infobox_title"))
    return found.join(F.broadcast(shown), "doc_id", "left")


def title_places(pages: DataFrame) -> DataFrame:
    """mark (a hash of the title), title, doc_id and text (a hash of the text): where the page of a title is, to be kept ranged and sorted by mark."""
    return pages.select(F.xxhash64("title").alias("mark"), "title", "doc_id", F.xxhash64("raw_text").alias("text"))


def load_titles(titles: list[str], places: DataFrame, pages: DataFrame) -> DataFrame:
    """The stored pages of some titles. Hashes select row groups of the places, and their doc_ids row groups of the pages, which are stored in that order."""
    if not titles:
        return pages.where("false")
    marks = [r[0] for r in places.sparkSession.createDataFrame([(t,) for t in titles], "title string").select(F.xxhash64("title")).collect()]
    ids = [r[0] for r in places.where(F.col("mark").isin(marks) & F.col("title").isin(titles)).select("doc_id").collect()]  # a row a page of these titles
    return pages.where(F.col("doc_id").isin(ids) if ids else F.lit(False))


def load_results(results: DataFrame, pages: DataFrame) -> DataFrame:
    """The results (few rows) with their stored pages, by title."""
    return pages.join(F.broadcast(results), "title")


def formatted(results: DataFrame) -> DataFrame:
    """rank, title, score, url, category, the best last."""
    return results.select("rank", "title", "score", page_url(F.col("title")).alias("url"), F.col("infobox_title").alias("category")).orderBy(F.desc("rank"))


def infobox_details(results: DataFrame, pages: DataFrame, rank: int) -> DataFrame:
    """key and value of the infobox of the result at ``rank``."""
    one = results.where(F.col("rank") == rank).select("doc_id")
    return pages.join(F.broadcast(one), "doc_id").select(F.explode("infobox.properties").alias("key", "value"))
