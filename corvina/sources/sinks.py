"""Writers: CSV parts, the resumable store of preprocessed documents."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvina.operators.parse import infobox_string
from corvina.sources.dump import read_or_empty

#: Terms by what they were made of. The title is for people to read.
CACHE = "key string, title string, terms array<string>"


def write_parts(pages: DataFrame, path: str, files: int | None = None) -> None:
    """title, raw_text, infobox (as text), terms (joined by spaces) as CSV with a header; leading tabs are kept."""
    rows = pages.select("title", "raw_text", infobox_string(F.col("infobox")).alias("infobox"), F.array_join("terms", " ").alias("terms"))
    rows = rows.repartition(files) if files else rows
    rows.write.mode("overwrite").options(header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def made_by(components: Iterable[str], stop_words: Iterable[str] = (), lemmas: Callable | None = None) -> str:
    """A fingerprint of what turns texts into terms. A tagger of one's own is known by its ``fingerprint``, or else by its name."""
    tagger = getattr(lemmas, "fingerprint", None) or (f"{lemmas.__module__}.{lemmas.__qualname__}" if lemmas else "")
    return hashlib.md5(json.dumps([sorted(set(components)), sorted(set(stop_words)), tagger], ensure_ascii=False).encode()).hexdigest()


def with_key(pages: DataFrame, how: str, title: str = "title", text: str = "text") -> DataFrame:
    """Add ``key``: what a page's terms depend on, and its title. Where a page stands in a dump is no part of it."""
    part = lambda c: F.concat(F.col(c).isNull().cast("string"), F.lit("\0"), F.coalesce(c, F.lit("")))
    return pages.withColumn("key", F.md5(F.concat(F.lit(f"{how}\0"), part(title), F.lit("\0"), part(text)).cast("binary")))


def not_cached(keyed: DataFrame, path: str) -> DataFrame:
    """The rows whose key the store doesn't have yet."""
    return keyed.join(read_or_empty(keyed.sparkSession, path, CACHE).select("key"), "key", "left_anti")


def filled(keyed: DataFrame, path: str) -> DataFrame:
    """The rows with the store's ``terms``, null where it has none. Two writers may have put in the same key: their terms are equal."""
    cache = read_or_empty(keyed.sparkSession, path, CACHE).select("key", "terms").dropDuplicates(["key"])
    return keyed.join(cache, "key", "left")


def append_terms(terms: DataFrame, path: str) -> None:
    """Add preprocessed documents; a failed job adds nothing."""
    terms.select("key", "title", "terms").write.mode("append").parquet(path)
