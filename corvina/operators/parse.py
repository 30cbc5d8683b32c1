"""Pages to rows: namespace filter, infobox, statistics; the infobox's text form and back."""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Namespaces left out, and the patterns of the wiki markup. Repetitions in ATTRIBUTE are possessive: its alternatives
# begin with different characters, so this changes no match and keeps the regular-expression engine off the stack.
DISALLOWED = ("Wikipédia:", "MediaWiki:")
INFOBOX = r"(?s)\{\{Infobox(.*?)[\n|](.*?)\}\}"
ATTRIBUTE = r"(?s)\|\s*([^=]+?)\s*=\s*((?:<[^<>]*+>|\[\[(?:(?!\]\]).)*+\]\]|\{\{(?:(?!\}\}).)*+\}\}|[^|{}\[\]<>]++)++)"
LINK = r"(?d)\[\[(?:(.+?)\|)?(.+?)\]\]"
ESCAPED_TAG = r"(?d)(\&lt\;).*?(\&gt\;)"
URL = "https://sk.wikipedia.org/wiki/"
# End of fixed values.

_ENDS = r"(?U)^[\s\x1C-\x1F]+|[\s\x1C-\x1F]+$"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, _ENDS, "")


def allowed(title: Column) -> Column:
    """Not of a left-out namespace; a null title is allowed."""
    title = F.coalesce(title, F.lit(""))
    out = F.lit(True)
    for prefix in DISALLOWED:
        out = out & ~title.startswith(prefix)
    return out


def title_case(c: Column) -> Column:
    """Each run of letters with a capital first letter, the rest in lower case."""
    runs = F.regexp_extract_all(c, F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.left(r, F.lit(1))), F.lower(F.substr(r, F.lit(2))))), "")


def infobox_name(raw: Column) -> Column:
    two = F.slice(F.split(title_case(strip(raw)), " "), 1, 2)
    return F.regexp_replace(F.array_join(two, ""), r"(?U)\W+", "")


def infobox_properties(body: Column) -> Column:
    """Keys and values of an infobox's body; of a key that repeats, the last value. An empty map if there are none."""
    pairs = F.arrays_zip(F.regexp_extract_all(body, F.lit(ATTRIBUTE), F.lit(1)).alias("k"), F.regexp_extract_all(body, F.lit(ATTRIBUTE), F.lit(2)).alias("v"))
    plain = F.transform(pairs, lambda p: F.struct(strip(p["k"]).alias("key"), F.regexp_replace(strip(p["v"]), LINK, "$2").alias("value")))
    full = F.filter(plain, lambda p: p["value"] != "")
    clean = F.transform(full, lambda p: F.struct(p["key"].alias("key"), F.replace(F.regexp_replace(p["value"], ESCAPED_TAG, ""), F.lit("&amp;amp;"), F.lit("&")).alias("value")))
    last = F.transform(
        F.array(clean), lambda ps: F.filter(ps, lambda p, i: ~F.exists(F.slice(ps, i + 2, F.size(ps)), lambda q: q["key"] == p["key"]))
    )[0]
    return F.map_from_entries(last)


def with_infobox(pages: DataFrame, text: str = "raw_text") -> DataFrame:
    """Add ``infobox`` (name, properties), null without one, of the first infobox in the text; it ends at its first double brace."""
    t = F.coalesce(F.col(text), F.lit(""))
    found = pages.withColumns({"_name": F.regexp_extract(t, INFOBOX, 1), "_body": F.regexp_extract(t, INFOBOX, 2)})
    parsed = found.withColumn("_properties", infobox_properties(F.col("_body")))
    box = F.when(F.size("_properties") > 0, F.struct(infobox_name(F.col("_name")).alias("name"), F.col("_properties").alias("properties")))
    return parsed.withColumn("infobox", box).drop("_name", "_body", "_properties")


def parse_pages(records: DataFrame) -> DataFrame:
    """doc_id, title, raw_text, infobox, infobox_title of the allowed pages that have a text."""
    kept = records.where(allowed(F.col("title")) & F.col("raw_text").isNotNull())
    return with_infobox(kept).withColumn("infobox_title", F.col("infobox.name"))


def parse_stats(records: DataFrame, pages: DataFrame) -> DataFrame:
    """One row: pages, parsed_pages, pages_with_infobox."""
    parsed = pages.agg(F.count("*").alias("parsed_pages"), F.count("infobox").alias("pages_with_infobox"))
    return parsed.select(records.agg(F.count("*")).scalar().alias("pages"), "parsed_pages", "pages_with_infobox")


def infobox_types(pages: DataFrame) -> DataFrame:
    """infobox name and its number of pages."""
    return pages.where("infobox is not null").groupBy(F.col("infobox.name").alias("infobox_name")).agg(F.count("*").alias("pages"))


@F.pandas_udf(T.StringType())
def _dict_text(maps: pd.Series) -> pd.Series:
    return maps.map(lambda m: str(dict(m)), na_action="ignore")


def infobox_string(box: Column) -> Column:
    """``name``, a tab, and the properties as a Python dict; null without an infobox."""
    return F.when(box.isNotNull(), F.concat(box["name"], F.lit("\t"), _dict_text(box["properties"])))


@F.pandas_udf(T.StructType([T.StructField("name", T.StringType()), T.StructField("properties", T.MapType(T.StringType(), T.StringType()))]))
def read_infobox_string(texts: pd.Series) -> pd.DataFrame:
    """Back from the text: a dict alone, or a name and a dict; anything else is no infobox."""

    def one(t: str | None) -> tuple:
        parts = (t or "").split("\t")
        body = parts[0] if len(parts) == 1 and parts[0].startswith("{") else parts[1] if len(parts) == 2 else None
        try:
            properties = ast.literal_eval(body) if body is not None else None
        except (ValueError, SyntaxError):
            properties = None
        if not isinstance(properties, dict):
            return None, None
        return (parts[0] if len(parts) == 2 else None), {str(k): str(v) for k, v in properties.items()}

    return pd.DataFrame([one(t) for t in texts], columns=["name", "properties"])


def page_url(title: Column, base: str = URL) -> Column:
    return F.concat(F.lit(base), F.replace(title, F.lit(" "), F.lit("_")))
