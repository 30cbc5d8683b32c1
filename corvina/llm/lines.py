"""Line dedup over overlapping windows of three lines.

A line is what stands between newlines that a line with a word follows, so blank lines stay with the line before them. A
window is three consecutive lines, each without white space at its ends, as two 64-bit hashes. A window that occurs more than once in
the table has its first place at the smallest (doc_id, line); at every later place its lines are covered, covered ranges merge, and the
covered lines go. DataFrame functions only. Windows are written, so each text is split and hashed once; the first places are a minimum by
hash, combined before the shuffle and written; joining them back is an equi-join of two plain exchanges, so a passage that millions of documents share is split by adaptive execution.

Defined cases: texts of fewer than three lines and null texts stay as they are; rows that repeat a doc_id with an equal text
are one document, and rows of one doc_id with other texts are told apart by their text's hash; rows with a null doc_id are neither
compared nor changed; an empty table gives no rows; other columns pass through ``dedup_lines`` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvina.llm._base import Scratch

SPLIT = r"\n(?=[\x20\x09\x0B-\x0D]*[^\x20\x09-\x0D])"
#: Names that the operator adds meanwhile.
MARK, STARTS = "_corvina_text_mark", "_corvina_starts"


def lines(text: Column) -> Column:
    return F.split(text, SPLIT)


def windows(docs: DataFrame) -> DataFrame:
    """doc_id, mark, i, h1, h2: each window of each text."""
    trimmed = F.transform(lines(F.col("text")), lambda x: F.regexp_replace(x, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", ""))
    hashed = F.transform(trimmed, lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b")))
    three = F.transform(
        F.array(hashed),
        lambda h: F.transform(
            F.slice(h, 3, F.greatest(F.size(h) - 2, F.lit(0))),
            lambda x, i: F.struct(F.xxhash64(h[i]["a"], h[i + 1]["a"], x["a"]).alias("h1"), F.xxhash64(h[i]["b"], h[i + 1]["b"], x["b"]).alias("h2")),
        ),
    )[0]
    rows = docs.where("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias(MARK), F.posexplode(three).alias("i", "w"))
    return rows.select("doc_id", MARK, "i", "w.h1", "w.h2")


def later_starts(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, mark, and the starts of the windows that stand earlier, too."""
    w = scratch.save(windows(docs))
    firsts = w.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", MARK, "i")).alias("f"), F.max(F.struct("doc_id", MARK, "i")).alias("l"))
    firsts = scratch.save(firsts.where("f < l").select("h1", "h2", "f"))
    later = w.join(firsts, ["h1", "h2"]).where(F.struct("doc_id", MARK, "i") > F.col("f"))
    return later.groupBy("doc_id", MARK).agg(F.collect_set("i").alias(STARTS))


def dedup_lines(docs: DataFrame, scratch: Scratch, counts: bool = False) -> DataFrame:
    """The table without the covered lines, and n_lines and n_removed if ``counts``."""
    starts = later_starts(docs.select("doc_id", "text"), scratch)
    marked = docs.withColumn(MARK, F.xxhash64("text"))
    both = marked.join(starts.withColumnRenamed("doc_id", "_corvina_id"), (F.col("_corvina_id") == marked["doc_id"]) & (starts[MARK] == marked[MARK]), "left").drop(starts[MARK]).drop("_corvina_id")
    text = F.col("text")
    covered = F.array_distinct(F.flatten(F.transform(STARTS, lambda s: F.sequence(s, s + 2))))
    kept = F.transform(F.array(lines(text)), lambda x: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), covered), lambda j: x[j]), "\n"))[0]
    out = both.withColumn("text", F.when(F.col(STARTS).isNull(), text).otherwise(kept))
    if counts:
        out = both.select(*[c for c in both.columns if c != "text"], F.when(text.isNull(), 0).otherwise(F.size(lines(text))).cast("long").alias("n_lines"), F.coalesce(F.size(covered), F.lit(0)).cast("long").alias("n_removed"), F.when(F.col(STARTS).isNull(), text).otherwise(kept).alias("text"))
    return out.drop(MARK, STARTS)


SQL = r"""
with l as (
  select doc_id, text, case when text is null then [] else string_split(
    regexp_replace(text, '\n([\x20\x09\x0B-\x0D]*[^\x20\x09-\x0D])', chr(1) || '\1', 'g'), chr(1)) end as lines
  from documents),
w as (
  select doc_id, i, list_transform(lines[i + 1 : i + 3], lambda x: regexp_replace(x, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')) as win
  from (select doc_id, lines, unnest(range(0, greatest(len(lines) - 2, 0))) as i from l)),
f as (select win, min((doc_id, i)) as f from w group by win having count(*) > 1),
r as (select doc_id, list_distinct(flatten(list(range(i, i + 3)))) as removed from w join f using (win) where (doc_id, i) > f group by doc_id)
select doc_id, len(lines)::bigint as n_lines, coalesce(len(removed), 0)::bigint as n_removed,
  case when removed is null then text else array_to_string(
    list_transform(list_filter(range(0, len(lines)), lambda j: not list_contains(removed, j)), lambda j: lines[j + 1]), chr(10)) end as text
from l left join r using (doc_id)
"""
