"""Quality rules: counts over each whole text, and a hashed n-gram log-likelihood ratio.

The ratio compares two multinomials over hashed 1- and 2-grams of words: the trusted target (all labelled rows)
and the raw corpus (every n-gram of every document). A document's score is the mean over its n-grams, so
length drops out, and every document is kept or rejected by the same threshold. Unless it is given, the threshold comes from the trusted
rows alone: the ratio is fitted on a half of it, by hash of doc_id, and the scores of the other half, which the model has not seen, say how
low a good text scores: their quantile ``low``, and below it ``slack`` times its distance from the median. DataFrame functions only:
documents are read for the counts, for the held half's scores and for all scores, and no pass shuffles a text while the trusted ids
are few enough to be sent to every executor (``IDS``, and ``BROADCAST_BYTES`` as stored); beyond, texts meet them in a shuffle. The model is one row of ``buckets`` numbers, written
to the shared folder and held by each task. Quantiles are taken from counts of the scores to ``DIGITS`` digits, whose number doesn't grow with the rows.

Defined cases: a null text has no words and is rejected as too short; repeated rows are judged each by itself; an empty
table gives no rows; without any trusted row all ratios are 0; with fewer than ``LEAST`` scores to tell a threshold from, only the base
rules decide; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvina.llm._base import BROADCAST_ROWS, Scratch, few

#: Scores that a threshold needs at least.
LEAST = 20
#: Digits to which scores are counted for quantiles.
DIGITS = 4
#: Trusted ids (a long each) that are sent to every executor.
IDS = 4 * BROADCAST_ROWS
#: Everything that is made of a text's words is one expression over w, the words, and k, their hashes, both bound as lambda
#: variables: no array is copied into a row between the steps. h are the hashes of the windows of three words; what is
#: left of them are the positions of those that occur twice, then the words that these cover.
SPLIT = r"filter(split(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), x -> x <> '')"
OF_WORDS = """transform(array({split}), w ->
  transform(array(transform(w, x -> xxhash64(x))), k -> named_struct(
    'n_words', cast(size(w) as bigint),
    'word_chars', cast(length(array_join(w, '')) as bigint),
    'n_repeat_words', if(size(k) < 4, 0L, transform(array(transform(slice(k, 3, size(k) - 2), (x, i) -> xxhash64(k[i], k[i + 1], x))), h ->
      if(size(array_distinct(h)) = size(h), 0L, cast(aggregate(
        sort_array(transform(
          transform(array(sort_array(transform(h, (x, i) -> struct(x as h, i as i)))),
                    s -> filter(s, (x, i) -> coalesce(get(s, i - 1).h = x.h, false) or coalesce(get(s, i + 1).h = x.h, false)))[0],
          x -> x.i)),
        struct(0 as n, -3 as last), (a, p) -> struct(a.n + least(3, p - a.last) as n, p as last), a -> a.n) as bigint)))[0])
    {more}))[0])[0]"""


#: A column that isn't deterministic keeps a later filter above the counts: pushed below them, it would make them again for each rule.
MARK = "_corvina_mark"


def base_rules(docs: DataFrame, more: str = "", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``carry``, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, and what ``more`` adds over w and k."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    n = docs.select(
        *carry, F.monotonically_increasing_id().alias(MARK), F.expr(OF_WORDS.format(split=SPLIT, more=more)).alias("of_words"), F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.transform(F.array(lines), lambda x: F.size(x) - F.size(F.array_distinct(x)))[0].cast("long").alias("n_dup_lines"),
    )
    return n.select(*carry, MARK, "of_words.*", "n_symbols", "n_dup_lines").withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


#: Buckets of the 1-grams and of the 2-grams, from the words' hashes.
GRAMS = "concat(transform(k, x -> cast(pmod(x, {buckets}) as int)), transform(slice(k, 2, greatest(size(k) - 1, 0)), (x, i) -> cast(pmod(xxhash64(k[i], x), {buckets}) as int)))"


def grams(buckets: int) -> Column:
    """The buckets of all 1- and 2-grams of the column text."""
    return F.expr(f"transform(array(transform({SPLIT}, x -> xxhash64(x))), k -> {GRAMS.format(buckets=buckets)})[0]")


def trusted_sample(trusted: DataFrame, target_docs: int | None = None) -> DataFrame:
    """doc_id and half (0 or 1) of all ids; ``target_docs``, if a caller wants fewer: those of the smallest hash, so a rerun takes the same."""
    ids = trusted.where("doc_id is not null").select("doc_id").distinct()
    ids = ids if target_docs is None else ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(target_docs)
    return ids.withColumn("half", F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(2)))


def log_ratios(docs: DataFrame, target: DataFrame, buckets: int, alpha: float) -> DataFrame:
    """One row, one column: ln p(bucket | target) - ln p(bucket | corpus) for each bucket, from 0. target: doc_id."""
    seen = docs.select("doc_id", "text").join(target.select("doc_id", F.lit(1).alias("is_target")), "doc_id", "left")
    n = seen.select("is_target", F.explode(grams(buckets)).alias("b")).groupBy("b").agg(F.count("*").alias("raw"), F.count("is_target").alias("hit"))
    full = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("b")).join(n, "b", "left").na.fill(0)
    one = full.agg(F.sort_array(F.collect_list(F.struct("b", "raw", "hit"))).alias("m"), F.sum("raw").alias("all_raw"), F.sum("hit").alias("all_hit"))
    prior = F.lit(alpha * buckets)
    ratio = lambda x: F.when(F.col("all_hit") > 0, F.log((x["hit"] + alpha) / (F.col("all_hit") + prior)) - F.log((x["raw"] + alpha) / (F.col("all_raw") + prior))).otherwise(0.0)
    return one.select(F.transform("m", ratio).alias("ratios"))


def scored(docs: DataFrame, model: DataFrame, buckets: int, carry: tuple[str, ...]) -> DataFrame:
    """Columns of base_rules, and score: the mean ratio of the n-grams (a text without any has 0)."""
    total = f", 'total', aggregate({GRAMS.format(buckets=buckets)}, 0D, (a, b) -> a + ratios[b]), 'n_grams', greatest(2 * size(k) - 1, 0)"
    based = base_rules(docs.select(*carry, "text", model.scalar().alias("ratios")), total, carry)
    return based.withColumn("score", F.when(F.col("n_grams") > 0, F.col("total") / F.col("n_grams")).otherwise(0.0)).drop("total", "n_grams")


def own_threshold(docs: DataFrame, held: DataFrame, model: DataFrame, buckets: int, low: float, slack: float) -> DataFrame:
    """One row, one column: the threshold by the scores of the held trusted documents that the base rules let pass."""
    good = scored(docs.select("doc_id", "text").join(held.select("doc_id"), "doc_id"), model, buckets, ("doc_id",)).where(f"not base_failed and {MARK} >= 0")
    one = good.groupBy("doc_id").agg(F.round(F.min("score"), DIGITS).alias("score")).groupBy("score").agg(F.count("*").alias("n"))
    q = one.agg(F.percentile("score", F.array(F.lit(low), F.lit(0.5)), F.col("n")).alias("q"), F.sum("n").alias("n"))
    return q.select(F.when(F.col("n") >= LEAST, F.expr(f"q[0] - {slack}D * (q[1] - q[0])")).otherwise(F.lit(float("-inf"))).alias("threshold"))


def quality(docs: DataFrame, trusted: DataFrame, buckets: int = 1 << 15, target_docs: int | None = None, alpha: float = 1.0, threshold: float | None = None, low: float = 0.01, slack: float = 0.75, carry: tuple[str, ...] = ("doc_id",), keep_mark: bool = False) -> DataFrame:
    """Columns of base_rules and score, kept: not failed, and a score of at least ``threshold`` (of the trusted rows, if it is None)."""
    scratch = Scratch(docs.sparkSession, "quality", counted=True)
    ids = scratch.save(trusted_sample(trusted, target_docs))
    sent = F.broadcast if few(ids, IDS) else lambda df: df
    model = scratch.save(log_ratios(docs, sent(ids if threshold is not None else ids.where("half = 0")), buckets, alpha))
    if threshold is not None:
        least = F.lit(threshold)
    else:
        least = scratch.save(own_threshold(docs, sent(ids.where("half = 1")), model, buckets, low, slack)).scalar()
    out = scored(docs, model, buckets, carry)
    return (out if keep_mark else out.drop(MARK)).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= least))


def filter_quality(docs: DataFrame, trusted: DataFrame, **options) -> DataFrame:
    """The rows that ``quality`` keeps, with all their columns; rows are judged in place, nothing is joined back."""
    whole = docs.select("doc_id", "text", F.struct(*[docs[c] for c in docs.columns]).alias("_corvina_row"))
    return quality(whole, trusted, carry=("_corvina_row",), keep_mark=True, **options).where(f"kept and {MARK} >= 0").select("_corvina_row.*")
