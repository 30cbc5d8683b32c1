"""Lemmas and tags of words that the dictionary doesn't list: rewritten endings, counted by suffix, with back-off; tags by their neighbours.

``learn`` turns each entry (word, lemma, tag) into a rewrite (letters cut from the end, letters put there) and counts it under every suffix of the word from the letters
cut up to ``LONGEST``. Of each suffix and tag the most frequent rewrite is kept. A word goes by its longest suffix that at least ``LEAST`` entries have, so rare
endings back off to shorter ones, and at last to the empty suffix. ``guess`` does this for a table of words, as joins; ``tagger`` for the running words
of a text, where several tags are left and a bigram model of tags, counted over the listed words of a corpus, chooses by Viterbi. Listed words are
what the dictionary says.
"""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvina.functions.text import Lemmas

LONGEST, LEAST = 5, 2


def suffixes(word: str, least: str = "0") -> Column:
    """The endings of the column ``word`` of ``least`` to LONGEST letters (the whole word at most)."""
    top = f"least({LONGEST}, length({word}))"
    return F.expr(f"if({least} > {top}, cast(array() as array<string>), transform(sequence({least}, {top}), k -> right({word}, k)))")


def learn(entries: DataFrame) -> DataFrame:
    """suffix, pos, cut, add, n (entries with this rewrite), of_pos (entries with this tag), of_suffix (all entries): one row a suffix and tag.

    entries: word, lemma, pos. Of equally frequent rewrites the one that cuts less, then the first by what it adds. Rewrites that cut more than LONGEST letters are no rule.
    """
    shared = F.expr("aggregate(sequence(1, greatest(1, least(length(word), length(lemma)))), 0, (a, i) -> if(a = i - 1 and substring(word, i, 1) = substring(lemma, i, 1) and substring(word, i, 1) <> '', i, a))")
    e = entries.where("word is not null and lemma is not null and pos is not null").select("word", "lemma", "pos", shared.alias("same"))
    e = e.select("word", "pos", (F.length("word") - F.col("same")).alias("cut"), F.expr("substring(lemma, same + 1)").alias("add"))
    counted = e.select("pos", "cut", "add", F.explode(suffixes("word", "cut")).alias("suffix")).groupBy("suffix", "pos", "cut", "add").agg(F.count(F.lit(1)).alias("n"))
    best = counted.groupBy("suffix", "pos").agg(F.min(F.struct((-F.col("n")).alias("n"), "cut", "add")).alias("b"), F.sum("n").alias("of_pos"))
    total = best.groupBy("suffix").agg(F.sum("of_pos").alias("of_suffix"))
    return best.join(total, "suffix").select("suffix", "pos", "b.cut", "b.add", (-F.col("b.n")).alias("n"), "of_pos", "of_suffix")


def guess(words: DataFrame, entries: DataFrame, rules: DataFrame) -> DataFrame:
    """word, lemma, pos, listed for a table of distinct words: by the dictionary, else by the rules; of equally frequent tags the first by name.

    A word without any rule (an empty dictionary) is its own lemma and a noun.
    """
    known = entries.groupBy("word").agg(F.max(F.struct("lemma", "pos")).alias("d"))
    both = words.select("word").join(known, "word", "left")
    ends = both.where("d is null").select("word", F.explode(suffixes("word")).alias("suffix"))
    fit = ends.join(rules.where((F.col("of_suffix") >= LEAST) | (F.col("suffix") == "")), "suffix").where("cut <= length(word)")
    best = fit.groupBy("word").agg(F.min(F.struct((-F.length("suffix")).alias("k"), (-F.col("of_pos")).alias("n"), "pos", "cut", "add")).alias("b"))
    out = both.join(best, "word", "left")
    made = F.expr("if(b is null, word, concat(left(word, length(word) - b.cut), b.add))")
    return out.select("word", F.coalesce("d.lemma", made).alias("lemma"), F.coalesce("d.pos", "b.pos", F.lit("NOUN")).alias("pos"), F.col("d").isNotNull().alias("listed"))


def tag_bigrams(docs: DataFrame, entries: DataFrame, terms: str = "terms") -> DataFrame:
    """a, b, n: how often a listed word of tag b follows one of tag a (null before the first word). Words with several tags tell nothing."""
    tags = entries.groupBy("word").agg(F.min("pos").alias("pos"), F.max("pos").alias("other")).where("pos = other").select("word", "pos")
    # each word with the one before it, made where the text is
    pairs = docs.select(F.explode(F.expr(f"transform({terms}, (x, i) -> struct(get({terms}, i - 1) as before, x as word))")).alias("p")).select("p.*")
    one = pairs.groupBy("before", "word").agg(F.count(F.lit(1)).alias("n"))
    b = one.join(tags.select("word", F.col("pos").alias("b")), "word")
    follows = b.join(tags.select(F.col("word").alias("before"), F.col("pos").alias("a")), "before").groupBy("a", "b").agg(F.sum("n").alias("n"))
    starts = b.where("before is null").groupBy("b").agg(F.sum("n").alias("n")).select(F.lit(None).cast("string").alias("a"), "b", "n")
    return follows.unionByName(starts)


def tagger(entries: dict[str, tuple[str, str]], rules: DataFrame, bigrams: DataFrame | None = None) -> Callable[[], Lemmas]:
    """A tagger for ``lemmatize``. What a worker holds has the size of the dictionary: rules are endings of its words, bigrams pairs of its tags."""
    by: dict[str, list] = defaultdict(list)
    for r in rules.where((F.col("of_suffix") >= LEAST) | (F.col("suffix") == "")).orderBy("suffix", "pos").collect():
        by[r.suffix].append((r.pos, math.log(r.of_pos / r.of_suffix), r.cut, r.add))
    pairs: dict = {(r.a, r.b): r.n for r in bigrams.collect()} if bigrams is not None else {}
    tags = sorted({p for _, p in entries.values()} | {x[0] for xs in by.values() for x in xs})
    after: dict = defaultdict(int)
    for (a, _), n in pairs.items():
        after[a] += n
    step = {(a, b): math.log((pairs.get((a, b), 0) + 1) / (after[a] + max(1, len(tags)))) for a in [None, *tags] for b in tags}
    by = dict(by)

    def options(word: str) -> list[tuple[str, float, str]]:
        """(tag, log share, lemma), one for a listed word."""
        if word in entries:
            lemma, pos = entries[word]
            return [(pos, 0.0, lemma)]
        for k in range(min(LONGEST, len(word)), -1, -1):
            if fit := [(pos, p, word[: len(word) - cut] + add) for pos, p, cut, add in by.get(word[len(word) - k :], ()) if cut <= len(word)]:
                return fit
        return [("NOUN", 0.0, word)]

    def make() -> Lemmas:
        def run(words: list[str]) -> list[tuple[str, str]]:
            best: dict = {None: 0.0}
            back = []
            for w in words:
                now, came = {}, {}
                for pos, share, lemma in options(w):
                    score, a = max(((s + step.get((a, pos), 0.0), a) for a, s in best.items()), key=lambda x: x[0])
                    if pos not in now or score + share > now[pos]:
                        now[pos], came[pos] = score + share, (a, lemma)
                best = now
                back.append(came)
            out, pos = [], max(best, key=best.get)
            for came in reversed(back):
                before, lemma = came[pos]
                out.append((lemma, pos))
                pos = before
            return out[::-1]

        return run

    make.fingerprint = hashlib.md5(repr((sorted(entries.items()), sorted(by.items()), sorted(pairs.items(), key=repr))).encode()).hexdigest()
    return make
