"""A Slovak suffix stemmer as one table of rules, rendered as SQL (Spark and DuckDB) and as a Python function.

A step tries its rules in order and applies the first whose suffix ends the word and whose length the word exceeds. A rule
cuts letters; a rule marked PAL softens first: it cuts to ``keep`` letters of the suffix, then a hard ending replaces a soft
one, or the last letter goes.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAL = True

# Steps of rules (the word is longer than, suffixes, letters cut, softened), in order.
CASE = [
    (7, "atoch", 5, False),
    (6, "aťom", 3, PAL),
    (5, "och ich ích ého ami emi ému ete eti iho ího ími imu aťa", 2, PAL),
    (5, "ách ata aty ých ami ové ovi ými", 3, False),
    (4, "om", 1, PAL),
    (4, "es ém ím", 2, PAL),
    (4, "úm at ám os us ým mi ou ej", 2, False),
    (3, "e i í", 0, PAL),
    (3, "ú y a o á é ý", 1, False),
]
POSSESSIVE = [(5, "ov", 2, False), (5, "in", 1, PAL)]
COMPARATIVE = [(5, "ejš ějš", 2, PAL)]
DIMINUTIVE = [
    (7, "oušok", 5, False),
    (6, "ečok éčok ičok íčok enok énok inok ínok", 3, PAL),
    (6, "áčok ačok očok učok anok onok unok ánok", 4, PAL),
    (5, "ečk éčk ičk íčk enk énk ink ínk", 3, PAL),
    (5, "áčk ačk očk učk ank onk unk átk ánk ušk", 3, False),
    (4, "ek ék ík ik", 1, PAL),
    (4, "ák ak ok uk", 1, False),
    (3, "k", 1, False),
]
AUGMENTATIVE = [(6, "ajzn", 4, False), (5, "izn isk", 2, PAL), (4, "ák", 2, False)]
DERIVATIONAL = [
    (8, "obinec", 6, False),
    (7, "ionár", 4, PAL),
    (7, "ovisk ovstv ovišt ovník", 5, False),
    (6, "ások nosť teln ovec ovík ovtv ovin štin", 4, False),
    (6, "enic inec itel", 3, PAL),
    (5, "árn", 3, False),
    (5, "enk ián ist isk išt itb írn", 2, PAL),
    (5, "och ost ovn oun out ouš ušk kyn čan kář néř ník ctv stv", 3, False),
    (4, "áč ač án an ár ar ás as", 2, False),
    (4, "ec en ér ír ic in ín it iv", 1, PAL),
    (4, "ob ot ov oň ul yn čk čn dl nk tv tk vk", 2, False),
    (3, "c č k l n t", 1, False),
]
SOFT = [("ci ce či če", "k"), ("zi ze ži že", "h"), ("čte čti čtí", "ck"), ("šte šti ští", "sk")]
STEPS = [CASE, POSSESSIVE, COMPARATIVE, DIMINUTIVE, AUGMENTATIVE, DERIVATIONAL]
# End of fixed values.

WORD = re.compile(r"^\w+$")


def soften(word: str) -> str:
    for endings, hard in SOFT:
        for e in endings.split():
            if word.endswith(e):
                return word[: -len(e)] + hard
    return word[:-1]


@functools.lru_cache(1 << 16)
def stem(word: str, aggressive: bool = True) -> str:
    """The stem; what isn't one word of letters, digits and underscores is given back as it is."""
    if not WORD.match(word):
        return word
    word = word.lower()
    for step in STEPS if aggressive else STEPS[:2]:
        rule = next((r for r in step if len(word) > r[0] and word.endswith(tuple(r[1].split()))), None)
        if rule:
            word = word[: len(word) - rule[2]]
            word = soften(word) if rule[3] else word
    return word


def _ends(x: str, endings: str) -> str:
    """By length, as membership of the last letters: the same SQL in Spark and DuckDB."""
    by_length: dict[int, list[str]] = {}
    for e in endings.split():
        by_length.setdefault(len(e), []).append(e)
    return " or ".join(f"right({x}, {n}) in ({', '.join(repr(e) for e in es)})" for n, es in by_length.items())


def step_sql(rules: list, x: str) -> str:
    """SQL for one step over the column ``x``, with x not longer than a rule asks taken as no match."""
    cases = []
    for longer, endings, cut, softened in rules:
        y = f"left({x}, length({x}) - {cut})" if cut else x
        out = y
        if softened:
            hard = " ".join(f"when {_ends(y, es)} then concat(left({y}, length({y}) - {len(es.split()[0])}), '{h}')" for es, h in SOFT)
            out = f"case {hard} else left({y}, length({y}) - 1) end"
        cases.append(f"when length({x}) > {longer} and ({_ends(x, endings)}) then {out}")
    return f"case {' '.join(cases)} else {x} end"


def stem_steps(word: str, plain: str, aggressive: bool = True) -> Iterator[str]:
    """Expressions, one a step, each over the column ``s`` of the step before (the first over ``word``). ``plain``: whether it is a word."""
    yield f"case when {plain} then lower({word}) else {word} end"
    for step in STEPS if aggressive else STEPS[:2]:
        yield f"case when {plain} then {step_sql(step, 's')} else s end"


def with_stem(df, word: str = "word", out: str = "stem", aggressive: bool = True):
    """Add the stem as a column, by SQL alone: one projection a step, so that no expression is repeated in itself."""
    plain = f"{word} rlike '(?U)^\\\\w+$'"
    for e in stem_steps(word, plain, aggressive):
        df = df.withColumn("s", F.expr(e))
    return df.withColumnRenamed("s", out)


@F.pandas_udf(T.ArrayType(T.StringType()))
def stem_words(words: pd.Series) -> pd.Series:
    """Stems of arrays of words."""
    return words.map(lambda ws: [stem(w) for w in ws], na_action="ignore")
