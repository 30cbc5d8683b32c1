"""Text components as column expressions: normalise, tokenise, stop words, lemmas; and the pipeline that runs them in order."""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Callable, Iterable, Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvina.config import COMPONENTS

#: Letters and number signs that aren't decimal digits, and the underscore, make a token.
TOKEN = r"[\p{L}\p{Nl}\p{No}_]+"
SHORTEST, LONGEST = 2, 15
#: What the tagger may keep, and lemmas that are mapped again.
ALLOWED_POS = ("NOUN", "ADJ", "VERB", "ADV")
CUSTOM_WORDS = {"eý": "eú", "urť": "url", "adries": "adresa"}

#: White space as Python's regular expressions have it.
SPACES = r"(?U)[\s\x1C-\x1F]+"


#: Rows of a batch that are Python's objects at a time; the others stay as Arrow has them.
AT_ONCE = 128


def by_slices(f: Callable, values: pa.Array, kind: pa.DataType) -> pa.Array:
    """``f`` of each value that isn't null. Spark's batches have 10,000 rows: whole texts and their words are made objects ``AT_ONCE`` rows at a time."""
    parts = (pa.array([None if x is None else f(x) for x in values.slice(at, AT_ONCE).to_pylist()], kind) for at in range(0, len(values), AT_ONCE))
    return pa.concat_arrays([pa.array([], kind), *parts])


@F.arrow_udf(T.StringType())
def _nfkc(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for t in texts:
        yield by_slices(lambda x: unicodedata.normalize("NFKC", x), t, pa.string())


def nfkc(text: Column) -> Column:
    """Compatibility composition. Only texts that aren't plain ASCII go to Python."""
    return F.coalesce(_nfkc(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)


def normalize(text: Column, unicode: bool = True) -> Column:
    """White space to one space, zero-width spaces to spaces, links away, NFKC."""
    spaced = F.regexp_replace(F.regexp_replace(text, SPACES, " "), "​", " ")
    plain = F.regexp_replace(spaced, "http[^ ]+", "")
    return nfkc(plain) if unicode else plain


def tokenize(text: Column) -> Column:
    """Lower-case tokens of 2 to 15 characters that don't begin with an underscore; digits separate."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))
    return F.filter(found, lambda x: F.length(x).between(SHORTEST, LONGEST) & ~x.startswith("_"))


def remove_words(terms: Column, words: Iterable[str]) -> Column:
    """Without the given words and without one-letter words; repeated terms stay."""
    words = list(words)  # a set of literals, looked up by hash
    return F.filter(terms, lambda x: (~x.isin(words) if words else F.lit(True)) & (F.length(x) > 1))


Lemmas = Callable[[list[str]], list[tuple[str, str]]]


def lemmatize(terms: Column, make: Callable[[], Lemmas], custom: dict[str, str] | None = CUSTOM_WORDS) -> Column:
    """Lemmas of allowed parts of speech. ``make`` builds the tagger once a Python worker: words of a text to (lemma, tag) pairs."""

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tagger = make()
        for batch in batches:
            yield by_slices(lambda ws: [lemma for lemma, pos in tagger(ws) if pos in ALLOWED_POS and len(lemma) > 1], batch, pa.list_(pa.string()))

    out = run(terms)
    if custom:
        table = F.create_map(*[F.lit(x) for pair in custom.items() for x in pair])
        out = F.transform(out, lambda x: F.coalesce(F.try_element_at(table, x), x))
    return out


def dictionary(entries: dict[str, tuple[str, str]]) -> Callable[[], Lemmas]:
    """A tagger by lookup; a word that isn't listed is its own lemma and a noun."""

    def make() -> Lemmas:
        return lambda words: [entries.get(w, (w, "NOUN")) for w in words]

    make.fingerprint = hashlib.md5(repr(sorted(entries.items())).encode()).hexdigest()
    return make


def stages(components: Iterable[str], stop_words: Iterable[str] = (), lemmas: Callable[[], Lemmas] | None = None) -> list[tuple[str, Callable[[Column], Column]]]:
    """(name, what it makes of the step before, first of the text) of the components in their fixed order. A component without the one it builds on is refused."""
    wanted, stop_words = set(components), list(stop_words)
    if unknown := wanted - set(COMPONENTS):
        raise ValueError(f"no such components: {sorted(unknown)}")
    if "tokenize" not in wanted and wanted & {"remove_stopwords", "lemmatize", "stop_words_cleaner"}:
        raise ValueError("components after tokenize need it")
    steps = [("normalize", normalize)] if "normalize" in wanted else []
    steps.append(("tokenize", tokenize) if "tokenize" in wanted else ("split", lambda c: F.filter(F.split(c, SPACES), lambda x: x != "")))
    if "remove_stopwords" in wanted:
        steps.append(("remove_stopwords", lambda c: remove_words(c, stop_words)))
    if "lemmatize" in wanted:
        steps.append(("lemmatize", lambda c: lemmatize(c, lemmas or dictionary({}))))
    if "stop_words_cleaner" in wanted:
        steps.append(("stop_words_cleaner", lambda c: remove_words(c, stop_words)))
    return steps


def preprocess(docs: DataFrame, components: Iterable[str], stop_words: Iterable[str] = (), lemmas: Callable[[], Lemmas] | None = None, text: str = "text", extra: Iterable[Callable[[Column], Column]] = (), watch: Observation | None = None) -> DataFrame:
    """The column ``terms`` by the components, in their fixed order, then by components of one's own: functions of the terms' column.

    A component without the one it builds on is refused. watch: is told, as the terms are made, the number of rows and how many words each component leaves.
    """
    steps = [*stages(components, stop_words, lemmas), *((f"extra_{i}", c) for i, c in enumerate(extra))]
    if watch is None:
        out = F.col(text)
        for _, step in steps:
            out = step(out)
        return docs.withColumn("terms", out)
    docs, at, words = docs.withColumn("_step", F.col(text)), "_step", []
    for i, (name, step) in enumerate(steps):
        docs = docs.withColumn(f"_step_{i}", step(F.col(at)))
        at = f"_step_{i}"
        if name != "normalize":
            words.append(F.sum(F.coalesce(F.size(at), F.lit(0))).alias(name))
    seen = docs.observe(watch, F.count(F.lit(1)).alias("rows"), *words)
    return seen.withColumn("terms", F.col(at)).drop("_step", *[f"_step_{i}" for i in range(len(steps))])


def reductions(seen: Mapping[str, int]) -> list[tuple[str, int, int, float | None]]:
    """(component, words before it, words after it, percent removed) from what an observation of ``preprocess`` was told."""
    counts = [(k, v or 0) for k, v in seen.items() if k != "rows"]
    return [(name, before, after, 100 * (before - after) / before if before else None) for (_, before), (name, after) in zip(counts, counts[1:])]


def reduction(before: Column, after: Column) -> Column:
    """Percent of the words that a component removed; null without words."""
    return F.try_divide(100.0 * (F.size(before) - F.size(after)), F.size(before))
