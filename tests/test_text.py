import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from corvina.config import Config, load_config, require_file
from corvina.functions import stem as st
from corvina.functions import text as tx
from corvina.sources.dump import read_words

GOLDEN = "Toto je test na\n odstranenie novych riadkov a URL adries. https://www.google.com"


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "t string").select(column.alias("x")).first()["x"]


def test_normalize(spark):
    f = tx.normalize(F.col("t"))
    assert one(spark, f, GOLDEN) == "Toto je test na odstranenie novych riadkov a URL adries. "
    assert one(spark, f, "a​b \x1cﬁ ½ http://é.x y") == "a b fi 1⁄2  y"
    assert one(spark, f, None) is None


def test_tokenize(spark):
    f = tx.tokenize(F.col("t"))
    assert one(spark, f, one(spark, tx.normalize(F.col("t")), GOLDEN)) == "toto je test na odstranenie novych riadkov url adries".split()
    assert one(spark, f, "abc1def _x y " + "q" * 16 + " ŠŤ a_b") == ["abc", "def", "šť", "a_b"]
    assert one(spark, f, None) == []


def test_stop_words(spark, tmp_path):
    (tmp_path / "w").write_text(" toto\nje\nna\n\na")
    words = read_words(spark, str(tmp_path / "w"))
    assert words == ["toto", "je", "na", "a"]
    f = tx.remove_words(tx.tokenize(F.col("t")), words)
    assert one(spark, f, "toto je test na test x odstranenie") == ["test", "test", "odstranenie"]


def test_lemmas_and_pipeline(spark):
    entries = {"novych": ("novy", "ADJ"), "riadkov": ("riadok", "NOUN"), "váhu": ("váh", "PROPN"), "adries": ("adries", "NOUN")}
    df = spark.createDataFrame([(1, "Novych riadkov Váhu adries a the https://x"), (2, None)], "doc_id long, text string")
    out = tx.preprocess(df, ["lemmatize", "tokenize", "normalize", "remove_stopwords", "stop_words_cleaner"], ["the"], tx.dictionary(entries))
    assert {r.doc_id: r.terms for r in out.collect()} == {1: ["novy", "riadok", "adresa"], 2: []}
    own = tx.preprocess(df, ["tokenize"], extra=[lambda t: F.filter(t, lambda x: x.startswith("r")), F.array_distinct])
    assert {r.doc_id: r.terms for r in own.collect()} == {1: ["riadkov"], 2: []}
    with pytest.raises(ValueError):
        tx.preprocess(df, ["normalize", "lemmatize"])
    with pytest.raises(ValueError):
        tx.preprocess(df, ["nothing"])


def test_config(tmp_path):
    path = tmp_path / "conf" / "c.json"
    assert load_config(str(path)) == Config()
    path.write_text('{"workers": 6, "other": 1}')
    assert load_config(str(path)).workers == 6 and load_config(str(path)).boosts["title"] == 5.0
    with pytest.raises(ValueError):
        require_file(None)
    with pytest.raises(FileNotFoundError):
        require_file(str(tmp_path / "none"))


def test_stem_goldens():
    assert [st.stem(w) for w in ("prezidentom", "rusko", "republika", "Rusko,", "Rusko")] == ["preziden", "rus", "repub", "Rusko,", "rus"]
    assert st.stem("mestom", aggressive=False) == "mest"


def test_stem_sql_is_the_function(spark):
    rng = random.Random(3)
    ends = [e for step in st.STEPS for rule in step for e in rule[1].split()]
    words = ["".join(rng.choice("abčdeiíklmnoprsštuzž") for _ in range(rng.randint(0, 6))) + "".join(rng.choice(ends) for _ in range(rng.randint(1, 2))) for _ in range(4000)] + ["Rusko,", "a", "ABC", "x-y"]
    df = spark.createDataFrame([(w,) for w in set(words)], "word string")
    assert all(r.stem == st.stem(r.word) for r in st.with_stem(df).collect())
    assert all(re.fullmatch(r"\w+", unicodedata.normalize("NFC", w)) for w in ends)


def test_batches_are_made_objects_in_slices(spark):
    """Nulls and empty values stay, in order, over the edges of slices; a slice's objects are gone before the next is made."""
    import weakref

    import pyarrow as pa

    class Word(str):
        pass

    alive, most = weakref.WeakSet(), 0

    def f(x):
        nonlocal most
        alive.add(w := Word(x + "!"))
        most = max(most, len(alive))
        return [w]

    values = [None if i % 5 == 0 else f"w{i}" for i in range(1000)]
    assert tx.by_slices(f, pa.array(values), pa.list_(pa.string())).to_pylist() == [None if v is None else [v + "!"] for v in values]
    assert most <= 2 * tx.AT_ONCE and len(tx.by_slices(f, pa.array([], pa.string()), pa.string())) == 0
