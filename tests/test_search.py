import json
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from corvina.config import Config, load_config
from corvina.engine import Engine, FieldEngine, answer
from corvina.engine import main as engine_main
from corvina.functions.text import dictionary, preprocess
from corvina.operators import fielded, index, metrics
from corvina.operators.index import Index, build_index, vectors
from corvina.operators.search import boost, candidates, cosine, dot_product, search, search_many
from corvina.operators.segments import Segments
from corvina.plans.args import Operator
from corvina.operators.parse import parse_pages
from corvina.sources.dump import read_dump_raw, read_lemmas, read_or_empty
from corvina.sources.sinks import CACHE, append_terms, made_by, not_cached, with_key, write_parts
from corvina.streaming.incremental import preprocess_batch, preprocess_stream

from test_parse import DUMP

WORDS = "a b c d e f g h".split()


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(5)
    docs = {i: [rng.choice(WORDS[: 2 + i % 7]) for _ in range(rng.randint(0, 12))] for i in range(60)} | {60: []}
    return docs, spark.createDataFrame(list(docs.items()), "doc_id long, terms array<string>")


@pytest.fixture(scope="module")
def built(corpus):
    return build_index(corpus[1])


def weights(docs):
    df = {w: sum(w in d for d in docs.values()) for w in WORDS}
    idf = {w: math.log10((1 + len(docs)) / (1 + df[w])) + 1 for w in WORDS}
    return {i: [(1 + math.log10(d.count(t))) * idf[t] for t in d] for i, d in docs.items()}, df, idf


def test_vocabulary_and_vectors(corpus, built):
    docs, frame = corpus
    w, df, idf = weights(docs)
    for r in built.vocab.collect():
        assert (r.df, r.cf) == (df[r.term], sum(d.count(r.term) for d in docs.values())) and r.idf == pytest.approx(idf[r.term])
    for r in vectors(frame, built).collect():
        n = math.sqrt(sum(x * x for x in w[r.doc_id]))
        assert r.vector == pytest.approx([x / n for x in w[r.doc_id]])


def test_cosine_is_the_evaluation_by_occurrence(corpus, built):
    docs, _ = corpus
    w, _, _ = weights(docs)
    terms = ["a", "c", "a"]
    got = {r.doc_id: r.score for r in cosine(built, terms).collect()}
    for i, d in docs.items():
        q = [0.0] * len(d)
        for t in terms:
            if t in d:
                q[d.index(t)] = w[i][d.index(t)]
        if any(q):
            dot = sum(x * y for x, y in zip(q, w[i]))
            assert got[i] == pytest.approx(dot / math.sqrt(sum(x * x for x in q)) / math.sqrt(sum(x * x for x in w[i])))
        else:
            assert i not in got
    assert dot_product(built, ["a"]).count() == sum("a" in d for d in docs.values())


def test_operators(corpus, built):
    docs, _ = corpus
    ids = lambda *a: {r[0] for r in candidates(built, *a).collect()}
    assert ids(["a", "b"], Operator.AND) == {i for i, d in docs.items() if {"a", "b"} <= set(d)} == ids(["a", "b"], Operator.AND, "compat")
    assert ids(["a", "h"], Operator.OR) == {i for i, d in docs.items() if {"a", "h"} & set(d)}
    assert ids([], Operator.AND) == set() and ids(["zzz"], Operator.OR) == set()
    with pytest.raises(ValueError):
        candidates(built, ["a"], "xor")
    top = search(built, ["a", "nothing"], Operator.AND, 5).collect()
    assert [r["rank"] for r in top] == [1, 2, 3, 4, 5] and [r.score for r in top] == sorted((r.score for r in top), reverse=True)


def test_an_empty_intersection_starts_anew(spark):
    i = build_index(spark.createDataFrame([(1, ["a"]), (2, ["b"]), (3, ["c"])], "doc_id long, terms array<string>"))
    assert candidates(i, ["a", "b", "c"], Operator.AND).count() == 0
    assert [r[0] for r in candidates(i, ["a", "b", "c"], Operator.AND, "compat").collect()] == [3]
    assert candidates(i, ["a", "b"], Operator.AND, "compat").count() == 0


def test_the_query_of_a_term_that_starts_anew_is_its_sql(spark, tmp_path):
    """Where the first two terms stand together nothing starts anew."""
    import duckdb

    from corvina.plans import catalogue

    for name, texts in (("apart", ["pour eux", "und so", "the end", "the und"]), ("together", ["pour und", "pour und the", "the end"])):
        spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/{name}/documents.parquet")
        db = duckdb.connect()
        db.execute(f"create view documents as select * from '{tmp_path}/{name}/documents.parquet/*.parquet'")
        want = [(r[0], r[1], round(r[2], 6)) for r in db.sql(catalogue.ORACLES["search_and_compat"]).fetchall()]
        got = [(r["rank"], r.doc_id, round(r.score, 6)) for r in catalogue.QUERIES["search_and_compat"](spark, f"{tmp_path}/{name}").collect()]
        assert got == want and bool(got) == (name == "apart")


def test_terms_are_counted_where_the_text_is(spark, tmp_path):
    """No posting is shuffled on the way to its weight, unless a doc_id is repeated; counts are the same."""
    shape = "doc_id long, terms array<string>"
    docs = [(i, [rng.choice(WORDS) for _ in range(i % 9)] + [None] * (i % 2)) for rng in [random.Random(3)] for i in range(40)] + [(50, None), (51, []), (None, ["a", "a"])]
    counts = lambda rows: sorted(((r.doc_id, r.term, r.tf) for r in rows.collect()), key=repr)
    once = spark.createDataFrame(docs, shape)
    assert counts(index.term_counts(once)) == counts(index.term_frequencies(once))
    twice = spark.createDataFrame([*docs, (7, ["a", "zz"]), (None, ["a"])], shape)
    assert counts(index.term_counts(twice)) == counts(index.term_frequencies(twice))
    assert "Exchange hashpartitioning" not in build_index(once).postings._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("few", [0, 500_000])
def test_blocks_are_made_of_counts(corpus, built, spark, tmp_path, monkeypatch, few):
    """Without the postings by term, whether the vocabulary is sent to all tasks or not."""
    from corvina.operators import ranked

    monkeypatch.setattr(index, "FEW_TERMS", few)
    monkeypatch.setattr(index, "HOT", 5)
    ranked.write_ranked(index.write_counts(corpus[1], str(tmp_path)), str(tmp_path))
    assert not (tmp_path / "postings").exists()
    got = ranked.search_ranked(ranked.Ranked.load(spark, str(tmp_path)), ["a", "c"], Operator.OR, 10)[0]
    assert [tuple(r) for r in got.collect()] == [tuple(r) for r in search(built, ["a", "c"], Operator.OR, 10).collect()]


def test_boosts(spark):
    pages = spark.createDataFrame([(1, "Ruskom prezidentom,", ("x", {"mesto prezidentom": "rusko rusko"})), (2, None, None)], "doc_id long, title string, infobox struct<name:string,properties:map<string,string>>")
    got = {r.doc_id: r.boost for r in boost(pages, ["rusko", "prezidentom", "rusko"]).collect()}
    assert got[2] == 0 and got[1] == pytest.approx(3 * 0.3 + 2 * 0.15 + 0.1)  # the title's second word is no plain word and stays whole


def test_fielded(spark, tmp_path):
    schema = "doc_id long, title string, infobox struct<name:string,properties:map<string,string>>, terms array<string>"
    pages = spark.createDataFrame([(1, "Rusko dnes", ("štát", {"mesto": "moskva"}), ["rusko", "rusko"]), (2, "Iné", None, ["rusko", "more"]), (3, "Rusko", None, ["more"])], schema)
    store = Segments(spark, str(tmp_path))
    for some, n in ((pages.where("doc_id < 3"), 2), (pages, 1), (pages, 0)):  # what is there stays
        new = store.lacking(some)
        assert new.count() == n
        store.append(fielded.field_terms(new))
    store.publish(norms=False)
    i = store.field_index()
    assert {r.field: (r.n_docs, r.avgdl) for r in i.fields.collect()}["terms"] == (3, pytest.approx(5 / 3))
    got = fielded.field_search(i, fielded.clauses(["rusko", "moskva"], ["rusko"])).collect()
    assert [r.doc_id for r in got] == [1, 2]  # 3 has no such term in its text
    assert [r.doc_id for r in fielded.field_search(i, fielded.clauses(["rusko"], [])).collect()] == [3, 1]


def test_metrics(spark):
    got = spark.createDataFrame([(1, r, d) for r, d in ((1, 1), (2, 2), (3, 3), (4, 4))] + [(2, 1, 9)], "query_id int, rank int, doc_id long")
    want = spark.createDataFrame([(1, 2), (1, 4), (1, 5), (3, 1)], "query_id int, doc_id long")
    prf = {r.query_id: (r.precision, r.recall, r.f1) for r in metrics.precision_recall_f1(got, want).collect()}
    assert prf[1] == pytest.approx((0.5, 2 / 3, 4 / 7)) and prf[2] == (0, 0, 0) and prf[3] == (0, 0, 0)
    assert {r.query_id: r.ap for r in metrics.average_precision(got, want).collect()} == {1: pytest.approx(1 / 3), 3: 0}
    assert {r.query_id: r.precision for r in metrics.precision_at(got, want, 2).collect()} == {1: 0.5, 2: 0}


def test_preprocessing_goes_on(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"t{i}", f"Word{i} and the") for i in range(4)], "doc_id long, title string, text string")
    store, steps = str(tmp_path / "store"), ["tokenize", "remove_stopwords"]
    preprocess_batch(pages.where("doc_id < 2"), store, steps, ["the"])
    assert sorted(r.doc_id for r in not_cached(with_key(pages, made_by(steps, ["the"])), store).collect()) == [2, 3]
    pages.write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        preprocess_stream(spark, str(tmp_path / "in"), "doc_id long, title string, text string", store, str(tmp_path / "ck"), steps, ["the"]).awaitTermination()
    rows = read_or_empty(spark, store, CACHE).collect()
    assert sorted((r.title, r.terms) for r in rows) == [(f"t{i}", ["word", "and"]) for i in range(4)]
    assert read_or_empty(spark, str(tmp_path / "none"), CACHE).count() == 0


def test_engine(spark, tmp_path):
    (tmp_path / "d.xml").write_text(DUMP.replace("pomoc</text>", "Rusko pomoc</text>").replace("<title>Bez</title>", "<title>Bez</title><revision><text>o Rusko more</text></revision>"))
    conf = Config(index_path=str(tmp_path / "i"), dump_path=str(tmp_path / "d.xml"), preprocessor_components=["normalize", "tokenize", "remove_stopwords"])
    engine = Engine.build(spark, conf, ["the"])
    got = engine.search("Rusko?", n=5).orderBy("rank").collect()
    assert [r.title for r in got] == ["Rusko", "Bez"] and got[0].infobox_title == "ŠtátSveta" and got[0].score > got[1].score
    assert Engine.load(spark, conf).search("xyzq", Operator.OR).count() == 0
    assert engine.match_count("Rusko?") == 2 and engine.match_count("xyzq", Operator.OR) == 0


def test_the_written_index_is_the_built_one(corpus, built, spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "HOT", 5)  # most terms are hot
    done = index.write_index(corpus[1], str(tmp_path / "i"))
    got = Index.load(spark, str(tmp_path / "i"))
    assert done["n_docs"] == 61 and done["n_terms"] == built.vocab.count() and done["n_postings"] == built.postings.count() and done["seconds"] > 0
    key = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())
    for t in ("postings", "vocab", "doc_norm", "corpus_stats"):
        a, b = getattr(got, t), getattr(built, t)
        assert key(a.select(sorted(a.columns))) == key(b.select(sorted(b.columns)))
    plan = index.term_frequencies(spark.createDataFrame([(1, "a b")], "doc_id long, text string").selectExpr("doc_id", "split(text, ' ') as terms"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1


def test_an_index_is_written_where_its_texts_are(corpus, built, spark, tmp_path):
    """postings are neither ranged by term nor written with their weights; a question's filter reaches the counts, which are sorted, and the vocabulary."""
    index.write_index(corpus[1].repartition(3), str(tmp_path / "i"))
    files = list((tmp_path / "i/tf").glob("*.parquet"))
    found = [[r.term for r in spark.read.parquet(str(f)).collect()] for f in files]
    assert not (tmp_path / "i/postings").exists() and len(files) == 3 and all(f == sorted(f) for f in found) and any(set(a) & set(b) for a in found for b in found if a is not b)
    got = Index.load(spark, str(tmp_path / "i"))
    plan = search(got, ["a", "c"], Operator.OR, 10)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("In(term, [a,c])") == 2 and "SortMergeJoin" not in plan
    for i in (got, Index(built.postings, built.vocab, built.doc_norm, built.corpus_stats)):
        for terms in (["a", "c", "a"], ["a", "nowhere"], ["nowhere"], []):
            want = built.postings.where(F.col("term").isin(terms)) if terms else built.postings.limit(0)
            assert sorted(map(tuple, i.of(terms).collect())) == sorted(map(tuple, want.collect()))
        for op in Operator:
            assert search(i, ["a", "c"], op, 10).collect() == search(built, ["a", "c"], op, 10).collect()


def test_engine_resumes_and_reads_old_keys(spark, tmp_path):
    (tmp_path / "d.xml").write_text(DUMP)
    (tmp_path / "lemmas.tsv").write_text("rusku\trusko\tPROPN\nmoskva\tmoskva\tNOUN\ntext\tslovo\tNOUN\n")
    (tmp_path / "conf.json").write_text(json.dumps({"inverted_index_path": str(tmp_path / "i"), "sk_wikipedia_dump_path": str(tmp_path / "d.xml"), "already_processed_path": str(tmp_path / "done"), "lemmas_path": str(tmp_path / "lemmas.tsv"), "preprocessor_components": ["tokenize", "lemmatize", "document_saver"]}))
    conf = load_config(str(tmp_path / "conf.json"))
    how = made_by(conf.preprocessor_components, (), dictionary(read_lemmas(spark, conf.lemmas_path)))
    made = with_key(spark.createDataFrame([("Prázdna", "")], "title string, text string"), how)
    append_terms(made.withColumn("terms", F.array(F.lit("kept"))), conf.already_processed_path)  # made before
    engine = Engine.build(spark, conf)
    assert {r.term for r in engine.index.lookup("kept").collect()} == {"kept"} and engine.index.lookup("slovo").count() == 1 and engine.index.lookup("rusku").count() == 0
    assert spark.read.parquet(conf.already_processed_path).count() == 3
    n, found = answer(engine, "text -n 3")
    assert n == 1 and found.first().title == "Rusko"


def test_prompt(spark, tmp_path, monkeypatch, capsys):
    (tmp_path / "d.xml").write_text(DUMP)
    (tmp_path / "stop").write_text("the\n")
    (tmp_path / "conf.json").write_text(json.dumps({"index_path": str(tmp_path / "i"), "dump_path": str(tmp_path / "d.xml"), "stop_words_path": str(tmp_path / "stop"), "preprocessor_components": ["tokenize"], "verbose": False}))
    monkeypatch.setattr("sys.argv", ["engine", str(tmp_path / "conf.json")])
    lines = iter(["Rusku -o", "1", "", "-o", "Q"])
    engine_main(lambda _: next(lines))
    out = capsys.readouterr().out
    assert "1 documents" in out and "hlavné mesto & y" in out and "the query is empty" in out


def test_field_engine(spark, tmp_path):
    (tmp_path / "d.xml").write_text(DUMP.replace("Text o [[", "Text prezidenta [[").replace("<title>Bez</title>", "<title>Prezident</title><revision><text>o prezidenta a more, more, more, a more more more, more</text></revision>"))
    pages = parse_pages(read_dump_raw(spark, str(tmp_path / "d.xml")))
    write_parts(preprocess(pages, ["tokenize"], text="raw_text"), str(tmp_path / "parts"))
    conf = Config(index_path=str(tmp_path / "f"), preprocessor_components=["tokenize"])
    FieldEngine.build(spark, conf, str(tmp_path / "parts"))
    engine = FieldEngine.build(spark, conf, str(tmp_path / "parts"))  # again: nothing is added
    assert {r.field: r.n_docs for r in engine.index.fields.collect()}["title"] == 3
    got = engine.search("prezidenta").orderBy("rank").collect()
    # both have the term; the stem of the question is that of the first one's title
    assert [r.title for r in got] == ["Prezident", "Rusko"] and got[1].infobox_title == "ŠtátSveta" and got[0].score > got[1].score
    assert engine.search("nothing").count() == 0


def test_weights_of_a_large_vocabulary_and_vectors(spark, corpus, monkeypatch):
    """Only terms that few exceed in df are sent; vectors have no row an occurrence, and a repeated doc_id is one document."""
    docs, frame = corpus[0], corpus[1]
    whole = build_index(frame)
    want = {(r.term, r.doc_id): r.w for r in whole.postings.collect()}
    told = {r.doc_id: r.vector for r in vectors(frame, whole).collect()}
    monkeypatch.setattr(index, "FEW_TERMS", 3)
    monkeypatch.setattr(index, "HOT", 1)
    vocab = whole.vocab
    assert 0 < vocab.where(F.col("df") > index.frequent(vocab)).count() <= 3
    split = build_index(frame)
    assert {(r.term, r.doc_id): r.w for r in split.postings.collect()} == pytest.approx(want)
    again = {r.doc_id: r.vector for r in vectors(frame, split).collect()}
    assert again.keys() == told.keys() and all(again[k] == pytest.approx(told[k]) for k in told)
    plan = vectors(frame, split)._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan
    two = spark.createDataFrame([(1, ["a", "b"]), (1, ["b"]), (2, None), (3, ["b", None, "c"])], "doc_id long, terms array<string>")
    got = [(r.doc_id, len(r.vector)) for r in vectors(two, build_index(two)).collect()]
    assert sorted(got) == [(1, 3), (1, 3), (2, 0), (3, 2)]


def test_questions_meet_postings_where_they_are(spark, corpus, built):
    """Postings aren't shuffled by term, and what a question has of a document is added up without a second shuffle."""
    asked = spark.createDataFrame([(1, ["a", "b"]), (2, ["c"])], "query_id long, terms array<string>")
    plan = search_many(built, asked, Operator.AND, 5)._jdf.queryExecution().executedPlan().toString()
    keys = [set(re.findall(r"([a-z_]+)#", k)) for k in re.findall(r"hashpartitioning\(([^)]*)\)", plan)]
    assert {"doc_id"} in keys and {"term"} not in keys and {"doc_id", "query_id"} not in keys


def test_what_was_retrieved_is_found_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    got = spark.createDataFrame([(1, r, r) for r in range(1, 6)], "query_id int, rank int, doc_id long").mapInArrow(count, "query_id int, rank int, doc_id long")
    metrics.evaluate(got, spark.createDataFrame([(1, 2)], "query_id int, doc_id long"), (3, 5)).collect()
    assert seen.value == 5


def test_words_are_stemmed_once_each(spark, monkeypatch):
    """Not at each place of a text: rows are distinct before they go to Python."""
    from corvina.plans import catalogue

    seen = []
    monkeypatch.setattr(catalogue.index, "written", lambda table, name: seen.append(name) or table)
    catalogue.QUERIES["lemma_guesses"](spark, "/root/testdata/sf0.001")
    assert seen == ["words", "entries"]
