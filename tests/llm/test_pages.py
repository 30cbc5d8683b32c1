"""Operators over pages and vectors, and the piece encoder, against definitions, libraries and round trips."""

import base64
import gzip
import hashlib
import html
import math
import os
import random
import time
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvina.llm import neardup, pieces, warc
from corvina.llm.html import extract, main_text
from corvina.llm._base import Scratch

MODEL = "/opt/tokenizers/piece_bpe_32k.model"

# --- vectors


def links_of(rows, threshold=0.93):
    ok = {}
    for i, v, label in rows:
        good = i is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
        if good:
            x = np.array(v, float)
            ok.setdefault(i, (x / np.linalg.norm(x), label))
    return {i: {j for j, (y, m) in ok.items() if j != i and m == lab and len(y) == len(x) and x @ y >= threshold} for i, (x, lab) in ok.items()}


def vectors(n=250, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        if i and rng.random() < 0.6:
            v = np.array(rows[rng.integers(len(rows))][1]) + rng.normal(0, rng.choice([0, 0.05, 0.2]), 16)
        else:
            v = rng.normal(size=16)
        rows.append((i, [float(np.float32(x)) for x in v], int(rng.integers(2))))
    return rows


@pytest.mark.parametrize("block", [1024, 4])
def test_near_duplicates(spark, block):
    rows = vectors() + [(900, None, 0), (901, [0.0] * 16, 0), (902, [1.0, None], 0), (903, [float("nan")] * 16, 0), (904, [float("inf")] + [1.0] * 15, 1), (905, [1.0, 0.0], None), (906, [], 0), (907, [1.0, 1.0], 0), (908, [2.0, 2.0], 0), (None, [1.0, 1.0], 0)]
    rows.append(rows[5])
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "vec_id long, embedding array<float>, label int, weight int, code string")
    got = neardup.near_duplicates(df, Scratch(spark, "t"), block=block, bits=6, tables=40, group_rows=50).collect()
    assert len(got) == len(rows)
    links = links_of(rows)
    comp = {i: i for i in links}
    while True:
        new = {i: min([comp[i], *(comp[j] for j in links[i])]) for i in comp}
        if new == comp:
            break
        comp = new
    for r in got:
        i = r.vec_id
        assert (r.n_links, r.component_id) == (len(links.get(i, ())), comp.get(i, i))
        assert r.kept == (i is not None and comp.get(i, i) == i)
    assert sum(map(len, links.values())) > 100
    assert neardup.near_duplicates(df.where("false"), Scratch(spark, "t")).count() == 0


def test_production_parameters_find_planted_pairs(spark):
    """Pairs planted at cosines from 0.93 up, among vectors at random: bits and tables are those that the query takes."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(400):
        x = rng.normal(size=64)
        x /= np.linalg.norm(x)
        y = rng.normal(size=64)
        y -= (y @ x) * x
        c = rng.uniform(0.931, 0.95)
        rows += [(2 * i, x.tolist(), 0), (2 * i + 1, (c * x + np.sqrt(1 - c * c) * y / np.linalg.norm(y)).tolist(), 0)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), Scratch(spark, "t")).collect()
    links = links_of(rows)
    assert sum(r.n_links for r in got) >= 0.98 * sum(map(len, links.values())) > 700
    assert all(r.n_links <= len(links[r.vec_id]) for r in got)
    assert neardup.tables_for(0.93, neardup.bits_for(8000), 0.997) == 48


# --- pages


def page(article, body="", title="T"):
    return (
        f'<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/">Home page</a></li><li><a>More, here.</a></li></ul></nav>'
        f'<!-- <p>old</p> --><div class="ad">Buy this, now. It is good.</div>{article}{body}<footer>&copy; Us, here. All rights.</footer></body></html>'
    )


LONG = "<p>" + "</p><p>".join(f"A sentence of the article, number {i}. It goes on, and on, for a while." for i in range(5)) + "</p>"
LONG_TEXT = "\n".join(f"A sentence of the article, number {i}. It goes on, and on, for a while." for i in range(5))


@pytest.mark.parametrize(
    "given, expected",
    [
        (None, ""),
        ("", ""),
        ("<nav>only</nav>", ""),
        ("plain &amp; simple", "plain & simple"),
        (page("<article><h1>A &eacute;&#233;&am</h1><p><b>x\n\t y<br>z<p>short.</p></article>"), "A éé&am\nx y z\nshort."),
        (page(f"<article>{LONG}<aside>Not, this.</aside><form><p>Nor this.</p><input></form><div id='comments'><p>First, comment!</p></div></article>"), LONG_TEXT),
        (page(f"<main><div class='cookie-notice'>Cookies, yes.</div>{LONG}</main>", "<aside class='sidebar'><p>Side, text. More.</p></aside>"), LONG_TEXT),
        (page(f"<div>{LONG}</div>"), LONG_TEXT),
        ("<article><p>cut in the mid", "cut in the mid"),
        ("<article><p>a</p><script>never ends <p>b", "a"),
        ("<article>1 < 2 <p title='x>y'>b</p> c &lt;i&gt;", "1 < 2\nb\nc <i>"),
    ],
)
def test_main_text(given, expected):
    assert main_text(given) == expected


def test_ratios_run_where_articles_are_teasers_or_not_all():
    cards = '<section class="more"><article class="card"><h3><a href="/">One more</a></h3></article><article class="card"><h3><a>And one</a></h3></article></section>'
    assert main_text(page(f"<div>{LONG}</div>", cards)) == LONG_TEXT
    assert main_text(page(f"<article><h1>Title</h1>{LONG}</article>", f"<section>{LONG}</section>")) == f"Title\n{LONG_TEXT}\n{LONG_TEXT}"


@pytest.mark.parametrize(
    "given",
    [
        f'<body class="has-sidebar"><div>{LONG}</div></body>',
        f'<html class="no-footer"><body><article>{LONG}</article><div class="sidebar"><p>Side, text.</p></div></body></html>',
        f'<div id="page" class="with-sidebar"><main>{LONG}</main><div class="comments"><article class="comment"><p>First, comment!</p></article></div></div>',
        f'<div class="with-sidebar"><div class="text">{LONG}</div><div class="sidebar"><p>Side, text.</p></div></div>',
        f'<form><div>{LONG}</div></form>',
        f'<div class="social"><p>{LONG_TEXT[:LONG_TEXT.index(chr(10))]}</p></div><div class="footer">{LONG[LONG.index("</p>") + 4:]}</div>',
    ],
)
def test_names_of_wrappers_are_no_noise(given):
    assert main_text(given) == LONG_TEXT or "social" in given and LONG_TEXT.endswith(main_text(given)) and main_text(given)


def test_the_header_of_an_article_is_content():
    assert main_text(f'<article><div class="article-header"><h1>Title</h1></div>{LONG}</article>') == f"Title\n{LONG_TEXT}"


@pytest.mark.parametrize("given", ['<svg viewBox="0 0 1 1"/>', "<svg/>", "<svg><text>drawn</text></svg>", "<math/>", '<object data="x">'])
def test_empty_or_open_elements_swallow_nothing(given):
    assert main_text(f"<article>{given}{LONG}</article>") == LONG_TEXT


def test_formulas_are_text():
    assert main_text("<article><p>As <math><mi>a</mi><mo>=</mo><mi>b</mi></math> holds.</p></article>") == "As a=b holds."


def test_extract(spark):
    rows = [(1, "u", page(f"<article>{LONG}</article>"), 1), (2, None, None, 2), (None, "x", "<p>é</p>", 3), (1, "u", "<p>é</p>", 1), (3, "u", "<p>" + "x " * 100_000, 0)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = extract(df).collect()
    assert [(r.page_id, r.url, r.text, r.n_chars) for r in got][:4] == [(1, "u", LONG_TEXT, len(LONG_TEXT)), (2, None, "", 0), (None, "x", "é", 1), (1, "u", "é", 1)]
    assert got[4].n_chars == 199_999 and extract(df.where("false")).count() == 0
    assert html.unescape("&am") == "&am"


def test_warc(spark, tmp_path):
    odd = "a\r\n\r\nWARC/1.0\r\nContent-Length: 5\r\n\r\nb\r\n\r\n"
    rows = [(i, f"http://h/{i}", ["same", odd, f"own é {i}", "", None][i % 5]) for i in range(60)]
    rows += [(100, "http://x/\r\nInjected: yes", "x" * 300_000), (None, None, "same"), (None, "u", "lonely"), (7, "http://h/7", "own é 7"[::-1])]
    df = spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, html string, digest string")
    scratch = Scratch(spark, "t")
    warc.write(df, f"{scratch.root}/a", scratch, file_bytes=9000)
    recs = scratch.save(warc.read(spark, f"{scratch.root}/a"))
    assert recs.groupBy("type").count().where("type in ('request', 'metadata')").agg(F.min("count"), F.max("count")).first()[:] == (len(rows), len(rows))
    assert recs.where("not whole").count() == 0 and recs.where("type = 'response' and payload is null").count() == 0
    got = warc.assemble(recs).collect()
    assert len(got) == len(rows)
    largest = {}
    for i, _, h in rows:
        if i is not None:
            largest[h or ""] = max(largest.get(h or "", -1), i)
    for r in got:
        p = r.response
        if r.page_id is None:
            assert p.type == "response" and r.refers_to is None
            continue
        body = next(h or "" for i, _, h in rows if i == r.page_id and base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode() == p.payload_digest)
        first = largest[body] == r.page_id
        assert (p.type, r.refers_to, p.payload_bytes) == ("response" if first else "revisit", None if first else largest[body], len(body.encode()))
        assert p.payload == (body if first else None) and r.request.id and r.metadata.page_id == r.page_id
    path = os.listdir(f"{scratch.root}/a".removeprefix("file://"))
    raw = b"".join(gzip.open(f"{scratch.root}/a".removeprefix("file://") + "/" + f).read() for f in path if f.endswith(".gz"))
    assert sum(1 for _ in warc.records(raw)) == 3 * len(rows) and b"\r\nInjected" not in raw
    warc.write(df, f"{scratch.root}/b", scratch, min_bytes=5)
    kinds = {r.page_id: r.response.type for r in warc.assemble(warc.read(spark, f"{scratch.root}/b", bodies=False)).collect()}
    assert kinds[0] == "response" and kinds[1] == "revisit"
    warc.write(df.where("false"), f"{scratch.root}/c", scratch)
    assert warc.assemble(warc.read(spark, f"{scratch.root}/c")).count() == 0
    with pytest.raises(ValueError):
        list(warc.records(b"WARC/1.0\r\nContent-Length: 9\r\n\r\nabc"))


# --- pieces


def toy_unigram() -> bytes:
    """A small unigram model: letters, some pairs and words, byte pieces."""
    rng = random.Random(1)
    entries = [("<unk>", 0.0, 2)] + [(f"<0x{i:02X}>", 0.0, 6) for i in range(256)]
    entries += [(p, -rng.uniform(1, 9), 1) for p in ["▁", *"abcdeé", "ab", "bc", "cde", "▁a", "▁ab", "abc", "▁abc", "dé", "éé", "▁▁", "ea"]]
    message = b""
    for piece, score, kind in entries:
        p = piece.encode()
        body = b"\x0a" + bytes([len(p)]) + p + b"\x15" + struct.pack("<f", score) + b"\x18" + bytes([kind])
        message += b"\x0a" + bytes([len(body)]) + body
    trainer = b"\x18\x01" + b"\x98\x02\x01"  # model_type unigram, byte_fallback
    norm = b"\x0a\x08identity" + b"\x18\x01\x20\x00\x28\x01"
    return message + b"\x12" + bytes([len(trainer)]) + trainer + b"\x1a" + bytes([len(norm)]) + norm


def texts(letters, n):
    rng = random.Random(7)
    return ["", " ", "  a  b ", "x" * 300, "日本 😀 Ж", "abc\n\tcde", *("".join(rng.choice(letters) for _ in range(rng.randint(1, 40))) for _ in range(n))]


@pytest.mark.skipif(not os.path.exists(MODEL), reason="needs the model file")
def test_bpe_is_the_library(spark):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    ts = texts("abcdefg thein  \né.1", 400)
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(ts)] + [(None, None, "x"), (1, ts[9], "x")], "doc_id long, text string, ids string")
    both = pieces.decode(pieces.encode(df, MODEL), MODEL).collect()
    assert sorted(map(str, both)) == sorted(map(str, pieces.encode_and_decode(df, MODEL).collect()))
    assert len(both) == len(ts) + 2
    for r in both:
        if r.doc_id is None:
            assert r.ids is None and r.text is None
        elif r.doc_id != 1:
            assert list(r.ids) == lib.encode(ts[r.doc_id]) and r.text == ts[r.doc_id] == lib.decode(list(r.ids))
    assert pieces.encode(df.where("false"), MODEL).count() == 0


def test_unigram_lattice_is_the_library(spark, tmp_path):
    import sentencepiece

    (tmp_path / "m").write_bytes(toy_unigram())
    lib = sentencepiece.SentencePieceProcessor(model_file=str(tmp_path / "m"))
    ts = texts("abcdeé  x", 300)
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(ts)] + [(999, None, "x"), (999, "ab", "x"), (2, ts[2], "x")], "doc_id long, text string, word string")
    rows = pieces.encode(df, str(tmp_path / "m")).collect()
    assert len(rows) == len(ts) + 3
    for r in rows:
        if r.doc_id < 900:
            want = lib.encode(ts[r.doc_id])  # of two paths with one score, either will do
            assert list(r.ids) == want or lib.decode(list(r.ids)) == lib.decode(want) and sum(map(lib.get_score, r.ids)) == pytest.approx(sum(map(lib.get_score, want)), abs=1e-4)
    assert sorted([r.ids for r in rows if r.doc_id == 999], key=str) == sorted([None, lib.encode("ab")], key=str)
    assert pieces.encode(df.where("false"), str(tmp_path / "m")).count() == 0


def test_models_that_are_not_provided_for_are_refused():
    with pytest.raises(ValueError):
        pieces.load(toy_unigram().replace(b"\x20\x00\x28\x01", b"\x20\x01\x28\x01"))


def test_registered_queries(spark):
    """Every operator is registered, and gives the rows of its SQL where it has one."""
    import duckdb

    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.001"
    names, sql = entry.queries(), entry.oracle_sql()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)) and "pipeline" in names
    if not os.path.isdir(sf):
        return
    db = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "benchmark"):
        db.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    rows = {t: db.sql(f"select count(*) from {t}").fetchall()[0][0] for t in ("documents", "pages", "embeddings")}
    for n in sorted(x for x in names if x.startswith("op")):
        got = names[n](spark, sf)
        columns, made = sorted(got.columns), got.collect()
        assert len(made) == rows["pages" if n.startswith(("op6", "op9")) else "embeddings" if n.startswith("op4") else "documents"]
        if n in sql:
            want = db.sql(sql[n])
            assert sorted(want.columns) == columns
            assert sorted(repr([r[c] for c in columns]) for r in made) == sorted(repr([r[want.columns.index(c)] for c in columns]) for r in want.fetchall())
    assert {"op1_sharding", "op4_embedding_neardup", "op5_line_dedup", "op7_jaccard_join", "op9_warc", "op11_resample"} <= sql.keys()


def test_registered_queries_on_empty_tables(spark, tmp_path):
    """No rows, and the columns that the full tables give; the pipeline, too."""
    import __spark_entry__ as entry

    tables = {"documents": "doc_id long, text string, lang string, source string, n_chars long", "labels": "doc_id long, quality long, toxic long", "pages": "page_id long, url string, html string", "embeddings": "vec_id long, embedding array<float>, label int", "benchmark": "item_id long, text string"}
    for t, schema in tables.items():
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{t}.parquet")
    for n, f in entry.queries().items():
        if n == "pipeline" or n.startswith("op"):
            got = f(spark, str(tmp_path))
            assert got.count() == 0 and len(got.columns) > 2, n


def test_vectors_are_those_of_the_sql(spark, tmp_path):
    """The registered query's SQL on vectors with links, as the small test tables have none."""
    import duckdb

    from corvina.llm import queries

    rows = vectors(150, 5) + [(900, None, 0), (901, [0.0] * 16, 0), (902, [1.0, None], 0), (903, [float("nan")] * 16, 0), (905, [1.0, 0.0], None), (906, [], 0), (907, [1.0, 1.0], 0), (908, [2.0, 2.0], 0)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    db = duckdb.connect()
    db.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    want = sorted(db.sql(f"select vec_id, n_links, component_id, kept from ({queries.OP4_SQL})").fetchall())
    got = sorted(tuple(r) for r in queries.op4_embedding_neardup(spark, str(tmp_path)).select("vec_id", "n_links", "component_id", "kept").collect())
    assert len(want) == len(rows) and sum(w[1] for w in want) > 50
    assert sum(g == w for g, w in zip(got, want)) >= 0.95 * len(want) and all(g[1] <= w[1] for g, w in zip(got, want))


def test_html_names():
    """Names of the body, of wrappers and of an article's own parts don't take the text away; comments that are articles go."""
    p = "This is a paragraph of the main article, with commas, and a full stop. It goes on for a while, so that it counts."
    for page in (f'<body class="home no-sidebar"><div><p>{p}</p><p>{p}</p></div></body>', f'<body class="page has-header"><div><p>{p}</p><p>{p}</p></div></body>', f'<form id="aspnetForm"><div class="c"><p>{p}</p><p>{p}</p></div></form>'):
        assert main_text(page) == f"{p}\n{p}"
    assert main_text(f'<article><p>{p}</p><div class="legal-analysis"><p>Law. {p}</p></div><div class="legal-notice"><p>{p}</p></div></article>') == f"{p}\nLaw. {p}"
    assert main_text(f'<article><p>{p}</p></article><article class="comment"><p>I think so, too. {p}</p></article>') == p
    assert main_text(f'<article><p>{p}</p><ul><li><a href="x">One</a><li><a href="x">Two</a><li><a href="x">Three</a></ul></article>') == f"{p}\nOne\nTwo\nThree"
    cards = "<section><article><h3>Teaser</h3><p>Short text.</p></article><article><h3>Another</h3><p>Short text.</p></article></section>"
    assert main_text(f'<div class="content">{f"<p>{p}</p>" * 4}</div>{cards}') == "\n".join([p] * 4)
    assert main_text(f'<div class="x"><p>{p}</p><ul><li>First of a list</li><li>Second</li></ul><blockquote>A quote, as said.</blockquote><p>{p}</p></div>').split("\n")[1:4] == ["First of a list", "Second", "A quote, as said."]


def test_tag_path_ratios_by_the_definition():
    """Paths' scores computed node by node, in plain Python, choose the same paths, on pages without an article and on random ones."""
    import math

    from corvina.llm import html as h

    def chosen(found, least=1.0):
        full = [n for n in found if not n.noise and n.text.strip()]
        by = {}
        for n in full:
            by.setdefault(n.path, []).append(n)
        avg = lambda x: sum(x) / len(x)
        size = {p: avg([len(n.text.strip()) for n in ns]) for p, ns in by.items()}
        marks = {p: avg([len(h.PUNCTUATION.findall(n.text)) for n in ns]) for p, ns in by.items()}
        w = [math.exp(-d * d / 2) for d in range(-2, 3)]
        near = lambda i, v: sum(w[d + 2] * v[full[min(max(i + d, 0), len(full) - 1)].path] for d in range(-2, 3)) / sum(w)
        fused = [math.sqrt(near(i, size) * (1 + near(i, marks))) * (0.1 if n.linked else 1) for i, n in enumerate(full)]
        score = {p: avg([f for f, n in zip(fused, full) if n.path == p]) for p in by}
        dev = math.sqrt(avg([(f - avg(fused)) ** 2 for f in fused])) if full else 0
        edge = min(least * dev, 0.5 * max(score.values())) if len(score) > 1 else 0
        own = [0 if n.linked else len(n.text.strip()) for n in full]
        raised = any(n.inside for n in full) and 2 * sum(o for o, n in zip(own, full) if n.inside) >= sum(own)
        return {p for p, s in score.items() if s + (edge if raised and any(n.inside for n in by[p]) else 0) >= edge - 1e-9}

    rng, tags = random.Random(4), ["div", "p", "span", "a", "li", "ul", "section", "b", "td", "article"]
    cut = 0
    for _ in range(200):
        page = "".join(rng.choice([f"<{(t := rng.choice(tags))} class=c{rng.randrange(3)}>", f"</{rng.choice(tags)}>", " ".join(["word,"] * rng.choice([1, 2, 30])), "text."]) for _ in range(60))
        found = h.nodes(page)
        want = chosen(found)
        assert h.content_paths(found, 1.0) == want
        cut += want < {n.path for n in found if not n.noise and n.text.strip()}
    assert cut > 100


def test_recall_with_production_parameters(spark):
    """8,000 vectors of one label, whose name is no number: 17 bits in 48 tables. Chains of near vectors at 0.93 to 0.97 among random ones."""
    rng = np.random.default_rng(5)
    x = rng.standard_normal((8000, 32))
    for i in range(0, 4000, 2):  # a partner at a given cosine
        u = x[i] / np.linalg.norm(x[i])
        r = rng.standard_normal(32)
        r -= (r @ u) * u
        c = rng.uniform(0.931, 0.97)
        x[i + 1] = c * u + math.sqrt(1 - c * c) * r / np.linalg.norm(r)
    assert neardup.bits_for(8000) == 17 and neardup.tables_for(0.93, 17, 0.997) == 48
    df = spark.createDataFrame([(i, v, "a") for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>, label string")
    got = {r.vec_id: r.n_links for r in neardup.near_duplicates(df, Scratch(spark, "t")).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = (unit @ unit.T >= 0.93).sum(axis=1) - 1
    assert want.sum() >= 4000 and all(got[i] <= want[i] for i in got)
    assert sum(got.values()) / want.sum() > 0.99


WORDY = "<p>" + "A long paragraph of the article, with sentences. And more of it, too. " * 3 + "</p>"


@pytest.mark.parametrize("part, stays", [
    (f'<section id="related-work"><h2>Related work</h2>{WORDY}</section>', True), (f'<section id="social-history">{WORDY}</section>', True), ('<p class="share-price">The share price rose by a tenth.</p>', True),
    ('<div class="ad-hoc">An ad hoc solution was found, they say.</div>', True), ('<div class="share-buttons"><a href=x>Tweet this, now.</a></div>', False), ('<div class="related-articles"><a>One</a><a>Two</a></div>', False),
    ('<div class="ad-container">Buy now, cheap!</div>', False), ('<div class="newsletter-signup">Subscribe to our letter. It is free.</div>', False), ('<div class="social-reach"><a>Many, many.</a> ok</div>', False),
])
def test_names_with_a_word_of_their_own(part, stays):
    for around in ("article", "div"):
        page = lambda x: main_text(f"<html><body><{around}>{WORDY}{WORDY}{x}{WORDY}</{around}></body></html>")  # noqa: B023, E731
        assert (len(page(part)) > len(page(""))) == stays, around


def test_lists_of_comments():
    page = f'<html><body><article>{WORDY}</article><ol class="commentlist"><li>{WORDY.replace("article", "reader")}</li><li>I agree, as ever. {WORDY}</li></ol></body></html>'
    assert main_text(page) == main_text(f"<html><body><article>{WORDY}</article></body></html>")


@pytest.mark.parametrize("page", ["<div>" * 100_000 + "</b>" * 100_000, "<h1>x" * 100_000, "<td>" * 100_000, "<p>a<ul><li>b" * 50_000, "<p>" * 100_000 + "<li>" * 100_000])
def test_time_is_linear_in_the_page(page):
    began = time.process_time()
    main_text(page)
    assert time.process_time() - began < 8
