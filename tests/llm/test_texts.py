"""Operators over documents against plain Python, on small tables with nulls, empty and long texts, ties, repeats and clashing columns."""

import collections
import math
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from corvina.llm import jaccard, langid, lines, mixing, quality
from corvina.llm._base import Scratch, small
from corvina.llm.components import components
from corvina.llm.shards import Conflict, ShardStore

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, _name string, weight int"


def frame(spark, rows):
    """doc_id, text, and optionally lang and source; with columns whose names operators use, too."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or ""), "x", "y", 1) for r in rows]
    return spark.createDataFrame(full, DOCS)


def prose(rng, n, words=400):
    return " ".join(f"w{int(rng.paretovariate(0.6)) % words}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    base = [prose(rng, rng.randint(1, 300)) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(base)]
    for i in range(40, 100):  # copies, near copies, bordering copies
        words = rng.choice(base).split()
        for _ in range(rng.choice([0, 0, 1, 2, 5])):
            words[rng.randrange(len(words))] = "new" + str(rng.randrange(9))
        rows.append((i, " ".join(words).upper() if i % 7 == 0 else "  ".join(words)))
    return rows + [(200, None), (201, ""), (202, " \t\n"), (203, "one two"), (204, "ONE\ttwo"), (205, "x " * 30_000), (3, base[3]), (None, base[0])]


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def classes(links, ids):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {i: find(i) for i in ids}


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)] + [(7, x) for x in range(500, 560)] + [(1, 1)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()}
    want = classes(edges, {x for e in edges for x in e})
    assert got == {i: c for i, c in want.items() if i != c}
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t")).count() == 0


@pytest.mark.parametrize("percent", [80, 50])
def test_jaccard_groups(spark, corpus, percent):
    sets = {}
    for i, t in corpus:
        w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in words(t)]
        if i is not None:
            sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    linked = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    want = classes(linked, sets)
    got = jaccard.groups(frame(spark, corpus), Scratch(spark, "t"), percent=percent).collect()
    assert len(got) == len(corpus)
    for r in got:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), want[r.doc_id])
    assert len(linked) > 30
    assert jaccard.groups(frame(spark, []), Scratch(spark, "t")).count() == 0


def test_a_group_of_many_near_copies_needs_few_pairs(spark):
    """Copies of one text, each with an own change: all in one group, though later ones are compared with a few leaders only."""
    rng = random.Random(2)
    base = [f"u{i}" for i in range(400)]
    rows = []
    for i in range(300):
        t = list(base)
        t[rng.randrange(400)] = f"v{i}"
        rows.append((i, " ".join(t)))
    _, _, found, _ = jaccard.links(frame(spark, rows), Scratch(spark, "t"))
    assert found.count() < 300 * 12
    assert jaccard.groups(frame(spark, rows), Scratch(spark, "t")).where("component_id <> 0").count() == 0


def test_cells_decide_most_of_a_group_of_near_copies(spark, monkeypatch):
    """Copies with few changes link by their distance from the pivot alone; with more changes the blocks decide, and all counts are exact."""
    rng = random.Random(3)
    base, rows = [f"u{i}" for i in range(400)], []
    for i in range(200):
        t = list(base)
        for _ in range(i % 2 if i < 150 else 7):
            t[rng.randrange(400)] = f"v{i}x{rng.random()}"
        rows.append((i, " ".join(t)))
    sets = {i: {tuple(t.split()[j : j + 5]) for j in range(396)} for i, t in rows}
    want = {a: sum(a != b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) for b in sets) for a in sets}
    open_rows = []
    whole = jaccard.cells
    monkeypatch.setattr(jaccard, "cells", lambda *a: open_rows.append(whole(*a)) or open_rows[0])
    got = jaccard.groups(frame(spark, rows), Scratch(spark, "t"), counts=True).collect()
    assert {r.doc_id: r.n_links for r in got} == want and len(set(want.values())) > 1
    assert any(not r.open for r in open_rows[0].collect()) and any(r.itself for r in open_rows[0].collect())


def test_parities_bound_the_difference(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    rows, apart = [], []
    for n, m, shared in [(0, 3, 0), (5, 5, 5), (500, 510, 480), (500, 900, 300), (513, 600, 100), (40_000, 39_000, 38_000)]:
        x = rng.integers(0, 1 << 63, n + m, dtype=np.uint64)
        a, b = x[:n], np.concatenate([x[:shared], x[n : n + m - shared]])
        rows.append((jaccard.parities(a).tolist(), jaccard.parities(b).tolist()))
        apart.append(n + m - 2 * shared)
    got = [r[0] for r in spark.createDataFrame(rows, "a_bits array<long>, b_bits array<long>").selectExpr(jaccard.APART).collect()]
    assert all(g <= a for g, a in zip(got, apart)) and got[1] == 0 and got[2] > 15 and got[3] > 200 and got[4] > 200 and got[5] > 2000


@pytest.mark.parametrize("times", [2, 4])
def test_jaccard_groups_of_repeated_rows(spark, times):
    """Different pairs of near copies are grouped each by itself, also where every row stands an even number of times."""
    rows = []
    for i in range(0, 12, 2):
        t = [f"t{i}x{j}" for j in range(200)]
        rows += [(i, " ".join(t)), (i + 1, " ".join([*t[:-1], "other"]))]
    got = jaccard.groups(frame(spark, rows * times), Scratch(spark, "t")).collect()
    assert len(got) == len(rows) * times
    assert {(r.doc_id, r.component_id) for r in got} == {(i, i - i % 2) for i, _ in rows}


@pytest.mark.parametrize("block", [128, 8])
def test_jaccard_counts_all_links(spark, corpus, block, monkeypatch):
    """In groups of near copies, and along a chain in which only neighbours link, each document has all its links."""
    monkeypatch.setattr(jaccard.link_counts, "__defaults__", (block,))
    rng = random.Random(5)
    rows = list(corpus)
    for i in range(40):
        t = [f"u{j}" for j in range(200)]
        for _ in range(i % 4 * 2):
            t[rng.randrange(200)] = f"v{rng.randrange(3)}"
        rows.append((300 + i, " ".join(t)))
    rows += [(400 + i, " ".join(f"c{j}" for j in range(9 * i, 9 * i + 100))) for i in range(30)]
    sets = {}
    for i, t in rows:
        w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in words(t)]
        if i is not None:
            sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    want = {a: sum(a != b and bool(sets[a] & sets[b]) and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) for b in sets) for a in sets}
    got = jaccard.groups(frame(spark, rows), Scratch(spark, "t"), counts=True).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: r.n_links for r in got} == {**want, None: 0}
    assert {r.n_links for r in got if r.doc_id and r.doc_id >= 400} == {1, 2}


def test_jaccard_groups_of_an_id_with_several_texts(spark):
    """Doc 5 equals doc 1 in one text and is near doc 9 in another: all three are one group, doc 20's second text is near doc 21's."""
    text = lambda c, last="": " ".join([*(f"{c}{j}" for j in range(200)), last])
    rows = [(1, text("a")), (5, text("a")), (5, text("b")), (9, text("b", "x")), (20, text("c")), (20, text("d")), (21, text("d", "x")), (30, text("e"))]
    got = jaccard.groups(frame(spark, rows), Scratch(spark, "t"), counts=True).collect()
    assert sorted((r.doc_id, r.component_id, r.n_links) for r in got) == [(1, 1, 1), (5, 1, 1), (5, 1, 1), (9, 1, 1), (20, 20, 0), (20, 20, 1), (21, 20, 1), (30, 30, 0)]


def test_jaccard_rows_are_those_of_the_sql(spark, tmp_path):
    """The registered query and its SQL, on words parted by each of the six white-space characters and by others, which part none."""
    import duckdb

    from corvina.llm import queries

    gaps = ["\x20", "\t", "\n", "\x0b", "\x0c", "\r", "\r\n", "\u00a0", "\x1f"]
    rows = [(i, gap.join(f"w{j}" for j in range(30))) for i, gap in enumerate(gaps)]
    rows += [(20, "\r"), (21, "a\rb"), (22, "A\x0cB"), (23, None), (24, ""), (25, gaps[5].join(f"w{j}" for j in range(29)))]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    columns = ["doc_id", "n_shingles", "component_id", "n_links"]
    want = sorted(db.sql(f"select {', '.join(columns)} from ({queries.OP7_SQL})").fetchall())
    got = sorted(tuple(r) for r in queries.op7_jaccard_join(spark, str(tmp_path)).select(columns).collect())
    assert got == want
    assert {r[0]: r[1:] for r in got} == {**{i: (26, 0, 7) for i in range(7)}, 7: (1, 7, 0), 8: (1, 8, 0), 20: (0, 20, 0), 21: (1, 21, 1), 22: (1, 21, 1), 23: (0, 23, 0), 24: (0, 24, 0), 25: (25, 0, 7)}


def test_a_language_of_long_texts_is_learnt(spark):
    rows = [(i, "zz qq kz wq " * 40_000, "xx") for i in range(3)] + [(10 + i, "der die und ung " * 30, "de") for i in range(20)]
    rows += [(50, "zq kzqq wq zz qq", None), (51, "x" * 1_000_000, "yy")]
    docs = frame(spark, rows)
    got = langid.sample(docs.where("lang is not null"), 5000, piece_chars=2000)
    assert set(got) == {"xx", "de", "yy"} and all(sum(map(len, x)) <= 5000 for x in got.values()) and len(got["xx"][0]) == 2000
    assert {r.doc_id: r.lang_pred for r in langid.identify(docs, F.lit(False)).collect()}[50] == "xx"


def test_language_sample_has_a_text_once(spark):
    rows = [(i, "hot text") for i in range(50)] + [(100 + i, f"own text {i}") for i in range(10)]
    got = langid.sample(frame(spark, rows), 1000)["en"]
    assert sorted(got) == sorted({t.encode() for _, t in rows})


def deduped(rows):
    """Lines of each text and which of them go, by the definition."""
    split = {i: re.split(lines.SPLIT, t) if t is not None else None for i, t in rows}
    first, out = {}, {}
    for i in sorted(k for k in split if k is not None and split[k] is not None):
        trim = [re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", x) for x in split[i]]
        gone = set()
        for j in range(len(trim) - 2):
            if first.setdefault(tuple(trim[j : j + 3]), (i, j)) != (i, j):
                gone |= {j, j + 1, j + 2}
        out[i] = gone
    return split, out


def test_line_dedup(spark):
    rng = random.Random(4)
    pool = [f"line {i}" for i in range(25)]
    rows = [(i, "\n".join(rng.choice(pool) + rng.choice(["", " ", "\r", "\n\n"]) for _ in range(rng.randint(0, 30)))) for i in range(60)]
    passage = "\n".join(["A passage", "that many", "documents", "share"])
    rows += [(100 + i, f"own {i}\n{passage}\n\nend {i}") for i in range(30)] + [(200, None), (201, ""), (202, "\n\n"), (203, "a\nb"), (204, "a\nb"), (None, passage), (205, "z\n" * 5000)]
    split, gone = deduped(rows)
    got = lines.dedup_lines(frame(spark, rows), Scratch(spark, "t"), counts=True).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.text == passage
        elif split[r.doc_id] is None:
            assert (r.text, r.n_lines, r.n_removed) == (None, 0, 0)
        else:
            keep = [x for j, x in enumerate(split[r.doc_id]) if j not in gone[r.doc_id]]
            assert (r.text, r.n_lines, r.n_removed) == ("\n".join(keep), len(split[r.doc_id]), len(gone[r.doc_id]))
    out = lines.dedup_lines(frame(spark, [(1, "a\nb\nc"), (1, "a\nb\nc"), (2, "a\nb\nc")]), Scratch(spark, "t"))
    assert sorted((r.doc_id, r.text) for r in out.collect()) == [(1, "a\nb\nc"), (1, "a\nb\nc"), (2, "")] and out.columns[0] == "doc_id"
    assert lines.dedup_lines(frame(spark, []), Scratch(spark, "t")).count() == 0


def rules(t):
    w = words(t)
    win = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = collections.Counter(win)
    covered = {i + k for i, x in enumerate(win) if n[x] > 1 for k in range(3)}
    full = [x for x in (t or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(full) - len(set(full)), len(covered)


def test_quality(spark, corpus):
    rows = [*corpus, (300, "é#ü *a* |\n a \nb\n a \n" * 40), (301, "a b c " * 60), (302, "THE!! END!! " + prose(random.Random(3), 80).upper())]
    trusted = spark.createDataFrame([(i,) for i in range(0, 100, 3)] + [(None,)], "doc_id long")
    buckets, alpha = 64, 1.0
    got = quality.quality(frame(spark, rows), trusted, buckets=buckets, threshold=-0.05).collect()

    def grams(t):
        h = [xxhash.xxh64(x.encode(), seed=42).intdigest() for x in words(t)]
        two = [xxhash.xxh64(b.to_bytes(8, "little"), seed=xxhash.xxh64(a.to_bytes(8, "little"), seed=42).intdigest()).intdigest() for a, b in zip(h, h[1:])]
        signed = [x - (1 << 64) if x >> 63 else x for x in h + two]
        return [x % buckets for x in signed]

    raw, hit = collections.Counter(), collections.Counter()
    for i, t in rows:
        raw.update(grams(t))
        if i is not None and i < 100 and i % 3 == 0:
            hit.update(grams(t))
    ratio = [math.log((hit[b] + alpha) / (sum(hit.values()) + alpha * buckets)) - math.log((raw[b] + alpha) / (sum(raw.values()) + alpha * buckets)) for b in range(buckets)]
    by_id = collections.defaultdict(list)
    for i, t in rows:
        by_id[i].append(t)
    for r in got:
        t = by_id[r.doc_id][0]
        n, *rest = rules(t)
        assert [r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words] == [n, *rest]
        assert r.base_failed == (n < 50 or 100 * rest[-1] > 50 * n)
        g = grams(t)
        assert r.score == pytest.approx(sum(ratio[b] for b in g) / len(g) if g else 0, abs=1e-9)
        assert r.kept == (not r.base_failed and r.score >= -0.05)
    assert len(got) == len(rows)
    kept = quality.filter_quality(frame(spark, rows), trusted)
    assert kept.columns == frame(spark, []).columns
    assert quality.quality(frame(spark, []), trusted).count() == 0
    assert quality.quality(frame(spark, rows), trusted.where("false")).where("score <> 0").count() == 0
    assert quality.quality(frame(spark, rows), trusted.where("false")).where("kept = base_failed").count() == 0


def test_quality_threshold_of_the_trusted_sample(spark):
    """Texts of words that the trusted ones don't have go, though no label says so; all that are like the trusted stay."""
    rng = random.Random(12)
    plain = [(i, " ".join(f"w{rng.randrange(300)}" for _ in range(150))) for i in range(200)]
    junk = [(1000 + i, " ".join(f"{rng.choice('$%&#')}{rng.randrange(200)}" for _ in range(150))) for i in range(20)]
    trusted = spark.createDataFrame([(i,) for i in range(100)], "doc_id long")
    got = {r.doc_id: r for r in quality.quality(frame(spark, plain + junk + [(1, plain[1][1])]), trusted, buckets=4096).collect()}
    assert not any(r.base_failed for r in got.values())
    assert {i for i, r in got.items() if r.kept} >= {i for i, _ in plain} - {min(range(200), key=lambda i: got[i].score)}
    assert not any(got[i].kept for i, _ in junk)
    score = sorted(got[r.doc_id].score for r in quality.trusted_sample(trusted, 10_000).where("half = 1").collect())
    at = lambda q: score[int(q * (len(score) - 1))] + (q * (len(score) - 1) % 1) * (score[min(len(score) - 1, int(q * (len(score) - 1)) + 1)] - score[int(q * (len(score) - 1))])
    least = at(0.01) - 0.75 * (at(0.5) - at(0.01))
    assert all(r.kept == (r.score >= least) for r in got.values())


def test_quality_takes_all_trusted_rows(spark, monkeypatch):
    """No number of them is left out, of the counts or of the threshold; too many to be sent to all executors give the same."""
    trusted = spark.range(10_500).withColumnRenamed("id", "doc_id")
    assert quality.trusted_sample(trusted).count() == 10_500
    rows = [(i, f"{'x' if i < 10_000 else 'y'}{i % 7}") for i in range(10_500)]
    got = {r.doc_id: r.score for r in quality.quality(frame(spark, rows), trusted, buckets=512, threshold=0.0).collect()}
    assert set(got.values()) == {0.0}  # target and corpus are the same texts
    monkeypatch.setattr(quality, "IDS", 10)
    assert {r.doc_id: r.score for r in quality.quality(frame(spark, rows), trusted, buckets=512, threshold=0.0).collect()} == got


def test_targets():
    t = mixing.targets({"a": 100, "b": 100, "c": 10, None: 100, "": 0}, (3, 1, 2), 1.5, 2.0)
    assert list(sorted(t, key=lambda s: (s is None, s or ""))) == ["", "a", "b", "c", None]
    assert t[""] == 0 and t["c"] == 20 and sum(t.values()) == pytest.approx(1.5 * 310)
    assert all(t[s] <= 2 * n for s, n in {"a": 100, "b": 100, "c": 10, None: 100}.items())
    # shares by weight among those that aren't full: a 1, b 2, null 1
    assert t["b"] == 200 and t["a"] / t[None] == pytest.approx(1 / 1, rel=1) and mixing.targets({}, (1,), 1.5, 2) == {}


def test_mixing(spark, corpus):
    rng = random.Random(6)
    rows = [(i, prose(rng, rng.choice([0, 1, 30, 400])), "en", rng.choice(["a", "b", "b", "b", "é", "", None])) for i in range(900)] + [(5000, None, "en", "a"), (None, "x y", "en", "a"), (7, "q r s", "en", "zz")]
    plan = mixing.plan_mix(frame(spark, rows), Scratch(spark, "t"), leaf=16, fan=4).collect()
    again = mixing.plan_mix(frame(spark, rows).repartition(7), Scratch(spark, "t"), leaf=16, fan=4).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.size, r.copies)
    assert sorted(plan, key=key) == sorted(again, key=key) and len(plan) == len(rows)
    size = {}
    for _, t, _, s in rows:
        size[s] = size.get(s, 0) + len(words(t))
    goal = mixing.targets(size, (3, 1, 2), 1.5, 2.0)
    taken, largest = collections.Counter(), collections.Counter()
    for r in plan:
        assert r.target == pytest.approx(goal[r.source]) and r.source_size == size[r.source] and r.taken == r.copies * r.size <= 2 * r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    for s in size:  # the last open document, and the rows outside the rounding (repeated ids)
        assert abs(taken[s] - goal[s]) <= largest[s] + 6
    none = [(None, f"word {i} of several", "en", "q" if i % 2 else None) for i in range(400)]
    lone = mixing.plan_mix(frame(spark, none), Scratch(spark, "t"), weights=(1, 9), share=0.9).collect()
    assert sum(r.taken for r in lone) == pytest.approx(0.9 * 1600, abs=10) and 0 < sum(r.taken for r in lone if r.source == "q") < 400
    out = collections.Counter(r.text for r in mixing.mix(frame(spark, none), Scratch(spark, "t"), weights=(1, 9), share=0.9).collect())
    assert sum(out.values()) * 4 == sum(r.taken for r in lone) and set(out.values()) <= {1, 2}
    with pytest.raises(ValueError):
        mixing.plan_mix(frame(spark, rows[:50]).withColumn("source", F.col("doc_id").cast("string")), Scratch(spark, "t"), most_sources=9)
    mixed = mixing.mix(frame(spark, rows[:900]), Scratch(spark, "t"))
    many = collections.Counter(r.doc_id for r in mixed.collect())
    assert set(many.values()) <= {1, 2} and mixed.columns == frame(spark, []).columns
    assert mixing.plan_mix(frame(spark, []), Scratch(spark, "t")).count() == 0


def test_the_last_group_is_repaired():
    rng = random.Random(5)
    for _ in range(200):
        sizes = [rng.choice([3, 10, 50, 400]) for _ in range(60)]
        ps = [rng.choice([0.0, 0.3, 0.6, 1.0]) for _ in sizes]
        first = mixing.pivotal(range(60), sizes, ps, 1, True)
        out = mixing.repaired(sizes, ps, first)
        assert all(o in (0, 1) and (0 < p < 1 or o == p) for o, p in zip(out, ps))
        miss = lambda x: abs(sum(n * (o - p) for n, o, p in zip(sizes, x, ps)))
        assert miss(out) <= miss(first)
        for i, p in enumerate(ps):  # no document is left whose turn would bring the words nearer
            assert not 0 < p < 1 or miss([1 - o if j == i else o for j, o in enumerate(out)]) >= miss(out) - 1e-9
    assert mixing.repaired([7], [0.4], [1.0]) == [0.0] and mixing.repaired([7], [0.6], [1.0]) == [1.0] and mixing.repaired([], [], []) == []


def test_pivotal_keeps_the_mean():
    total = [0.0] * 3
    for seed in range(4000):
        for i, p in enumerate(mixing.pivotal([1, 2, 3], [10, 30, 5], [0.2, 0.5, 0.7], seed, True)):
            assert p in (0, 1)
            total[i] += p / 4000
    assert total == pytest.approx([0.2, 0.5, 0.7], abs=0.03)


def test_language(spark):
    rng = random.Random(8)
    make = {"de": "der die und ung schen tz ein", "fr": "le la que eaux tion et é", "xx": "zz qq kz wq"}
    text = lambda lang: " ".join("".join(rng.choice(make[lang].split()) for _ in range(rng.randint(1, 3))) for _ in range(40))
    rows = [(i, text(lang), lang) for i, lang in enumerate(["de", "fr", "xx"] * 40)]
    rows += [(500, None, "de"), (501, "", "fr"), (502, "123 456 !!", "de"), (503, text("de") * 300, None), (504, "Ωμέγα", None), (505, " ", None), (506, "a", None)]
    got = {r.doc_id: r for r in langid.identify(frame(spark, rows), F.col("doc_id") % 4 == 2, sample_bytes=5000).collect()}
    assert len(got) == len(rows)
    for i, t, lang in rows[:120]:
        assert got[i].lang_pred == lang and got[i].held_out == (i % 4 == 2) and 0.5 < got[i].score <= 1
    assert [got[i].lang_pred for i in (500, 501, 502, 505)] == ["und"] * 4 and got[503].lang_pred == "de" and got[504].lang_pred in make and got[506].lang_pred in make
    alone = langid.identify(frame(spark, [(1, "abc", None)]), F.lit(False)).collect()
    assert [(r.lang_pred, r.score) for r in alone] == [("und", 0.0)]
    assert langid.identify(frame(spark, []), F.lit(False)).count() == 0


def test_code_lengths_are_those_of_the_trees():
    import numpy as np

    samples = {"a": [b"abracadabra abra", b"cad abra"], "b": [b"Banana bandana", b"ana\n\nnab"]}
    order, model = 3, langid.fit(samples, 3)
    fold = lambda t: b" " + b" ".join(t.lower().split())
    for text in (b"abra banana", b"xyz", b"ab", b"  n  "):
        data, off = langid.folded(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        bits = model.code_lengths(data, off)[0]
        assert all(model.long_code_length(data, piece)[0] == pytest.approx(bits) for piece in (1, 3, 5, 100))
        for lang, got in zip(model.langs, bits):
            seen = collections.defaultdict(collections.Counter)
            for t in map(fold, samples[lang]):
                for i in range(len(t)):
                    for k in range(min(order, i) + 1):
                        seen[t[i - k : i]][t[i]] += 1
            want, t = 0.0, bytes(data)
            for i in range(len(t)):
                for k in range(min(order, i), -1, -1):
                    c = seen.get(t[i - k : i])
                    if c:
                        n, d = sum(c.values()), len(c)
                        want -= math.log2((c[t[i]] or d) / (n + d))
                        if c[t[i]]:
                            break
                else:
                    want += math.log2(257)
            assert got == pytest.approx(want)


def test_shards(spark, tmp_path):
    store = ShardStore(spark, f"file://{tmp_path}/s", target_bytes=4000, fan=3, least_bytes=100)
    assert store.manifest() == (0, [])
    docs = frame(spark, [(i, f"text {i}" * (i % 9)) for i in range(200)] + [(None, None)] * 2)
    for i in range(4):
        store.append(docs.where(f"coalesce(doc_id, 0) % 4 = {i}"))
    store.append(docs.where("false"))
    version, runs = store.manifest()
    assert version == 5 and len(runs) == 5
    rows = lambda v=None: sorted(map(str, store.read(v).drop("_run").collect()))
    before = rows()
    assert before == sorted(map(str, docs.collect()))
    assert store.compact() == 6 and rows() == before == rows(5)
    (run,) = store.manifest()[1]
    assert run.rows == 202 and len(run.made_of) == 4 and store.compact() == 6
    with pytest.raises(Conflict):
        store.commit(5, runs)
    store.append(docs.withColumn("part", F.coalesce(F.col("doc_id"), F.lit(0)) % 2), "part")
    assert len(store.manifest()[1]) == 3 and store.read().count() == 404 and "part" not in store.read().columns
    store.vacuum()
    assert store.versions() == [7] and store.read().count() == 404
    none = ShardStore(spark, f"file://{tmp_path}/none")
    none.append(docs.where("false").withColumn("part", F.lit(1)), "part")
    none.append(docs.where("false"))
    none.compact()
    assert none.read().columns[:2] == ["doc_id", "text"] and none.read().count() == 0 and len(none.manifest()[1]) == 1


def test_models_of_many_languages(monkeypatch):
    rng, samples = random.Random(1), {}
    for k in range(10):
        letters = [chr(0x400 + k * 60 + i) for i in range(60)]
        vocabulary = ["".join(rng.choice(letters) for _ in range(rng.randint(2, 9))) for _ in range(20_000)]
        samples[f"l{k}"] = [" ".join(rng.choice(vocabulary) for _ in range(60_000)).encode()[:400_000]]
    model = langid.fit(samples)
    assert model.bytes() < 200 << 20
    text, at = langid.folded(np.frombuffer(b"".join(x[0][:900] for x in samples.values()), np.uint8), np.arange(11) * 900)
    assert [model.langs[i] for i in model.code_lengths(text, at).argmin(axis=1)] == sorted(samples)
    monkeypatch.setattr(langid, "MOST_BYTES", 1 << 20)
    with pytest.raises(ValueError):
        langid.fit(samples)


def test_places():
    rng = np.random.default_rng(3)
    for n, size in ((0, 10), (5, 100), (1000, 1 << 18), (0, 1 << 40), (1, 1 << 40), (200_000, 1 << 40)):
        codes = np.unique(rng.integers(0, size, n))
        places = langid.Places(codes, size)
        asked = np.concatenate([codes, rng.integers(0, size, 1000)])
        want = np.searchsorted(codes, asked) if len(codes) else np.zeros(len(asked), int)
        hit = np.isin(asked, codes)
        assert np.array_equal(places(asked), np.where(hit, want + 1, 0))


@pytest.mark.parametrize("seed", range(8))
def test_shards_of_different_columns(spark, tmp_path, seed):
    rng = random.Random(seed)
    kinds = {"id": "long", "x": "string", "y": "double", "_run": "string", "_arrival": "int", "runs": "array<int>"}
    value = {"long": lambda i: i, "string": lambda i: f"s{i}", "double": lambda i: i / 2, "int": lambda i: -i, "array<int>": lambda i: [i, 1]}
    store, want = ShardStore(spark, f"file://{tmp_path}/s", fan=2), []
    for k in range(3):
        columns = ["id", *rng.sample([c for c in kinds if c != "id"], rng.randint(0, 4))]
        rows = [tuple(value[kinds[c]](10 * k + i) for c in columns) for i in range(3)]
        df = spark.createDataFrame(rows, ", ".join(f"{c} {kinds[c]}" for c in columns)).coalesce(1)
        store.append(*((df.withColumn("a", F.col("id") % 2), "a") if seed % 2 else (df,)))
        want += [dict(zip(columns, r)) for r in rows]
    every = {c for r in want for c in r}
    full = sorted(repr(sorted((r | {c: None for c in every - r.keys()}).items())) for r in want)
    found = lambda: sorted(repr(sorted(r.asDict().items())) for r in store.read().collect())
    assert found() == full
    store.compact()
    store.vacuum()
    assert found() == full and set(store.read().columns) == every and len(store.manifest()[1]) == 1
    with pytest.raises(TypeError):
        store.append(spark.createDataFrame([("1",)], "ID string"))
    assert store.read(run="of").select("of").distinct().count() == 1
    with pytest.raises(ValueError):
        store.read(run="id")


def test_plan_merges_like_with_like(spark):
    from corvina.llm.shards import Run

    store = ShardStore(spark, "file:///tmp/none", fan=4, least_bytes=100)
    run = lambda name, n: Run(name, 1, n)
    assert store.plan([run("a", 50), run("b", 60), run("c", 70)]) == []
    (group,) = store.plan([run(x, 50) for x in "abcd"] + [run("large", 10_000)])
    assert [r.name for r in group] == list("abcd")
    # four merged runs of a tier make one of the next
    (group,) = store.plan([run(str(i), 150) for i in range(3)] + [run(x, 50) for x in "abcd"])
    assert len(group) == 7


def test_small_broadcasts_by_size(spark):
    t = Scratch(spark, "t").save(spark.range(10))
    assert "broadcast" in small(t, 10)._jdf.queryExecution().logical().toString().lower() and small(t, 9) is t


def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(9)
    texts = [" ".join(f"w{rng.randrange(5000)}" for _ in range(120)) for _ in range(30)]
    shared = "\n".join(f"shared line {i} of a passage" for i in range(4))
    rows = [(i, t + ("\n" + shared if i < 4 else ""), "en", "ab"[i % 2]) for i, t in enumerate(texts)]
    rows += [(50, texts[5].rsplit(" ", 1)[0] + " w1", "en", "a"), (51, "too short", "en", "a"), (52, None, None, None), (53, "!! ?? " * 200, "en", "b")]
    docs = spark.createDataFrame([(i, t, la, s, len(t or "")) for i, t, la, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    stage = dict(corpus_pipeline.STAGES)
    out = {}
    for name, f in corpus_pipeline.STAGES:
        docs = f(spark, docs, str(tmp_path))
        out[name] = docs.collect()
        docs = spark.createDataFrame(out[name], docs.schema)
    assert len(stage) == 5
    assert {r.doc_id for r in out["quality rules"]} == {*range(30), 50}
    lined = {r.doc_id: r for r in out["line dedup"]}
    assert "shared line" in lined[0].text and not any("shared line" in lined[i].text for i in (1, 2, 3)) and all(r.n_chars == len(r.text) for r in lined.values())
    assert {r.doc_id for r in out["n-gram Jaccard join"]} == set(range(30))
    many = collections.Counter(r.doc_id for r in out["mixing sources"])
    total = sum(len(words(r.text)) for r in out["n-gram Jaccard join"])
    assert abs(sum(many[r.doc_id] * len(words(r.text)) for r in out["n-gram Jaccard join"]) - 1.5 * total) <= 300
    texts_of = {r.doc_id: r.text for r in out["mixing sources"]}
    assert collections.Counter(r.doc_id for r in out["SentencePiece"]) == many and all(r.text == texts_of[r.doc_id] and r.n_pieces == len(r.ids) for r in out["SentencePiece"])
    again = stage["mixing sources"](spark, spark.createDataFrame([(1, "a b", "en", None, 3, "x"), (None, "c d", None, "s", 3, "y")] * 2, "doc_id long, text string, lang string, source string, n_chars long, _corvina_n string"), str(tmp_path))
    assert again.columns[-1] == "_corvina_n" and {(r.doc_id, r.text) for r in again.collect()} <= {(1, "a b"), (None, "c d")}
    ran = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.ids) for r in ran) == sorted((r.doc_id, r.ids) for r in out["SentencePiece"])


def test_pipeline_stages_take_odd_rows(spark, tmp_path):
    """Repeated rows and doc_ids, null ids and texts, and columns of names that operators use: no stage fails, columns stay, decisions are by row."""
    rng = random.Random(2)
    text = lambda: " ".join(f"w{rng.randrange(900)}" for _ in range(90))
    a, b = text(), text()
    rows = [(1, a, "s"), (1, a, "s"), (1, b, "t"), (2, a, None), (None, b, "s"), (3, None, "s"), (4, "", "s"), (5, "x " * 5000, "s")] + [(10 + i, text(), "s") for i in range(20)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, key string, kept string, score string, part string, _corvina_own string"
    docs = spark.createDataFrame([(i, t, None, s, len(t or ""), "k", "x", "y", "p", "o") for i, t, s in rows], schema)
    spark.createDataFrame([(10, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, f in corpus_pipeline.STAGES:
        out = f(spark, docs, str(tmp_path))
        got = out.collect()
        if name == "SentencePiece":
            assert len(got) == len(docs.collect()) and all(r.n_pieces == len(r.ids) for r in got)
            break
        assert out.columns == docs.columns
        ids = [r.doc_id for r in got]
        if name == "quality rules":
            assert sorted(ids, key=str) == sorted([1, 1, 1, 2, None, *range(10, 30)], key=str)
        if name == "line dedup":
            assert len(ids) == 25
        if name == "n-gram Jaccard join":
            assert sorted(ids, key=str) == sorted([1, 1, 1, None, *range(10, 30)], key=str)
        docs = spark.createDataFrame(got, out.schema)
