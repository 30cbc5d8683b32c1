"""Importance resampling, alignment of tokenizers and personal data against plain Python, with nulls, empty and long texts, ties, repeats and clashing columns."""

import collections
import hashlib
import math
import os
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from corvina.llm import align, pii, resample
from corvina.llm._base import Scratch

CLASH = "doc_id long, text string, weight int, score string, rank string, bucket string, _row int, block string, pair int, count int, spans string, c int, t string, b int, rows int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", "y", "z", 2, "q", 3, 4, "s", 5, "u", 6, 7) for i, t in rows], CLASH)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    word = lambda: rng.choice(["Šťastný", "alpha", "BETA", "x1", "9", "é", "snake_case", "a-b", "中文", "gamma"]) + rng.choice(["", "", "s", str(rng.randrange(30))])
    rows = [(i, " ".join(word() for _ in range(rng.choice([1, 5, 19, 20, 21, 60, 200])))) for i in range(120)]
    rows += [(200, None), (201, ""), (202, " .,-\n"), (203, "one"), (204, "Lorem " * 40_000), (205, "ab" * 600_000), (None, rows[3][1]), (None, rows[3][1]), (None, None), (-5, rows[7][1]), (3, rows[3][1]), (3, rows[3][1]), (3, rows[5][1])]
    rows += [(i, rows[0][1]) for i in range(300, 420)]  # as many copies as all the rest
    return rows


# --- importance resampling


def features(text, n):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return len(words), [" ".join(words[i : i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1)]


def by_hand(docs, target, n, buckets, percent, least, seed):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    every = [features(t, n) for _, t in docs]
    raw, want = (collections.Counter(bucket(f) for fs in texts for f in fs) for texts in ([fs for _, fs in every], [features(t, n)[1] for t in target]))
    s, t = sum(raw.values()), sum(want.values())
    gain = [math.floor(1000 * math.log((want[b] + 1) * (s + buckets) / ((raw[b] + 1) * (t + buckets)))) for b in range(buckets)]
    out = []
    for (i, _), (words, fs) in zip(docs, every):
        weight = math.floor(sum(gain[bucket(f)] for f in fs) / len(fs)) if fs else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, words, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2]))
    k = len(able) * percent // 100
    ranks = collections.defaultdict(list)
    for place, r in enumerate(able[:k], 1):
        ranks[r].append(place)
    left = {r: list(p) for r, p in ranks.items()}
    return sorted([(*r, left[r].pop(0) if left.get(r) and r[1] >= least else None) for r in out], key=repr)


@pytest.mark.parametrize("n, buckets, percent, least", [(1, 10_000, 10, 20), (3, 64, 100, 0), (2, 97, 55, 1), (1, 10, 0, 20)])
def test_resampling(spark, texts, n, buckets, percent, least):
    target = [texts[i][1] for i in range(0, 40, 3)] + [None, ""]
    got = resample.resample(frame(spark, texts), spark.createDataFrame([(t, 1) for t in target], "text string, n int"), Scratch(spark, "t"), n, buckets, percent, least, 2024)
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=repr) == by_hand(texts, target, n, buckets, percent, least, 2024)


def test_resampling_of_nothing(spark):
    docs, none = frame(spark, []), spark.createDataFrame([], "text string")
    assert resample.resample(docs, none, Scratch(spark, "t")).count() == 0
    one = resample.resample(frame(spark, [(1, "a " * 30)]), none, Scratch(spark, "t"), percent=100).first()
    assert one["rank"] == 1 and one.n_features == 30


def test_long_texts_in_pieces():
    text = ("ab Cd-ef " * 50 + "x" * 200 + " é1 ").encode() * 3
    want = features(text.decode(), 3)
    for size in (7, 64, 10_000):
        before, resample.PIECE = resample.PIECE, size
        try:
            assert [w.decode() for ws in resample.word_lists(text, size) for w in ws] == features(text.decode(), 1)[1]
        finally:
            resample.PIECE = before
    parts = list(resample.feature_buckets(text, 3, 1 << 20))
    assert sum(w for w, _ in parts) == want[0] and collections.Counter(int(b) for _, bs in parts for b in bs) == collections.Counter(zlib.crc32(f.encode()) % (1 << 20) for f in want[1])


def test_runs_over_the_edges_of_pieces(monkeypatch):
    text = b"a b c d e f g h i j " * 5
    monkeypatch.setattr(resample.word_lists, "__defaults__", (6,))
    parts = list(resample.feature_buckets(text, 4, 1 << 20))
    assert len(parts) > 10 and collections.Counter(int(b) for _, bs in parts for b in bs) == collections.Counter(zlib.crc32(f.encode()) % (1 << 20) for f in features(text.decode(), 4)[1])


@pytest.mark.parametrize("seed", range(4))
def test_kth_key(spark, seed):
    rng = random.Random(seed)
    wide = [-(1 << 63), (1 << 63) - 1, 0, -1, 1, 1 << 40]
    rows = list({(rng.choice(wide + [rng.randrange(-9, 9)]), rng.choice(wide + [rng.randrange(1 << 20)]), i) for i in range(200)})
    df = spark.createDataFrame(rows, "a long, b long, i long").cache()
    for k in (1, 2, 50, 199, 200, rng.randrange(1, 200)):
        chosen = df.where(resample.up_to(resample.kth_key(df, ["a", "b", "i"], k))).collect()
        assert sorted(map(tuple, chosen)) == sorted(rows)[:k]
    ranked = {tuple(r)[:3]: r["rank"] for r in resample.ranked(df.repartition(7), ["a", "b", "i"], Scratch(spark, "t")).select("a", "b", "i", "rank").collect()}
    assert ranked == {r: n for n, r in enumerate(sorted(rows), 1)}


# --- alignment

A, B = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
needs_files = pytest.mark.skipif(not (os.path.exists(A) and os.path.exists(B)), reason="needs the tokenizers' files")


def aligned(rows):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    t, s = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    t.encode_special_tokens = True
    letters = align.byte_letters()
    known, links, counts = {}, [], collections.Counter()
    for _, text in rows:
        if text in known:
            groups, pairs, n_a, n_b = known[text]
        else:
            groups, pairs, n_a, n_b = [], [], 0, 0
            if text:
                a, b = t.encode(" " + text, add_special_tokens=False).ids, s.encode(text)
                spelled_a = [bytes(letters[c] for c in t.id_to_token(i)) for i in a]
                spelled_b = [bytes([int(s.id_to_piece(i)[3:5], 16)]) if s.is_byte(i) else s.id_to_piece(i).replace("▁", " ").encode() for i in b]
                if b"".join(spelled_a) == b"".join(spelled_b) == (" " + text).encode():
                    n_a, n_b = len(a), len(b)
                    ends_a, ends_b, at = {}, {}, 0
                    for i, x in enumerate(spelled_a):
                        at += len(x)
                        ends_a[at] = i
                    at = 0
                    for i, x in enumerate(spelled_b):
                        at += len(x)
                        ends_b[at] = i
                    i = j = 0
                    for cut in sorted(ends_a.keys() & ends_b.keys()):
                        groups.append(",".join(map(str, a[i : ends_a[cut] + 1])) + "|" + ",".join(map(str, b[j : ends_b[cut] + 1])))
                        pairs.append((a[ends_a[cut]], b[ends_b[cut]]))
                        i, j = ends_a[cut] + 1, ends_b[cut] + 1
            known[text] = groups, pairs, n_a, n_b
        counts.update(pairs)
        links.append((groups, pairs, n_a, n_b))
    top = collections.Counter()
    for (_, b), n in counts.items():
        top[b] = max(top[b], n)
    return sorted([(i, n_a, n_b, len(g), len(p), sum(counts[x] == top[x[1]] for x in p), sum(counts[x] for x in p), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for (i, _), (g, p, n_a, n_b) in zip(rows, links)], key=repr)


@needs_files
def test_alignment(spark, texts, monkeypatch):
    rows = [*texts, (500, "▁"), (501, "a▁b"), (502, "<|endoftext|> <s> </s> <unk> <0x41>"), (503, "  two  spaces \n\n\tand\r\nlines "), (504, "🎉🎉 नमस्ते ﬁ ½ \x00 ​"), (505, "don't we'll I'M")]
    got = align.align(frame(spark, rows), A, B, Scratch(spark, "t"))
    assert sorted(map(tuple, got.collect()), key=repr) == aligned(rows)
    assert align.align(frame(spark, []), A, B, Scratch(spark, "t")).count() == 0
    empty = align.align(frame(spark, [(1, None), (2, "")]), A, B, Scratch(spark, "t")).collect()
    assert sorted(map(tuple, empty)) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


@needs_files
def test_rows_of_blocks_are_no_larger_than_texts(spark):
    """Readers decode thousands of rows at once; what a block's documents share stands in one of them."""
    rows = [(i, "some words that stand in every text, %d " % i * 20) for i in range(60)]
    got = align.blocks(frame(spark, rows), A, B).collect()
    assert sorted(r.doc_id for r in got) == list(range(60))
    assert all(len(r.slots) == r.n_groups <= len(rows[r.doc_id][1]) for r in got)
    assert len({r.block for r in got}) == sum(r.pairs is not None for r in got) < 10


@needs_files
def test_the_fast_encoder_is_the_slow_one():
    """Where the file says otherwise, its own library encodes."""
    import json

    with open(A, encoding="utf-8") as f:
        text = f.read()
    fast = align.byte_level(text)
    j = json.loads(text)
    j["normalizer"] = {"type": "NFC"}
    slow = align.byte_level(json.dumps(j))
    assert "tiktoken" in type(fast.encode.__self__).__module__ and slow.spelled == fast.spelled
    rng = random.Random(1)
    letters = " \n\t'sStreéßñ中文🎉0123³²½_-.,!<|endoftext|>▁​\x00\x1c"
    for _ in range(2000):
        t = " " + "".join(rng.choice(letters) for _ in range(rng.randint(0, 40)))
        assert fast.encode(t) == slow.encode(t), t


# --- personal data

RULES = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(n := re.sub("[^0-9]", "", m)) <= 19 and sum(x - 9 * (x > 9) for x in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(n)))) % 10 == 0),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
]


def base_spans(text):
    return [(k, m.start(), m.end()) for k, p, ok in RULES for m in re.finditer(p, text or "") if ok(m[0])]


def valid_card(rng):
    n = "4" + "".join(rng.choice("0123456789") for _ in range(14))
    return next(n + d for d in "0123456789" if RULES[2][2](n + d))


@pytest.fixture(scope="module")
def private():
    rng = random.Random(5)
    prose = lambda k: " ".join(rng.choice("the quick brown fox jumps over a lazy dog número čas 12 7 345".split()) for _ in range(k))
    rows = []
    for i in range(300):
        card = valid_card(rng)
        bad = card[:-1] + str((int(card[-1]) + 1) % 10)
        what = [f"{rng.choice('abc')}.b{i}@mail{i % 9}.example.com", f"{i % 256}.51.17.{i % 250}", card, f"+1 ({100 + i}) 555-{1000 + i}", f'token = "{hashlib.sha1(str(i).encode()).hexdigest()}"', bad, f"{i}.300.1.2", prose(3), f"john (at) host{i} (dot) com", f"tel. 0905 {100 + i} {200 + i}"][i % 10]
        rows.append((i, f"{prose(20)} {what} {prose(10)}"))
    alphabet = "ab1234567890.@+-() \n%_é🎉"
    rows += [(1000 + i, "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 120)))) for i in range(400)]
    rows += [(2000, None), (2001, ""), (2002, "a@b.c@d.e_f@g.h"), (2003, "1.2.3.4.5.6.7.8 256.1.1.1 00001.2.3.4 99999999999999999999999.1.1.1"), (2004, "4111 1111 1111 1111-4111-1111-1111-1111"), (2005, "+1.......2+12345678901+"), (2006, "x" * 3000 + "@" + "y" * 3000), (2007, "9" * 4000), (2008, "a.b" * 1000 + "@c" + ".d" * 500), (2009, "1.1.1.1 " * 3000), (2010, "é🎉 a@b.co 🎉 1.2.3.4"), (None, "a@b.co"), (None, "a@b.co"), (0, rows[0][1])]
    return rows


def test_base_rules(spark, private):
    got = pii.detect(frame(spark, private), Scratch(spark, "t"))
    out = collections.Counter((r.doc_id, tuple((s.kind, s.start, s.stop) for s in r.spans if s.base)) for r in got.collect())
    assert out == collections.Counter((i, tuple(base_spans(t))) for i, t in private)


def test_what_is_added(spark, private):
    text = dict(private)
    added = collections.Counter()
    for r in pii.detect(frame(spark, private), Scratch(spark, "t")).where("doc_id < 300").collect():
        ends = [(s.start, s.stop) for s in r.spans]
        assert len(set(ends)) == len(ends) or not all(s.base for s in r.spans)
        for s in r.spans:
            if not s.base:
                assert s.p >= 0.9 and not any(o.base and s.start < o.stop and o.start < s.stop for o in r.spans)
                added[r.doc_id % 10] += 1
                assert (text[r.doc_id][s.start : s.stop]) == hashlib.sha1(str(r.doc_id).encode()).hexdigest() if r.doc_id % 10 == 4 else True
    assert added[4] == 30  # every secret's value
    assert not added[5] and not added[6] and not added[7]  # numbers that fail the checks, plain prose


def test_long_runs_are_read_once(spark):
    """Runs of one class, which a pattern that starts anew at each character would read as often as they are long."""
    rows = [(1, "x" * 300_000 + "@" + "y" * 300_000), (2, "9" * 400_000), (3, "a.b" * 100_000 + "@c" + ".d" * 50_000), (4, "1." * 200_000), (5, "a@b.c " * 50_000)]
    got = {r.doc_id: r.spans for r in pii.detect(frame(spark, rows), Scratch(spark, "t")).collect()}
    assert [len(got[i]) for i in range(1, 4)] == [0, 0, 1] and (got[3][0].start, got[3][0].stop) == (0, 400_002)
    assert [s.start for s in got[5]] == [6 * i for i in range(50_000)] and len(got[4]) == 50_000


def test_labelers_are_weighed(spark):
    """Two labelers that agree on two clusters; the one that always says yes tells nothing."""
    spans = [("card", [1, 0, 1, 1, 0])] * 50 + [("card", [-1, 0, -1, 1, 0])] * 50 + [("card", [0, 0, 1, 1, 0])] * 5 + [("card", [0, 0, -1, 1, 0])] * 5
    m = pii.reliabilities(spark.createDataFrame(spans, "kind string, votes array<int>")).first()
    k = pii.KINDS.index("card")
    at = lambda table, labeler, vote: table[3 * (5 * k + labeler) + vote + 1]
    assert at(m.yes, 0, 1) > 0.8 and at(m.no, 0, -1) > 0.8 and at(m.yes, 2, 1) > 0.9 and at(m.no, 2, -1) > 0.9
    assert at(m.yes, 3, 1) == pytest.approx(at(m.no, 3, 1), abs=0.1) and m.share[k] == pytest.approx(0.5, abs=0.05)


def test_personal_data_of_nothing(spark):
    assert pii.detect(frame(spark, []), Scratch(spark, "t")).count() == 0
    got = pii.detect(frame(spark, [(1, "plain"), (2, None)]), Scratch(spark, "t")).collect()
    assert sorted((r.doc_id, r.spans) for r in got) == [(1, []), (2, [])]


def test_running_sums(spark):
    rng = random.Random(2)
    rows = [[rng.randrange(9) for _ in range(n)] for n in (0, 1, 127, 128, 129, 1000, 20_000)]
    got = spark.createDataFrame([(r,) for r in rows], "x array<bigint>").select(F.expr(pii.running("x")).alias("s")).collect()
    for r, g in zip(rows, got):
        want, n = [], 0
        for x in r:
            n += x
            want.append(n)
        assert g.s == want
