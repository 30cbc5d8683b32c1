"""Language identification by prediction by partial matching over bytes.

For each language a context tree of order ``order`` is counted on a bounded sample of labelled texts, then frozen. A byte s after a context
c costs -log2 p(s | c): with n occurrences of c, d distinct bytes after it and m of them s, p = m / (n + d) if m > 0 (escape method C);
otherwise the escape d / (n + d) is paid and the next shorter context asked, down to order -1, where 257 symbols are alike.
An unseen context costs nothing and passes on. Trees of all languages are merged to one table of grams: a gram's row holds its
cost in every language, escapes included, so scoring takes one walk per order for all languages. A text's score is
its exact code length in each; the shortest code wins (ties: the first label), and the score is its share when each language
weighs 2 to the minus bits per ``sharp`` bytes, so it doesn't saturate with length.

Only text is looked at. Texts are lower-cased from A to Z and runs of white space count as one space; every byte of every text is scored,
vectorised over chunks in Arrow batches, without a shuffle. The model's size is bounded by ``sample_bytes`` for each language (at least one
text, or a stretch of 20,000 characters of it, is learnt of each): grams are found by hash, in 24 bytes each, and cost 4 bytes a language (some 100 MB for ten languages of
60 letters). A model beyond ``MOST_BYTES`` is refused with an error. Chunks shrink as languages grow in number.

Defined cases: null texts and texts without a letter are ``und`` with score 0; a byte that no sample has costs the escapes and order -1;
without any labelled text every prediction is ``und``; rows that repeat are predicted alike; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvina.llm._bytes import chunks, mix

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[9, 10, 11, 12, 13]] = 32


def folded(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower case, white space run together; each row is led by one space."""
    b = _FOLD[data]
    keep = np.ones(len(b), bool)
    space = b == 32
    keep[1:] = ~(space[1:] & space[:-1])
    first = off[:-1][off[:-1] < off[1:]]
    keep[first] = ~space[first]
    n = np.concatenate([[0], np.cumsum(keep)])[off]
    rows = len(off) - 1
    out = np.empty(n[-1] + rows, np.uint8)
    at = n[:-1] + np.arange(rows)
    lead = np.zeros(len(out), bool)
    lead[at] = True
    out[lead] = 32
    out[~lead] = b[keep]
    return out, np.concatenate([at, [len(out)]])


class Places:
    """The places, from 1, of sorted distinct codes, and 0 for any other. Few codes are a table by code; else a hash table of 24 bytes a code."""

    DENSE = 1 << 18

    def __init__(self, codes: np.ndarray, size: int):
        self.codes = np.concatenate([[-1], codes])
        if size <= self.DENSE:
            self.bits = None
            self.table = np.zeros(size, np.int32)
            self.table[codes] = np.arange(1, len(codes) + 1)
            return
        self.bits = np.uint64(64 - max(4, int(4 * len(codes)).bit_length()))
        self.table = np.zeros(1 << (64 - int(self.bits)), np.int32)
        left, at = np.arange(1, len(codes) + 1), self.first(codes)
        while len(left):  # of those that meet at a place one stays, the others go on to the next
            free = np.flatnonzero(self.table[at] == 0)
            _, one = np.unique(at[free], return_index=True)
            stay = np.zeros(len(left), bool)
            stay[free[one]] = True
            self.table[at[stay]] = left[stay]
            left, at = left[~stay], (at[~stay] + 1) & (len(self.table) - 1)

    def first(self, codes: np.ndarray) -> np.ndarray:
        return (mix(codes.astype(np.uint64)) >> self.bits).astype(np.int64)

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        if self.bits is None:
            return self.table[codes]
        at = self.first(codes)
        found = self.table[at]
        more = np.flatnonzero((found > 0) & (self.codes[found] != codes))
        while len(more):
            at[more] = (at[more] + 1) & (len(self.table) - 1)
            found[more] = self.table[at[more]]
            more = more[(found[more] > 0) & (self.codes[found[more]] != codes[more])]
        return found

    def bytes(self) -> int:
        return self.codes.nbytes + self.table.nbytes


@dataclass
class Model:
    """langs; for order k: step[k] takes (gram of length k, next byte's class) to a gram of length k + 1 (0: not seen), cost[k] and
    escape[k] have a row for each gram of length k (row 0: nothing): the cost of its last byte, and of an escape after it."""

    langs: list[str]
    classes: np.ndarray
    step: list[Places] = field(default_factory=list)
    cost: list[np.ndarray] = field(default_factory=list)
    escape: list[np.ndarray] = field(default_factory=list)
    unseen: float = 0.0

    def bytes(self) -> int:
        return sum(s.bytes() for s in self.step) + sum(x.nbytes for x in (*self.cost, *self.escape))

    def code_lengths(self, data: np.ndarray, off: np.ndarray, skip: int = 0) -> np.ndarray:
        """Bits of each row in each language, without those of the first ``skip`` bytes, which are context only. Rows are separated by their leading
        spaces: no context crosses a row."""
        c = self.classes[data].astype(np.int64)
        top, width = len(self.step), int(self.classes.max()) + 1
        ordinal = np.arange(len(c)) - np.repeat(off[:-1], np.diff(off))
        grams = [np.zeros(len(c), np.int64)]  # by length; the empty gram is row 0 of length 0
        for k in range(top):
            before = np.zeros(len(c), np.int64)
            before[1:] = grams[k][:-1]
            if k:
                before[ordinal < k] = 0
            if k:  # only what has been seen so far can go on
                there = np.flatnonzero(before)
                g = np.zeros(len(c), np.int64)
                g[there] = self.step[k](before[there] * width + c[there])
            else:
                g = self.step[0](c)
            grams.append(g)
        bits = np.zeros((len(c), len(self.langs)))
        todo = np.arange(len(c))
        for k in range(top, 0, -1):  # the longest gram that any language has
            g = grams[k][todo]
            hit = g > 0
            bits[todo[hit]] += self.cost[k][g[hit]]
            todo = todo[~hit]
            if k > 1:
                prev = todo - 1
                ctx = np.where(ordinal[todo] >= k - 1, grams[k - 1][prev], 0)
                bits[todo] += self.escape[k - 1][ctx]
            else:
                bits[todo] += self.escape[0][0] + self.unseen
        bits[:skip] = 0
        return np.add.reduceat(bits, off[:-1], axis=0) if len(off) > 1 else bits[:0]

    def long_code_length(self, data: np.ndarray, piece: int = 1 << 20) -> np.ndarray:
        """Bits of one row of any length, piece by piece, each after the bytes that are its context: memory follows the piece."""
        total, context = np.zeros((1, len(self.langs))), len(self.step) - 1
        for a in range(0, len(data), piece):
            lead = min(a, context)
            part = data[a - lead : a + piece]
            total += self.code_lengths(part, np.array([0, len(part)]), lead)
        return total


def fit(samples: dict[str, list[bytes]], order: int = 4) -> Model:
    """Count the trees and fill the tables. samples: texts by language."""
    langs = sorted(samples)
    text = {lang: folded(np.frombuffer(b"".join(x), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in x])]).astype(np.int64)) for lang, x in samples.items()}
    seen = np.unique(np.concatenate([t for t, _ in text.values()])) if text else np.zeros(0, np.uint8)
    model = Model(langs, np.zeros(256, np.int64))
    model.classes[seen] = np.arange(1, len(seen) + 1)
    width, n_langs = len(seen) + 1, len(langs)
    model.unseen = float(np.log2(257))
    ids = {lang: np.zeros(len(t), np.int64) for lang, (t, _) in text.items()}
    parents_cost = np.full((1, n_langs), model.unseen)  # of order -1
    suffix = None
    counts_of_context = []
    for k in range(order + 1):
        # grams of length k + 1: (gram of length k before, class)
        codes = {}
        for lang, (t, off) in text.items():
            c = model.classes[t]
            before = np.zeros(len(t), np.int64)
            before[1:] = ids[lang][:-1]
            ordinal = np.arange(len(t)) - np.repeat(off[:-1], np.diff(off))
            code = before * width + c
            code[(ordinal < k) | ((before == 0) & (k > 0))] = -1
            codes[lang] = code
        every = np.concatenate(list(codes.values()))
        grams = np.unique(every[every >= 0])
        rows = len(model.step[k - 1].codes) if k else 1
        step = Places(grams, int(rows) * width)
        new_ids = {lang: np.where(code >= 0, step(np.maximum(code, 0)), 0) for lang, code in codes.items()}
        m = np.stack([np.bincount(new_ids[lang], minlength=len(grams) + 1) for lang in langs], axis=1).astype(float)
        m[0] = 0
        context = np.concatenate([[0], grams // width])
        n = np.zeros((int(rows), n_langs))
        np.add.at(n, context[1:], m[1:])
        d = np.zeros((int(rows), n_langs))
        np.add.at(d, context[1:], (m[1:] > 0).astype(float))
        with np.errstate(divide="ignore", invalid="ignore"):
            escape = np.where(n > 0, -np.log2(d / (n + d)), 0.0)
            own = -np.log2(m / (n + d)[context])
        # the cost in the next shorter context: of the gram without its first byte
        if k == 0:
            shorter = np.full((len(grams) + 1, n_langs), model.unseen)
        else:
            cut = np.zeros(len(grams) + 1, np.int64)
            for lang, new in new_ids.items():
                cut[new] = ids[lang]
                # ids hold grams of length k that end here: the last k bytes of the gram
            cut[0] = 0
            shorter = model.cost[k][cut]
        cost = np.where(m > 0, own, escape[context] + shorter)
        cost[0] = 0
        model.step.append(step)
        if k == 0:
            model.cost.append(np.zeros((1, n_langs), np.float32))
        model.cost.append(cost.astype(np.float32))
        model.escape.append(escape.astype(np.float32))
        ids = new_ids
        if model.bytes() > MOST_BYTES:
            raise ValueError(f"the model of {n_langs} languages is larger than {MOST_BYTES} bytes; learn from fewer bytes a language or take a lower order")
    return model


#: What a model may take in the driver and in each worker. It grows with the languages and the grams learnt.
MOST_BYTES = 1 << 30


def sample(docs: DataFrame, sample_bytes: int, piece_chars: int = 20_000, seed: int = 0) -> dict[str, list[bytes]]:
    """Texts of each label by the smallest hash of the text, up to ``sample_bytes`` a language, one at least; collected, so bounded.

    Of a text of more than ``piece_chars`` characters a stretch of that length is learnt, from a place by hash, so one text doesn't
    fill the sample and a language that has only long texts has one, too.
    """
    h = F.xxhash64("text", F.lit(seed))
    place = F.pmod(h, F.greatest(F.length("text") - piece_chars, F.lit(0)).cast("long") + 1).cast("int") + 1
    piece = F.when(F.length("text") > piece_chars, F.substr("text", place, F.lit(piece_chars))).otherwise(F.col("text"))
    labelled = docs.where("lang is not null and text is not null and text <> ''").select("lang", piece.alias("text"), F.xxhash64("text").alias("h"), (h.bitwiseAND(F.lit((1 << 62) - 1)) / float(1 << 62)).alias("u"))
    labelled = labelled.withColumn("n", F.octet_length("text").cast("long"))
    # copies of a text count once, and are combined before they are sent
    total = labelled.select("lang", "n", "h", "u").distinct().groupBy("lang").agg(F.sum("n").alias("total"), F.min("u").alias("least"))
    share = F.broadcast(total.select("lang", (F.lit(float(sample_bytes)) / F.col("total")).alias("share"), "least"))
    rows = labelled.join(share, "lang").where("u < share or u = least").select("lang", "text", "u").distinct().collect()
    out: dict[str, list[bytes]] = {}
    room: dict[str, int] = {}
    for r in sorted(rows, key=lambda r: (r.u, r.text)):
        b = r.text.encode()
        if r.lang not in out or room[r.lang] >= len(b):
            room[r.lang] = room.get(r.lang, sample_bytes) - len(b)
            out.setdefault(r.lang, []).append(b)
    return out


def predictor(model: Model, sharp: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            letters = np.array(batch.column("letters").to_pylist(), bool)
            lang, score = [], []
            for row, data, off in chunks(batch.column("text"), max(1 << 14, (1 << 22) // len(model.langs))):
                t, at = folded(data, off)
                bits = model.code_lengths(t, at) if len(at) > 2 or len(t) <= 1 << 21 else model.long_code_length(t, max(1 << 14, (1 << 22) // len(model.langs)))
                best = bits.argmin(axis=1)
                w = np.exp2(-(bits - bits.min(axis=1, keepdims=True)) * sharp / np.diff(at)[:, None])
                ok = letters[row : row + len(best)]
                lang += [model.langs[b] if x else "und" for b, x in zip(best, ok)]
                score += np.where(ok, 1 / w.sum(axis=1), 0.0).tolist()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, held_out: Column, sample_bytes: int = 400_000, order: int = 4, sharp: float = 20.0) -> DataFrame:
    """doc_id, held_out, lang_pred, score. The model is fitted on rows that aren't held out."""
    marked = docs.select(F.col("doc_id").cast("long"), "text", "lang", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    samples = sample(marked.where(~F.col("held_out")), sample_bytes)
    rows = marked.select("doc_id", "held_out", "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    if not samples:
        return rows.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    return rows.mapInArrow(predictor(fit(samples, order), sharp), "doc_id long, held_out boolean, lang_pred string, score double")
