"""SentencePiece encoding and decoding with a given model file.

A text is written as SentencePiece does without a normalizer: spaces become U+2581, and one leads. No piece of a model goes on
past a space into the next word, so a text falls into words that are encoded apart. A word's lattice has an edge for each
substring, of at most the longest piece's length, that is a piece.

* Unigram models (``viterbi_words``): the relational lattice. Distinct words are exploded to substrings, equi-joined to the piece
  table (of the model's size, broadcast), grouped by word, and a Viterbi fold by Spark's higher-order ``aggregate`` takes the
  path of the highest score. Documents join the words' pieces and are put together in order.
* BPE models (``Merger``): their scores are merge ranks, not log-probabilities, and the highest-scoring path isn't the model's
  encoding. So the same edges are found by hash, and the fold merges the adjacent pair of the best rank (leftmost of equals) until none is an
  edge, on all new words of an Arrow batch in step. It runs where the text is: no shuffle, and a bounded cache of frequent words.

Characters without a piece become byte pieces, or the unknown piece. Decoding joins the pieces, reads byte pieces as UTF-8 and
drops the leading space: it gives back every text without U+2581 (which reads as a space).

Defined cases: null encodes to null, an empty text to no pieces; words of any length are encoded whole; repeated rows are encoded
alike; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvina.llm._bytes import mix, powers

SPACE = "▁"
WORDS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Longer words are merged one by one, with a heap; shorter ones together, a merge a step.
LONG = 200


def fields(b: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protocol-buffer message."""
    i = 0

    def varint() -> int:
        nonlocal i
        x = shift = 0
        while True:
            c = b[i]
            i += 1
            x |= (c & 127) << shift
            shift += 7
            if c < 128:
                return x

    while i < len(b):
        tag = varint()
        if tag & 7 == 0:
            value: int | bytes = varint()
        else:
            n = varint() if tag & 7 == 2 else 4 if tag & 7 == 5 else 8
            value = b[i : i + n]
            i += n
        yield tag >> 3, value


@dataclass
class Model:
    pieces: list[str]
    scores: list[float]
    types: list[int]
    kind: int
    byte_fallback: bool
    unknown: int

    def first_byte(self) -> int:
        return self.pieces.index("<0x00>") if self.byte_fallback else -1

    def spoken(self) -> list[int]:
        """Ids that text can be encoded to by their string."""
        return [i for i, t in enumerate(self.types) if t in (NORMAL, USER)]


def load(model: bytes) -> Model:
    """A model file's content. Normalizers other than identity, and user-defined pieces, aren't provided for and raise."""
    out = Model([], [], [], UNIGRAM, False, 0)
    for number, value in fields(model):
        if number == 1:
            f = dict(fields(value))
            out.pieces.append(f[1].decode())
            out.scores.append(struct.unpack("<f", f[2])[0] if 2 in f else 0.0)
            out.types.append(f.get(3, NORMAL))
        elif number == 2:
            f = dict(fields(value))
            out.kind, out.byte_fallback = f.get(3, UNIGRAM), bool(f.get(35, 0))
        elif number == 3:
            f = dict(fields(value))
            if f.get(2) or not f.get(3, 1) or f.get(4, 1) or not f.get(5, 1):
                raise ValueError("only models with the identity normalizer and a leading space are provided for")
    if out.kind not in (UNIGRAM, BPE) or USER in out.types or any(re.search(f"[^{SPACE}]{SPACE}", out.pieces[i]) for i in out.spoken()):
        raise ValueError("only unigram and BPE models whose pieces end with the word are provided for")
    out.unknown = out.types.index(UNKNOWN)
    return out


# --- BPE


class Merger:
    """Encodes words by a BPE model's merges; keeps the pieces of ``cache`` to twice as many words."""

    def __init__(self, model: Model, cache: int = 50_000):
        self.model, self.room, self.young, self.old = model, cache, {}, {}
        self.bytes_from, self.table = model.first_byte(), {}
        ids = np.array(model.spoken())
        texts = [model.pieces[i] for i in ids]
        self.longest = max(map(len, texts))
        cp, at = self.code_points(texts)
        h = self.spans(self.sums(cp), at[:-1], at[1:])
        order = np.argsort(h)
        self.keys, self.ids = h[order], ids[order]
        self.sizes, self.ranks = np.diff(at)[order], -np.array(model.scores)[ids[order]]
        # by the hashes' first bits: the last piece that has them, and whether others do
        first = (self.keys >> np.uint64(46)).astype(np.int64)
        self.slot = np.full(1 << 18, -1, np.int64)
        self.slot[first] = np.arange(len(first))
        self.crowded = np.bincount(first, minlength=1 << 18) > 1

    @staticmethod
    def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)

    @staticmethod
    def sums(cp: np.ndarray) -> np.ndarray:
        v = mix(cp.astype(np.uint64) + np.uint64(0x5851F42D4C957F2D)) * powers(len(cp) + 1)[0][: len(cp)]
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(v, dtype=np.uint64)])

    @staticmethod
    def spans(sums: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix((sums[b] - sums[a]) * powers(len(sums))[1][a])

    def edges(self, sums: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Row of the piece that stands from a to b, or -1."""
        out = np.full(len(a), -1, np.int64)
        fit = np.flatnonzero(b - a <= self.longest)
        h = self.spans(sums, a[fit], b[fit])
        first = (h >> np.uint64(46)).astype(np.int64)
        at = self.slot[first]
        hit = (at >= 0) & (self.keys[at] == h)
        other = np.flatnonzero(~hit & self.crowded[first])
        at[other] = np.minimum(np.searchsorted(self.keys, h[other]), len(self.keys) - 1)
        hit[other] = self.keys[at[other]] == h[other]
        hit &= self.sizes[at] == (b - a)[fit]
        out[fit[hit]] = at[hit]
        return out

    def rank(self, sums: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        row = self.edges(sums, a, b)
        return np.where(row >= 0, self.ranks[row], np.inf)

    def merged(self, words: list[str]) -> list[bytes]:
        cp, off = self.code_points(words)
        sums, n = self.sums(cp), len(cp)
        start, stop = off[:-1], off[1:]
        word = np.repeat(np.arange(len(words)), np.diff(off))
        end = np.arange(1, n + 1)  # of the symbol that starts here
        begin = np.arange(-1, n)  # of the symbol that ends here
        rank = np.full(n, np.inf)
        inner = np.flatnonzero(end < stop[word])
        rank[inner] = self.rank(sums, inner, inner + 2)
        live = np.arange(len(words))
        first, length = start, np.diff(off)
        at = np.arange(n)  # positions of the live words
        while len(live):
            r = rank[at]
            heads = np.concatenate([[0], np.cumsum(length)[:-1]])
            low = np.minimum.reduceat(r, heads)
            going = low < np.inf
            where = np.flatnonzero((r == np.repeat(low, length)) & np.repeat(going, length))
            owner = np.repeat(np.arange(len(live)), length)[where]
            i = at[where[np.concatenate([[True], owner[1:] != owner[:-1]])]] if len(where) else where
            j = end[i]
            k = end[j]
            rank[j] = np.inf
            end[i], begin[k] = k, i
            last = stop[word[i]]
            rank[i] = np.inf
            more = k < last
            rank[i[more]] = self.rank(sums, i[more], end[k[more]])
            before = i > start[word[i]]
            p = begin[i[before]]
            rank[p] = self.rank(sums, p, k[before])
            if going.sum() < 0.7 * len(live):
                live, first, length = live[going], first[going], length[going]
                at = np.repeat(first - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum()) if len(live) else at[:0]
        symbol = np.zeros(n, bool)
        place = start[start < stop]
        while len(place):
            symbol[place] = True
            place = end[place]
            place = place[place < n]
            place = place[~symbol[place]]
        a = np.flatnonzero(symbol)
        row = self.edges(sums, a, end[a])
        # ids in a row; a character without a piece has its bytes' pieces
        found = np.where(row >= 0, self.ids[row], self.model.unknown)
        lone = np.flatnonzero(row < 0) if self.bytes_from >= 0 else row[:0]
        spelled = [np.frombuffer(chr(c).encode("utf-8", "surrogatepass"), np.uint8) for c in cp[a[lone]].tolist()]
        many = np.ones(len(a), np.int64)
        many[lone] = [len(x) for x in spelled]
        ids = np.repeat(found, many)
        if len(lone):
            ids[np.repeat(row < 0, many)] = self.bytes_from + np.concatenate(spelled).astype(np.int64)
        cut = 4 * np.concatenate([[0], np.cumsum(np.bincount(word[a], many, len(words)))]).astype(np.int64)
        data = ids.astype(np.int32).tobytes()
        return [data[x:y] for x, y in zip(cut[:-1].tolist(), cut[1:].tolist())]

    def merged_long(self, word: str) -> bytes:
        """One word by a heap of pairs: the same merges, in time that hardly more than its length decides."""
        if not self.table:
            self.table = {self.model.pieces[i]: (-self.model.scores[i], i) for i in self.model.spoken()}
        n, table = len(word), self.table
        end, begin, alive = list(range(1, n + 1)), list(range(-1, n)), [True] * n
        heap: list[tuple[float, int, int, int]] = []

        def offer(a: int, b: int, c: int) -> None:
            if c - a <= self.longest and (hit := table.get(word[a:c])):
                heapq.heappush(heap, (hit[0], a, b, c))

        for i in range(n - 1):
            offer(i, i + 1, i + 2)
        while heap:
            _, a, b, c = heapq.heappop(heap)
            if not (alive[a] and end[a] == b and alive[b] and end[b] == c):
                continue
            alive[b], end[a], begin[c] = False, c, a
            if a:
                offer(begin[a], a, c)
            if c < n:
                offer(a, c, end[c])
        out, at = [], 0
        while at < n:
            hit = table.get(word[at : end[at]])
            out += [hit[1]] if hit else [self.bytes_from + b for b in word[at].encode("utf-8", "surrogatepass")] if self.bytes_from >= 0 else [self.model.unknown]
            at = end[at]
        return np.array(out, np.int32).tobytes()

    def learn(self, words: list[str]) -> None:
        self.young.update(zip(words, self.merged(words)))

    def encode(self, texts: list[str | None], together: int = 1 << 17) -> list[bytes | None]:
        """The ids of each text as the bytes of 32-bit integers."""
        split = [None if t is None else WORDS.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        if len(self.young) > self.room:
            self.old, self.young = self.young, {}
        new = set().union(*(s for s in split if s)) - self.young.keys()
        for w in new & self.old.keys():
            self.young[w] = self.old[w]
        waiting, size = [], 0
        for w in new - self.young.keys():
            if len(w) > LONG:
                self.young[w] = self.merged_long(w)
                continue
            waiting.append(w)
            size += len(w)
            if size > together:
                self.learn(waiting)
                waiting, size = [], 0
        if waiting:
            self.learn(waiting)
        known = self.young.__getitem__
        return [None if s is None else b"".join(map(known, s)) for s in split]


def lists(ids: list[bytes | None]) -> pa.Array:
    """A list column from the ids' bytes; None is null."""
    at = np.concatenate([[0], np.cumsum([len(x or b"") // 4 for x in ids])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.frombuffer(b"".join(x or b"" for x in ids), np.int32)), mask=pa.array([x is None for x in ids], pa.bool_()))


def encode_bpe(docs: DataFrame, model: Model, back: bool = False, chars: int = 1 << 19) -> DataFrame:
    """doc_id and ids, and with ``back`` the text that the ids decode to, made in the same pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger, speak = Merger(model), Speaker(model) if back else None
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            row = 0
            while row < len(batch):
                size, part = 0, []
                while row + len(part) < len(batch) and (size < chars or not part):
                    part.append(texts[row + len(part)].as_py())
                    size += len(part[-1] or "")
                out = lists(merger.encode(part))
                made = [ids.slice(row, len(part)), out, *([speak(out)] if speak else [])]
                yield pa.RecordBatch.from_arrays(made, names=["doc_id", "ids", "text"][: len(made)])
                row += len(part)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids array<int>" + ", text string" * back)


class Speaker:
    """Texts from lists of ids. Control pieces have no text; bytes that aren't UTF-8 read as U+FFFD."""

    def __init__(self, model: Model):
        said = [b"" if t == CONTROL else bytes([int(p[3:5], 16)]) if t == BYTE else b" \xe2\x81\x87 " if t == UNKNOWN else p.replace(SPACE, " ").encode() for p, t in zip(model.pieces, model.types)]
        self.said = np.array([*said, None], object)[:-1]

    def __call__(self, ids: pa.Array) -> pa.Array:
        at = ids.offsets.to_numpy()
        spoken = self.said[ids.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]].astype(np.int64)].tolist() if len(ids) else []
        texts = []
        for there, a, b in zip(ids.is_valid().to_pylist(), (at[:-1] - at[0]).tolist(), (at[1:] - at[0]).tolist()):
            t = b"".join(spoken[a:b]).decode("utf-8", "replace") if there else None
            texts.append(t[1:] if t and t[0] == " " else t)
        return pa.array(texts, pa.string())


# --- unigram

#: Edges by their ends; for each end the best score so far and the edge that reaches it; then back from the last end.
FOLD = """transform(array(transform(ends, e -> e.here)), by_end -> transform(array(aggregate(by_end,
  cast(array(struct(0D as score, -1 as start, -1 as id)) as array<struct<score: double, start: int, id: int>>),
  (path, here) -> concat(path, array(aggregate(here,
    cast(struct(double('-infinity') as score, -1 as start, -1 as id) as struct<score: double, start: int, id: int>),
    (top, x) -> if(path[x.start].score + x.score > top.score, struct(path[x.start].score + x.score as score, x.start as start, x.id as id), top)))))), path ->
  aggregate(sequence(1, n), struct(n as at, cast(array() as array<struct<start: int, stop: int, id: int>>) as ids),
    (a, i) -> if(a.at = 0, a, struct(path[a.at].start as at, concat(array(struct(path[a.at].start as start, a.at as stop, path[a.at].id as id)), a.ids) as ids)),
    a -> a.ids))[0])[0]"""


def viterbi_words(words: DataFrame, model: Model) -> DataFrame:
    """word, ids for a table of distinct words."""
    spark = words.sparkSession
    spoken = model.spoken()
    table = spark.createDataFrame([(model.pieces[i], i, model.scores[i]) for i in spoken], "piece string, id int, score double")
    longest, least = max(len(model.pieces[i]) for i in spoken), min(model.scores[i] for i in spoken) - 10
    sized = words.withColumn("n", F.length("word"))
    starts = sized.select("word", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("start"))
    spans = starts.select("word", "n", "start", F.explode(F.sequence(F.col("start") + 1, F.least("n", F.col("start") + longest))).alias("stop")).withColumn("piece", F.expr("substring(word, start + 1, stop - start)"))
    edges = spans.join(F.broadcast(table), "piece", "left").where("id is not null or stop = start + 1")
    edge = F.struct("start", F.coalesce("id", F.lit(-1)).alias("id"), F.coalesce("score", F.lit(least)).alias("score"))
    by_end = edges.groupBy("word", "n", "stop").agg(F.array_sort(F.collect_list(edge)).alias("here"))
    lattice = by_end.groupBy("word", "n").agg(F.array_sort(F.collect_list(F.struct("stop", "here"))).alias("ends"))
    first = model.first_byte()
    unknown = f"transform(sequence(0, octet_length(c) - 1), i -> cast({first} + cast(conv(substring(hex(encode(c, 'UTF-8')), 2 * i + 1, 2), 16, 10) as int) as int))" if first >= 0 else f"array({model.unknown})"
    ids = f"flatten(transform({FOLD}, x -> if(x.id >= 0, array(x.id), transform(array(substring(word, x.start + 1, x.stop - x.start)), c -> {unknown})[0])))"
    return lattice.select("word", F.expr(ids).alias("ids"))


def encode_unigram(docs: DataFrame, model: Model) -> DataFrame:
    """Distinct words through the lattice; then each document's words, joined to them, in order. Rows are told apart by id and text."""
    d = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("mark"))
    norm = F.concat(F.lit(SPACE), F.translate("text", " ", SPACE))
    places = d.where("text <> ''").dropDuplicates(["doc_id", "mark"]).select("doc_id", "mark", F.posexplode(F.regexp_extract_all(norm, F.lit(WORDS.pattern), F.lit(0))).alias("at", "word"))
    known = viterbi_words(places.select("word").distinct(), model)
    whole = places.join(known, "word").groupBy("doc_id", "mark").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "ids"))), lambda x: x["ids"])).alias("ids"))
    whole = whole.withColumnRenamed("doc_id", "d").withColumnRenamed("mark", "m")
    out = d.join(whole, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("mark") == F.col("m")), "left")
    return out.select("doc_id", F.when(F.col("text").isNotNull(), F.coalesce("ids", F.array().cast("array<int>"))).alias("ids"))


def read_model(model_file: str) -> Model:
    """The file is read by the driver; what is sent to the workers has its size."""
    with open(model_file, "rb") as f:
        return load(f.read())


def encode(docs: DataFrame, model_file: str) -> DataFrame:
    """doc_id and ids (array<int>)."""
    model = read_model(model_file)
    return encode_bpe(docs, model) if model.kind == BPE else encode_unigram(docs, model)


def decode(tokens: DataFrame, model_file: str) -> DataFrame:
    """doc_id, ids and text from doc_id and ids."""
    model = read_model(model_file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        speak = Speaker(model)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ids"), speak(batch.column("ids"))], names=["doc_id", "ids", "text"])

    return tokens.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")).mapInArrow(run, "doc_id long, ids array<int>, text string")


def encode_and_decode(docs: DataFrame, model_file: str) -> DataFrame:
    """doc_id, ids and the text that they decode to; for BPE models in one pass, with one Python worker a task."""
    model = read_model(model_file)
    return encode_bpe(docs, model, back=True) if model.kind == BPE else decode(encode(docs, model_file), model_file)
