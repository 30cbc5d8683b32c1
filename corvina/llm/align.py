"""Cross-tokenizer alignment: where the tokens of two tokenizers end together, and which pairs of tokens do so most.

A text with a space before it is encoded by a byte-level BPE (A, ``tokenizers``' file) and by a SentencePiece model (B, which adds the space itself). Both
give tokens of at least one byte whose bytes, joined, are the text. Byte offsets at which a token of A and one of B end cut both into groups;
the two tokens that end there are linked.

* First pass (Arrow): the texts of a batch are one run of bytes with the documents' offsets. One bincount of all ends of both tokenizers has a 2 where
  they meet; tokens, links and groups follow from prefix sums over it, and a document's share is the difference at its offsets. Each document of a block of some ``BLOCK``
  bytes is a row: its figures, and for each of its links the place of the pair among the block's distinct ones, which stand with their counts in the block's first row. No
  row is larger than its text makes it, so Parquet's readers, which decode some thousand rows at once, hold no more of a table of rows than of its texts.
* Counts: pairs are summed over all blocks (a block has each once, so no pair is frequent), and each B token's highest count is a maximum over them. Every
  block's pairs get their counts back by a join.
* Second pass (Arrow): a block's documents meet the counts of its pairs; the links' figures are summed between the documents' offsets in the same way.

Texts are encoded once. Nothing that grows with the corpus is sent to all tasks: highest counts go by B's ids, whose number is the vocabulary's.

Defined cases: a null or empty text, and one whose joined tokens aren't space and text (a U+2581, which B reads as a space), has no tokens:
zeros, and '' for the groups' hash. A text of any length is encoded whole, as one block. Repeated rows, null ids and clashing names are
no special case; an empty table gives no rows. Strings of special tokens in texts are plain text.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvina.llm._base import Scratch

#: Bytes of text that are taken together, unless one text is longer.
BLOCK = 1 << 20
#: Blocks that a task puts together with their counts, about.
BLOCKS = 16
#: How the byte-level BPE file cuts texts before it merges; a fixed value of that file's ``ByteLevel`` step.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BYTE = 6  # kind of a piece that is a byte


def byte_letters() -> dict[str, int]:
    """The letter that a byte-level vocabulary writes for each byte: printable Latin-1 for itself, the others from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


@dataclass
class Tokens:
    """encode: a text's ids. spelled: each id's bytes."""

    encode: Callable[[str], list[int]]
    spelled: list[bytes]


def byte_level(file: str) -> Tokens:
    """From the JSON text of a ``tokenizers`` byte-level BPE. Where ids are merge ranks, the same ids are made by a faster encoder."""
    import tiktoken
    from tokenizers import Tokenizer

    j = json.loads(file)
    vocab, letters = j["model"]["vocab"], byte_letters()
    spelled = [b""] * (1 + max([*vocab.values(), *(t["id"] for t in j["added_tokens"])]))
    special = {t["content"] for t in j["added_tokens"]}
    for piece, i in vocab.items():
        spelled[i] = piece.encode() if piece in special else bytes(letters[c] for c in piece)
    pairs = [m if isinstance(m, list) else m.split(" ") for m in j["model"]["merges"]]
    ranked = all(vocab.get("".join(m)) == 256 + k for k, m in enumerate(pairs)) and j["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True} and not j["normalizer"]
    if ranked:
        ranks = {spelled[i]: i for p, i in vocab.items() if p not in special}
        return Tokens(tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary, spelled)
    t = Tokenizer.from_str(file)
    t.encode_special_tokens = True
    return Tokens(lambda text: t.encode(text, add_special_tokens=False).ids, spelled)


def pieces(model: bytes) -> Tokens:
    """From a SentencePiece model. Encodes a text that has a space before it by leaving that to the model."""
    from sentencepiece import SentencePieceProcessor

    s = SentencePieceProcessor(model_proto=model)
    spelled = [bytes([int(s.id_to_piece(i)[3:5], 16)]) if s.is_byte(i) else b"" if s.is_control(i) or s.is_unknown(i) else s.id_to_piece(i).replace("▁", " ").encode() for i in range(s.get_piece_size())]
    return Tokens(lambda text: s.encode(text[1:], num_threads=1), spelled)


class Aligner:
    """Encodes and aligns the texts of a block."""

    def __init__(self, a: Tokens, b: Tokens):
        self.a, self.b = a, b
        self.length = [np.array([len(x) for x in t.spelled], np.int64) for t in (a, b)]
        # a token as it stands in the groups' text: first of a document's group, or after another of its own
        self.first_a, self.next_a, self.first_b, self.next_b = (np.array([b"%s%d" % (c, i) for i in range(len(t.spelled))], object) for t, c in ((a, b";"), (a, b","), (b, b"|"), (b, b",")))

    def encoded(self, text: str | None) -> tuple[list[int], list[int], int]:
        """Ids of A and B and the number of bytes; nothing, if either doesn't give the bytes back."""
        if not text:
            return [], [], 0
        spaced = " " + text
        data, a, b = spaced.encode(), self.a.encode(spaced), self.b.encode(spaced)
        if b"".join(map(self.a.spelled.__getitem__, a)) != data or b"".join(map(self.b.spelled.__getitem__, b)) != data:
            return [], [], 0
        return a, b, len(data)

    def __call__(self, texts: list[str | None]) -> dict[str, np.ndarray | list]:
        """Of each document n_a, n_b, n_groups, groups_sha256; pairs and n (the distinct links as A << 32 | B, sorted), slots (each link's pair, by place)."""
        every = [self.encoded(t) for t in texts]
        size = np.array([e[2] for e in every], np.int64)
        offset = np.concatenate([[0], np.cumsum(size)])  # of the documents, in bytes
        n_a, n_b = (np.array([len(e[i]) for e in every], np.int64) for i in (0, 1))
        a, b = (np.fromiter((x for e in every for x in e[i]), np.int64, int(n.sum())) for i, n in ((0, n_a), (1, n_b)))
        end_a, end_b = np.cumsum(self.length[0][a]), np.cumsum(self.length[1][b])
        marks = np.bincount(np.concatenate([end_a, end_b]), minlength=int(offset[-1]) + 1)
        cuts = np.concatenate([[0], np.cumsum(marks == 2)])  # before each byte offset
        n_groups = np.diff(cuts[offset + 1])
        last_a, last_b = np.flatnonzero(marks[end_a] == 2), np.flatnonzero(marks[end_b] == 2)
        pairs, slots, n = np.unique(a[last_a] << 32 | b[last_b], return_inverse=True, return_counts=True)
        return {"n_a": n_a, "n_b": n_b, "n_groups": n_groups, "groups_sha256": self.hashes(a, b, last_a, last_b, n_a, n_b), "pairs": pairs, "n": n, "slots": slots.astype(np.int32)}

    def hashes(self, a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> list[str]:
        """Of each document's groups as text. A group's tokens of A stand before its tokens of B, so a token moves on by the other side's tokens of the groups before."""
        in_a, in_b = np.diff(last_a + 1, prepend=0), np.diff(last_b + 1, prepend=0)
        at_a = np.arange(len(a)) + np.repeat(last_b + 1 - in_b, in_a)
        at_b = np.arange(len(b)) + np.repeat(last_a + 1, in_b)
        first_a, first_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
        first_a[last_a + 1 - in_a], first_b[last_b + 1 - in_b] = True, True
        said = np.empty(len(a) + len(b), object)
        for at, ids, first, one, other in ((at_a, a, first_a, self.first_a, self.next_a), (at_b, b, first_b, self.first_b, self.next_b)):
            said[at[first]], said[at[~first]] = one[ids[first]], other[ids[~first]]
        stop = np.cumsum(n_a + n_b)
        return [hashlib.sha256(b"".join(said[x:y].tolist())[1:]).hexdigest() if y > x else "" for x, y in zip((stop - n_a - n_b).tolist(), stop.tolist())]


def blocks(docs: DataFrame, a_file: str, b_file: str) -> DataFrame:
    """A row a document (see Aligner) and its block's name; pairs and n stand in a block's first row. Both files are read by the driver; what the workers get has their size."""
    with open(a_file, encoding="utf-8") as f:
        a_text = f.read()
    with open(b_file, "rb") as f:
        b_model = f.read()
    names = ["block", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "slots", "pairs", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = None
        for batch in batches:
            align = align or Aligner(byte_level(a_text), pieces(b_model))
            ids, texts, row = batch.column("doc_id"), batch.column("text"), 0
            while row < len(batch):
                part, size = [], 0
                while row + len(part) < len(batch) and (size < BLOCK or not part):
                    part.append(texts[row + len(part)].as_py())
                    size += len(part[-1] or "")
                got = align(part)
                stop = np.concatenate([[0], np.cumsum(got["n_groups"])]).astype(np.int32)
                slots = pa.ListArray.from_arrays(pa.array(stop), pa.array(got["slots"], pa.int32()))
                first = [pa.array([got[k], *[None] * (len(part) - 1)], pa.list_(pa.int64())) for k in ("pairs", "n")]
                columns = [pa.array([uuid.uuid4().hex] * len(part)), ids.slice(row, len(part)), *(pa.array(got[k]) for k in ("n_a", "n_b", "n_groups")), pa.array(got["groups_sha256"], pa.string()), slots, *first]
                yield pa.RecordBatch.from_arrays(columns, names=names)
                row += len(part)

    schema = "block string, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, slots array<int>, pairs array<long>, n array<long>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def pair_counts(table: DataFrame) -> DataFrame:
    """pair, count, best (whether no pair of the same B has a higher count), over all blocks."""
    pairs = table.select(F.explode(F.arrays_zip("pairs", "n")).alias("p")).groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.n").alias("count"))
    return pairs.withColumn("b", F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)))


def align(docs: DataFrame, a_file: str, b_file: str, scratch: Scratch) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row of ``docs`` (doc_id, text)."""
    table = scratch.save(blocks(docs, a_file, b_file))
    counts = scratch.save(pair_counts(table))
    highest = counts.groupBy("b").agg(F.max("count").alias("highest"))  # at most a row an id of B's vocabulary
    known = counts.join(F.broadcast(highest), "b").select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))
    # a task gets some blocks, however many there are
    tasks = max(1, table.where("pairs is not null").count() // BLOCKS)
    asked = table.select("block", F.posexplode("pairs").alias("slot", "pair"))
    told = asked.join(known, "pair").select(F.col("block").alias("of_block"), "slot", "count", "best")

    def run(block: pa.Table, told: pa.Table) -> pa.Table:
        stop = np.concatenate([[0], np.cumsum(block["n_groups"].to_numpy())])
        links, place, out = pc.list_flatten(block["slots"]).to_numpy(), told["slot"].to_numpy(), {}
        for k in ("best", "count"):
            of_pair = np.zeros(len(place), np.int64)
            of_pair[place] = told[k].to_numpy()
            out[k] = np.diff(np.concatenate([[0], np.cumsum(of_pair[links])])[stop])
        columns = [block[k] for k in ("doc_id", "n_a", "n_b", "n_groups")]
        return pa.Table.from_arrays([*columns, block["n_groups"], pa.array(out["best"]), pa.array(out["count"]), block["groups_sha256"]], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    whole, told = table.drop("pairs", "n").repartition(tasks, "block").groupBy("block"), told.repartition(tasks, "of_block").groupBy("of_block")
    return whole.cogroup(told).applyInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
