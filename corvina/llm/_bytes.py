"""Vectorised work on the UTF-8 bytes of an Arrow column of texts: words, their hashes, hashes of runs of words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes taken at a time, unless one text is longer. It bounds a worker's memory, not what is read.
CHUNK = 1 << 20

_rng = np.random.default_rng(20260101)
_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = int(_rng.integers(1 << 40, 1 << 63)) | 1
_STEP = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers and their inverses modulo 2**64, at least n."""
    if not _powers or len(_powers["up"]) < n:
        n = max(n, CHUNK + 1)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            factors = np.full(n, base, np.uint64)
            factors[0] = 1
            _powers[name] = np.cumprod(factors, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64: spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chunks(texts: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets of the rows in them) for runs of rows of about ``limit`` bytes. A null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(off, off[row] + limit, "right")) - 1)
        yield row, data[off[row] : off[end]], off[row : end + 1] - off[row]
        row = end


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the index of each row's first word (with the total at the end)."""
    word = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)  # a row's first byte starts anew
    edge[off] = True
    prev = np.empty_like(word)
    if len(word):
        prev[0] = False
        prev[1:] = word[:-1]
    begins = word & (~prev | edge[:-1])
    after = np.empty_like(word)
    if len(word):
        after[-1] = False
        after[:-1] = word[1:]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(word & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, off)


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial in the bytes, from which any substring's hash follows."""
    up, _ = powers(len(data) + 1)
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(_VALUE[data] * up[: len(data)], dtype=np.uint64)])


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of substrings; equal substrings have equal hashes wherever they stand."""
    return mix((sums[ends] - sums[starts]) * powers(len(sums))[1][starts])


def shingle_sets(texts: pa.Array, k: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, sorted distinct hashes of each row's runs of k words). A to Z count as a to z; a row of fewer than k
    words has one run, all of them; one without words has none."""
    for row, data, off in chunks(texts):
        data = _LOWER[data]
        starts, ends, first = words(data, off)
        h = span_hash(prefix_sums(data), starts, ends)
        total = np.zeros(len(h), np.uint64)
        for j in range(min(k, len(h))):
            total[: len(h) - j] += h[j:] * _STEP[j]
        out = []
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            if b - a >= k:
                out.append(np.unique(mix(total[a : b - k + 1])))
            elif b > a:
                out.append(mix((h[a:b] * _STEP[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a)))
            else:
                out.append(h[:0])
        yield row, out
