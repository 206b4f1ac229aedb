"""Word splitting and hashing of whole Arrow string columns with numpy.

Spark deals the documents out; these helpers turn one Arrow batch of texts into flat word
arrays.  They work on pieces of a megabyte or a few, so that memory does not follow the batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1_000_000
LONG_WORD = 1024
SEED, MULT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
WHITE = [0x20, *range(0x09, 0x0E)]

IS_WORD = np.ones(256, bool)
IS_WORD[WHITE] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
IS_POINT = np.ones(256, bool)  # bytes that begin a code point
IS_POINT[0x80:0xC0] = False
_MASK = np.array([(1 << (8 * i)) - 1 for i in range(8)] + [2**64 - 1], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise."""
    h = h ^ (h >> np.uint64(30))
    h = h * MULT
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@dataclass
class Piece:
    """Some consecutive texts of a batch, split into words."""

    first: int  # index of the first text in its batch
    data: np.ndarray  # bytes of all texts, one after the other
    offsets: np.ndarray  # where each text begins in data, and the end
    start: np.ndarray  # byte span of each word
    end: np.ndarray
    doc: np.ndarray  # text of each word, counted from first
    bounds: np.ndarray  # where each text's words begin, and the end

    @property
    def n_docs(self) -> int:
        return len(self.offsets) - 1

    @property
    def n_words(self) -> np.ndarray:
        return np.diff(self.bounds)

    def hashes(self) -> np.ndarray:
        return word_hashes(self.data, self.start, self.end)

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """Sums of a value per byte, by text."""
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return np.diff(total[self.offsets])


def pieces(texts: pa.Array, lower: bool = False, size: int = PIECE_BYTES) -> Iterator[Piece]:
    """Split a string column (null counts as empty) into pieces of about ``size`` bytes."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("") if texts.null_count else texts
    if not len(texts):
        return
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, where, raw = texts.buffers()
    offsets = np.frombuffer(where, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        own = offsets[at : to + 1] - offsets[at]
        data = raw[offsets[at] : offsets[to]]
        yield _split(at, LOWER[data] if lower else data, own)
        at = to


def _split(first: int, data: np.ndarray, offsets: np.ndarray) -> Piece:
    word = IS_WORD[data]
    if len(data):
        before, after = np.empty_like(word), np.empty_like(word)
        before[0], before[1:] = False, word[:-1]
        after[-1], after[:-1] = False, word[1:]
        inner = offsets[:-1][offsets[:-1] < len(data)]
        before[inner] = False
        after[offsets[1:][offsets[1:] > 0] - 1] = False
        start, end = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    else:
        start = end = np.zeros(0, np.int64)
    doc = np.searchsorted(offsets[1:], start, "right")
    bounds = np.searchsorted(start, offsets)
    return Piece(first, data, offsets, start, end, doc, bounds)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, eight bytes at a time."""
    length = end - start
    h = length.astype(np.uint64) * SEED
    if not len(start):
        return h
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    long = np.flatnonzero(length > LONG_WORD)
    live, done = np.flatnonzero(length <= LONG_WORD), 0
    while len(live):
        h[live] = (h[live] ^ (eight[start[live] + done] & _MASK[np.minimum(length[live] - done, 8)])) * MULT
        h[live] ^= h[live] >> np.uint64(29)
        done += 8
        live = live[length[live] > done]
    for i in long:
        h[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return mix(h)


def windows(h: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words inside one text, and the word where each begins."""
    total = len(h)
    if total < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    run = h[: total - n + 1] + SEED
    for i in range(1, n):
        run *= MULT
        run += h[i : total - n + 1 + i]
    run = mix(run)
    ok = np.ones(total - n + 1, bool)
    for i in range(1, n):  # a run that begins less than n words before the next text crosses into it
        cross = bounds[1:-1] - i
        ok[cross[(cross >= 0) & (cross < len(ok))]] = False
    at = np.flatnonzero(ok)
    return run[at], at


def by_text(doc: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Order that brings equal hashes of one text together, texts ascending."""
    key = (doc.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24))
    order = np.argsort(key)
    k, v = key[order], h[order]
    if len(k) and (((k[1:] == k[:-1]) & (v[1:] != v[:-1])).any() or doc[-1] >> 24):
        return np.lexsort((h, doc))
    return order
