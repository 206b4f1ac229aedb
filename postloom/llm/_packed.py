"""Documents packed into pieces, so that what a piece asks of the whole corpus is asked once.

A piece is some megabytes of consecutive texts of one task: ids of the documents, words of each,
and the words as numbers into the piece's own vocabulary of 64-bit hashes.  Pieces are stored in
a bucketed table by ``grp``, a few pieces each.  An operator sends the distinct things of a piece
(words, pairs, seeds) to slices by their hash, and the slices' answers come back to the piece by
a join on ``grp``, which does not shuffle the pieces.  However often something occurs, a slice
hears of it once from each piece.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from ._store import Scratch, partitions
from ._words import pieces

PIECE_BYTES = 5_000_000
GROUP_PIECES = 4
DIGEST = 16
HEAD = struct.Struct("<BI")
WIDTHS = ("<u1", "<u2", "<u4", "<u8")


def pack_ints(a: np.ndarray) -> bytes:
    """Numbers from 0 up, in as few bytes each as the largest needs, compressed where that helps."""
    top = int(a.max()) if len(a) else 0
    width = (top >= 1 << 8) + (top >= 1 << 16) + (top >= 1 << 32)
    raw = a.astype(WIDTHS[width]).tobytes()
    small = pa.compress(raw, codec="zstd", asbytes=True) if len(raw) > 64 else raw
    less = len(small) < len(raw)
    return HEAD.pack(width | less << 4, len(a)) + (small if less else raw)


def unpack_ints(b: bytes) -> np.ndarray:
    kind, n = HEAD.unpack_from(b)
    width = WIDTHS[kind & 15]
    raw = b[HEAD.size :]
    if kind >> 4:
        raw = pa.decompress(raw, decompressed_size=n * np.dtype(width).itemsize, codec="zstd", asbytes=True)
    return np.frombuffer(raw, width).astype(np.int64)


def pack_words(h: np.ndarray) -> bytes:
    """Hashes as the distinct ones, frequent first, and a number for each; the numbers by byte planes."""
    vocab, back, n = np.unique(h, return_inverse=True, return_counts=True)
    order = np.argsort(-n, kind="stable")
    rank = np.empty(len(vocab), np.uint32)
    rank[order] = np.arange(len(vocab), dtype=np.uint32)
    planes = rank[back].astype("<u4").view(np.uint8).reshape(-1, 4)
    used = 1 + (len(vocab) > 1 << 8) + (len(vocab) > 1 << 16) + (len(vocab) > 1 << 24)
    parts = [vocab[order].tobytes(), *(pack_ints(planes[:, i]) for i in range(used))]
    return struct.pack(f"<I{len(parts)}I", len(parts), *map(len, parts)) + b"".join(parts)


def unpack_words(b: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(vocabulary, number of each word)."""
    (n,) = struct.unpack_from("<I", b)
    sizes = struct.unpack_from(f"<{n}I", b, 4)
    at, parts = 4 + 4 * n, []
    for size in sizes:
        parts.append(b[at : at + size])
        at += size
    ids = np.zeros(0, np.int64)
    for i, plane in enumerate(parts[1:]):
        ids = unpack_ints(plane) if not i else ids | unpack_ints(plane) << 8 * i
    return np.frombuffer(parts[0], np.uint64), ids


@dataclass
class Packed:
    """A piece again."""

    piece: int
    doc_ids: pa.Array
    n_words: np.ndarray
    vocab: np.ndarray
    ids: np.ndarray
    digests: bytes

    @property
    def n_docs(self) -> int:
        return len(self.n_words)

    @cached_property
    def bounds(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.n_words)])

    @cached_property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_docs), self.n_words)

    @cached_property
    def hashes(self) -> np.ndarray:
        return self.vocab[self.ids]

    @cached_property
    def short(self) -> np.ndarray:
        """A 32-bit hash of each word."""
        return (self.vocab >> np.uint64(32)).astype(np.uint32)[self.ids]


def unpacked(rows: pa.RecordBatch | pa.Table, i: int) -> Packed:
    col = lambda name: rows.column(name)[i]
    vocab, ids = unpack_words(col("words").as_py())
    return Packed(col("piece").as_py(), col("ids").values, unpack_ints(col("counts").as_py()), vocab, ids, col("digests").as_py())


def store_pieces(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(grp, piece, ids, counts, words, digests) of (doc_id, text), words A-Z lower-cased; null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = TaskContext.get().partitionId() << 24
        for b in batches:
            for p in pieces(b.column(1), lower=True, size=PIECE_BYTES):
                raw = p.data.tobytes()
                digests = b"".join(hashlib.blake2b(raw[s:e], digest_size=DIGEST).digest() for s, e in zip(p.offsets[:-1].tolist(), p.offsets[1:].tolist(), strict=True))
                own = b.column(0).slice(p.first, p.n_docs)
                ids = pa.ListArray.from_arrays(pa.array([0, p.n_docs], pa.int32()), own)
                one = [pa.array([piece // GROUP_PIECES]), pa.array([piece]), ids, *(pa.array([x], pa.binary()) for x in (pack_ints(p.n_words), pack_words(p.hashes()), digests))]
                yield pa.RecordBatch.from_arrays(one, ["grp", "piece", "ids", "counts", "words", "digests"])
                piece += 1

    kind = docs.schema["doc_id"].dataType.simpleString()
    made = docs.select("doc_id", "text").mapInArrow(run, f"grp bigint, piece bigint, ids array<{kind}>, counts binary, words binary, digests binary")
    return scratch.bucketed(made, "grp", partitions(docs.sparkSession), "pieces")


def by_slice(h: np.ndarray, slices: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, edges): the hashes slice by slice, in their order within each, and where each slice begins."""
    where = ((h >> np.uint64(40)) % np.uint64(slices)).astype(np.uint16 if slices < 1 << 16 else np.uint32)
    order = np.argsort(where, kind="stable")
    return order, np.concatenate([[0], np.cumsum(np.bincount(where, minlength=slices))])


def key_bytes(h: np.ndarray, width: int) -> np.ndarray:
    """The low bytes of each hash."""
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).reshape(-1)


def keys_of(raw: bytes, width: int) -> np.ndarray:
    wide = np.zeros((len(raw) // width, 8), np.uint8)
    wide[:, :width] = np.frombuffer(raw, np.uint8).reshape(-1, width)
    return wide.view("<u8").reshape(-1)


def binaries(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary())


def by_piece(table: pa.Table, order: str) -> dict[int, list[int]]:
    """Row numbers of each piece, by ``order``."""
    piece = table.column("piece").to_numpy()
    out: dict[int, list[int]] = {}
    for i in np.lexsort((table.column(order).to_numpy(), piece)).tolist():
        out.setdefault(int(piece[i]), []).append(i)
    return out
