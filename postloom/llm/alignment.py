"""Alignment of two tokenizers' tokens (operator 12), on Arrow tables.

Every text is encoded by a byte-level tokenizer A and by a sentence-piece tokenizer B.  The id
lists are flattened with their parent indices; segmented cumulative sums of the tokens' byte
lengths give the end of every token in its document, and hash joins of the two tables of ends on
(doc, end) give the places where both end and the stretches between any two ends, each of which is
one link of an A token and a B token.

Links are counted by id pair in units of some megabytes of text; Spark merges the partial counts,
and every unit asks once for each distinct pair that it holds.  Texts are encoded once: a unit
keeps its links as numbers into its own pairs.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._packed import pack_ints, unpack_ints
from ._store import Scratch, partitions, stored

UNIT_BYTES = 8_000_000
CHUNK_BYTES = 1_000_000
KEPT_PARTS = 300_000  # parts of texts whose ids a worker process keeps
HALF = 1 << 32  # a pair is one number: A's id in the high half, B's in the low one
SIDES = ("a", "b")
COUNTS = ("n_a", "n_b", "n_groups", "n_links")


@dataclass(frozen=True)
class Side:
    """What a tokenizer's ids stand for: bytes, how many, and the id in decimal."""

    token_bytes: pa.Array
    lengths: pa.Array
    names: pa.Array

    @staticmethod
    def of(values: list[bytes]) -> Side:
        own = pa.array(values, pa.binary())
        return Side(own, pc.cast(pc.binary_length(own), pa.int64()), pa.array([str(i) for i in range(len(values))]))


def byte_alphabet() -> dict[str, int]:
    """Signs of a byte-level vocabulary: printable Latin-1 stands for itself, the other bytes for 256 and up."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def cut_at_spaces(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where the parts of texts begin that a byte-level tokenizer encodes by themselves.

    ``starts``: where each text begins.  A text is cut before a lone space between two signs that
    are no white space: the pattern that cuts text into words takes a space with what follows it,
    and nothing else crosses such a place.  Signs are told by bytes, so only ASCII and the letters
    of Latin-1 count as no white space; elsewhere parts are longer.
    """
    at = np.flatnonzero(data[2:-1] == 0x20) + 2
    plain = (data > 0x20) & (data < 0x7F)
    before = plain[at - 1] | (data[at - 2] == 0xC3) & (data[at - 1] >= 0x80)
    after = plain[at + 1] | (data[at + 1] == 0xC3)
    begins = np.zeros(len(data), bool)
    begins[starts] = begins[at[before & after]] = True
    return np.flatnonzero(begins)


@dataclass
class ByteLevel:
    """A byte-level tokenizer that encodes each distinct part of texts once and keeps some of them."""

    tokenizer: object
    parts: bool  # whether it cuts text in the usual way
    kept: dict[bytes, bytes] = field(default_factory=dict)

    def encode(self, texts: list[str]) -> pa.ListArray:
        if not self.parts:
            return pa.array([e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)], pa.list_(pa.int32()))
        raw = pa.array(texts).cast(pa.binary())
        edges = np.frombuffer(raw.buffers()[1], np.int32)[: len(texts) + 1]
        data = np.frombuffer(raw.buffers()[2], np.uint8)[: edges[-1]]
        starts = cut_at_spaces(data, edges[:-1]) if len(data) > 3 else edges[:-1]
        where = pa.py_buffer(np.append(starts, len(data)).astype(np.int32))
        coded = pa.Array.from_buffers(pa.binary(), len(starts), [None, where, pa.py_buffer(data)]).dictionary_encode()
        values = coded.dictionary.to_pylist()
        new = [v for v in values if v not in self.kept]
        if len(self.kept) + len(new) > KEPT_PARTS:
            self.kept, new = {}, values
        for first in range(0, len(new), 1000):
            some = new[first : first + 1000]
            for v, e in zip(some, self.tokenizer.encode_batch_fast([v.decode() for v in some], add_special_tokens=False), strict=True):
                self.kept[v] = np.array(e.ids, np.int32).tobytes()
        own = [self.kept[v] for v in values]
        ends = np.cumsum([0, *map(len, own)]) // 4
        lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.frombuffer(b"".join(own), np.int32)))
        counts = np.diff(ends)[coded.indices.to_numpy()]
        of_text = np.append(0, np.cumsum(counts))[np.searchsorted(starts, edges)]
        return pa.ListArray.from_arrays(pa.array(of_text.astype(np.int32)), pc.list_flatten(pc.take(lists, coded.indices)))


@lru_cache(maxsize=2)
def byte_level(path: str):  # noqa: ANN201
    """(encoder, Side) of a byte-level tokenizer file; marks inside texts are plain text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are what runs side by side
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    signs, vocab = byte_alphabet(), tokenizer.get_vocab()
    values = [b""] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        values[i] = bytes(signs[c] for c in token) if all(c in signs for c in token) else token.encode()
    form = json.loads(tokenizer.to_str())
    cut = form.get("pre_tokenizer") or {}
    usual = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space") and not form.get("normalizer") and all(t["special"] for t in form.get("added_tokens", []))
    return ByteLevel(tokenizer, bool(usual)).encode, Side.of(values)


@lru_cache(maxsize=2)
def sentence_piece(path: str):  # noqa: ANN201
    """(encoder, Side) of a sentence-piece model, which puts a space before each text by itself."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    values = [bytes([int(model.id_to_piece(i)[3:-1], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode() for i in ids]
    return lambda texts: pa.array(model.encode(texts, num_threads=1), pa.list_(pa.int32())), Side.of(values)


def _encoded(encode, side: Side, texts: list[str], wanted: list[bytes]) -> tuple[pa.ListArray, np.ndarray]:  # noqa: ANN001
    """Id lists of the texts, and which of them stand for the wanted bytes."""
    lists = encode(texts)
    joined = pc.take(side.token_bytes, lists.values)
    raw = joined.buffers()[2]
    raw = raw.to_pybytes() if raw is not None else b""
    edges = np.frombuffer(joined.buffers()[1], np.int32)[lists.offsets.to_numpy()].tolist() if len(joined) else [0] * (len(texts) + 1)
    return lists, np.array([raw[s:e] == w for s, e, w in zip(edges[:-1], edges[1:], wanted, strict=True)], bool)


def token_ends(lists: pa.ListArray, lengths: pa.Array, name: str) -> pa.Table:
    """(doc, end, ``name``): each token's document, its end in that document's bytes, and its number."""
    ids = pc.list_flatten(lists)
    doc = pc.cast(pc.list_parent_indices(lists), pa.int64())
    total = pc.cumulative_sum(pc.take(lengths, ids))
    before = pc.take(pa.concat_arrays([pa.array([0], pa.int64()), total]), lists.offsets.slice(0, len(lists)))
    return pa.table({"doc": doc, "end": pc.subtract(total, pc.take(before, doc)), name: pa.array(np.arange(len(ids)))})


@dataclass
class Aligned:
    """Some documents: counts of each, its groups as text, and the id pair of every link."""

    counts: dict[str, np.ndarray]
    groups: pa.Array
    pairs: pa.Array


def _per_doc(doc: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(doc, minlength=n).astype(np.int64)


def _cut(values: pa.Array, ends: np.ndarray, sign: str) -> pa.Array:
    """The strings joined by ``sign``, anew after each of the ends."""
    edges = pa.array(np.concatenate([[0], ends]).astype(np.int32))
    return pc.binary_join(pa.ListArray.from_arrays(edges, values), sign)


def aligned(lists: tuple[pa.ListArray, pa.ListArray], sides: tuple[Side, Side]) -> Aligned:
    """Groups and links of documents whose two id lists stand for the same bytes."""
    n = len(lists[0])
    a, b = (token_ends(x, s.lengths, name) for x, s, name in zip(lists, sides, SIDES, strict=True))
    both = a.join(b, ["doc", "end"], join_type="full outer", use_threads=False).sort_by([("doc", "ascending"), ("end", "ascending")]).combine_chunks()
    shared = both.filter(pc.and_(pc.is_valid(both["a"]), pc.is_valid(both["b"])))
    where = both["doc"].to_numpy(), shared["doc"].to_numpy()
    counts = {name: pc.list_value_length(x).to_numpy().astype(np.int64) for name, x in zip(COUNTS, lists, strict=False)}
    counts |= {"n_groups": _per_doc(where[1], n), "n_links": _per_doc(where[0], n)}
    ids = [pc.list_flatten(x) for x in lists]
    # a stretch belongs to the token that ends next; the last end of a document is one of both
    token = [pc.fill_null_backward(both[name]).combine_chunks() for name in SIDES]
    high, low = (pc.cast(pc.take(i, t), pa.int64()) for i, t in zip(ids, token, strict=True))
    texts = [_cut(pc.take(s.names, i), shared[name].to_numpy() + 1, ",") for s, i, name in zip(sides, ids, SIDES, strict=True)]
    groups = _cut(pc.binary_join_element_wise(*texts, "|"), np.cumsum(counts["n_groups"]), ";")
    return Aligned(counts, groups, pc.add(pc.multiply(high, pa.scalar(HALF)), low))


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Stretches of about CHUNK_BYTES of text, a long text by itself."""
    first, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t or "")
        if held >= CHUNK_BYTES or i - first >= 20_000:
            yield first, i + 1
            first, held = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def _aligned_texts(texts: list[str | None], encoders: tuple) -> Aligned:
    """Documents of one chunk; those without tokens have empty lists."""
    own = [t or "" for t in texts]
    wanted = [b" " + t.encode() for t in own]
    (encode_a, side_a), (encode_b, side_b) = encoders
    a, fine_a = _encoded(encode_a, side_a, [" " + t for t in own], wanted)
    b, fine_b = _encoded(encode_b, side_b, own, wanted)
    fine = fine_a & fine_b & np.array([bool(t) for t in own])
    if not fine.all():
        a, b = (pa.array([x.as_py() if ok else [] for x, ok in zip(lists, fine.tolist(), strict=True)], pa.list_(pa.int32())) for lists in (a, b))
    return aligned((a, b), (side_a, side_b))


UNIT = "unit bigint, ids array<{}>, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, n_links array<bigint>, groups_sha256 array<string>, links binary, pairs array<bigint>, times array<bigint>"


def units(docs: DataFrame, byte_level_file: str, piece_model: str, scratch: Scratch) -> DataFrame:
    """A row for each unit of documents: ids, counts and digests of each, links as numbers into the unit's pairs, and how often each pair is linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders = byte_level(byte_level_file), sentence_piece(piece_model)
        number, ids, parts, held = TaskContext.get().partitionId() << 24, [], [], 0

        def flush() -> pa.RecordBatch:
            links = pa.chunked_array([p.pairs for p in parts]).combine_chunks()
            counted = pa.table({"pair": links}).group_by("pair", use_threads=False).aggregate([([], "count_all")]).combine_chunks()
            pairs = counted["pair"].combine_chunks()
            numbers = pc.index_in(links, value_set=pairs).to_numpy()
            sha = ["" if not g else hashlib.sha256(g.encode()).hexdigest() for p in parts for g in p.groups.to_pylist()]
            one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
            columns = [pa.array([number]), one(pa.concat_arrays(ids))]
            columns += [one(pa.array(np.concatenate([p.counts[c] for p in parts]))) for c in COUNTS]
            columns += [one(pa.array(sha, pa.string())), pa.array([pack_ints(numbers)], pa.binary()), one(pairs), one(counted["count_all"].combine_chunks())]
            return pa.RecordBatch.from_arrays(columns, ["unit", "ids", *COUNTS, "groups_sha256", "links", "pairs", "times"])

        for batch in batches:
            texts = batch.column(1).to_pylist()
            for first, end in _chunks(texts):
                ids.append(batch.column(0).slice(first, end - first))
                parts.append(_aligned_texts(texts[first:end], encoders))
                held += sum(len(t or "") for t in texts[first:end])
                if held >= UNIT_BYTES or sum(map(len, ids)) >= 1 << 18:
                    yield flush()
                    number, ids, parts, held = number + 1, [], [], 0
        if parts:
            yield flush()

    kind = docs.schema["doc_id"].dataType.simpleString()
    made = docs.select("doc_id", "text").mapInArrow(run, UNIT.format(kind))
    return scratch.bucketed(made, "unit", partitions(docs.sparkSession), "units")


def pair_counts(unit: DataFrame) -> DataFrame:
    """(pair, n, best): links of each id pair in the corpus, and whether no other A id has more with this B id."""
    partial = unit.select(F.inline_outer(F.arrays_zip(F.col("pairs").alias("pair"), "times"))).filter("pair is not null")
    total = partial.groupBy("pair").agg(F.sum("times").alias("n"))
    most = total.groupBy((F.col("pair") % HALF).alias("b")).agg(F.max("n").alias("most"))  # a row an id of B's vocabulary
    return total.join(F.broadcast(most), F.col("pair") % HALF == F.col("b")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def per_document(unit: DataFrame, counts: DataFrame) -> DataFrame:
    """A row for each document; a unit's links look up what its pairs count corpus-wide."""
    names = ["doc_id", *COUNTS, "n_best", "count_sum", "groups_sha256"]
    kind = unit.schema["ids"].dataType.elementType.simpleString()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        at = right["pos"].to_numpy()
        n, best = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        n[at], best[at] = right["n"].to_numpy(), right["best"].to_numpy()
        out = []
        for i in range(left.num_rows):
            cell = lambda c, i=i: left[c][i].values
            links = unpack_ints(left["links"][i].as_py())
            edges = np.concatenate([[0], np.cumsum(cell("n_links").to_numpy())])
            sums = [np.diff(np.concatenate([[0], np.cumsum(v[links])])[edges]) for v in (best, n)]
            out.append(pa.RecordBatch.from_arrays([cell("ids"), *(cell(c) for c in COUNTS), *map(pa.array, sums), cell("groups_sha256")], names))
        return pa.Table.from_batches(out)

    asked = unit.select(F.col("unit").alias("of_unit"), F.posexplode_outer("pairs").alias("pos", "pair")).filter("pair is not null")
    replies = asked.join(counts, "pair").select("of_unit", "pos", "n", "best")
    longs = ", ".join(f"{c} bigint" for c in names[1:-1])
    return unit.groupBy("unit").cogroup(replies.groupBy("of_unit")).applyInArrow(run, f"doc_id {kind}, {longs}, groups_sha256 string")


@dataclass(frozen=True)
class Alignment:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) and (a_id, b_id, n, best)."""

    documents: DataFrame
    pairs: DataFrame


def align_tokenizers(docs: DataFrame, byte_level_file: str, piece_model: str) -> Alignment:
    """How the tokens of two tokenizers match, document by document and for the whole corpus.

    A encodes a space and the text, B the text, to which it adds the space.  A document whose text
    is null or empty, or whose tokens do not stand for exactly these bytes on both sides, has no
    tokens: its numbers are 0 and its digest is empty.  Texts of any length are taken whole; ties
    for the highest count of a B id are all best.  Rows that repeat, share a doc_id or have none
    come back each by itself, and each counts.  An empty table gives empty results; further columns
    are left aside.
    """
    scratch = Scratch(docs.sparkSession, "alignment")
    try:
        unit = units(docs, byte_level_file, piece_model, scratch)
        counts = stored(pair_counts(unit), "pairs")
        documents = stored(per_document(unit, counts), "aligned")
    finally:
        scratch.remove()
    return Alignment(documents, counts.select(F.shiftright("pair", 32).alias("a_id"), (F.col("pair") % HALF).alias("b_id"), "n", "best"))
