"""Token ids in binary files (operator 10).

Format of a block (little-endian): magic ``TKS2``, number of documents and of ids, bytes of the
data stream; document ids (int64), a byte each that says whether the id is null, ids of each
document (uint32); one control byte for every four ids, two bits each for a length of one to four
bytes; the data bytes.  Ids are ranks by frequency
over the whole corpus, so frequent tokens take one byte.  Blocks lie one after the other, each
closed by a newline, in files named in the order of their doc_ids.

A folder of token ids holds those files under ``ids`` and, under ``ranks``, a Parquet table with the
id of each rank, so that it can be read without anything else.

Spark's text writer puts the blocks into files, and its binaryFile reader brings them back, so the
format works in any store that Spark can use, with its commit protocol for lost executors.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ._store import Scratch, new_path, stored
from ._words import Piece, pieces, word_hashes

MAGIC = b"TKS2"
HEAD = struct.Struct("<4sIQQ")
BLOCK_IDS = 1 << 20
FILE_IDS = 1 << 24
CACHE_WORDS = 2_000_000  # words whose ids a worker process keeps
CHUNK = 100  # words encoded together

# Fixed value: how a tokenizer must cut text for its words to be encoded one by one.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

WHITE, LETTER, SYMBOL, OTHER = range(4)
KIND = np.full(256, OTHER, np.uint8)
KIND[:128] = SYMBOL
KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = LETTER
KIND[[0x20, *range(0x09, 0x0E)]] = WHITE


@lru_cache(maxsize=2)
def _tokenizer(path: str):  # noqa: ANN202
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def by_words(path: str) -> bool:
    """Whether the tokenizer cuts text by WORD_PATTERN and ends each part with a marked token."""
    own = json.loads(_tokenizer(path).to_str())
    splits = [x for x in (own.get("pre_tokenizer") or {}).get("pretokenizers", []) if x["type"] == "Split"]
    cut = len(splits) == 1 and splits[0]["pattern"] == {"Regex": WORD_PATTERN} and splits[0]["behavior"] == "Removed" and splits[0]["invert"]
    marks = [x["content"] for x in own.get("added_tokens", [])]
    return bool(cut and own["model"].get("end_of_word_suffix") and not any(c.isspace() for m in marks for c in m))


def cut_words(p: Piece, whole: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the parts of a piece's words that are encoded by themselves.

    Words are cut between an ASCII letter and another ASCII sign, either way, but not behind an
    apostrophe: WORD_PATTERN never matches across such a place, so the ids of the parts are the
    ids of the word.  Words that hold one of ``whole``, the tokenizer's own marks, stay whole.
    """
    kind = KIND[p.data]
    before, after = kind[:-1], kind[1:]
    cut = (before == LETTER) & (after == SYMBOL) | (before == SYMBOL) & (after == LETTER) & (p.data[:-1] != 0x27)
    inner = np.flatnonzero(cut) + 1
    word = np.searchsorted(p.start, inner, "right") - 1
    keep = (word >= 0) & (p.start[word] < inner) & (inner < p.end[word])
    raw = p.data.tobytes()
    marked = [m.start() for mark in whole if mark in raw for m in re.finditer(re.escape(mark), raw)]
    keep &= ~np.isin(word, np.searchsorted(p.start, marked, "right") - 1)
    inner = inner[keep]
    return np.sort(np.concatenate([p.start, inner])), np.sort(np.concatenate([p.end, inner]))


class WordCoder:
    """Ids of words: each distinct word is encoded once and kept, up to a number of words.

    Words lie in two sorted tables, a large one and one of what came since; a full coder forgets all.
    """

    def __init__(self, path: str) -> None:
        self.tok, self.words = _tokenizer(path), by_words(path)
        vocabulary = self.tok.get_vocab()
        self.marks = [x["content"].encode() for x in json.loads(self.tok.to_str()).get("added_tokens", [])]
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        if self.words:
            suffix = json.loads(self.tok.to_str())["model"]["end_of_word_suffix"]
            self.ends[[i for w, i in vocabulary.items() if w.endswith(suffix)]] = True
        self.clear()

    def clear(self) -> None:
        empty = lambda: (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32))
        self.tables = [empty(), empty()]
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0

    def _add(self, key: np.ndarray, n: np.ndarray, ids: np.ndarray) -> None:
        """``key`` is ascending."""
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.zeros(max(len(self.ids), len(ids)), np.uint32)])
        self.ids[self.used : self.used + len(ids)] = ids
        new = key, self.used + np.cumsum(n) - n, n.astype(np.int32)
        self.used += len(ids)
        merged = lambda x, y: (lambda at: tuple(np.insert(a, at, b) for a, b in zip(x, y, strict=True)))(np.searchsorted(x[0], y[0]))
        self.tables[1] = merged(self.tables[1], new)
        if len(self.tables[1][0]) * 4 > len(self.tables[0][0]):
            self.tables = [merged(*self.tables), (key[:0], new[1][:0], new[2][:0])]

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids of each word).  Words of letters have one end token each, which tells them apart in a text of many."""
        plain = np.array([w.isalpha() for w in words], bool)
        order = np.argsort(~plain, kind="stable")
        out: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        some = [words[i] for i in order[: int(plain.sum())]]
        chunks = [some[i : i + CHUNK] for i in range(0, len(some), CHUNK)]
        odd: list[tuple[int, list[str]]] = [(-1, [words[i] for i in order[len(some) :]])]
        for k, (chunk, got) in enumerate(zip(chunks, self.tok.encode_batch_fast([" ".join(c) for c in chunks], add_special_tokens=False), strict=True)):
            ids = np.array(got.ids, np.uint32)
            last = np.flatnonzero(self.ends[ids])
            out.append(ids)
            counts.append(np.diff(last, prepend=-1))
            if len(last) != len(chunk):  # a letter that its lower-casing takes apart
                odd.append((k, chunk))
        for k, chunk in odd:
            got = self.tok.encode(chunk, is_pretokenized=True, add_special_tokens=False)
            ids = np.array(got.ids, np.uint32)
            n = np.bincount(np.array(got.word_ids, np.int64), minlength=len(chunk)) if len(ids) else np.zeros(len(chunk), np.int64)
            if k < 0:
                out.append(ids)
                counts.append(n)
            else:
                out[k], counts[k] = ids, n
        ids, n = np.concatenate(out), np.concatenate(counts)
        at = np.cumsum(n) - n
        back = np.empty(len(words), np.int64)
        back[order] = np.arange(len(words))
        n, at = n[back], at[back]
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        return ids[np.repeat(at, n) + step], n

    def _found(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, number) of the ids of each word; place -1 where it is not known."""
        at, n = np.full(len(key), -1), np.zeros(len(key), np.int64)
        for keys, where, many in self.tables:
            if len(keys):
                i = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                hit = keys[i] == key
                at[hit], n[hit] = where[i[hit]], many[i[hit]]
        return at, n

    def encode(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first text, ids, ids of each text) of each piece."""
        for p in pieces(texts):
            if not self.words:
                raw = [p.data[s:e].tobytes().decode() for s, e in zip(p.offsets[:-1].tolist(), p.offsets[1:].tolist(), strict=True)]
                got = [x.ids for x in self.tok.encode_batch_fast(raw, add_special_tokens=False)]
                yield p.first, np.array([i for x in got for i in x], np.uint32), np.array([len(x) for x in got], np.int64)
                continue
            start, end = cut_words(p, self.marks)
            key, first, back = np.unique(word_hashes(p.data, start, end), return_index=True, return_inverse=True)
            if len(self.tables[0][0]) + len(self.tables[1][0]) > CACHE_WORDS:
                self.clear()
            at, n = self._found(key)
            new = np.flatnonzero(at < 0)
            if len(new):
                raw = p.data.tobytes()
                ids, many = self._encode([raw[s:e].decode() for s, e in zip(start[first[new]].tolist(), end[first[new]].tolist(), strict=True)])
                at[new], n[new] = self.used + np.cumsum(many) - many, many
                self._add(key[new], many, ids)
            n, at = n[back], at[back]
            total = np.cumsum(n)
            step = np.arange(int(total[-1]) if len(total) else 0) - np.repeat(total - n, n)
            ids = self.ids[np.repeat(at, n) + step]
            sums = np.concatenate([[0], total])
            yield p.first, ids, np.diff(sums[np.searchsorted(start, p.offsets)])


@lru_cache(maxsize=1)
def _coder(path: str) -> WordCoder:
    """A worker process keeps its coder from task to task."""
    return WordCoder(path)


def encoded(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """(doc_id, ids): the ids of each document, end id included, as little-endian unsigned 16- or 32-bit integers."""
    wide = _tokenizer(tokenizer).get_vocab_size() > 1 << 16
    kind = np.dtype("<u4") if wide else np.dtype("<u2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(tokenizer)
        for b in batches:
            for first, ids, n in coder.encode(b.column(1)):
                where = np.concatenate([[0], np.cumsum(n + 1)])
                out = np.full(where[-1], end_id, kind)
                inner = np.ones(where[-1], bool)
                inner[where[1:] - 1] = False
                out[inner] = ids
                raw = pa.py_buffer(out.tobytes())
                held = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((where * kind.itemsize).astype(np.int32).tobytes()), raw])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(n)), held, pa.array(n + 1)], ["doc_id", "ids", "n_tokens"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, ids binary, n_tokens bigint")


def id_counts(ids: DataFrame, vocabulary: int) -> DataFrame:
    """(id, n) over all documents."""
    kind = "<u4" if vocabulary > 1 << 16 else "<u2"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, np.int64)
        for b in batches:
            for x in b.column(0):
                total += np.bincount(np.frombuffer(x.as_buffer(), kind), minlength=vocabulary)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["id", "n"])

    return ids.select("ids").mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))


def ranks(counts: DataFrame, vocabulary: int) -> tuple[np.ndarray, np.ndarray]:
    """Rank of each id, and id of each rank: by count, ties by id; unused ids last.  One row an id of the vocabulary."""
    n = np.zeros(vocabulary, np.int64)
    for r in counts.collect():
        n[r["id"]] = r["n"]
    id_of = np.lexsort((np.arange(vocabulary), -n)).astype(np.uint32)
    rank_of = np.empty(vocabulary, np.uint32)
    rank_of[id_of] = np.arange(vocabulary, dtype=np.uint32)
    return rank_of, id_of


LENGTHS = np.array([[(c >> (2 * i) & 3) + 1 for i in range(4)] for c in range(256)], np.int64)


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned 32-bit values."""
    v = values.astype("<u4")
    length = 1 + (v >= 1 << 8).astype(np.int64) + (v >= 1 << 16) + (v >= 1 << 24)
    codes = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    codes[: len(v)] = length - 1
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    used = np.arange(4) < length[:, None]
    return control.astype(np.uint8).tobytes(), v.view(np.uint8).reshape(-1, 4)[used].tobytes()


def unpack(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The values again: lengths come from a table of the 256 control bytes."""
    length = LENGTHS[control].reshape(-1)[:n]
    at = np.cumsum(length) - length
    out = np.zeros((n, 4), np.uint8)
    for i in range(4):
        has = length > i
        out[has, i] = data[at[has] + i]
    return out.view("<u4").reshape(-1)


def block(doc_ids: list[int | None], counts: np.ndarray, values: np.ndarray) -> bytes:
    control, data = pack(values)
    head = HEAD.pack(MAGIC, len(doc_ids), len(values), len(data))
    none = np.array([d is None for d in doc_ids], np.uint8)
    ids = np.array([0 if d is None else d for d in doc_ids], "<i8")
    return head + ids.tobytes() + none.tobytes() + counts.astype("<u4").tobytes() + control + data


def blocks(raw: bytes) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(doc_ids, ids of each, all values) of every block of a file."""
    at = 0
    while at < len(raw):
        magic, docs, n, size = HEAD.unpack_from(raw, at)
        if magic != MAGIC:
            raise ValueError("not a token file")
        at += HEAD.size
        ids = pa.array(np.frombuffer(raw, "<i8", docs, at), mask=np.frombuffer(raw, np.uint8, docs, at + 8 * docs) > 0)
        counts = np.frombuffer(raw, "<u4", docs, at + 9 * docs)
        at += 13 * docs
        control = np.frombuffer(raw, np.uint8, -(-n // 4), at)
        at += len(control)
        yield ids, counts, unpack(control, np.frombuffer(raw, np.uint8, size, at), n)
        at += size + 1  # the writer's newline


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, file_ids: int = FILE_IDS) -> None:
    """Writes the ids of all documents in ascending doc_id order, and the table of their ranks.

    The format holds doc_ids as 64-bit numbers; a table with others is refused.  Null texts count
    as empty: their only id is the end.  Null doc_ids come first.  Rows that repeat a doc_id (or
    have none) are written one after the other, in the order of a hash of their ids, which also
    deals them out, so that many of them do not meet in one file.  An empty table gives no blocks.
    """
    id_type = docs.schema["doc_id"].dataType
    if not isinstance(id_type, T.IntegralType):
        raise ValueError(f"doc_id must be a whole number to be stored in token files, not {id_type.simpleString()}")
    vocabulary = max(_tokenizer(tokenizer).get_vocab_size(), end_id + 1)
    kind = "<u4" if _tokenizer(tokenizer).get_vocab_size() > 1 << 16 else "<u2"
    spark = docs.sparkSession
    scratch = Scratch(spark, "encoded")
    try:
        _write_blocks(docs, scratch, path, tokenizer, end_id, vocabulary, kind, file_ids)
    finally:
        scratch.remove()


def _write_blocks(docs: DataFrame, scratch: Scratch, path: str, tokenizer: str, end_id: int, vocabulary: int, kind: str, file_ids: int) -> None:
    ids = scratch.stored(encoded(docs, tokenizer, end_id).withColumn("tie", F.xxhash64("ids")), "ids")
    rank_of, id_of = ranks(id_counts(ids, vocabulary), vocabulary)
    table = pa.table({"rank": pa.array(np.arange(vocabulary)), "id": pa.array(id_of.astype(np.int64))})
    docs.sparkSession.createDataFrame(table).coalesce(1).write.parquet(f"{path}/ranks")  # a row an id of the vocabulary
    total = ids.agg(F.sum("n_tokens")).first()[0] or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        who, parts, held = [], [], 0

        def flush() -> pa.RecordBatch:
            counts = np.array([len(x) for x in parts])
            return pa.RecordBatch.from_arrays([pa.array([block(who, counts, rank_of[np.concatenate(parts)])], pa.binary())], ["block"])

        for b in batches:
            for d, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                who.append(d)
                parts.append(np.frombuffer(x.as_buffer(), kind))
                held += len(parts[-1])
                if held >= BLOCK_IDS:
                    yield flush()
                    who, parts, held = [], [], 0
        if who:
            yield flush()

    files = max(1, -(-total // file_ids))
    dealt = ids.repartitionByRange(files, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "ids")
    dealt.mapInArrow(run, "block binary").select(F.col("block").cast("string").alias("value")).write.text(f"{path}/ids")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the folder at ``path``, from its files alone.

    ``start`` counts the ids of all documents before it: files follow one another by name, as
    Spark names them by partition.  A folder without blocks gives an empty result.
    """

    table = spark.read.parquet(f"{path}/ranks").toArrow()  # a row an id of the vocabulary
    id_of = np.zeros(table.num_rows, np.uint32)
    id_of[table["rank"].to_numpy()] = table["id"].to_numpy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                seen = 0
                for docs, counts, values in blocks(raw.as_buffer().to_pybytes()):
                    ids = id_of[values].astype("<u4")
                    ends = np.cumsum(counts.astype(np.int64))
                    starts = ends - counts
                    crc = [zlib.crc32(ids[s:e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(docs)), docs, pa.array(starts + seen), pa.array(counts.astype(np.int64)), pa.array(crc, pa.int64())], ["file", "doc_id", "start", "n_tokens", "ids_crc32"])
                    seen += len(values)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/ids").select(F.substring_index("path", "/", -1).alias("path"), "content")
    each = stored(files.mapInArrow(run, "file string, doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"), "read")
    sizes = each.groupBy("file").agg(F.sum("n_tokens").alias("n"))  # a row a file
    before = F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("file", F.coalesce(before, F.lit(0)).alias("before"))
    out = each.join(F.broadcast(sizes), "file")
    return out.select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files that its ids are written to.

    Null and empty texts have the end id only; very long texts are encoded whole.  Null doc_ids
    come before all others, rows that repeat a doc_id come back once each.  A doc_id that is no whole
    number is refused (ValueError).  An empty table gives
    an empty result; further columns are left aside.
    """
    spark = docs.sparkSession
    path = new_path(spark, "tokens")
    write_tokens(docs, path, tokenizer, end_id)
    return read_tokens(spark, path)
