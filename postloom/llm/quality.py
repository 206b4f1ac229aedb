"""Quality rules with cross-document line frequency (operator 5).

Lines are normalised (A-Z lower-cased, white space collapsed) and hashed; for every host the
distinct documents of each line are counted, copies of one text as one document.  A line above
its host's limit is boilerplate and is removed; a document of which too little is left is
depleted and rejected.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import free_name, small_enough, stored
from ._words import IS_POINT, IS_WORD, Piece, by_text, pieces, windows


@dataclass(frozen=True)
class Rules:
    min_words: int = 10
    repeat_window: int = 5
    max_repeat_percent: int = 20
    #: a line is removed when more distinct documents of its host have it than both of these say
    line_docs: int = 20
    line_percent: int = 1
    #: a document is depleted when fewer words than this share (or than min_words) are left
    left_percent: int = 25


ASCII_SPACE = " \t\n\r\v\f"
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True


def line_key(line: bytes) -> int:
    """Hash of a normalised line."""
    return int.from_bytes(hashlib.blake2b(b" ".join(line.lower().split()), digest_size=8).digest(), "little", signed=True)


def _repeat_words(piece: Piece, n: int) -> np.ndarray:
    """Words of each text in windows of n words that the text has twice or more."""
    out = np.zeros(piece.n_docs, np.int64)
    s, at = windows(piece.hashes(), piece.bounds, n)
    if not len(s):
        return out
    doc = piece.doc[at]
    order = by_text(doc, s)
    same = (doc[order][1:] == doc[order][:-1]) & (s[order][1:] == s[order][:-1])
    twice = np.zeros(len(s), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(piece.doc) + 1, np.int64)
    np.add.at(edge, at[twice], 1)
    np.add.at(edge, at[twice] + n, -1)
    covered = np.cumsum(edge[:-1]) > 0
    return np.bincount(piece.doc[covered], minlength=piece.n_docs)


def _lines(text: bytes) -> tuple[int, list[int], list[int]]:
    """Repeated lines, and the normalised lines that hold a word with the words in all their copies."""
    seen, repeats, held = set(), 0, {}
    for line in text.split(b"\n"):
        words = len(line.split())
        if words:
            repeats += line in seen
            seen.add(line)
            key = line_key(line)
            held[key] = held.get(key, 0) + words
    return repeats, list(held), list(held.values())


def measured(docs: DataFrame, host: str, rules: Rules) -> DataFrame:
    """Per document: the base counts, a hash of the text, its lines and their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in pieces(b.column(2)):
                spans = list(zip(p.offsets[:-1].tolist(), p.offsets[1:].tolist(), strict=True))
                raw = p.data.tobytes()
                lines = [_lines(raw[i:j]) for i, j in spans]
                texts = [int.from_bytes(hashlib.blake2b(raw[i:j], digest_size=8).digest(), "little", signed=True) for i, j in spans]
                where = pa.array(np.concatenate([[0], np.cumsum([len(x[1]) for x in lines])]).astype(np.int32))
                columns = [
                    b.column(0).slice(p.first, p.n_docs),
                    b.column(1).slice(p.first, p.n_docs),
                    pa.array(texts, pa.int64()),
                    pa.array(p.n_words),
                    pa.array(p.per_text(IS_WORD[p.data] & IS_POINT[p.data])),
                    pa.array(p.per_text(SYMBOL[p.data])),
                    pa.array([x[0] for x in lines], pa.int64()),
                    pa.array(_repeat_words(p, rules.repeat_window)),
                    pa.ListArray.from_arrays(where, pa.array([k for x in lines for k in x[1]], pa.int64())),
                    pa.ListArray.from_arrays(where, pa.array([k for x in lines for k in x[2]], pa.int64())),
                    b.column(3).slice(p.first, p.n_docs),
                ]
                yield pa.RecordBatch.from_arrays(columns, names)

    names = ["doc_id", "host", "text_hash", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines", "line_words", "version"]
    kinds = [docs.schema["doc_id"].dataType.simpleString(), docs.schema[host].dataType.simpleString(), *["bigint"] * 6, *["array<bigint>"] * 2, "bigint"]
    schema = ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True))
    return docs.select("doc_id", F.col(host), "text", F.xxhash64("text")).mapInArrow(run, schema)


def frequent_lines(each: DataFrame, rules: Rules) -> DataFrame:
    """(host, line) above the host's limit."""
    # copies of one text count once; equal (host, text) meet before their lines are told apart
    texts = each.select("host", "text_hash", F.explode("lines").alias("line"))
    count = texts.groupBy("host", "line").agg(F.countDistinct("text_hash").alias("n_docs")).filter(F.col("n_docs") > rules.line_docs)
    hosts = each.groupBy("host").agg(F.countDistinct("text_hash").alias("host_docs"))
    both = count.join(hosts, count["host"].eqNullSafe(hosts["host"])).drop(hosts["host"])
    return both.filter(F.col("n_docs") * 100 > F.col("host_docs") * rules.line_percent).select("host", "line")


def judged(docs: DataFrame, host: str = "source", rules: Rules = Rules()) -> DataFrame:
    """(doc_id, host, version, text_hash, base counts, n_removed_words, removed lines, base_failed, kept), one row per document.

    Null, empty and blank texts have no words and fail the base rules.  A null host is a host of
    its own.  Rows that repeat are judged alike, each in its row; the verdict depends on counts
    only, so ties do not matter.  An empty table gives an empty one; further columns are left aside.
    """
    each = stored(measured(docs, host, rules), "measured")
    frequent = stored(frequent_lines(each, rules), "lines")
    per_host = frequent.groupBy("host").agg(F.collect_set("line").alias("bad"))
    # a host has fewer than 100 / line_percent lines above its limit for each line of its texts
    per_host = small_enough(per_host.join(frequent.groupBy("host").count().withColumnRenamed("host", "h"), F.col("host").eqNullSafe(F.col("h"))).drop("h", "count"), 16_000)
    each = each.join(per_host.withColumnRenamed("host", "h"), F.col("host").eqNullSafe(F.col("h")), "left").drop("h")
    pairs = F.arrays_zip("lines", "line_words")
    out = F.when(F.col("bad").isNotNull(), F.filter(pairs, lambda x: F.array_contains("bad", x["lines"]))).otherwise(F.filter(pairs, lambda x: F.lit(False)))
    each = each.withColumn("out", out)
    removed = F.aggregate(F.col("out.line_words"), F.lit(0).cast("long"), lambda a, x: a + x)
    each = each.withColumn("n_removed_words", removed)
    left = F.col("n_words") - F.col("n_removed_words")
    failed = (F.col("n_words") < rules.min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * rules.max_repeat_percent)
    depleted = (F.col("n_removed_words") > 0) & ((left < rules.min_words) | (left * 100 < F.col("n_words") * rules.left_percent))
    return each.select("doc_id", "host", "version", "text_hash", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_removed_words", F.col("out.lines").alias("removed"), failed.alias("base_failed"), (~failed & ~depleted).alias("kept"))


def without_lines(text: Column, removed: Column) -> Column:
    """The text without its lines whose key is in ``removed``; others stay as they are."""

    @F.arrow_udf("string")
    def cut(texts: pa.Array, keys: pa.Array) -> pa.Array:
        def one(t: str | None, bad: list[int] | None) -> str | None:
            if not t or not bad:
                return t
            gone = set(bad)
            return "\n".join(x for x in t.split("\n") if not x.strip(ASCII_SPACE) or line_key(x.encode()) not in gone)

        return pa.array([one(t.as_py(), k.as_py()) for t, k in zip(texts, keys, strict=True)], pa.string())

    return cut(text, removed)


def quality_filter(docs: DataFrame, host: str = "source", rules: Rules = Rules()) -> DataFrame:
    """The kept documents; boilerplate lines are cut out of their texts, all other columns stay.

    Only rejected and cut documents are joined back, so the others' texts need not move; a row's
    verdict is that of its id, host and text, so null and repeated ids do no harm and rows that
    repeat stay or go together.  Null, empty and blank texts are rejected.  An empty table gives
    an empty one; columns of any name stay as they are.
    """
    id_, host_, version, kept, removed, changed = (free_name(docs, n) for n in ("judged_id", "judged_host", "judged_version", "kept", "removed", "judged"))
    own = judged(docs, host, rules).filter(~F.col("kept") | (F.size("removed") > 0))
    verdict = own.select(F.col("doc_id").alias(id_), F.col("host").alias(host_), F.col("version").alias(version), F.col("kept").alias(kept), F.col("removed").alias(removed), F.lit(True).alias(changed))
    verdict = small_enough(stored(verdict.dropDuplicates([id_, host_, version]), "verdict"), 200)
    same = docs["doc_id"].eqNullSafe(verdict[id_]) & docs[host].eqNullSafe(verdict[host_]) & (F.xxhash64(docs["text"]) == verdict[version])
    both = docs.join(verdict, same, "left").filter(F.coalesce(kept, F.lit(True)))
    cut = F.col(changed).isNotNull()
    none = F.array().cast("array<bigint>")
    text = F.when(cut, without_lines(F.when(cut, F.col("text")).otherwise(""), F.coalesce(removed, none))).otherwise(F.col("text"))
    return both.withColumn("text", text).select(*docs.columns)
