"""Language-model scoring by deleted interpolation (operator 9).

A bigram model mixes three maximum-likelihood estimates: P(w | h) from bigram counts, P(w) from
word counts, and 1 / |vocabulary|.  The mixture weights depend on the frequency of the context h,
in buckets of powers of two, and are learned by expectation-maximisation: counts from most of the
training documents predict the counts held out in the rest.  Scoring then uses the counts of both.

Counts cover all words and bigrams of all training documents.  Each piece of documents sends its
distinct words and bigrams, with their counts, to slices by hash; a slice sums them over the
corpus and answers every piece in the order in which it asked.  The piece then has all that its
documents' scores need.  Words and bigrams are told apart by 64 bits.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._packed import Packed, binaries, by_piece, by_slice, key_bytes, keys_of, pack_ints, store_pieces, unpack_ints, unpacked
from ._store import Scratch, partitions, stored
from ._words import mix

TRAIN, TUNE, HELD = 0, 1, 2
END_HASH, BEGIN_HASH = np.uint64(0x0E11D), np.uint64(0x0BE6)
SLICES_PER_PARTITION = 2  # keeps a slice's share of the bigrams small
PAIR_BYTES = 8
STEPS = 8  # likelihood ratios are told apart by eighths of a power of two when weights are learned
COUNTS = ("word_train", "word_tune", "pair_train", "pair_tune")


@dataclass(frozen=True)
class Lm:
    folds: int = 7
    held_fold: int = 2  # never learned from
    tune_fold: int = 3  # of the training documents, those whose counts the weights are fitted to
    rounds: int = 30


def parts_of(doc_ids: pa.Array, lm: Lm) -> np.ndarray:
    """TRAIN, TUNE or HELD of each document; a null id counts as empty text."""
    fold = np.array([zlib.crc32(b"" if d is None else str(d).encode()) % lm.folds for d in doc_ids.to_pylist()], np.int64)
    return np.where(fold == lm.held_fold, HELD, np.where(fold == lm.tune_fold, TUNE, TRAIN))


class Tokens:
    """A piece's tokens: words and an end for each document; its distinct words and bigrams slice by slice."""

    def __init__(self, p: Packed, slices: int) -> None:
        self.end, self.begin = len(p.vocab), len(p.vocab) + 1  # as words of the piece
        self.vocab = np.concatenate([p.vocab, [END_HASH]])
        self.doc = np.repeat(np.arange(p.n_docs), p.n_words + 1)
        self.word = np.full(len(self.doc), self.end, np.int64)
        self.word[np.arange(len(p.ids)) + p.doc] = p.ids
        context = np.empty_like(self.word)
        context[1:] = self.word[:-1]
        context[np.cumsum(p.n_words + 1) - (p.n_words + 1)] = self.begin
        pair, self.pair = np.unique(context * (self.begin + 1) + self.word, return_inverse=True)
        self.pair_context, self.pair_word = pair // (self.begin + 1), pair % (self.begin + 1)
        self.pair_hash = mix(mix(np.append(self.vocab, BEGIN_HASH)[self.pair_context]) + self.vocab[self.pair_word])
        self.word_order, self.word_edges = by_slice(self.vocab, slices)
        self.pair_order, self.pair_edges = by_slice(self.pair_hash, slices)

    def counts(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often each distinct word and bigram is among the chosen tokens, slice by slice."""
        words = np.bincount(self.word[tokens], minlength=len(self.vocab))
        pairs = np.bincount(self.pair[tokens], minlength=len(self.pair_word))
        return words[self.word_order], pairs[self.pair_order]


def asked(pieces: DataFrame, slices: int, lm: Lm) -> DataFrame:
    """What each piece has of each slice's words and bigrams; whole slices meet in a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for i in range(len(rows)):
                p = unpacked(rows, i)
                t, part = Tokens(p, slices), parts_of(p.doc_ids, lm)[:, None]
                (w0, p0), (w1, p1) = (t.counts((part == x)[t.doc, 0]) for x in (TRAIN, TUNE))
                words, pairs = t.vocab[t.word_order].tobytes(), key_bytes(t.pair_hash[t.pair_order], PAIR_BYTES).tobytes()
                we, pe = t.word_edges.tolist(), t.pair_edges.tolist()
                some = np.flatnonzero(np.diff(t.word_edges) + np.diff(t.pair_edges)).tolist()
                cut = lambda x, e: binaries([pack_ints(x[e[s] : e[s + 1]]) for s in some])
                columns = [
                    pa.array(some, pa.int32()),
                    pa.array([p.piece] * len(some), pa.int64()),
                    binaries([words[8 * we[s] : 8 * we[s + 1]] for s in some]),
                    binaries([pairs[PAIR_BYTES * pe[s] : PAIR_BYTES * pe[s + 1]] for s in some]),
                    *(cut(x, e) for x, e in ((w0, we), (w1, we), (p0, pe), (p1, pe))),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["slice", "piece", "words", "pairs", *COUNTS])

    out = pieces.mapInArrow(run, f"slice int, piece bigint, words binary, pairs binary, {', '.join(f'{c} binary' for c in COUNTS)}")
    return out.repartitionById(slices, F.col("slice"))


def answers(questions: DataFrame) -> DataFrame:
    """The corpus counts of all that was asked, in the same order, and each slice's totals in one of its rows.

    A task holds the words and bigrams that the pieces sent to its slices: 8 bytes each and their counts.
    """
    from ._packed import GROUP_PIECES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[int, list[tuple]] = {}
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                by.setdefault(row[0], []).append(row)
        for slice_, rows in by.items():
            out, totals = [], []
            for column, width in ((2, 8), (3, PAIR_BYTES)):
                keys = np.concatenate([keys_of(r[column], width) for r in rows])
                edges = np.cumsum([len(r[column]) // width for r in rows])[:-1]
                _, back = np.unique(keys, return_inverse=True)
                sums = [np.bincount(back, np.concatenate([unpack_ints(r[2 * column + j]) for r in rows])).astype(np.int64) for j in (0, 1)]
                totals.append(sums)
                out += [np.split(x[back] if len(back) else back, edges) for x in sums]
            train, tune = totals[0]
            first = np.zeros((len(rows), 3), np.int64)
            first[0] = int((train + tune > 0).sum()), int((train + tune).sum()), int(train.sum())
            piece = np.array([r[1] for r in rows], np.int64)
            columns = [pa.array(piece // GROUP_PIECES), pa.array(piece), pa.array([slice_] * len(rows), pa.int32()), *(binaries([pack_ints(x) for x in o]) for o in out), *(pa.array(first[:, j]) for j in range(3))]
            yield pa.RecordBatch.from_arrays(columns, ["grp", "piece", "slice", *COUNTS, "types", "tokens", "train_tokens"])

    return questions.mapInArrow(run, f"grp bigint, piece bigint, slice int, {', '.join(f'{c} binary' for c in COUNTS)}, types bigint, tokens bigint, train_tokens bigint")


def _answered(left: pa.Table, right: pa.Table, slices: int) -> Iterator[tuple[Packed, Tokens, list[np.ndarray]]]:
    """Each piece with its tokens and the corpus counts of its distinct words and bigrams."""
    rows = by_piece(right, "slice")
    for i in range(len(left)):
        p = unpacked(left, i)
        t, counts = Tokens(p, slices), []
        for c in COUNTS:
            got = [unpack_ints(right.column(c)[j].as_py()) for j in rows[p.piece]]
            own = np.zeros(sum(map(len, got)), np.int64)
            own[t.word_order if c.startswith("word") else t.pair_order] = np.concatenate(got)
            counts.append(own)
        yield p, t, counts


def _estimates(t: Tokens, words: np.ndarray, pairs: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of the context, P(w | h), P(w)) of each distinct bigram."""
    context = np.append(words, words[t.end])[t.pair_context]  # as many beginnings as ends
    bucket = np.where(context > 0, np.log2(np.maximum(context, 1)).astype(np.int64) + 1, 0)
    return bucket, pairs / np.maximum(context, 1), words[t.pair_word] / max(total, 1)


def tuning_counts(pieces: DataFrame, replies: DataFrame, slices: int, lm: Lm, types: int, train_tokens: int) -> DataFrame:
    """(bucket, r2, r1, n): tuning tokens by context bucket and by how far each estimate is above the uniform one."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        for p, t, (w_train, _, p_train, _) in _answered(left, right, slices):
            n = np.bincount(t.pair[(parts_of(p.doc_ids, lm) == TUNE)[t.doc]], minlength=len(t.pair_word))
            bucket, p2, p1 = (x[n > 0] for x in _estimates(t, w_train, p_train, train_tokens))
            r = [np.where(x > 0, np.round(np.log2(np.maximum(x, 1e-300) * (types + 1)) * STEPS), -9999).astype(np.int64) for x in (p2, p1)]
            key, back = np.unique((bucket * 20_000 + r[0] + 10_000) * 20_000 + r[1] + 10_000, return_inverse=True)
            found.append((key, np.bincount(back, n[n > 0], len(key)).astype(np.int64)))
        key, n = (np.concatenate([f[j] for f in found] or [np.zeros(0, np.int64)]) for j in (0, 1))
        return pa.table({"bucket": key // 400_000_000, "r2": key // 20_000 % 20_000 - 10_000, "r1": key % 20_000 - 10_000, "n": n})

    both = pieces.groupBy("grp").cogroup(replies.groupBy("grp"))
    return both.applyInArrow(run, "bucket bigint, r2 bigint, r1 bigint, n bigint").groupBy("bucket", "r2", "r1").agg(F.sum("n").alias("n"))


def mixture_weights(bucket: np.ndarray, r2: np.ndarray, r1: np.ndarray, n: np.ndarray, rounds: int) -> np.ndarray:
    """Weights (bigram, word, uniform) of every bucket, by expectation-maximisation."""
    out = np.full((66, 3), 1 / 3)
    out[0] = (0.0, 0.9, 0.1)  # an unseen context has no bigrams
    for b in np.unique(bucket):
        own = bucket == b
        ratio = np.stack([np.where(r[own] < -9000, 0.0, 2.0 ** (r[own] / STEPS)) for r in (r2, r1)] + [np.ones(int(own.sum()))])
        w = np.full(3, 1 / 3)
        for _ in range(rounds):
            share = w[:, None] * ratio
            w = (share / share.sum(0) * n[own]).sum(1) + 1e-3
            w /= w.sum()
        out[b] = w
    # a bucket that tuning never met takes the weights of the nearest one below
    met = set(np.unique(bucket).tolist())
    for b in range(1, 66):
        if b not in met and met and b > min(met):
            out[b] = out[b - 1]
    return out


def scores(pieces: DataFrame, replies: DataFrame, slices: int, lm: Lm, types: int, tokens: int, weights: np.ndarray) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, base_score, score) of every row."""
    names = ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]
    kind = pieces.schema["ids"].dataType.elementType

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for p, t, (w_train, w_tune, p_train, p_tune) in _answered(left, right, slices):
            words = w_train + w_tune
            bucket, p2, p1 = _estimates(t, words, p_train + p_tune, tokens)
            w = weights[bucket]
            score = np.log10(w[:, 0] * p2 + w[:, 1] * p1 + w[:, 2] / (types + 1))
            base = np.log10((words + 1.0) / (tokens + types + 1))
            per = lambda values: np.bincount(t.doc, values, p.n_docs)
            held = parts_of(p.doc_ids, lm) == HELD
            columns = [p.doc_ids, pa.array(held), pa.array(p.n_words + 1), pa.array(per((words > 0)[t.word]).astype(np.int64)), pa.array(per(base[t.word])), pa.array(per(score[t.pair]))]
            out.append(pa.RecordBatch.from_arrays(columns, names))
        return pa.Table.from_batches(out)

    both = pieces.groupBy("grp").cogroup(replies.groupBy("grp"))
    return both.applyInArrow(run, f"doc_id {kind.simpleString()}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double")


def scored(docs: DataFrame, lm: Lm = Lm()) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row per document.

    Null, empty and blank texts have the end token only.  A null doc_id counts as empty text when
    folds are dealt.  Rows that repeat are scored each by itself, alike; an empty table gives an
    empty result, and a table without training documents scores by the uniform estimate.  Further
    columns are left aside.
    """
    scratch = Scratch(docs.sparkSession, "lm")
    try:
        return stored(_scored(docs, lm, scratch), "scores")
    finally:
        scratch.remove()


def _scored(docs: DataFrame, lm: Lm, scratch: Scratch) -> DataFrame:
    slices = SLICES_PER_PARTITION * partitions(docs.sparkSession)
    pieces = store_pieces(docs, scratch)
    replies = scratch.stored(answers(asked(pieces, slices, lm)), "replies")
    total = replies.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("types", "tokens", "train_tokens")]).first()
    types, tokens = total["types"], total["tokens"]
    tuning = tuning_counts(pieces, replies, slices, lm, types, total["train_tokens"]).toArrow()  # as many rows as steps, not as tokens
    weights = mixture_weights(*(tuning[c].to_numpy() for c in ("bucket", "r2", "r1", "n")), lm.rounds)
    if not tokens:
        weights[:] = (0.0, 0.0, 1.0)
    out = scores(pieces, replies, slices, lm, types, tokens, weights)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
