"""Line dedup, filter audit and tokenizer alignment against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from postloom.llm import alignment, filter_audit, line_dedup
from postloom.llm._store import Scratch

public_tokenizers = pytest.importorskip("public_tokenizers")
A_FILE, B_FILE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ROW = "doc_id long, text string, source string, gone string, h1 long, n_lines string"
WHITE = " \t\n\x0b\x0c\r"
LONG = [f"This is the boilerplate line number {i} that many sites repeat" for i in range(6)]


def low(x):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x)


def texts():
    r = random.Random(5)
    out = [None, "", "\n", "\n\n", "x" * 39, "é" * 40, " " * 50, "short\nlines\n", "word " * 30_000, "last line without feed"]
    for i in range(60):
        own = [" ".join(r.choices("alpha Beta gamma DELTA épsilon zeta $ eta".split(), k=r.randint(1, 30))) for _ in range(r.randint(0, 6))]
        own += r.choices([x if r.random() < 0.5 else f"  {x.upper()}\t" for x in LONG], k=r.randint(0, 3))
        r.shuffle(own)
        out.append("\n".join(own))
    out += ["é" * 40] * 5 + ["\n".join(LONG * 300)] + out[12:16]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if i % 7 == 0 else f"s{i % 3}", "g", i, "n") for i, t in enumerate(texts())]
    rows += [(None, rows[20][1], "", "g", 0, "n"), (None, LONG[0], "s1", "g", 0, "n"), (None, LONG[0], "s1", "g", 0, "n")]
    rows += [(20, rows[20][1], "s2", "g", 0, "n"), (20, "another text\n" + LONG[1], "s2", "g", 0, "n"), *rows[30:32]]
    return spark.createDataFrame(rows, ROW)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], ROW)


def expected_lines(rows):
    held = defaultdict(set)
    split = [(d, (t or "").split("\n")) for d, t in rows]
    key = lambda x: low(x.strip(WHITE))
    for d, own in split:
        for x in own:
            if len(key(x)) >= 40:
                held[key(x)].add(d)
    last = {k: max(v, key=lambda d: (d is not None, d)) for k, v in held.items() if len(v) >= 5}
    out = []
    for d, own in split:
        kept = [x for x in own if key(x) not in last or last[key(x)] == d]
        out.append((d, len(own), len(own) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("limit", [0, 64_000_000])
def test_line_dedup(docs, empty, limit):
    """Broadcast and salted keys give what brute force gives."""
    want = expected_lines([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert any(n_dropped for _, _, n_dropped, _ in want)
    out = line_dedup.dedup_lines(docs, limit=limit)
    assert out.columns == [*docs.columns, "_n_lines", "n_dropped"]
    got = out.select("doc_id", "_n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"))
    assert Counter(tuple(r) for r in got.collect()) == want
    assert line_dedup.dedup_lines(empty, limit=limit).count() == 0


def test_line_digest_is_native(docs):
    out = line_dedup.line_digest(docs)
    want = expected_lines([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert Counter(tuple(r) for r in out.collect()) == want
    assert not re.search("Python|Pandas|Arrow", out._jdf.queryExecution().executedPlan().toString())


def test_trie_holds_least_ids():
    r = random.Random(1)
    words = ["".join(r.choices("ab", k=r.randint(0, 9))).encode() for _ in range(400)] + [b"a" * 5000, b"a" * 5000 + b"b", b"a" * 4999 + b"c"]
    trie, least = filter_audit.Trie(), {}
    for i, w in enumerate(r.sample(words * 2, len(words) * 2)):
        own = None if i % 50 == 0 else (i * 7919) % 1000
        trie.insert(w, own, i)
        least.setdefault(w, []).append(own)
    assert len(trie.terminals) == len(least)
    want = Counter((min((x for x in v if x is not None), default=None), len(v)) for v in least.values())
    assert Counter((t.least, len(t.members)) for t in trie.terminals) == want


def fails(rows):
    first = {}
    for d, t, *_ in rows:
        if d is not None:
            first[t or ""] = min(d, first.get(t or "", d))
    for d, t, source in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        own = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t))}
        own["E"] = t in first and (d is None or d > first[t])
        yield d, source or "", {k for k, v in own.items() if v}


def expected_audit(rows, labels):
    good, toxic = ({d for d, *x in labels if x[i] == 1 and d is not None} for i in (0, 1))
    out, share = {}, Counter()
    flagged = list(fails(rows))
    for order in map("".join, permutations("ABCDE")):
        for d, part, own in flagged:
            at = min((order.index(f) for f in own), default=9)
            for s, f in enumerate(order):
                c = out.setdefault((part, order, s + 1), Counter())
                c["kept"] += at > s
                c["removed"] += at == s
                c["redundant"] += f in own and at < s
                c["unique_fails"] += own == {f}
                c["good_lost"] += at == s and d in good
                c["toxic_lost"] += at == s and d in toxic
                share[part, f] += at == s
    return {k: tuple(v[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")) + (share[k[0], k[1][k[2] - 1]],) for k, v in out.items()}


@pytest.mark.parametrize("range_bytes", [filter_audit.RANGE_BYTES, 600])
def test_filter_audit(spark, docs, empty, monkeypatch, range_bytes):
    """All orders against brute force; small ranges lengthen prefixes and empty tries on the way."""
    monkeypatch.setattr(filter_audit, "RANGE_BYTES", range_bytes)
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 70, 3)] + [(3, 0, 1), (3, 1, 0), (None, 1, 1), (6, None, None)]
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in filter_audit.audited(docs, table).collect()}
    assert got == expected_audit(rows, labels)
    assert filter_audit.audited(empty, table).count() == 0


def test_copies_by_string_ids(spark):
    rows = [("b", "same"), ("a", "same"), ("c", None), (None, "same"), ("d", ""), ("a", "same")]
    own = spark.createDataFrame([(*r, "s") for r in rows], "doc_id string, text string, source string")
    scratch = Scratch(spark, "audit_test")
    got = Counter((r["doc_id"], r["mask"] >> 4) for r in filter_audit.filter_masks(own, scratch).collect())
    assert got == Counter([("a", 0), ("a", 0), ("b", 1), (None, 1), ("c", 0), ("d", 1)])
    scratch.remove()


def test_prefixes_lengthen_where_they_hold_too_much(spark):
    shared = "p" * 200
    rows = [(i, shared + str(i), 210) for i in range(40)] + [(100 + i, f"{i} text of its own", 20) for i in range(40)]
    scratch = Scratch(spark, "prefix_test")
    got = filter_audit.with_prefix(spark.createDataFrame(rows, "grp long, text string, size long"), scratch, 1000).collect()
    assert {len(r["prefix"]) for r in got if r["grp"] < 100} == {len(shared) + 1, len(shared) + 2}
    assert all(len(r["prefix"]) <= filter_audit.FIRST_PREFIX for r in got if r["grp"] >= 100)
    scratch.remove()


def brute_links(text):
    """(n_a, n_b, groups as text, links) by walking both token lists; None where there are no tokens."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_side = Tokenizer.from_file(A_FILE)
    a_side.encode_special_tokens = True
    b_side = sentencepiece.SentencePieceProcessor(model_file=B_FILE)
    signs = alignment.byte_alphabet()

    def one(t):
        if not t:
            return None
        a, b = a_side.encode(" " + t, add_special_tokens=False).ids, b_side.encode(t)
        raw_a = [bytes(signs[c] for c in a_side.id_to_token(i)) for i in a]
        raw_b = [bytes([int(p[3:5], 16)]) if b_side.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [b_side.id_to_piece(i)]]
        if not b"".join(raw_a) == b"".join(raw_b) == (" " + t).encode():
            return None
        links, groups, x, y = [], [([], [])], 0, 0
        left_a, left_b = len(raw_a[0]), len(raw_b[0])
        while True:
            links.append((a[x], b[y]))
            step = min(left_a, left_b)
            left_a, left_b = left_a - step, left_b - step
            if not left_a:
                groups[-1][0].append(str(a[x]))
            if not left_b:
                groups[-1][1].append(str(b[y]))
            if not left_a and not left_b:
                groups.append(([], []))
            x, y = x + (not left_a), y + (not left_b)
            if x == len(a) and y == len(b):
                break
            left_a, left_b = left_a or len(raw_a[x]), left_b or len(raw_b[y])
        return len(a), len(b), ";".join(f"{','.join(p)}|{','.join(q)}" for p, q in groups[:-1]), links

    return one(text) if isinstance(text, str | None) else [one(t) for t in text]


@pytest.mark.parametrize("unit_bytes", [alignment.UNIT_BYTES, 3000])
def test_alignment(spark, docs, empty, monkeypatch, unit_bytes):
    monkeypatch.setattr(alignment, "UNIT_BYTES", unit_bytes)
    monkeypatch.setattr(alignment, "CHUNK_BYTES", 1000 if unit_bytes < 10_000 else alignment.CHUNK_BYTES)
    odd = [" ", "a", "héllo wörld\n\n 😀 日本語テキスト", "<|endoftext|> <s></s>\x00\x01 ▁ foo", "  lead and trail  ", "﻿BOM ﬁ Å", "▁"]
    own = docs.select("doc_id", "text", "source").unionByName(spark.createDataFrame([(1000 + i, t, "o") for i, t in enumerate(odd)], "doc_id long, text string, source string"))
    rows = [(r["doc_id"], r["text"]) for r in own.collect()]
    each = brute_links([t for _, t in rows])
    n = Counter(p for x in each if x for p in x[3])
    most = Counter()
    for (_, b), k in n.items():
        most[b] = max(most[b], k)
    want = Counter()
    for (d, _), x in zip(rows, each, strict=True):
        if x is None:
            want[d, 0, 0, 0, 0, 0, 0, ""] += 1
        else:
            want[d, x[0], x[1], x[2].count(";") + 1, len(x[3]), sum(n[p] == most[p[1]] for p in x[3]), sum(n[p] for p in x[3]), hashlib.sha256(x[2].encode()).hexdigest()] += 1
    assert sum(x is None for x in each) > 3
    got = alignment.align_tokenizers(own, A_FILE, B_FILE)
    assert Counter(tuple(r) for r in got.documents.collect()) == want
    assert {(r["a_id"], r["b_id"]): (r["n"], r["best"]) for r in got.pairs.collect()} == {p: (k, k == most[p[1]]) for p, k in n.items()}
    none = alignment.align_tokenizers(empty, A_FILE, B_FILE)
    assert none.documents.count() == none.pairs.count() == 0


def test_parts_are_encoded_like_whole_texts():
    """Texts cut at lone spaces, with white space of all kinds around them."""
    r = random.Random(11)
    signs = ["a", "Wort", "é", "ß", "日本", "1", "22", "'s", "'", ".", "...", " ", " ", " ", "  ", "\n", "\t", "\xa0", "\u3000", "\x85", "\x00", "😀", "_", "<|endoftext|>"]
    own = ["".join(r.choices(signs, k=r.randint(1, 40))) for _ in range(3000)] + ["a", "", " ", "a b"]
    encode, _ = alignment.byte_level(A_FILE)
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(A_FILE)
    whole.encode_special_tokens = True
    assert encode([" " + t for t in own]).to_pylist() == [e.ids for e in whole.encode_batch([" " + t for t in own], add_special_tokens=False)]
