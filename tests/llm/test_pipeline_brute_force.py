"""The whole pipeline on a small table, row by row, against plain Python."""

from __future__ import annotations

import hashlib
import heapq
import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
from test_brute_force import filled_targets, low, shingles

from postloom.llm.mixing import Mix
from postloom.llm.quality import Rules


def words(t):
    return (t or "").encode().split()


def quality(docs):
    rules, hosts, held = Rules(), defaultdict(set), defaultdict(set)
    norm = lambda line: b" ".join(low(line.decode()).encode().split())
    for _, t, source in docs:
        hosts[source].add(t or "")
        for line in (t or "").encode().split(b"\n"):
            if line.split():
                held[source, norm(line)].add(t or "")
    bad = {k for k, v in held.items() if len(v) > rules.line_docs and len(v) * 100 > len(hosts[k[0]]) * rules.line_percent}
    for d, t, source in docs:
        w = words(t)
        runs = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        repeated = {i + j for i in range(len(w) - 4) if runs[tuple(w[i : i + 5])] > 1 for j in range(5)}
        lines = (t or "").encode().split(b"\n")
        left = [x for x in lines if (source, norm(x)) not in bad]
        n = len(b" ".join(left).split())
        depleted = len(left) < len(lines) and (n < rules.min_words or n * 100 < len(w) * rules.left_percent)
        if len(w) >= rules.min_words and 100 * len(repeated) <= rules.max_repeat_percent * len(w) and not depleted:
            yield d, b"\n".join(left).decode(), source


def one_of_each(docs):
    sets = {d: shingles(t) for d, t, _ in docs}
    first, rows = {d: d for d in sets}, sorted(sets)
    links = [(a, b) for i, a in enumerate(rows) for b in rows[i + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    while any(first[a] != first[b] for a, b in links):
        for a, b in links:
            first[a] = first[b] = min(first[a], first[b])
    return [x for x in docs if first[x[0]] == x[0]]


def clean(docs, items):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t or ""))
    windows = defaultdict(set)
    for t in items:
        w = cut(t)
        n = min(len(w), 10)
        if n:
            windows[n] |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    for d, t, source in docs:
        w = cut(t)
        if not any(tuple(w[i : i + n]) in own for n, own in windows.items() for i in range(len(w) - n + 1)):
            yield d, t, source


def mixed(docs):
    mix, sizes, by = Mix(), defaultdict(int), defaultdict(list)
    for d, t, source in docs:
        sizes[source] += len(words(t))
        by[source].append((hashlib.md5(f"{mix.seed}:{d}".encode()).hexdigest(), d, t))
    for source, target in filled_targets(dict(sizes), mix).items():
        flow = min(mix.max_passes * sizes[source], int(target))
        passes, extra = divmod(flow, sizes[source]) if sizes[source] else (0, 0)
        until = 0
        for _, d, t in sorted(by[source]):
            n = len(words(t))
            until += n
            times = passes + (extra > 0 and 2 * until - n <= 2 * extra)
            yield from [(d, t, source)] * (times if n else 0)


def shards(docs):
    slot = lambda d, t: int(hashlib.md5(f"{d}:{zlib.crc32(t.encode())}".encode()).hexdigest()[:8], 16) % 4096
    load = Counter()
    for d, t, _ in docs:
        load[slot(d, t)] += len(t.encode()) + 1
    heap, owner = [(0, s) for s in range(8)], {}
    for s in sorted(range(4096), key=lambda s: (-load[s], s)):
        held, shard = heapq.heappop(heap)
        owner[s] = shard
        heapq.heappush(heap, (held + load[s], shard))
    return Counter((d, t, slot(d, t), owner[slot(d, t)]) for d, t, _ in docs)


def test_pipeline_equals_brute_force(spark, sf):
    docs = [(r["doc_id"], r["text"], r["source"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    kept = list(quality(docs))
    one = one_of_each(kept)
    fine = list(clean(one, items))
    assert len(docs) > len(kept) > len(one) > len(fine) > 0
    want = shards(list(mixed(fine)))
    got = Counter((r["doc_id"], r["text"], r["virtual_slot"], r["shard"]) for r in corpus_pipeline.run(spark, sf).collect())
    assert got == want
