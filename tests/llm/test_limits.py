"""What the operators do beyond their former limits."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from postloom.llm import mixing, passages, token_files

from test_brute_force import filled_targets

public_tokenizers = pytest.importorskip("public_tokenizers")


def test_twenty_thousand_sources(spark):
    """Sources that share no document need no flow network, however many they are."""
    n = 20_100
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.format_string("host%05d", F.col("id")).alias("source"), F.repeat(F.lit("word "), (F.col("id") % 7).cast("int")).alias("text"))
    got = mixing.mixed(docs, F.array("source")).select("doc_id", "size", "target", "taken").collect()
    want = filled_targets({f"host{i:05d}": i % 7 for i in range(n)}, mixing.Mix())
    assert len(got) == n and all(abs(r["target"] - want[f"host{r['doc_id']:05d}"]) < 1e-6 and r["taken"] in (0, r["size"], 2 * r["size"]) for r in got)
    assert all(abs(r["taken"] - r["target"]) <= r["size"] for r in got)


def test_overlapping_sources_beside_single_ones(spark):
    """The plan of patterns is that of one network over all of them."""
    r = random.Random(4)
    names = [f"s{i}" for i in range(9)]
    patterns = {tuple(sorted(r.sample(names[:5], r.randint(1, 3)))): r.randint(0, 90) for _ in range(12)} | {(s,): r.randint(0, 90) for s in names}
    rows = [(str(p), list(p), n) for p, n in patterns.items()]
    got = {x["pattern"]: x for x in mixing.pattern_plan(spark.createDataFrame(rows, "pattern string, sources array<string>, size long"), mixing.Mix()).collect()}
    sizes = defaultdict(int)
    for p, n in patterns.items():
        for s in p:
            sizes[s] += n
    quotas = filled_targets(dict(sizes), mixing.Mix(), sum(patterns.values()))
    flow = mixing.route(patterns, quotas, 2)
    assert sum(x["passes"] * patterns[p] + x["extra"] for p, x in ((p, got[str(p)]) for p in patterns)) == sum(flow.values())
    for p in patterns:
        if len(p) == 1 and p[0] in names[5:]:
            assert got[str(p)]["passes"] * patterns[p] + got[str(p)]["extra"] == flow[p] and abs(got[str(p)]["target"] - quotas[p[0]]) < 1e-9


def test_rows_without_an_id_share_a_key(spark):
    docs = spark.range(2000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("s").alias("source"), F.lit("a b c").alias("text"))
    got = mixing.mixed(docs, F.array("source"))
    assert got.count() == 2000 and got.select("taken").distinct().count() == 1


def test_token_files_hold_all_that_their_reader_needs(spark):
    path = f"{spark.conf.get('spark.checkpoint.dir')}/tokens-{random.getrandbits(60)}"
    docs = spark.createDataFrame([(i, f"some words number {i}") for i in range(20)] + [(None, None)], "doc_id long, text string")
    token_files.write_tokens(docs, path, public_tokenizers.path("word_bpe_49k.json"), 2)
    got = token_files.read_tokens(spark, path).collect()
    assert len(got) == 21 and {r["start"] for r in got if r["doc_id"] is None} == {0}
    with pytest.raises(ValueError, match="whole number"):
        token_files.token_files(docs.withColumn("doc_id", F.lit("x")), public_tokenizers.path("word_bpe_49k.json"), 2)


def test_fuzzy_passages_with_every_seventh_word_changed(spark):
    """Passages of 100 words, one in seven of them changed: nine in ten are found at least."""
    r = random.Random(12)
    word = lambda: "".join(r.choices("abcdefghijklmnop", k=6))
    rows, pairs = [], 40
    for i in range(pairs):
        own = [word() for _ in range(100)]
        other = [word() if j % 7 == 3 else w for j, w in enumerate(own)]
        for k, body in enumerate((own, other)):
            rows.append((2 * i + k, " ".join([word() for _ in range(60)] + body + [word() for _ in range(60)])))
    out = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    linked = {frozenset((x["doc_id"], x["rep_doc_id"])) for x in out}
    assert sum(frozenset((2 * i, 2 * i + 1)) in linked for i in range(pairs)) >= 0.9 * pairs
