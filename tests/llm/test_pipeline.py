from __future__ import annotations

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from postloom.llm import decontaminate, jaccard, quality
from postloom.llm.queries import ORACLE_SQL, QUERIES

TABLES = "documents embeddings pages benchmark labels conversations".split()


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple("NULL" if pd.isna(v) else str(v) for v in r) for r in df.astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    assert rows(QUERIES[name](spark, sf).toPandas()) == rows(con.execute(ORACLE_SQL[name]).df())


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").cache()
    quality, near, clean, mix, shard = (f for _, f in corpus_pipeline.STAGES)
    kept = quality(spark, docs, sf)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    one = near(spark, docs, sf)
    assert one.columns == docs.columns
    twice = docs.unionByName(docs.selectExpr("doc_id + 100000 doc_id", "text", "lang", "source", "n_chars"))
    assert {r["doc_id"] for r in near(spark, twice, sf).select("doc_id").collect() if r["doc_id"] >= 100000} <= {r["doc_id"] + 100000 for r in docs.filter("trim(text) = ''").collect()}
    assert clean(spark, docs, sf).columns == docs.columns
    mixed = mix(spark, docs, sf)
    assert mixed.columns == docs.columns and max(r["count"] for r in mixed.groupBy("doc_id").count().collect()) <= 2
    out = shard(spark, docs, sf)
    assert out.count() == docs.count() and set(docs.columns) < set(out.columns)


def test_rows_without_id_are_judged_apart(spark):
    words = lambda a, n=40: " ".join(f"{a}word{i}" for i in range(n))
    rows = [(None, "few words", "s"), (None, words("a"), "s"), (None, words("b"), "s"), (None, words("c"), "s"), (5, words("a"), "s"), (6, words("d"), "s"), (6, "short", "s"), (6, "", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = lambda df: sorted((r["doc_id"] or 0, r["text"]) for r in df.collect())
    kept = quality.quality_filter(docs)
    assert out(kept) == sorted((i or 0, t) for i, t, _ in rows if len(t.split()) > 9)
    one = corpus_pipeline.near_duplicates(spark, kept, "")
    assert out(one) == sorted([(0, words("b")), (0, words("c")), (5, words("a")), (6, words("d"))])
    bench = spark.createDataFrame([(1, words("b"))], "item_id long, text string")
    assert out(decontaminate.clean_documents(one, bench)) == sorted([(0, words("c")), (5, words("a")), (6, words("d"))])
    near = spark.createDataFrame([(None, words("a")), (None, words("a") + " more"), (7, words("e"))], "doc_id long, text string")
    assert jaccard.jaccard_components(near).count() == 3


def test_registered():
    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))


def test_stages_on_odd_tables(spark, sf):
    """Nulls in any column, repeats, one id with two texts, long texts and columns named as the stages name their own."""
    words = lambda a, n=40: " ".join(f"{a}word{i}" for i in range(n))
    more = ["kept", "removed", "judged", "times", "pass", "shard", "virtual_slot", "n", "odd_id", "taken_id", "copy", "dirty_id", "map_slot"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in more)
    rows = [(1, words("a")), (1, words("b")), (2, words("c")), (2, words("c")), (None, words("d")), (None, words("d")), (None, None), (3, None), (4, ""), (5, "short"), (6, words("e", 30_000)), (7, words("a"))]
    full = [(i, t, None if k % 2 else "en", None if k % 3 else "s", None, *[f"{c}{k}" for c in more]) for k, (i, t) in enumerate(rows)]
    docs = spark.createDataFrame(full, schema)
    left = {"quality_rules": {(1, "a"), (1, "b"), (2, "c"), (-1, "d"), (6, "e"), (7, "a")}, "ngram_jaccard": {(1, "a"), (1, "b"), (2, "c"), (-1, "d"), (6, "e")}}
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, docs.limit(0), sf)
        assert empty.count() == 0 and set(docs.columns) <= set(empty.columns)
        before = docs
        docs = stage(spark, docs, sf)
        if name != "sharding":
            assert docs.columns == before.columns
        got = docs.collect()
        if name in left:
            assert {(-1 if r["doc_id"] is None else r["doc_id"], r["text"][0]) for r in got} == left[name]
        if name == "ngram_jaccard":
            assert len(got) == 5  # of rows that repeat one stays
        by_text = {r[1]: r for r in full}
        assert all(r["lang"] in (None, "en") and r["kept"].startswith("kept") and r["pass"].startswith("pass") and r["text"] in by_text for r in got)
    assert {"_shard", "_virtual_slot"} <= set(docs.columns)
