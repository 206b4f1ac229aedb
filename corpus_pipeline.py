"""Corpus pipeline: quality rules, near-duplicate join, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; ``run``
writes every stage's result as Parquet into the shared folder and reads it again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from postloom.llm._store import fits, free_name, stored
from postloom.llm.decontaminate import clean_documents
from postloom.llm.jaccard import jaccard_components
from postloom.llm.mixing import mix_documents
from postloom.llm.quality import quality_filter
from postloom.llm.sharding import shard_documents


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, without boilerplate lines; n_chars follows the text.

    Null, empty and short texts fail.  Rows that repeat, share an id or have none are judged each by
    itself, alike; a null source is a host of its own.  An empty table gives an empty one.
    """
    return quality_filter(docs).withColumn("n_chars", F.char_length("text").cast("long"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents: the one with the least doc_id.

    Rows without an id, or with one that repeats, are told apart by their text; an id goes before
    none.  Of rows alike in both, one stays.  Texts without words link with nothing, so all their
    rows with ids of their own stay, as do null texts.  An empty table gives an empty one; columns
    may be of any type.
    """
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64("text").alias("version"))
    linked = jaccard_components(docs.select(key.alias("doc_id"), "text"))
    seen = linked.groupBy("doc_id").agg(F.bool_or(F.col("doc_id") != F.col("component_id")).alias("copy"), F.count("*").alias("n"))
    odd = seen.filter("copy or n > 1").select(F.col("doc_id.doc_id").alias("odd_id"), F.col("doc_id.version").alias("odd_version"), "copy")
    odd = stored(odd, "copies")
    odd = F.broadcast(odd) if fits(odd) else odd
    same = docs["doc_id"].eqNullSafe(odd["odd_id"]) & (F.xxhash64(docs["text"]) == odd["odd_version"])
    alone = docs.join(odd, same, "left_anti")
    repeats = docs.join(odd.filter("not copy"), same, "left_semi")
    # rows that repeat may differ in other columns: the least of them, written as text, stays
    number = free_name(docs, "n")
    by = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy(F.to_json(F.struct(*[F.col(c) for c in docs.columns if c not in ("doc_id", "text")])), "text")
    return alone.unionByName(repeats.withColumn(number, F.row_number().over(by)).filter(F.col(number) == 1).drop(number))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window with the benchmark.

    Null and empty texts have no window and stay, rows without an id too; rows that repeat stay or
    go together.  An empty table gives an empty one, an empty benchmark keeps all.
    """
    return clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the target weights ask for, repeats included.

    Texts without words, null ones too, are never taken.  Rows that share an id and source, or have
    none, are taken equally often; a null source is a source of its own.  An empty table gives an
    empty one.
    """
    return mix_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their virtual slot and shard.

    A null text has no bytes; rows that share an id, or have none, are spread by their texts, rows
    alike share a slot.  An empty table gives an empty one.
    """
    return shard_documents(docs)


STAGES = [
    ("quality_rules", quality),
    ("ngram_jaccard", near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix),
    ("sharding", shard),
]
ORACLE_SQL = None  # the closure of the near-duplicate links has no SQL form on whole tables


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
