"""Line dedup across documents (operator 13), with DataFrame functions only.

Texts are exploded into lines with their positions; the normalised line is hashed and the distinct
documents of each hash are counted.  Lines over the threshold go, except in the last document that
holds them, and the other lines of a text come together again by position.  Line texts are never
shuffled: hashes and positions move, and the texts are cut where they are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import BROADCAST_BYTES, Scratch, ascii_lower, fits, free_name, partitions, stored

WHITE = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class Lines:
    """Which lines go: keys of ``min_chars`` code points or more, found in ``min_docs`` documents or more."""

    min_chars: int = 40
    min_docs: int = 5


def split_lines(text: Column) -> Column:
    """The text at each line feed; null and empty texts are one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_keys(docs: DataFrame, rules: Lines) -> DataFrame:
    """(doc_id, version, pos, h1, h2) of every line that is long enough; h1 and h2 are 128 bits of its key."""
    # outer explode: a plain one adds a filter on the array, which splits the text a second time
    own = docs.select("doc_id", F.xxhash64("text").alias("version"), F.posexplode_outer(split_lines(ascii_lower(F.col("text")))).alias("pos", "line"))
    own = own.withColumn("line", F.btrim("line", F.lit(WHITE))).filter(F.char_length("line") >= rules.min_chars)
    return own.select("doc_id", "version", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("second"), "line").alias("h2"))


def frequent(keys: DataFrame, rules: Lines) -> DataFrame:
    """(h1, h2, last_id): keys over the threshold, and the largest doc_id that holds each.

    Rows without a doc_id count as one document, before all others.
    """
    counted = keys.groupBy("h1", "h2").agg(F.count_distinct("doc_id").alias("n"), F.max(F.col("doc_id").isNull().cast("int")).alias("n_null"), F.max("doc_id").alias("last_id"))
    return counted.filter(F.col("n") + F.col("n_null") >= rules.min_docs).select("h1", "h2", "last_id")


def dropped_lines(docs: DataFrame, rules: Lines, scratch: Scratch, limit: int = BROADCAST_BYTES) -> DataFrame:
    """(own_id, own_version, gone): positions, ascending, of the lines that each text loses.

    Where the frequent keys fit the limit they are broadcast.  Else keys meet by hash and a salt,
    which deals the lines of one key over all partitions; a key is repeated only for salts that it has.
    """
    keys = line_keys(docs, rules)
    many = scratch.stored(frequent(keys, rules), "frequent")
    by = ["h1", "h2"]
    if fits(many, limit):
        many = F.broadcast(many)
    else:
        salt = F.pmod(F.xxhash64("doc_id", "version", "pos"), F.lit(partitions(docs.sparkSession))).cast("int")
        keys = keys.withColumn("salt", salt)
        many = scratch.stored(keys.select("h1", "h2", "salt").distinct().join(many, by), "salted")
        by = [*by, "salt"]
    gone = keys.join(many, by).filter(~F.col("doc_id").eqNullSafe(F.col("last_id")))
    return gone.groupBy(F.col("doc_id").alias("own_id"), F.col("version").alias("own_version")).agg(F.sort_array(F.collect_set("pos")).alias("gone"))


def _without(lines: Column, gone: Column) -> Column:
    """The stretches of ``lines`` between the positions in ``gone``, put together; linear in the lines."""
    edge = lambda i: F.coalesce(F.get(gone, i), F.size(lines))
    after = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(gone, i - 1) + 1)
    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(gone)), lambda i: F.slice(lines, after(i) + 1, edge(i) - after(i))))


def dedup_lines(docs: DataFrame, rules: Lines = Lines(), limit: int = BROADCAST_BYTES) -> DataFrame:
    """The documents with the lines that repeat across documents cut out, and n_lines and n_dropped.

    A line's key is the line without white space at its ends, A-Z lower-cased.  A key of at least
    ``min_chars`` code points in at least ``min_docs`` documents loses all its lines, except those
    in the largest doc_id that holds it; a document that repeats a line within itself counts once.
    A null text stays null and has one empty line.  Rows that share a doc_id are one document: a
    line is kept or cut alike in all of them, and rows without a doc_id are one document before all
    others.  Texts of any length are cut whole.  An empty table gives an empty one.  All columns
    stay; where they have the names of the new ones, those get an underscore before theirs.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    try:
        gone = stored(dropped_lines(docs, rules, scratch, limit), "gone_lines")
    finally:
        scratch.remove()
    gone = F.broadcast(gone) if fits(gone, limit) else gone
    same = docs["doc_id"].eqNullSafe(gone["own_id"]) & (F.xxhash64(docs["text"]) == gone["own_version"])
    n_lines, n_dropped = free_name(docs, "n_lines"), free_name(docs, "n_dropped")
    cut = F.array_join(_without(split_lines(docs["text"]), gone["gone"]), "\n")
    text = F.when(gone["gone"].isNull(), docs["text"]).otherwise(cut)
    columns = [text.alias("text") if c == "text" else docs[c] for c in docs.columns]
    return docs.join(gone, same, "left").select(*columns, F.size(split_lines(docs["text"])).cast("long").alias(n_lines), F.coalesce(F.size(gone["gone"]), F.lit(0)).cast("long").alias(n_dropped))


def line_digest(docs: DataFrame, rules: Lines = Lines()) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) of every row; see ``dedup_lines``."""
    out = dedup_lines(docs.select("doc_id", "text"), rules)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
