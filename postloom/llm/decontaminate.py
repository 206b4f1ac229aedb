"""Benchmark decontamination by winnowing (operator 1), with DataFrame functions only.

Words are hashed, every run of five words gets a hash, and of any six consecutive runs (ten
words) the least is kept as a fingerprint.  A stretch of ten words that document and benchmark
share has the same least run on both sides, so joining fingerprints finds every such stretch; the
words around each hit are then compared as text, window by window.
Items shorter than a window are one window of their own length, fingerprinted by its hash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import BROADCAST_BYTES, ascii_lower, small_enough, stored

WINDOW = 10
GRAM = 5
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Runs of digits, a-z and all beyond ASCII in the lower-cased text; null gives none."""
    return F.array_remove(F.split(F.coalesce(ascii_lower(text), F.lit("")), BREAK), "")


def _span(first: Column | int, count: Column) -> Column:
    """first, first + 1, ... (count of them, perhaps none)."""
    first = F.lit(first) if isinstance(first, int) else first
    return F.when(count > 0, F.sequence(first, first + count - 1)).otherwise(F.array().cast("array<int>"))


def _short_mark(mark: Callable, n: int) -> Callable[[Column], Column]:
    return lambda i: mark(F.xxhash64(F.lit(n), *[F.get("hashes", i + j) for j in range(n)]), i, i + 1, n)


def fingerprints(df: DataFrame, short: list[int], window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Adds n_words, least (least run of each window) and marks.

    A mark (fp, at, stop, n) says that the windows of n words which begin in [at, stop) have
    fingerprint fp.  ``short`` lists the window lengths below ``window`` to mark as well.
    """
    df = df.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w))).withColumn("n_words", F.size("words"))
    runs = F.transform(_span(0, F.col("n_words") - gram + 1), lambda i: F.xxhash64(*[F.get("hashes", i + j) for j in range(gram)]))
    df = df.withColumn("runs", runs)
    wide = window - gram + 1
    least = F.transform(_span(0, F.col("n_words") - window + 1), lambda i: F.least(*[F.get("runs", i + j) for j in range(wide)]))
    df = df.withColumn("least", least)
    heads = F.filter(_span(0, F.size("least")), lambda i: (i == 0) | (F.get("least", i) != F.get("least", i - 1)))
    df = df.withColumn("heads", heads)
    mark = lambda fp, at, stop, n: F.struct(fp.alias("fp"), at.cast("int").alias("at"), stop.cast("int").alias("stop"), F.lit(n).alias("n"))
    marks = F.transform("heads", lambda h, j: mark(F.get("least", h), h, F.coalesce(F.get("heads", j + 1), F.size("least")), window))
    for n in short:
        marks = F.concat(marks, F.transform(_span(0, F.col("n_words") - n + 1), _short_mark(mark, n)))
    return df.withColumn("marks", marks).drop("hashes", "runs", "least", "heads")


def benchmark_windows(benchmark: DataFrame, short: list[int], window: int = WINDOW, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """(fp) and (content, items): the fingerprints, and each window's text with its items."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text")).alias("words"))
    marked = fingerprints(items, short, window, gram)
    size = F.least(F.col("n_words"), F.lit(window))
    marked = marked.filter("n_words > 0").withColumn("marks", F.filter("marks", lambda m: m["n"] == size))
    # outer explodes: a plain one adds a filter on the array, which is pushed below all that makes it
    fps = marked.select(F.explode_outer("marks.fp").alias("fp")).filter("fp is not null").distinct()
    texts = F.transform(_span(1, F.col("n_words") - size + 1), lambda i: F.array_join(F.slice("words", i, size), " "))
    content = marked.select("item_id", F.explode_outer(texts).alias("content")).filter("content is not null").groupBy("content").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    return fps, content


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated), one row per document.

    A document word is hit when it lies in a stretch that equals ``window`` consecutive words of
    an item, or a whole shorter item.  Null, empty and symbol-only texts have no words and are
    clean; such items have no window; an empty benchmark leaves all clean, empty documents give an
    empty result.  A null item_id is no item.  Rows that repeat both doc_id and text come back
    once; rows that share a doc_id but not the text stay apart.  Further columns are left aside.
    """
    return hits(docs, benchmark, window, gram).drop("version")


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``contamination`` with the version of each text: rows that repeat a doc_id (or have none) are kept apart."""
    benchmark = benchmark.filter("item_id is not null").select("item_id", "text")
    count = F.size(words_of(F.col("text")))
    known = benchmark.agg(F.collect_set(F.when((count > 0) & (count < window), count)).alias("short"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("size")).first()
    short = sorted(known["short"])
    fps, content = benchmark_windows(benchmark, short, window, gram)
    if known["size"] * window <= BROADCAST_BYTES:  # each word is in so many windows at most
        fps, content = F.broadcast(fps), F.broadcast(content)

    own = docs.select("doc_id", F.xxhash64("text").alias("version"), words_of(F.col("text")).alias("words"))
    marked = fingerprints(own, short, window, gram)
    each = marked.select("doc_id", "version", "n_words", F.posexplode_outer("marks").alias("j", "mark"))
    each = each.select("doc_id", "version", "n_words", "j", F.col("mark.fp").alias("fp"), F.struct("mark.at", "mark.stop", "mark.n").alias("span"))
    hit = each.join(fps.withColumn("known", F.lit(True)), "fp", "left").filter("known or j is null or j = 0")
    # every document keeps its first row, so that clean ones come out too
    by_doc = hit.groupBy("doc_id", "version", "n_words").agg(F.collect_set(F.when(F.col("known"), F.col("span"))).alias("spans"))
    by_doc = stored(by_doc, "spans")

    # only texts with a known fingerprint are read again, and only their windows move on
    possible = by_doc.filter(F.size("spans") > 0).select(F.col("doc_id").alias("own_id"), F.col("version").alias("own_version"), "spans")
    size = possible.agg(F.coalesce(F.sum(F.size("spans") * 24 + 80), F.lit(0))).first()[0]
    possible = F.broadcast(possible) if size <= BROADCAST_BYTES else possible
    same = docs["doc_id"].eqNullSafe(possible["own_id"]) & (F.xxhash64(docs["text"]) == possible["own_version"])
    texts = docs.join(possible, same).select("own_id", "own_version", "spans", words_of(docs["text"]).alias("words"))
    window_at = lambda s, i: F.struct(i.alias("i"), s["n"].alias("n"), F.array_join(F.slice("words", i + 1, s["n"]), " ").alias("content"))
    all_ = F.flatten(F.transform("spans", lambda s: F.transform(_span(s["at"], s["stop"] - s["at"]), lambda i: window_at(s, i))))
    windows = texts.select("own_id", "own_version", F.explode_outer(all_).alias("w")).select("own_id", "own_version", "w.i", "w.n", "w.content")
    found = windows.join(content, "content")
    found = found.groupBy("own_id", "own_version").agg(F.collect_set(F.struct("i", "n")).alias("spots"), F.collect_set("items").alias("item_sets"))
    covered = F.array_distinct(F.flatten(F.transform("spots", lambda s: F.sequence(s["i"], s["i"] + s["n"] - 1))))
    found = found.select("own_id", "own_version", F.size(covered).cast("long").alias("hit_words"), F.sort_array(F.array_distinct(F.flatten("item_sets"))).alias("found_items"))
    same = by_doc["doc_id"].eqNullSafe(found["own_id"]) & (by_doc["version"] == found["own_version"])
    by_doc = by_doc.join(found, same, "left").withColumn("n_hit", F.coalesce("hit_words", F.lit(0)).cast("long")).withColumn("items", F.coalesce("found_items", F.array().cast("array<string>")))
    return by_doc.select(
        "doc_id",
        "version",
        F.col("n_words").cast("long").alias("n_words"),
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a hit word, all columns as they are (rows with a null doc_id too)."""
    dirty = hits(docs, benchmark).filter("contaminated").select(F.col("doc_id").alias("dirty_id"), F.col("version").alias("dirty_version")).distinct()
    dirty = small_enough(stored(dirty, "dirty"), 24)
    return docs.join(dirty, docs["doc_id"].eqNullSafe(dirty["dirty_id"]) & (F.xxhash64(docs["text"]) == dirty["dirty_version"]), "left_anti")
