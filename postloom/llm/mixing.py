"""Mixing sources to target weights by min-cost flow (operator 3).

Documents are aggregated by membership pattern (the set of sources they belong to).  A flow
network routes words from patterns to source quotas; a pattern's first pass over its documents is
free and each further pass costs more, so the flow repeats as little as it can.  Only sources that
share documents with others need the network; the rest, of any number, stay a Spark table, in which
a source's flow is its quota or what its passes hold.  The flow into a
pattern says how often its documents are taken: all of them so many times, and a seeded part of
them once more.  That part is the documents with the least md5 of seed and doc_id; its edge is
found by two rounds of counting by md5 prefix and a sorted remainder, so no task ever holds the
documents of a pattern.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._store import fits, free_name, partitions, small_enough, stored

WORD = r"[^\x20\x09-\x0D]+"
SEED = "mix-1"
MAX_PATTERNS = 200_000  # patterns of several sources in the flow network; more are refused, not dropped


@dataclass(frozen=True)
class Mix:
    weights: tuple[int, ...] = (3, 1, 2)
    share_percent: int = 150
    max_passes: int = 2
    seed: str = SEED


def size_of(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def source_quotas(by_source: DataFrame, total: int, mix: Mix) -> DataFrame:
    """(source, source_size, target): each source's quota: its weight's share of all, at most ``max_passes`` times its size.

    ``by_source``: source, source_size, a row each.  ``total``: words of all documents, less than the
    sum of the sizes where sources overlap.  Weights follow the order of the sources, nulls last:
    they are ranked by sorted ranges.  The share of a weight rises from step to step, as sources
    that it fills are left aside, until it fills no more; a step sums two columns.
    """
    spark = by_source.sparkSession
    ordered = by_source.withColumn("none", F.col("source").isNull()).repartitionByRange(partitions(spark), "none", "source").withColumn("part", F.spark_partition_id())
    ordered = stored(ordered, "sources")
    before, seen = [], 0
    for r in ordered.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect():  # a row a partition
        before.append((r["part"], seen))
        seen += r["n"]
    own = ordered.join(F.broadcast(spark.createDataFrame(before, "part int, before long")), "part")
    rank = F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy("none", "source")) - 1
    weight = F.get(F.lit(list(mix.weights)), (rank % len(mix.weights)).cast("int"))
    own = stored(own.select("source", "source_size", weight.cast("long").alias("weight")), "weights")
    full = F.col("source_size") * mix.max_passes
    ratio = full.cast("double") / F.col("weight")
    words, weights, filled = total * mix.share_percent / 100, own.agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0], -1
    left, open_ = words, weights
    while open_:
        r = own.filter(ratio < left / open_).agg(F.count("*").alias("n"), F.coalesce(F.sum(full), F.lit(0)).alias("full"), F.coalesce(F.sum("weight"), F.lit(0)).alias("weight")).first()
        if r["n"] == filled:
            break
        filled, left, open_ = r["n"], words - r["full"], weights - r["weight"]
    target = full.cast("double") if not open_ else F.when(ratio < left / open_, full.cast("double")).otherwise(F.lit(float(left)) * F.col("weight") / F.lit(open_))
    return own.select("source", "source_size", target.alias("target"))


def route(patterns: dict[tuple, int], quotas: dict[str | None, float], passes: int) -> dict[tuple, int]:
    """Words to take of each pattern: a maximum flow of least repetition cost.

    Arcs run from the origin to a pattern once for each pass (capacity its size, cost the number
    of passes before), from a pattern to its sources and from a source to the end (its quota).
    All cheapest augmenting paths of one cost level are those of one pass, as only the pass arcs
    cost something and an augmentation never gives up a cheaper one.

    A path is searched over sources: one source leads to another by a pattern that has both and
    sends words to the first.  Sources from which no quota can be reached stay so, and are left
    aside from then on, so a search that finds nothing happens at most once for each source.
    """
    quota = {s: int(q) for s, q in quotas.items()}
    flow: dict[tuple, dict] = {p: {} for p in patterns}
    by: dict = {}  # by[s][t]: patterns of both s and t that send words to s
    dead: set = set()

    def add(p: tuple, s: str | None, words: int) -> None:
        old = flow[p].get(s, 0)
        flow[p][s] = old + words
        if (old > 0) != (old + words > 0):
            for t in p:
                if t != s:
                    own = by.setdefault(s, {}).setdefault(t, {})
                    if old + words > 0:
                        own[p] = None
                    else:
                        own.pop(p, None)

    def path(p: tuple) -> list | None:
        """Sources from one of ``p`` to one with a quota left, and the patterns between them."""
        came: dict = {s: None for s in p if s not in dead}
        queue = deque(came)
        while queue:
            s = queue.popleft()
            if quota[s] > 0:
                out = [s]
                while came[out[-1]] is not None:
                    out.append(came[out[-1]])
                return out[::-1]
            for t, own in by.get(s, {}).items():
                if own and t not in came and t not in dead:
                    came[t] = s
                    queue.append(t)
        dead.update(came)
        return None

    order = sorted(patterns, key=lambda p: (len(p), [(s is None, s or "") for s in p]))
    for _ in range(passes):
        for p in order:
            left = patterns[p]
            while left and (found := path(p)) is not None:
                hops = [(s, t, next(iter(by[s][t]))) for s, t in zip(found, found[1:], strict=False)]
                amount = min([left, quota[found[-1]], *(flow[q][s] for s, _, q in hops)])
                add(p, found[0], amount)
                for s, t, q in hops:
                    add(q, s, -amount)
                    add(q, t, amount)
                quota[found[-1]] -= amount
                left -= amount
    return {p: sum(f.values()) for p, f in flow.items()}


def seeded_edges(docs: DataFrame, parts: DataFrame) -> DataFrame:
    """(pattern, edge): the last (md5, size) key that the extra pass takes, for each pattern.

    ``docs`` has pattern, size, key; ``parts`` has pattern, extra (words of the extra pass).
    A document is taken while the words before it are fewer than extra by half its size or more.
    """
    edge = parts.withColumn("before", F.lit(0).cast("long")).withColumn("prefix", F.lit(""))
    for digits in (3, 6):
        bucket = F.substring("key", 1, digits)
        own = docs.join(_small(edge), "pattern").filter(F.col("key").startswith(F.col("prefix")))
        sums = own.groupBy("pattern", bucket.alias("bucket"), "extra", "before").agg(F.sum("size").alias("words"))
        w = Window.partitionBy("pattern").orderBy("bucket")
        sums = sums.withColumn("until", F.col("before") + F.sum("words").over(w))
        # the bucket in which the sum passes extra, else the last one
        sums = sums.withColumn("rank", F.row_number().over(Window.partitionBy("pattern").orderBy((F.col("until") < F.col("extra")), F.when(F.col("until") < F.col("extra"), -F.col("until")).otherwise(F.col("until")), "bucket")))
        edge = stored(sums.filter("rank = 1").select("pattern", "extra", (F.col("until") - F.col("words")).alias("before"), F.col("bucket").alias("prefix")), "edge")
    own = docs.join(_small(edge), "pattern").filter(F.col("key").startswith(F.col("prefix")))
    # rows of one key, such as those without an id, are one row here, however many they are
    own = own.groupBy("pattern", "key", "extra", "before").agg(F.sum("size").alias("words"), F.max("size").alias("size"))
    w = Window.partitionBy("pattern").orderBy("key")
    own = own.withColumn("until", F.col("before") + F.sum("words").over(w))
    last = own.filter(F.col("until") * 2 - F.col("size") <= F.col("extra") * 2).groupBy("pattern").agg(F.max("key").alias("edge"))
    return edge.select("pattern", "prefix").join(last, "pattern", "left").select("pattern", F.coalesce("edge", "prefix").alias("edge"))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if fits(df) else df


def pattern_plan(patterns: DataFrame, mix: Mix) -> DataFrame:
    """(pattern, source_size, target, passes, extra): how often each pattern's documents are taken, and how many words once more.

    ``patterns``: pattern, sources, size, a row each.
    """
    spark = patterns.sparkSession
    total = patterns.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    by_source = patterns.select(F.explode("sources").alias("source"), "size").groupBy("source").agg(F.sum("size").alias("source_size"))
    quotas = stored(source_quotas(by_source, total, mix), "quotas")
    first = patterns.withColumn("source", F.col("sources")[0]).withColumn("many", F.size("sources"))
    own = first.join(quotas.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")) & (F.col("many") > 0), "left")
    flow = F.when(F.col("many") > 0, F.least(F.col("size") * mix.max_passes, F.floor("target").cast("long"))).otherwise(0)
    shared = patterns.filter(F.size("sources") > 1)
    if not shared.isEmpty():
        found = shared.limit(MAX_PATTERNS + 1).collect()
        if len(found) > MAX_PATTERNS:
            raise ValueError(f"more than {MAX_PATTERNS} patterns of several sources: aggregate sources first")
        met = spark.createDataFrame([(x,) for x in {x for r in found for x in r["sources"]}], "_met string")
        mine = quotas.join(F.broadcast(met), F.col("source").eqNullSafe(F.col("_met"))).collect()  # sources of the patterns found
        alone = patterns.filter(F.size("sources") == 1).withColumn("source", F.col("sources")[0]).join(F.broadcast(met), F.col("source").eqNullSafe(F.col("_met"))).collect()
        routed = route({tuple(r["sources"]): r["size"] for r in [*found, *alone]}, {r["source"]: r["target"] for r in mine}, mix.max_passes)
        rows = [(r["pattern"], routed[tuple(r["sources"])]) for r in [*found, *alone]]
        own = own.join(_small(spark.createDataFrame(rows, "pattern string, routed long")), "pattern", "left")
        flow = F.coalesce("routed", flow)
    own = own.withColumn("flow", flow)
    passes = F.when(F.col("size") > 0, F.least(F.lit(mix.max_passes), F.floor(F.col("flow") / F.col("size")))).otherwise(0).cast("long")
    return own.select("pattern", F.coalesce("source_size", F.lit(0)).cast("long").alias("source_size"), F.coalesce("target", F.lit(0.0)).alias("target"), passes.alias("passes"), (F.col("flow") - passes * F.col("size")).cast("long").alias("extra"))


def mixed(docs: DataFrame, sources: Column, mix: Mix = Mix()) -> DataFrame:
    """(doc_id, pattern, size, source_size, target, taken) of every document; ``sources``: its sources as an array.

    Sizes are words; null and blank texts have size 0 and are taken with 0 words.  A null source
    is a source of its own.  Rows with equal doc_id, or without one, have equal keys and are taken or
    left together, so a source of such rows may miss its target by their words; empty tables give
    empty results.  source_size and target are those of the
    document's first source in code-point order.  Further columns are left aside.
    """
    spark = docs.sparkSession
    # nulls last, as an empty marker that sorts behind all text
    each = docs.select("doc_id", F.array_sort(F.array_distinct(sources)).alias("sources"), size_of(F.col("text")).alias("size"))
    key = F.md5(F.concat(F.lit(mix.seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    each = each.withColumn("pattern", F.to_json(F.struct("sources"), {"ignoreNullFields": "false"})).withColumn("key", key)
    each = stored(each, "sizes")
    patterns = stored(each.groupBy("pattern").agg(F.first("sources").alias("sources"), F.sum("size").alias("size")), "patterns")
    plan = stored(pattern_plan(patterns, mix), "plan")
    edges = seeded_edges(each.select("pattern", "size", "key"), plan.filter("extra > 0").select("pattern", "extra"))
    plan = _small(stored(plan.join(_small(edges), "pattern", "left"), "taken_of"))
    out = each.join(plan, "pattern")
    more = F.when(F.col("edge").isNotNull() & (F.col("key") <= F.col("edge")), 1).otherwise(0)
    return out.select("doc_id", "pattern", "size", "source_size", "target", (F.col("size") * (F.col("passes") + more)).cast("long").alias("taken"))


def mix_documents(docs: DataFrame, source: str = "source", mix: Mix = Mix()) -> DataFrame:
    """The documents that the mix takes, once for each time, all columns as they are.

    Rows that share id and source are taken equally often; null ids and null sources are values
    like others.  Texts without words are never taken.  An empty table gives an empty one; columns
    of any name stay as they are.
    """
    id_, source_, times, number = (free_name(docs, n) for n in ("taken_id", "taken_source", "times", "pass"))
    own = F.from_json("pattern", "sources array<string>")["sources"][0]
    plan = mixed(docs, F.array(F.col(source)), mix).filter("taken > 0").select(F.col("doc_id").alias(id_), own.alias(source_), (F.col("taken") / F.col("size")).cast("int").alias(times))
    plan = small_enough(stored(plan.dropDuplicates([id_, source_]), "taken"), 24)
    same = docs["doc_id"].eqNullSafe(plan[id_]) & docs[source].eqNullSafe(plan[source_])
    both = docs.filter(size_of(F.col("text")) > 0).join(plan, same)
    return both.withColumn(number, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns)
