"""URL filters: rules, then a blocked Bloom filter before an exact join (operator 8)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import BROADCAST_BYTES, ascii_lower, small_enough, stored

WORDS = 8  # a block is eight 64-bit words; a key sets one bit in each
KEYS_PER_BLOCK = 40
BLOCK_BYTES = 80  # of a filter row: its number and its words


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without www. or m., path without index page, suffix or last slash, query without tracking; no scheme or fragment."""
    host = F.regexp_replace(host_of(url), r"^(www|m)\.", "")
    path = F.regexp_replace(path_of(url), r"(/|\.html?)+$", "")
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda q: (q != "") & ~q.rlike(r"^(utm_[a-z]+|ref|fbclid|gclid)="))), "&")
    return F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))


def rule_for(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits; null where none does."""
    name = verdict = None
    for r in sorted(rules, key=lambda r: (-len(r.name), r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name = F.when(fits, r.name) if name is None else name.when(fits, r.name)
        verdict = F.when(fits, r.verdict) if verdict is None else verdict.when(fits, r.verdict)
    none = F.lit(None).cast("string")
    return (none, none) if name is None else (name, verdict)


def _place(key: Column, blocks: int) -> tuple[Column, list[Column]]:
    """A key's block, and one bit for each of its words from six bits of a second hash."""
    block = F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")
    second = F.xxhash64(F.lit("bits"), key)
    six = [F.shiftrightunsigned(second, 6 * i).bitwiseAND(F.lit(63)).cast("int") for i in range(WORDS)]
    return block, [F.call_function("shiftleft", F.lit(1).cast("long"), x) for x in six]


def bloom(listed: DataFrame, blocks: int) -> DataFrame:
    """(block, w0 ... w7) of the keys in ``listed`` (key)."""
    block, bits = _place(F.col("key"), blocks)
    return listed.select(block.alias("block"), *[b.alias(f"b{i}") for i, b in enumerate(bits)]).groupBy("block").agg(*[F.bit_or(f"b{i}").alias(f"w{i}") for i in range(WORDS)])


def listed_flags(rows: DataFrame, key: str, listed: DataFrame) -> DataFrame:
    """``rows`` with a boolean ``listed``: whether ``key`` is among the keys of ``listed`` (key).

    The filter lets through every listed key and few others; only those meet the exact join.  It
    has a block for every 40 keys: one that a broadcast holds goes to the rows, for a larger one
    the rows go to their blocks.
    """
    listed = stored(listed.filter("key is not null").distinct(), "listed")
    blocks = max(1, -(-listed.count() // KEYS_PER_BLOCK))
    held = bloom(listed, blocks)
    held = F.broadcast(held) if blocks * BLOCK_BYTES <= BROADCAST_BYTES else held
    block, bits = _place(F.col(key), blocks)
    probe = rows.withColumn("block", block).join(held, "block", "left")
    passes = F.coalesce(F.col("w0").bitwiseAND(bits[0]) == bits[0], F.lit(False))
    for i in range(1, WORDS):
        passes = passes & F.coalesce(F.col(f"w{i}").bitwiseAND(bits[i]) == bits[i], F.lit(False))
    probe = probe.withColumn("possible", passes).select(*rows.columns, "possible")
    exact = small_enough(listed.select(F.col("key").alias("own_key"), F.lit(True).alias("listed")), 200)
    hits = probe.filter("possible").join(exact, F.col(key) == F.col("own_key"), "left").select(*rows.columns, F.coalesce("listed", F.lit(False)).alias("listed"))
    return hits.unionByName(probe.filter("not possible").select(*rows.columns, F.lit(False).alias("listed")))


def judge_urls(pages: DataFrame, listed: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, canonical, listed) of every page.

    The longest fitting rule decides; where none fits, a page is blocked if its canonical URL is
    in ``listed`` (key), else allowed.  Null urls and urls without ``://`` have empty host and
    path, fit no rule and are allowed unless the empty key is listed.  Repeated rows come back as
    often as they came in; empty tables are fine; further columns are left aside.
    """
    own = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), canonical(F.col("url")).alias("canonical"))
    own = stored(own, "urls")
    name, verdict = rule_for(F.col("host"), F.col("path"), rules)
    out = listed_flags(own, "canonical", listed)
    return out.select("page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"), "canonical", "listed")


#: labels of hosts that publish nothing else but spam; their pages make up the query's list
SPAM_LABELS = ("spam-farm", "cheap-pills")


def spam_list(pages: DataFrame, labels: tuple[str, ...] = SPAM_LABELS) -> DataFrame:
    """(key): canonical URLs of all pages on spam hosts."""
    own = pages.select(canonical(F.col("url")).alias("key"), F.split(host_of(F.col("url")), r"\.").alias("labels"))
    return own.filter(F.arrays_overlap("labels", F.array(*map(F.lit, labels)))).select("key")
