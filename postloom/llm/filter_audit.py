"""Audit of how filters interact (operator 11).

Four filters judge a text by itself, the fifth marks copies.  Copies are found by radix tries over
whole texts: each task inserts the texts of a batch into a compressed trie, which leaves one text
of equal ones and the least id of all; those texts are range-partitioned by adaptive prefixes (a
prefix that holds too many bytes is lengthened) and inserted into the tries of the ranges, whose
terminals hold the least ids table-wide.  The ids go back to the batches' groups, the flags of each
row become a mask, masks are counted by part, and all orders of the filters follow from the counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import Scratch, partitions, stored
from ._words import IS_POINT, by_text, pieces

RANGE_BYTES = 32_000_000
FIRST_PREFIX = 16
LETTERS = "ABCDE"
SYMBOLS = b"#$%&*|"


@dataclass(frozen=True)
class Limits:
    """A: fewer words; B: a smaller percentage of distinct words; C: a larger percentage of capitals."""

    words: int = 200
    distinct_percent: int = 50
    capital_percent: int = 2


@dataclass
class Node:
    label: bytes
    children: dict[int, Node] = field(default_factory=dict)
    least: object = None
    members: list[int] = field(default_factory=list)  # who ended here; a node without any is no terminal


def _common(text: bytes, at: int, label: bytes) -> int:
    """How many bytes of ``label`` stand at ``at``."""
    n = min(len(label), len(text) - at)
    for size in (64, n):  # most texts part early
        size = min(size, n)
        differs = np.frombuffer(text, np.uint8, size, at) != np.frombuffer(label, np.uint8, size)
        i = int(differs.argmax()) if size else 0
        if size and differs[i]:
            return i
    return n


class Trie:
    """A compressed trie of byte strings; terminals hold the least id and the members that ended there.  None is the largest id."""

    def __init__(self) -> None:
        self.root, self.bytes, self.terminals = Node(b""), 0, []

    def insert(self, text: bytes, least: object, member: int) -> None:
        node, at = self.root, 0
        while at < len(text):
            child = node.children.get(text[at])
            if child is None:
                child = node.children[text[at]] = Node(text[at:])
                self.bytes += len(child.label)
                node = child
                break
            if not text.startswith(child.label, at):
                n = _common(text, at, child.label)
                middle = node.children[text[at]] = Node(child.label[:n])
                child.label = child.label[n:]
                middle.children[child.label[0]] = child
                child = middle
            node, at = child, at + len(child.label)
        if not node.members:
            self.terminals.append(node)
            node.least = least
        elif least is not None and (node.least is None or least < node.least):
            node.least = least
        node.members.append(member)


def text_mask(texts: pa.Array, limits: Limits) -> np.ndarray:
    """Bits of the filters A to D that each text fails; a null text is an empty one."""
    out = []
    for p in pieces(texts):
        h = p.hashes()
        order = by_text(p.doc, h)
        doc, h = p.doc[order], h[order]
        first = np.ones(len(h), bool)
        first[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
        distinct = np.bincount(doc[first], minlength=p.n_docs)
        capitals, points = p.per_text((p.data >= 0x41) & (p.data <= 0x5A)), p.per_text(IS_POINT[p.data])
        symbols = p.per_text(np.isin(p.data, np.frombuffer(SYMBOLS, np.uint8)))
        fails = (p.n_words < limits.words, 100 * distinct < limits.distinct_percent * p.n_words, 100 * capitals > limits.capital_percent * points, symbols > 0)
        out.append(sum(f.astype(np.int32) << i for i, f in enumerate(fails)))
    return np.concatenate(out) if out else np.zeros(0, np.int32)


def batch_groups(docs: DataFrame, limits: Limits) -> DataFrame:
    """(grp, doc_id, part, mask, text, size, least): rows of one batch with equal texts share a group; its first row carries the text, its bytes and the least id."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grp = TaskContext.get().partitionId() << 36
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(2).fill_null("")
            raw = texts.cast(pa.binary()) if pa.types.is_string(texts.type) else texts.cast(pa.large_binary())
            trie = Trie()
            for i, x in enumerate(raw):
                trie.insert(x.as_buffer().to_pybytes(), ids[i], i)
            own = np.zeros(b.num_rows, np.int64)
            head = np.zeros(b.num_rows, bool)
            least = [None] * b.num_rows
            for k, node in enumerate(trie.terminals):
                own[node.members] = grp + k
                head[node.members[0]] = True
                least[node.members[0]] = node.least
            none = pa.array(~head)
            text = pc.if_else(none, pa.scalar(None, texts.type), texts)
            size = pc.if_else(none, pa.scalar(None, pa.int64()), pc.binary_length(raw).cast(pa.int64()))
            columns = [pa.array(own), b.column(0), b.column(1), pa.array(text_mask(texts, limits).astype(np.int32)), text, size, pa.array(least, b.column(0).type)]
            yield pa.RecordBatch.from_arrays(columns, ["grp", "doc_id", "part", "mask", "text", "size", "least"])
            grp += len(trie.terminals)

    own = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), "text")
    return own.mapInArrow(run, f"grp bigint, doc_id {kind}, part string, mask int, text string, size bigint, least {kind}")


def with_prefix(texts: DataFrame, scratch: Scratch, quota: int) -> DataFrame:
    """Adds prefix: FIRST_PREFIX signs, and four times as many wherever the texts of a prefix hold more bytes than ``quota``.

    The heavy prefixes, of which a length has no more than quotas fit into all bytes, are told by
    their hashes; two of one hash are both lengthened, so texts that are equal keep equal prefixes.
    A length is counted among the texts under heavy prefixes only, and the texts are joined with nothing.
    """
    length = FIRST_PREFIX
    deep, steps = texts, []
    while True:
        prefix = F.substring("text", 1, length)
        held = deep.select(prefix.alias("prefix"), "size").groupBy("prefix").agg(F.sum("size").alias("held"))
        heavy = [r[0] for r in held.filter(F.col("held") > quota).select(F.xxhash64("prefix")).collect()]
        if not heavy:
            break
        under = F.xxhash64(prefix).isin(heavy)
        steps.append((prefix, under))
        # a text that ends within its prefix has no longer one
        deep = deep.filter(under & (F.char_length("text") > length))
        length *= 4
    out = F.substring("text", 1, length)
    for prefix, under in reversed(steps):
        out = F.when(under, out).otherwise(prefix)
    return texts.withColumn("prefix", out)


def least_ids(texts: DataFrame, ranges: int) -> DataFrame:
    """(grp, first_id): the least id table-wide of each group's text, from the tries of the ranges of ``prefix``.

    A range comes in the order of its texts, so that whatever a text has left behind it in the
    trie is final: a trie that has grown to RANGE_BYTES gives its terminals away and starts anew.
    """
    kind = texts.schema["least"].dataType.simpleString()

    def given(trie: Trie, id_type: pa.DataType) -> pa.RecordBatch:
        n = [len(t.members) for t in trie.terminals]
        grp = np.array([m for t in trie.terminals for m in t.members], np.int64)
        least = pa.array([t.least for t in trie.terminals], id_type).take(pa.array(np.repeat(np.arange(len(n)), n)))
        return pa.RecordBatch.from_arrays([pa.array(grp), least], ["grp", "first_id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, last, id_type = Trie(), None, None
        for b in batches:
            id_type = b.column(2).type
            for x, grp, least in zip(b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                text = x.as_buffer().to_pybytes()
                if trie.bytes >= RANGE_BYTES and text != last:
                    yield given(trie, id_type)
                    trie = Trie()
                trie.insert(text, least, grp)
                last = text
        if trie.terminals:
            yield given(trie, id_type)

    dealt = texts.repartitionByRange(ranges, "prefix").sortWithinPartitions("text").select("text", "grp", "least")
    return dealt.mapInArrow(run, f"grp bigint, first_id {kind}")


def filter_masks(docs: DataFrame, scratch: Scratch, limits: Limits = Limits()) -> DataFrame:
    """(doc_id, part, mask) of every row; bit i says that it fails filter i of ABCDE."""
    rows = scratch.stored(batch_groups(docs, limits), "groups")
    texts = rows.filter("text is not null").select("grp", "text", "size", "least")
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    ranges = max(partitions(docs.sparkSession), -(-total // RANGE_BYTES))
    first = scratch.stored(least_ids(with_prefix(texts, scratch, total // (4 * ranges) + 1), ranges), "least")
    own = rows.select("grp", "doc_id", "part", "mask").join(first, "grp")
    copy = F.col("first_id").isNotNull() & (F.col("doc_id").isNull() | (F.col("first_id") < F.col("doc_id")))
    return own.select("doc_id", "part", (F.col("mask") + F.when(copy, 1 << 4).otherwise(0)).alias("mask"))


def mask_counts(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic); several labels of one doc_id say good or toxic if any of them does."""
    marks = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    # rows without an id have no label: only the others are joined
    known = masks.filter("doc_id is not null").join(marks, "doc_id", "left").select("part", "mask", "good", "toxic")
    none = F.lit(None).cast("int")
    own = known.unionByName(masks.filter("doc_id is null").select("part", "mask", none.alias("good"), none.alias("toxic")))
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return own.groupBy("part", "mask").agg(F.count("*").alias("n"), zero("good"), zero("toxic"))


def orders_of(counts: DataFrame, letters: str = LETTERS) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for every order of the filters.

    All follows from how many rows have no bit of a set of filters, for each of the 2^k sets.
    """
    k = len(letters)
    orders = list(permutations(range(k)))
    steps = [(order, s) for order in orders for s in range(k)]
    ints = lambda values: F.lit([int(v) for v in values])
    per = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("rows"))  # at most 2^k rows a part
    total = lambda name, keep: F.aggregate("rows", F.lit(0).cast("bigint"), lambda a, r: a + F.when(keep(r["mask"]), r[name]).otherwise(0))
    sets = F.sequence(F.lit(0), F.lit((1 << k) - 1))
    clear = lambda name: F.transform(sets, lambda s: total(name, lambda m: m.bitwiseAND(s) == 0))
    without = [clear(name).alias(f"no_{name}") for name in ("n", "good", "toxic")]
    only = F.array(*[total("n", lambda m, bit=1 << i: m == bit) for i in range(k)])
    share = [factorial(k) // max(1, m.bit_count()) for m in range(1 << k)]  # in how many orders each bit of a mask comes first
    first = F.array(*[sum((total("n", lambda m, own=own: m == own) * share[own] for own in range(1 << k) if own >> i & 1), F.lit(0).cast("bigint")) for i in range(k)])
    per = per.select("part", *without, only.alias("only"), first.alias("first"), F.explode(F.sequence(F.lit(0), F.lit(len(steps) - 1))).alias("i"))
    at = lambda values: F.get(ints(values), F.col("i"))
    set_of = lambda order, n: sum(1 << f for f in order[:n])
    per = per.withColumn("own", at(order[s] for order, s in steps)).withColumn("before", at(set_of(order, s) for order, s in steps)).withColumn("after", at(set_of(order, s + 1) for order, s in steps))
    names = F.lit(["".join(letters[f] for f in order) for order in orders])
    lost = lambda name: F.get(f"no_{name}", F.col("before")) - F.get(f"no_{name}", F.col("after"))
    failing = F.get("no_n", F.lit(0)) - F.get("no_n", at(1 << order[s] for order, s in steps))
    return per.select(
        "part",
        F.get(names, F.floor(F.col("i") / k).cast("int")).alias("filter_order"),
        (F.col("i") % k + 1).cast("int").alias("step"),
        F.get("no_n", F.col("after")).alias("kept"),
        lost("n").alias("removed"),
        (failing - lost("n")).alias("redundant"),
        F.get("only", F.col("own")).alias("unique_fails"),
        lost("good").alias("good_lost"),
        lost("toxic").alias("toxic_lost"),
        F.get("first", F.col("own")).alias("shapley"),
    )


def audited(docs: DataFrame, labels: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """What each filter removes at each place of every order of the five, by part (see ``orders_of``).

    Filters: A too few words, B too few distinct words, C too many capitals, D holds a symbol, E the
    text of a smaller doc_id.  A null text is an empty one, a null source the part ''.  A null
    doc_id is larger than all others and has no label; rows that share a doc_id are no copies of
    one another for E, and each counts.  Texts of any length are compared whole.  An empty table
    gives an empty result; further columns are left aside.
    """
    scratch = Scratch(docs.sparkSession, "audit")
    try:
        counts = stored(mask_counts(filter_masks(docs, scratch, limits), labels), "mask_counts")
    finally:
        scratch.remove()
    return orders_of(counts)
