"""N-gram Jaccard self-join with PartEnum signatures (operator 6).

A document's set holds the distinct shingles of five words.  Two sets of sizes a and b with
Jaccard similarity of at least t differ in at most (a + b)(1 - t)/(1 + t) elements.  Size bands
become levels of allowed difference K (a ladder with ratio sqrt 2): at a level the shingle domain
is partitioned by hash into m > K parts, and as no more than K parts can hold a difference, two
similar sets agree on at least m - K parts.  Each non-empty part of a set is one signature, so a
set shares at least ``need`` = m - K - (its empty parts) signatures with each similar set.  Sets
whose need is not positive also emit the smallest of their elements (a prefix longer than the
allowed difference); two sets that could miss each other both do so, and share one of those.

The need also keeps frequent passages cheap.  Signatures of few sets give pairs, with the count
of signatures they share.  A set that has fewer signatures in frequent ones than its need meets
every similar set among the pairs, often enough to tell by the count; frequent signatures are
worked off only between the other sets: each against the least one that it shares most with, then, once links are closed to
components, block by block what still lies in different components.  Equal sets are one class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import Scratch, partitions, small_enough, stored
from ._words import Piece, by_text, mix, pieces, windows
from .components import components

WORDS = 5
PERCENT = 75
PAIRS_AT_ONCE = 2_000_000
FREQUENT = 20  # sets of one signature beyond which it counts as frequent
PREFIX_LEVEL = 63
BLOCK = 1024  # sets of a block, about
BLOCK_ELEMENTS = 2_000_000  # and their elements


def levels(size_limit: int = 2**31) -> np.ndarray:
    """Allowed differences, ascending."""
    out, t = [], 0
    while not out or out[-1] < size_limit:
        out.append(int(np.ceil(2 ** (t / 2))))
        t += 1
    return np.unique(np.array(out, np.int64))


def parts_of(k: np.ndarray) -> np.ndarray:
    """Parts at a level: somewhat more than the differences, so that a non-empty part agrees."""
    return (k * 130) // 100 + 3


def shingle_sets(piece: Piece, n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(text, shingle) of the distinct shingles of each text, texts ascending."""
    h = piece.hashes()
    s, at = windows(h, piece.bounds, n)
    doc = piece.doc[at]
    count = piece.n_words
    few = np.flatnonzero((count > 0) & (count < n))
    if len(few):  # the whole sequence of a shorter text is its one shingle
        own = mix(count[few].astype(np.uint64))
        for i in range(n - 1):
            more = count[few] > i
            own[more] = mix(own[more] + h[piece.bounds[few[more]] + i])
        order = np.argsort(np.concatenate([doc, few]), kind="stable")
        doc, s = np.concatenate([doc, few])[order], np.concatenate([s, own])[order]
    if not len(doc):
        return doc, s
    order = by_text(doc, s)
    doc, s = doc[order], s[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (s[1:] != s[:-1])
    return doc[new], s[new]


def class_of(n_docs: int, doc: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Size of each text's set, and a hash of the set."""
    size = np.bincount(doc, minlength=n_docs).astype(np.int64)
    total = np.zeros(n_docs, np.uint64)
    np.add.at(total, doc, mix(s ^ np.uint64(0x51)))
    return size, mix(total + size.astype(np.uint64)).view(np.int64)


def signatures(size: np.ndarray, doc: np.ndarray, s: np.ndarray, percent: int = PERCENT, needs_only: bool = False) -> tuple:
    """(text, signature) of all texts, ``doc`` ascending; the level is in a signature's last six bits.

    With ``needs_only``: (text, level, need).
    """
    ladder = levels()
    lo, hi = 100 - percent, 100 + percent
    smallest, largest = -(-size * percent // 100), size * 100 // percent
    k_min, k_max = (size + smallest) * lo // hi, (size + largest) * lo // hi
    level, last = np.searchsorted(ladder, np.maximum(k_min, 1)), np.searchsorted(ladder, np.maximum(k_max, 1))
    last[k_max < 1] = -1  # only an equal set is similar
    out_doc, out_sig, needs = [], [], []
    weight = mix(s ^ np.uint64(0xA7))
    place = mix(s ^ np.uint64(0x3C)) >> np.uint64(32)
    level, risky = level.copy(), np.zeros(len(size), bool)
    while True:
        live = level <= last
        if not live.any():
            break
        k = ladder[np.minimum(level, len(ladder) - 1)]
        m = np.where(live, parts_of(k), 0)
        base = np.concatenate([[0], np.cumsum(m)])
        own = live[doc]
        d = doc[own]
        at = base[d] + ((place[own] * m[d].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
        held = np.bincount(at, minlength=base[-1]) > 0
        filled = np.diff(np.concatenate([[0], np.cumsum(held)])[base])
        need = filled - np.minimum(k, k_max)
        risky |= live & (need <= 0)
        if needs_only:
            who = np.flatnonzero(live)
            needs.append((who, level[who], need[who]))
        else:
            total = np.zeros(base[-1], np.uint64)
            np.add.at(total, at, weight[own])
            owner = np.repeat(np.arange(len(size)), m)
            part = np.arange(base[-1]) - base[owner]
            own_level = level[owner].astype(np.uint64)
            sig = mix(total ^ mix((own_level << np.uint64(40)) + part.astype(np.uint64)))
            out_doc.append(owner[held])
            out_sig.append(((sig & ~np.uint64(63)) | own_level)[held])
        level += 1
    if needs_only:
        return tuple(np.concatenate(x) for x in zip(*needs, strict=True)) if needs else (np.zeros(0, np.int64),) * 3
    if risky.any():
        # a similar set lacks at most size - ceil(size * percent / 100) of this one's elements
        take = size - smallest + 1
        own = risky[doc]
        d, e = doc[own], s[own]  # ascending by hash within a text
        rank = np.flatnonzero(own) - np.searchsorted(doc, np.arange(len(size)))[d]
        keep = rank < take[d]
        out_doc.append(d[keep])
        out_sig.append(mix(e[keep] ^ np.uint64(0xE1E)) | np.uint64(PREFIX_LEVEL))
    if not out_doc:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(out_doc), np.concatenate(out_sig)


def with_sets(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, version, n_shingles, cls, needs) of every document; version is a hash of its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in pieces(b.column(2), lower=True):
                doc, s = shingle_sets(p, words)
                size, cls = class_of(p.n_docs, doc, s)
                who, level, need = signatures(size, doc, s, percent, needs_only=True)
                order = np.argsort(who, kind="stable")
                held = pa.StructArray.from_arrays([pa.array(level[order].astype(np.int32)), pa.array(need[order].astype(np.int32))], ["level", "need"])
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(who[order], np.arange(p.n_docs + 1)).astype(np.int32)), held)
                yield pa.RecordBatch.from_arrays([*(b.column(i).slice(p.first, p.n_docs) for i in (0, 1)), pa.array(size), pa.array(cls), lists], ["doc_id", "version", "n_shingles", "cls", "needs"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("text").alias("version"), "text").mapInArrow(run, f"doc_id {kind}, version bigint, n_shingles bigint, cls bigint, needs array<struct<level:int,need:int>>")


def with_signatures(docs: DataFrame, slices: int, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(slice, cls, counts, sigs): a piece's signatures of a slice, those of a class once.

    ``cls`` and ``counts`` say how many of ``sigs`` belong to which class, in order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in pieces(b.column(0), lower=True):
                doc, s = shingle_sets(p, words)
                size, cls = class_of(p.n_docs, doc, s)
                once = np.zeros(p.n_docs, bool)
                once[np.unique(cls, return_index=True)[1]] = True
                doc, s = doc[once[doc]], s[once[doc]]
                d, sig = signatures(np.where(once, size, 0), doc, s, percent)
                if not len(d):
                    continue
                key = (sig % np.uint64(slices)).astype(np.int64) * p.n_docs + d
                order = np.argsort(key)
                key, sig = key[order], sig[order].view(np.int64)
                new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                cut = np.searchsorted(key[new] // p.n_docs, np.arange(slices + 1))
                some = np.flatnonzero(np.diff(cut))
                groups = pa.array(np.append(cut[some], len(new)).astype(np.int32))
                columns = [
                    pa.array(some.astype(np.int32)),
                    pa.ListArray.from_arrays(groups, pa.array(cls[key[new] % p.n_docs])),
                    pa.ListArray.from_arrays(groups, pa.array(np.diff(np.append(new, len(key))).astype(np.int32))),
                    pa.ListArray.from_arrays(pa.array(np.append(new, len(key))[np.append(cut[some], len(new))].astype(np.int32)), pa.array(sig)),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["slice", "cls", "counts", "sigs"])

    return docs.select("text").mapInArrow(run, "slice int, cls array<bigint>, counts array<int>, sigs array<bigint>")


def shared_signatures(dealt: DataFrame) -> DataFrame:
    """What the signatures that two classes or more have say, as rows (frequent, a, b, level, n).

    Not frequent: classes a < b share n signatures of the level, of those in one slice.
    Frequent: class a has signature b.

    ``dealt`` has whole slices in its partitions.  A task holds the signatures of its own
    slices as two numpy columns: 16 bytes each, all signatures divided by the slices.
    """
    names = ["frequent", "a", "b", "level", "n"]

    def rows(frequent: bool, a: np.ndarray, b: np.ndarray, level: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(a), 1 << 17):
            to = slice(i, i + (1 << 17))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a[to]), frequent)), pa.array(a[to]), pa.array(b[to]), pa.array(level[to].astype(np.int32)), pa.array(n[to].astype(np.int32))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sigs, owners = [], []
        for b in batches:
            sigs.append(b.column(3).flatten().to_numpy())
            owners.append(np.repeat(b.column(1).flatten().to_numpy(), b.column(2).flatten().to_numpy()))
        if not sigs:
            return
        sig, cls = np.concatenate(sigs), np.concatenate(owners)
        order = np.argsort(sig)
        new = np.ones(len(sig), bool)
        new[1:] = sig[order][1:] != sig[order][:-1]
        many = np.bincount(np.cumsum(new) - 1)
        order = order[np.repeat(many > 1, many)]
        sig, cls = sig[order], cls[order]
        order = np.lexsort((cls, sig))
        sig, cls = sig[order], cls[order]
        keep = np.ones(len(sig), bool)
        keep[1:] = (sig[1:] != sig[:-1]) | (cls[1:] != cls[:-1])
        sig, cls = sig[keep], cls[keep]
        if not len(sig):
            return
        head = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
        many = np.repeat(np.diff(np.append(head, len(sig))), np.diff(np.append(head, len(sig))))
        hot = many > FREQUENT
        yield from rows(True, cls[hot], sig[hot], sig[hot] & 63, many[hot])
        sig, cls = sig[~hot], cls[~hot]
        found = []
        for gap in range(1, FREQUENT):
            same = np.flatnonzero(sig[gap:] == sig[:-gap])
            if not len(same):
                break
            found.append((cls[same], cls[same + gap], sig[same] & 63))
        if not found:
            return
        a, b, level = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((level, b, a))
        a, b, level = a[order], b[order], level[order]
        head = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (level[1:] != level[:-1])]))
        yield from rows(False, a[head], b[head], level[head], np.diff(np.append(head, len(a))))

    return dealt.mapInArrow(run, "frequent boolean, a bigint, b bigint, level int, n int")


def sets_of(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(cls, size, elements): the set of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in pieces(b.column(0), lower=True):
                doc, s = shingle_sets(p, words)
                size, cls = class_of(p.n_docs, doc, s)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(s.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(cls), pa.array(size), lists], ["cls", "size", "elements"])

    return docs.select("text").mapInArrow(run, "cls bigint, size bigint, elements array<bigint>")


def similar(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose sets reach the similarity."""
    left = sets.select(F.col("cls").alias("a"), F.col("size").alias("size_a"), F.col("elements").alias("of_a"))
    right = sets.select(F.col("cls").alias("b"), F.col("size").alias("size_b"), F.col("elements").alias("of_b"))
    fits = (F.least("size_a", "size_b") * 100) >= (F.greatest("size_a", "size_b") * percent)
    both = pairs.join(left, "a").join(right, "b").filter(fits)
    common = F.size(F.array_intersect("of_a", "of_b")).cast("long")
    both = both.withColumn("common", common)
    return both.filter(F.col("common") * 100 >= (F.col("size_a") + F.col("size_b") - F.col("common")) * percent).select("a", "b", "common")


def _links(own: pa.Table, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the components of one pair of blocks: as many as it takes, not all there are."""
    cls, component, side, size = (own[c].to_numpy() for c in ("cls", "component", "side", "size"))
    component = component.copy()
    lists = own["elements"].combine_chunks()
    flat, at = lists.flatten().to_numpy(), lists.offsets.to_numpy()
    at = at - at[0]
    # a bit for each of 4096 hash values: sets differ in at least as many elements as bits
    bits = np.zeros((len(cls), 4096), bool)
    bits[np.repeat(np.arange(len(cls)), np.diff(at)), flat & 4095] = True
    bits = np.packbits(bits, axis=1).view(np.uint64)
    left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)  # side 2: a block against itself
    out_a, out_b = [], []
    for i in left:
        other = right[(component[right] != component[i]) & ((side[i] != 2) | (cls[right] > cls[i]))]
        apart = np.bitwise_count(bits[other] ^ bits[i]).sum(1, dtype=np.int64)
        for j in other[apart * (100 + percent) <= (size[other] + size[i]) * (100 - percent)]:
            if component[j] == component[i]:
                continue
            common = len(np.intersect1d(flat[at[i] : at[i + 1]], flat[at[j] : at[j + 1]], assume_unique=True))
            if common * 100 >= (size[i] + size[j] - common) * percent:
                out_a.append(cls[i])
                out_b.append(cls[j])
                component[component == component[j]] = component[i]
    return np.array(out_a, np.int64), np.array(out_b, np.int64)


def between_components(rows: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b) of similar sets that join the components of each family.

    ``rows``: cls, component, family, size, elements.  A family is cut into blocks of about
    BLOCK sets or BLOCK_ELEMENTS elements, and every two of its blocks meet in a task of their
    own; what a task holds does not follow the family.
    """
    count = rows.groupBy("family").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("size") / BLOCK_ELEMENTS)).cast("int").alias("blocks"))
    rows = rows.join(count, "family").withColumn("own", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    rows = rows.select("family", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), side.alias("side"), "cls", "component", "size", "elements")

    def run(own: pa.Table) -> pa.Table:
        a, b = _links(own, percent)
        return pa.table({"a": a, "b": b})

    return rows.groupBy("family", "lo", "hi").applyInArrow(run, "a bigint, b bigint")


def jaccard_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id): documents linked by Jaccard similarity of word shingles.

    Words are runs without white space, A-Z lower-cased; a text of fewer words is one shingle.
    Null, empty and blank texts have no shingle and link with nothing: they keep their own id.
    Rows that repeat a doc_id come back once each, whatever their texts; the component is the
    least doc_id, so ties do not matter.  Rows with a null doc_id link like all others and get the
    least id they reach, null if none has one.  An empty table gives an empty one; further columns
    are left aside.  Sets are told apart by a hash of 64 bits: among 10^10 different sets some
    three pairs are expected to be taken as equal.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    try:
        return stored(_components(docs, words, percent, scratch), "components")
    finally:
        scratch.remove()


def _components(docs: DataFrame, words: int, percent: int, scratch: Scratch) -> DataFrame:
    spark = docs.sparkSession
    slices = partitions(spark)
    own = scratch.stored(with_sets(docs, words, percent), "sets")
    dealt = with_signatures(docs, slices, words, percent).repartitionById(slices, F.col("slice"))
    shared = scratch.stored(shared_signatures(dealt), "shared")

    classes = own.filter("n_shingles > 0").groupBy("cls").agg(F.min("doc_id").alias("first"), F.min("version").alias("version"), F.first("n_shingles").alias("size"), F.first("needs").alias("needs"))
    classes = scratch.stored(classes, "classes")
    frequent = shared.filter("frequent")
    rest = frequent.groupBy("a", "level").agg(F.count("*").alias("lost")).withColumnRenamed("a", "cls")
    need = classes.select("cls", "size", F.explode("needs").alias("x")).select("cls", "size", F.col("x.level").alias("level"), F.col("x.need").alias("need"))
    # what a set must share with a similar one outside the frequent signatures
    need = need.join(rest, ["cls", "level"], "left").select("cls", "size", "level", (F.col("need") - F.coalesce("lost", F.lit(0))).alias("need"))
    prefix = classes.select("cls", "size", F.lit(PREFIX_LEVEL).alias("level"), F.lit(0).cast("long").alias("need"))
    need = scratch.stored(need.unionByName(prefix), "need")

    pairs = shared.filter("not frequent").groupBy("a", "b", "level").agg(F.sum("n").alias("n"))
    pairs = pairs.join(need.selectExpr("cls a", "level", "size size_a", "need need_a"), ["a", "level"]).filter("n >= need_a")
    pairs = pairs.join(need.selectExpr("cls b", "level", "size size_b", "need need_b"), ["b", "level"]).filter("n >= need_b")
    pairs = pairs.filter(F.least("size_a", "size_b") * 100 >= F.greatest("size_a", "size_b") * percent)
    pairs = scratch.stored(pairs.select("a", "b").distinct(), "pairs")

    members = frequent.selectExpr("b sig", "a cls", "level").join(need.filter("need <= 0").select("cls", "level"), ["cls", "level"])
    members = scratch.stored(members.select("sig", "cls"), "members")
    leads = members.groupBy("sig").agg(F.min("cls").alias("lead"))
    star = members.join(leads, "sig").filter("cls <> lead").groupBy("lead", "cls").agg(F.count("*").alias("n"))
    star = star.groupBy(F.col("cls").alias("b")).agg(F.max_by("lead", F.struct("n", "lead")).alias("a")).select("a", "b")
    tested = scratch.stored(pairs.unionByName(star).distinct(), "tested")

    wanted = tested.select(F.col("a").alias("cls")).union(tested.select("b")).union(members.select("cls")).distinct()
    wanted = small_enough(scratch.stored(classes.join(wanted, "cls").select(F.col("version").alias("wanted")), "wanted"), 16)
    # one text of each class; should two texts share a version, their sets still go by class
    sets = sets_of(docs.join(wanted, F.xxhash64(docs["text"]) == F.col("wanted"), "left_semi").select("text"), words)
    sets = scratch.stored(sets.dropDuplicates(["cls"]), "elements")

    links = scratch.stored(similar(tested, sets, percent).select("a", "b"), "linked")
    found = scratch.stored(components(links, scratch), "found")
    open_ = members.join(found.select(F.col("node").alias("cls"), "component"), "cls", "left")
    open_ = open_.withColumn("component", F.coalesce("component", "cls"))
    mixed = open_.groupBy("sig").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).filter("c0 <> c1")
    open_ = scratch.stored(open_.join(mixed.select("sig", "c0"), "sig"), "open")
    if not open_.isEmpty():
        # components, not sets, are tied by a shared signature: far fewer edges for the same families
        families = components(open_.selectExpr("c0 a", "component b").filter("a <> b").distinct(), scratch)
        rest = open_.select("cls", "component").distinct().join(families.selectExpr("node component", "component family"), "component")
        more = between_components(rest.join(sets, "cls"), percent)
        found = components(links.unionByName(scratch.stored(more, "more")), scratch)

    labelled = classes.join(found.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    least = labelled.groupBy("component").agg(F.min("first").alias("component_id"))
    named = labelled.join(least, "component").select("cls", "component_id")
    out = own.join(named, "cls", "left")
    out = out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    return out
