"""Sharding by fixed virtual slots (operator 7).

Every record hashes to one of a fixed number of virtual slots.  The bytes of each slot are summed
once, and a versioned map says which shard owns a slot.  Rebalancing edits the map, never the
hash: a new version moves as few slots as bring the shards near one another.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._store import free_name, new_path, stored

SLOTS = 4096  # fixed: changing it moves every record
SHARDS = 8


@dataclass(frozen=True)
class SlotMap:
    """One version of the slot-to-shard map."""

    version: int
    shards: int
    owner: tuple[int, ...]

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(self.version, self.shards, i, s) for i, s in enumerate(self.owner)], "version int, shards int, virtual_slot int, shard int")

    def save(self, spark: SparkSession, path: str) -> None:
        """Adds this version to the map table at ``path``."""
        self.frame(spark).coalesce(1).write.mode("append").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
        """The given version, or the newest."""
        table = spark.read.parquet(path)
        version = table.agg(F.max("version")).first()[0] if version is None else version
        rows = table.filter(F.col("version") == version).select("virtual_slot", "shard", "shards").distinct().limit(SLOTS).collect()
        return SlotMap(version, rows[0]["shards"], tuple(r["shard"] for r in sorted(rows, key=lambda r: r["virtual_slot"])))


def slot_of(doc_id: Column, crc: Column) -> Column:
    """Virtual slot of a record, by its id and text: rows that share an id, or have none, are spread by their texts."""
    name = F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("null")), crc.cast("string"))
    return F.pmod(F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("long"), F.lit(SLOTS)).cast("int")


def balanced(loads: list[int], shards: int = SHARDS) -> SlotMap:
    """First version: heaviest slot first, each to the lightest shard."""
    heap = [(0, s) for s in range(shards)]
    owner = [0] * len(loads)
    for slot in sorted(range(len(loads)), key=lambda i: (-loads[i], i)):
        held, shard = heapq.heappop(heap)
        owner[slot] = shard
        heapq.heappush(heap, (held + loads[slot], shard))
    return SlotMap(1, shards, tuple(owner))


def rebalanced(old: SlotMap, loads: list[int], shards: int | None = None, slack_percent: int = 1) -> SlotMap:
    """Next version for new loads or another number of shards: slots leave shards above their fair share only."""
    shards = shards or old.shards
    held = [0] * shards
    owner = [s if s < shards else -1 for s in old.owner]
    for slot, s in enumerate(owner):
        if s >= 0:
            held[s] += loads[slot]
    fair = sum(loads) / shards * (1 + slack_percent / 100)
    loose = [i for i, s in enumerate(owner) if s < 0]
    for slot in sorted(range(len(loads)), key=lambda i: (-loads[i], i)):
        s = owner[slot]
        if s >= 0 and loads[slot] and held[s] - loads[slot] >= sum(loads) / shards and held[s] > fair:
            held[s] -= loads[slot]
            owner[slot] = -1
            loose.append(slot)
    heap = [(h, s) for s, h in enumerate(held)]
    heapq.heapify(heap)
    for slot in sorted(loose, key=lambda i: (-loads[i], i)):
        h, s = heapq.heappop(heap)
        owner[slot] = s
        heapq.heappush(heap, (h + loads[slot], s))
    return SlotMap(old.version + 1, shards, tuple(owner))


def current_map(spark: SparkSession, loads: list[int], shards: int = SHARDS, path: str | None = None) -> SlotMap:
    """The newest version in the map table at ``path``, a further one added first where loads or shards ask for it.

    Without a table there version 1 is made; without a path, in a table of this run's own.
    """
    path = path or new_path(spark, "slot_map")
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        old = SlotMap.load(spark, path)
        new = rebalanced(old, loads, shards)
        if (new.shards, new.owner) == (old.shards, old.owner):
            return old
    else:
        new = balanced(loads, shards)
    new.save(spark, path)
    return SlotMap.load(spark, path)


def records(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, virtual_slot) of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    own = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return own.withColumn("virtual_slot", slot_of(F.col("doc_id"), F.col("text_crc32")))


def slot_loads(own: DataFrame) -> list[int]:
    """Bytes of each of the fixed slots."""
    loads = [0] * SLOTS
    for r in own.groupBy("virtual_slot").agg(F.sum("size").alias("bytes")).collect():  # one row a slot
        loads[r["virtual_slot"]] = r["bytes"]
    return loads


def sharded(docs: DataFrame, shards: int = SHARDS, slot_map: SlotMap | None = None, map_path: str | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot, map_version) of every row.

    Law ``bytes``: the shards' sizes are near equal.  ``slot`` numbers the records of a shard from
    0 without gaps, by virtual slot and then by doc_id and text.  Null texts have no bytes and the
    CRC of no bytes; rows that share an id, or have none, are spread by their texts.  Rows that
    repeat id and text go to one shard and get slots of their own, which of them first makes no
    difference.  The map is the given one or that of the table at ``map_path``, edited where the
    shards ask for it.  Empty tables give empty results; further columns are left aside.
    """
    spark = docs.sparkSession
    own = stored(records(docs), "records")
    slot_map = slot_map or current_map(spark, slot_loads(own), shards, map_path)
    owner = F.broadcast(slot_map.frame(spark).select("virtual_slot", "shard", F.col("version").alias("map_version")))
    count = own.groupBy("virtual_slot").agg(F.count("*").alias("n")).join(owner, "virtual_slot")
    w = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    first = count.select("virtual_slot", "shard", "map_version", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("first"))  # a row a slot
    within = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")) - 1
    out = own.withColumn("within", within).join(F.broadcast(first), "virtual_slot")
    return out.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        (F.col("first") + F.col("within")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot",
        "map_version",
    )


def shard_documents(docs: DataFrame, shards: int = SHARDS, map_path: str | None = None) -> DataFrame:
    """All documents and columns, with their virtual_slot and shard, by the map of the table at ``map_path``.

    Null texts have no bytes, null and repeated ids are spread by their texts.  An empty table
    gives an empty one.  Where ``docs`` has columns of these names, they stay, and the new ones get
    an underscore before theirs.
    """
    spark = docs.sparkSession
    slot_name, shard_name, key = free_name(docs, "virtual_slot"), free_name(docs, "shard"), free_name(docs, "map_slot")
    text = F.coalesce(F.col("text"), F.lit(""))
    slot = slot_of(docs["doc_id"], F.crc32(text.cast("binary")))
    owner = F.broadcast(current_map(spark, slot_loads(records(docs)), shards, map_path).frame(spark).select(F.col("virtual_slot").alias(key), F.col("shard").alias(shard_name)))
    return docs.withColumn(slot_name, slot).join(owner, F.col(slot_name) == F.col(key)).select(*docs.columns, slot_name, shard_name)
