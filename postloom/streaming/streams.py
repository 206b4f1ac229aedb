"""Scans and deliveries as streams."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.parse import parse_once
from ..operators.points import add_items, aggregate_counts, dedupe_key, new_point_id
from ..operators.resolve import collapse_geometry, once_among
from ..operators.rounds import checkpointed
from ..sources.keyed import read_keyed, write_keyed
from ..sources.point_store import PointStore


def deduped(scans: DataFrame, delay: str = "1 hour") -> DataFrame:
    """The first scan of each place of a tour, within the watermark; ``scans`` has resolved, canonicalId, lookupKey, postcode, ts."""
    own = scans.withColumn("place", F.coalesce(dedupe_key(), F.concat(F.lit("row:"), F.col("scan_id").cast("string"))))
    return own.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["tour_id", "place"])


def _status() -> Column:
    return F.when(F.col("event_type") == "purchase", "delivered").when(F.col("event_type") == "error", "failed").otherwise("pending")


def _last(rows: DataFrame, by: list[Column | str]) -> DataFrame:
    """The row with the greatest (ts, event_id) of each group."""
    return rows.groupBy("item_id", *by).agg(F.max_by(F.struct("status", "ts", "event_id"), F.struct("ts", "event_id")).alias("last"))


def _state(last: DataFrame) -> DataFrame:
    return last.select("item_id", "last.status", F.when(F.col("last.status") != "pending", F.col("last.ts")).alias("deliveredAt"))


def latest_status(events: DataFrame) -> DataFrame:
    """(item_id, status, deliveredAt): state after the last event of each item, the greatest event_id of equal times; pending clears the time."""
    return _state(_last(events.select(F.col("user_id").alias("item_id"), "event_id", "ts", _status().alias("status")), []))


def status_changes(events: DataFrame, delay: str = "1 hour", span: str = "1 day") -> DataFrame:
    """(item_id, window, last): a stream of each item's last event of every span, given again whenever it changes.

    The state holds one row for each item and open span.  A span closes, and its rows leave the
    state, once the watermark, ``delay`` behind the latest event, has passed its end; events of
    closed spans are dropped and counted as late.  For output mode update.
    """
    own = events.select(F.col("user_id").alias("item_id"), "event_id", "ts", _status().alias("status")).withWatermark("ts", delay)
    return _last(own, [F.window("ts", span).alias("span")])


def merged_status(changes: DataFrame) -> DataFrame:
    """``latest_status`` of all events that ``status_changes`` has given out."""
    return _state(_last(changes.select("item_id", "last.*"), []))


def live_counts(points: DataFrame, items: DataFrame, latest: DataFrame) -> DataFrame:
    """The totals of each tour with the items' states as their last events left them; items without an event keep theirs."""
    now = items.drop("status").join(items.select("item_id", F.col("status").alias("_old")).join(latest.select("item_id", F.col("status").alias("_new")), "item_id", "left"), "item_id")
    return aggregate_counts(points, now.withColumn("status", F.coalesce("_new", "_old")))


# The files of a batch are small beside what they hold, so whatever meets a batch is told to shuffle:
# the driver would have to hold what is broadcast.


class Index:
    """A gazetteer collapsed once and dealt over folders by lookupKey: a batch opens those of its own keys."""

    def __init__(self, gaz: DataFrame, path: str, buckets: int = 64) -> None:
        self.spark, self.path, self.buckets = gaz.sparkSession, path, buckets
        pool = collapse_geometry(gaz)
        self.schema = pool.schema
        write_keyed(pool, path, "lookupKey", buckets)

    def of(self, scans: DataFrame) -> DataFrame:
        return read_keyed(self.spark, self.path, self.schema, "lookupKey", self.buckets, scans.select("lookupKey")).select(self.schema.names)


def resolved_batch(batch: DataFrame, index: Index) -> DataFrame:
    """The parsed scans with canonicalId, resolved, lat and lng."""
    own = checkpointed(parse_once(batch))
    found = once_among(own, index.of(own))
    return own.hint("merge").join(found.select("scan_id", "canonicalId", (F.col("outcome") == "resolved").alias("resolved"), "lat", "lng"), "scan_id")


def touched(scans: DataFrame, store: PointStore) -> DataFrame:
    """The points that the scans can match or make again: by canonicalId, matchKey, or the id that a new point gets."""
    values = scans.select(F.explode(F.array("canonicalId", "matchKey")).alias("value"))
    ids = store.find(values).select("id").unionByName(scans.select(new_point_id().alias("id")))
    return store.get(ids)


def commit(gaz: DataFrame, start: DataFrame, folder: str, buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """A sink that parses and resolves each batch of scans and adds its items to the points.

    The points are a ``PointStore`` under ``folder``, which begins with ``start``.  A batch reads
    the points that its scans can match, and commits those that it changed or made; all others stay
    as they lie on disk.  ``placed/batch=i`` is written before that, and the commit carries the
    batch's number, so a batch that runs again after a failure overwrites what it left or, once
    committed, changes nothing.  The gazetteer is collapsed once, when the sink is made.  Scans:
    scan_id, seq, raw, createdAt.  ``buckets``: folders of the store and of the gazetteer, the same
    for as long as the store lasts.
    """
    spark = gaz.sparkSession
    store = PointStore(spark, f"{folder}/points", start.schema, buckets=buckets)
    if not store.versions():
        store.write(start)
    index = Index(gaz, f"{folder}/gazetteer-{uuid.uuid4().hex}", buckets)

    def sink(batch: DataFrame, i: int) -> None:
        tag = store.snapshot().tag
        if tag is not None and int(tag) >= i:
            return
        own = checkpointed(resolved_batch(batch, index))
        before = checkpointed(touched(own, store))
        points, placed = add_items(own, before)
        placed.write.mode("overwrite").parquet(f"{folder}/placed/batch={i}")
        store.commit(put=points.select(start.columns), tag=str(i))

    return sink


def committed(spark: SparkSession, folder: str, schema: T.StructType, buckets: int = 64) -> tuple[DataFrame, DataFrame]:
    """(points, placed) after the last batch."""
    return PointStore(spark, f"{folder}/points", schema, buckets=buckets).read(), spark.read.parquet(f"{folder}/placed").drop("batch")


@dataclass(frozen=True)
class Progress:
    """Of each micro-batch: rows read, rows too late for the watermark, rows that the state holds after it."""

    rows: list[int]
    late: list[int]
    state: list[int]


def run_to_end(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> Progress:
    """Runs a stream over what its source holds, a micro-batch at a time.

    Late rows are left out of the result and counted; Spark remembers its last 100 batches.
    """
    query = stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    told = [p.jsonValue if hasattr(p, "jsonValue") else p for p in query.recentProgress]
    of = lambda p, name: sum(o.get(name, 0) for o in p["stateOperators"])
    return Progress([p["numInputRows"] for p in told], [of(p, "numRowsDroppedByWatermark") for p in told], [of(p, "numRowsTotal") for p in told])


def file_stream(spark: SparkSession, path: str, schema: T.StructType, files: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def write_as_it_comes(rows: DataFrame, path: str, ts: str = "ts", slices: int = 4) -> None:
    """``rows`` as files that a stream reads in the order of their times: slices of time, a folder of files each, one after the other."""
    ends = rows.agg(F.min(ts).alias("lo"), F.max(ts).alias("hi")).first()
    if ends["lo"] is None:
        rows.limit(0).write.parquet(path)
        return
    step = (ends["hi"] - ends["lo"]) / slices
    for i in range(slices):
        own = rows.filter(F.col(ts) >= ends["lo"] + i * step) if i else rows
        own = own.filter(F.col(ts) < ends["lo"] + (i + 1) * step) if i < slices - 1 else own
        own.coalesce(1).write.mode("append").parquet(path)
