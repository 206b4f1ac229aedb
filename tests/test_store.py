"""The point store, the ingest stream on it, and late data."""

from __future__ import annotations

import uuid
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from postloom.operators import points as pts
from postloom.operators.rounds import checkpointed
from postloom.sources import gazetteer, lookups
from postloom.sources import views as V
from postloom.sources.point_store import Conflict, PointStore
from postloom.streaming import streams

POINT = "id string, matchKey string, canonicalId string, lookupKey string, postcode string, city string, lat double, lng double, createdAt timestamp_ntz"
SMALL = "id string, canonicalId string, matchKey string, city string"


def folder(spark, name):
    return f"{spark.conf.get('spark.checkpoint.dir')}/{name}-{uuid.uuid4().hex}"


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture
def store(spark):
    own = PointStore(spark, folder(spark, "store"), spark.createDataFrame([], SMALL).schema, buckets=8)
    own.write(spark.createDataFrame([(f"p{i}", f"c{i % 5}", f"m{i}", "Dorf") for i in range(40)], SMALL))
    return own


def test_put_delete_get_and_older_snapshots(spark, store):
    before = rows(store.read())
    put = spark.createDataFrame([("p1", "c1", "m1", "Stadt"), ("new", "c9", "m9", "Stadt")], SMALL)
    assert store.commit(put=put, delete=spark.createDataFrame([("p2",), ("p1",), ("nobody",)], "id string")) == 2
    now = {r["id"]: r for r in store.read().collect()}
    assert now["p1"]["city"] == now["new"]["city"] == "Stadt" and "p2" not in now and len(now) == 40
    assert rows(store.read(1)) == before and store.versions() == [1, 2]
    ids = spark.createDataFrame([("p1",), ("p2",), ("p3",), ("new",)], "id string")
    assert {r["id"] for r in store.get(ids).collect()} == {"p1", "p3", "new"}
    assert {r["id"] for r in store.get(ids, 1).collect()} == {"p1", "p2", "p3"}


def test_points_are_found_by_what_they_are_now(spark, store):
    store.commit(put=spark.createDataFrame([("p5", "other", "m5", "Dorf"), ("p7", "c2", "", "Dorf")], SMALL))
    find = lambda *v: {r["id"] for r in store.find(spark.createDataFrame([(x,) for x in v], "value string")).collect()}
    assert find("c0") == {f"p{i}" for i in range(0, 40, 5)} - {"p5"}
    assert find("other", "m7") == {"p5"} and find("m8", "") == {"p8"}
    assert store.find(spark.createDataFrame([], "value string")).isEmpty()


def test_folding_changes_no_point(spark, store):
    store.commit(put=spark.createDataFrame([("p1", "c1", "m1", "Stadt")], SMALL), delete=spark.createDataFrame([("p9",)], "id string"), tag="7")
    before = rows(store.read())
    store.compact()
    now = store.snapshot()
    assert rows(store.read()) == before and now.deltas == () and now.base_rows == 39 and now.tag == "7"
    store.vacuum()
    assert rows(store.read()) == before and store.versions() == [now.version]
    store.clear()
    assert store.read().isEmpty() and rows(store.read(now.version)) == before


def test_a_failed_or_late_writer_leaves_the_old_state(spark, store):
    before = rows(store.read())
    broken = store.read().withColumn("city", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        store.commit(put=broken)
    assert rows(store.read()) == before and store.versions() == [1]
    stale = store.snapshot()
    store.commit(delete=spark.createDataFrame([("p1",)], "id string"))
    with pytest.raises(Conflict):
        store._publish(type(stale)(2))
    assert len(rows(store.read())) == 39


def test_merge_in_one_step(spark, store):
    own = store.read()
    items = own.select(F.col("id").alias("point_id"), F.col("id").alias("item_id"))
    made = own.withColumn("createdAt", F.lit("2024-01-01").cast("timestamp")).withColumn("lat", F.lit(None).cast("double")).withColumn("lng", F.lit(None).cast("double"))
    kept, _ = pts.merge_points(made, items)
    kept = checkpointed(kept)
    version = store.replace_merged(kept.select(own.columns), own.join(kept, "id", "left_anti"))
    assert version == 2 and {r["canonicalId"] for r in store.read().collect()} == {f"c{i}" for i in range(5)} and store.read().count() == 5


def scans_of(spark, sf):
    return V.scans(spark, sf).select("scan_id", F.col("scan_id").alias("seq"), "raw", F.col("createdAt").cast("timestamp_ntz").alias("createdAt"))


def test_a_batch_writes_what_it_touches(spark, sf):
    """100 scans on 30,000 points: less than one in a hundred is written, none is read into the result."""
    n = 30_000
    start = spark.range(n).select(F.concat(F.lit("old"), "id").alias("id"), F.concat(F.lit("weg|"), "id").alias("matchKey"), F.concat(F.lit("index:old/"), "id").alias("canonicalId"), F.concat(F.lit("weg|"), "id").alias("lookupKey"), F.lit("").alias("postcode"), F.lit("").alias("city"), F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lng"), F.lit("2024-01-01").cast("timestamp_ntz").alias("createdAt"))
    out, gaz = folder(spark, "ingest"), checkpointed(V.gazetteer(spark, sf))
    sink = streams.commit(gaz, start, out)
    sink(checkpointed(scans_of(spark, sf).filter("scan_id < 100")), 0)
    now = PointStore(spark, f"{out}/points", start.schema).snapshot()
    assert now.base_rows == n and 0 < now.delta_rows < n / 100
    points, placed = streams.committed(spark, out, start.schema)
    assert placed.count() == 100 and points.count() == n + placed.join(start, F.col("point_id") == F.col("id"), "left_anti").select("point_id").distinct().count()


def test_the_stream_goes_on_from_its_checkpoint(spark, sf):
    """Files of a second run are taken once; a batch that was committed is not taken again."""
    own, source, mark, out = scans_of(spark, sf), folder(spark, "in"), folder(spark, "mark"), folder(spark, "out")
    start, gaz = spark.createDataFrame([], POINT), checkpointed(V.gazetteer(spark, sf))
    for part in ("scan_id < 300", "scan_id >= 300 and scan_id < 500"):
        own.filter(part).coalesce(1).write.mode("append").parquet(source)
        streams.run_to_end(streams.file_stream(spark, source, own.schema, 1), streams.commit(gaz, start, out), mark)
    points, placed = streams.committed(spark, out, start.schema)
    assert placed.count() == placed.select("scan_id").distinct().count() == 500
    assert placed.join(points, F.col("point_id") == F.col("id"), "left_anti").isEmpty()
    before = PointStore(spark, f"{out}/points", start.schema).versions()
    streams.commit(gaz, start, out)(checkpointed(own.filter("scan_id < 10")), 1)
    assert PointStore(spark, f"{out}/points", start.schema).versions() == before


def test_late_events_are_counted_and_states_leave(spark):
    at = datetime(2024, 1, 1)
    def events(hours, ids):
        return [(i, at + timedelta(hours=h), u, k) for i, (h, u, k) in zip(ids, hours, strict=True)]
    slices = [
        events([(1, 1, "purchase"), (2, 2, "error"), (2, 2, "purchase")], [1, 2, 3]),  # equal times: the greater id counts
        events([(60, 3, "click")], [4]),  # the first day is over
        events([(60, 3, "click")], [8]),  # a batch later the watermark says so
        events([(5, 1, "error"), (61, 3, "purchase")], [5, 6]),  # one event of the first day, too late
        events([(130, 4, "click")], [7]),
    ]
    source, mark, out = folder(spark, "in"), folder(spark, "mark"), folder(spark, "out")
    kind = "event_id long, ts timestamp, user_id long, event_type string"
    for own in slices:
        spark.createDataFrame(own, kind).coalesce(1).write.mode("append").parquet(source)
    stream = streams.file_stream(spark, source, spark.createDataFrame([], kind).schema, 1)
    told = streams.run_to_end(streams.status_changes(stream), lambda b, i: b.write.mode("overwrite").parquet(f"{out}/batch={i}"), mark, "update")
    assert sum(told.late) == 1 and max(told.state) >= 2 and told.state[-1] <= 1
    got = {r["item_id"]: r["status"] for r in streams.merged_status(spark.read.parquet(out)).collect()}
    assert got == {1: "delivered", 2: "delivered", 3: "delivered", 4: "pending"}


def test_duplicates_within_the_watermark(spark):
    at = datetime(2024, 1, 1)
    scan = lambda i, minutes, key: (i, 1, False, "", key, "", at + timedelta(minutes=minutes))
    kind = "scan_id long, tour_id long, resolved boolean, canonicalId string, lookupKey string, postcode string, ts timestamp"
    source, mark, out = folder(spark, "in"), folder(spark, "mark"), folder(spark, "out")
    for own in ([scan(1, 0, "a"), scan(2, 10, "a"), scan(3, 20, "b")], [scan(4, 30, "a"), scan(5, 600, "c")], [scan(9, 601, "c")], [scan(6, 0, "d"), scan(7, 610, "c")], [scan(8, 1300, "e")]):
        spark.createDataFrame(own, kind).coalesce(1).write.mode("append").parquet(source)
    kept = streams.deduped(streams.file_stream(spark, source, spark.createDataFrame([], kind).schema, 1), "1 hour")
    told = streams.run_to_end(kept, lambda b, i: b.write.mode("overwrite").parquet(f"{out}/batch={i}"), mark)
    assert sorted(r["lookupKey"] for r in spark.read.parquet(out).collect()) == ["a", "b", "c", "e"]
    assert sum(told.late) == 1 and told.state[-1] <= 1 < max(told.state)


def test_gazetteer_table_joins_without_a_shuffle(spark, sf):
    table = f"gaz_{uuid.uuid4().hex}"
    gazetteer.write_gazetteer(V.gazetteer(spark, sf), table, folder(spark, "gaz"), 4)
    try:
        keys = V.gazetteer(spark, sf).select("lookupKey").distinct().hint("merge")
        plan = gazetteer.read_gazetteer(spark, table).join(keys, "lookupKey")._jdf.queryExecution().executedPlan().toString()
        side = plan[plan.index("Bucketed: true") - 2000 : plan.index("Bucketed: true")]
        assert "SortMergeJoin" in plan and "Exchange" not in side[side.rindex("SortMergeJoin") :] if "SortMergeJoin" in side else "Exchange" not in side
    finally:
        spark.sql(f"drop table {table}")


def test_roads_of_some_tours_open_their_folders_only(spark):
    path = folder(spark, "roads")
    edges = spark.range(400).select(F.col("id").alias("tour_id"), F.lit(0).cast("long").alias("i"), F.lit(1).cast("long").alias("j"), F.when(F.col("id") % 5 != 0, F.col("id") * 1.0).alias("road"))
    lookups.write_roads(edges, path)
    own = lookups.read_roads(spark, path, spark.range(70, 75).select(F.col("id").alias("tour_id")).filter("tour_id > 0"))
    assert rows(own) == [(i, 0, 1, None if i % 5 == 0 else float(i)) for i in range(70, 75)]
    assert "dynamicpruning" in own._jdf.queryExecution().executedPlan().toString().lower()


def test_cache_keeps_what_was_looked_up_in_vain(spark):
    path = folder(spark, "cache")
    lookups.write_geocode_cache(spark.createDataFrame([("a|1", 53.0, 13.0), ("a|1", None, None), ("a|2", None, None), ("Roh", 54.0, 14.0), (None, None, None)], "key string, lat double, lng double"), path)
    scans = spark.createDataFrame([(1, "a|1", "x"), (2, "a|2", "x"), (3, "", "Roh"), (4, "a|3", "Roh"), (5, None, None)], "scan_id long, matchKey string, raw string")
    assert rows(lookups.cached_places(spark, path, scans).select("scan_id", "is_cached", F.coalesce("lat", F.lit(0.0)))) == [(1, True, 53.0), (2, True, 0.0), (3, True, 54.0), (4, False, 0.0), (5, True, 0.0)]
