from __future__ import annotations

import uuid

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from postloom.operators import parse, points as pts, resolve as res, routes
from postloom.operators.review import accumulate_photos
from postloom.operators.rounds import checkpointed
from postloom.sources import views as V
from postloom.streaming import streams

POINT = "id string, matchKey string, canonicalId string, lookupKey string, postcode string, city string, lat double, lng double, createdAt timestamp_ntz"


@pytest.fixture(scope="module")
def gaz(spark, sf):
    return checkpointed(V.gazetteer(spark, sf))


def test_lines_without_positions_are_split_by_postcode(spark):
    text = ["Seeweg 1", "17000 Dorf", "Am Markt 2", "17001 Dorf", "LTE"]
    rows = [(1, i, x, None, None) for i, x in enumerate(text)] + [(2, 0, "Seeweg 1", 5.0, 2.0), (2, 1, "17000 Dorf", None, None)]
    got = parse.split_by_gap(spark.createDataFrame(rows, "p int, line_no int, text string, top double, height double"), ["p"])
    assert {(r.p, r.raw) for r in got.collect()} == {(1, "Seeweg 1\n17000 Dorf"), (1, "Am Markt 2\n17001 Dorf"), (2, "Seeweg 1\n17000 Dorf")}


def test_online_confidence(spark):
    scans = spark.createDataFrame([(i, k, pc, city) for i, (k, pc, city) in enumerate([("a|1", "17000", ""), ("a|2", "", ""), ("a|3", "", ""), ("a|4", "", ""), ("a|1", "17000", "")])], "scan_id long, matchKey string, postcode string, city string")
    offline = scans.select("scan_id", F.lit("yellow").alias("confidence"), F.when(F.col("scan_id") == 4, "index").otherwise("street-missing").alias("reason"), F.lit("").alias("canonicalId"), (F.col("scan_id") == 4).alias("resolved"), F.lit(0).cast("long").alias("n_candidates"), F.lit(None).cast("string").alias("suggestion"))
    cache = spark.createDataFrame([("a|1", 53.0, 13.0), ("a|2", 53.0, 13.0), ("a|3", None, None)], "matchKey string, lat double, lng double")
    got = {r.scan_id: (r.confidence, r.lat) for r in res.confidence_online(offline, scans, cache).collect()}
    assert got == {0: ("green", 53.0), 1: ("yellow", 53.0), 2: ("red", None), 3: ("yellow", None), 4: ("yellow", None)}


def test_incomplete_order_falls_back_whole(spark):
    external = spark.createDataFrame([(1, "a", 1, True), (2, "b", 1, False)], "tour_id long, id string, position long, complete boolean")
    planned = spark.createDataFrame([(1, "a", 9, "straight"), (2, "b", 2, "straight"), (2, "c", 1, "straight")], "tour_id long, id string, position long, provider string")
    got = {tuple(r) for r in routes.external_or_planned(external, planned).collect()}
    assert got == {(1, "a", 1, "ors"), (2, "b", 2, "straight"), (2, "c", 1, "straight")}


def test_request_without_usable_stops(spark):
    stops = spark.createDataFrame([(1, "a", 53.0, 13.0, True, ""), (1, "b", None, 13.0, False, ""), (2, "c", None, None, False, "")], "tour_id long, id string, lat double, lng double, priority boolean, group string")
    got = {r.tour_id: (r.request, r.skipped) for r in routes.export_requests(stops, 50.0, 10.0).collect()}
    assert got[2] == (None, ["c"]) and got[1][1] == ["b"]
    assert got[1][0] == '{"jobs":[{"id":1,"location":[13.0,53.0],"priority":100}],"vehicles":[{"id":1,"profile":"driving-car","start":[10.0,50.0],"end":[10.0,50.0]}]}'


def test_repeated_photo_adds_nothing(spark, sf, gaz):
    own = parse.extract_blocks(V.lines(spark, sf).filter("tour_id < 3"), ["tour_id", "photo_id"])
    once = accumulate_photos(own, gaz)
    again = accumulate_photos(own.unionByName(own.withColumn("photo_id", F.col("photo_id") + 1_000_000)), gaz)
    named = lambda df: {tuple(r) for r in df.filter("lookupKey <> '' or resolved").select("tour_id", "lookupKey", "postcode").collect()}
    assert named(once) == named(again) and once.count() > 0


@pytest.fixture(scope="module")
def batches(spark, sf):
    own = V.scans(spark, sf).select("scan_id", F.col("scan_id").alias("seq"), "raw", F.col("createdAt").cast("timestamp_ntz").alias("createdAt"))
    return [checkpointed(own.filter("scan_id < 800")), checkpointed(own.filter("scan_id >= 800"))]


def _folder(spark):
    return f"{spark.conf.get('spark.checkpoint.dir')}/ingest-{uuid.uuid4().hex}"


def test_a_batch_that_runs_again_changes_nothing(spark, gaz, batches):
    start, out = spark.createDataFrame([], POINT), _folder(spark)
    sink = streams.commit(gaz, start, out)
    sink(batches[0], 0)
    sink(batches[1], 1)
    state = lambda: [sorted(map(str, x.collect())) for x in streams.committed(spark, out, start.schema)]
    before = state()
    sink(batches[1], 1)
    assert state() == before
    points, placed = streams.committed(spark, out, start.schema)
    assert placed.count() == placed.select("scan_id").distinct().count() == batches[0].count() + batches[1].count()
    assert placed.join(points, placed["point_id"] == points["id"], "left_anti").isEmpty()
    assert points.count() == points.select("id").distinct().count()


def test_one_batch_equals_adding_all(spark, sf, gaz, batches):
    start, out = spark.createDataFrame([], POINT), _folder(spark)
    everything = batches[0].unionByName(batches[1])
    streams.commit(gaz, start, out)(everything, 0)
    got = {(r.scan_id, r.point_id) for r in streams.committed(spark, out, start.schema)[1].collect()}
    own = parse.parse_address(everything)
    found = res.resolve(own, gaz).groupBy("scan_id").agg(F.max("canonicalId").alias("canonicalId"), F.bool_or(F.col("outcome") == "resolved").alias("resolved"), F.first("lat").alias("lat"), F.first("lng").alias("lng"))
    assert got == {(r.scan_id, r.point_id) for r in pts.add_items(own.join(found, "scan_id"), start)[1].collect()}


def test_stream_query_takes_every_scan(spark, sf):
    got = entry.queries()["t1_stream_ingest"](spark, sf).agg(F.sum("n_items").alias("n")).collect()[0].n
    assert got == V.scans(spark, sf).count()
