"""Queries whose rows grew with the product of scans and records, and tours whose pairs stood in tables."""

from __future__ import annotations

import random
import time

import numpy as np

from pyspark.sql import functions as F

from postloom.llm import filter_audit
from postloom.operators import resolve as res
from postloom.operators import neighbours, parse, points, tours
from postloom.sources import lookups

GAZ = "id string, street string, houseNumber string, postcode string, city string, lat double, lng double, lookupKey string, matchKey string"


def test_candidates_of_a_crowded_key_are_counted_without_pairs(spark):
    n = 60_000
    scans = spark.range(n).select(F.col("id").alias("scan_id"), F.when(F.col("id") == 7, "other|1").otherwise("allee|1").alias("lookupKey"))
    gaz = spark.range(n).select(F.concat(F.lit("n"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("id"), F.lit("allee|1").alias("lookupKey"))
    began = time.time()
    got = res.count_candidates(scans, gaz).groupBy("lookupKey", "n_candidates", "first_id").count().collect()
    assert sorted(tuple(r) for r in got) == sorted([("allee|1", n, "n000000", n - 1), ("other|1", 0, None, 1)], key=lambda r: r[0])
    assert time.time() - began < 30  # 3.6 billion pairs would take minutes


def test_many_orders_at_once_go_the_way_of_each(spark):
    r = np.random.default_rng(3)
    for n in (2, 3, 4, 5, 17, 41):
        flat = r.random((3, n * n)) * 1000
        of = np.repeat([0, 1, 2], 4)
        orders = np.stack([np.append(0, 1 + r.permutation(n - 1)) for _ in of])
        got, meters = tours._improve_many(flat, of, orders)
        for b, k in enumerate(of):
            m, own = flat[k].reshape(n, n), orders[b]
            for moves in (tours.reverse_moves, tours.stop_moves, tours.reverse_moves):
                own = tours._until_still(m, own, moves)
            assert own.tolist() == got[b].tolist() and abs(tours._length(m, own) - meters[b]) < 1e-6


def test_matrices_of_lists_are_those_of_pairs_and_never_written(spark, monkeypatch):
    r = np.random.default_rng(4)
    rows = [(t, f"s{i:02d}", 53 + r.random(), 13 + r.random(), bool(i % 3)) for t in range(4) for i in range(1, 3 + 7 * t)]
    stops = spark.createDataFrame(rows, "tour_id long, id string, lat double, lng double, priority boolean")
    lists = tours.straight_matrices(tours.stop_lists(stops), 53.5, 13.5)
    pairs = tours.matrices(tours.stop_pairs(stops, 53.5, 13.5))
    assert {x["tour_id"]: x["mat"] for x in lists.collect()} == {x["tour_id"]: x["mat"] for x in pairs.collect()}
    written = []
    monkeypatch.setattr(tours, "checkpointed", lambda df: (written.append(df.columns), df)[1])
    seeds = {x["tour_id"]: x["m"] for x in tours.seed_tours(pairs).select("tour_id", tours.tour_length(F.col("ord")).alias("m")).collect()}
    assert {x["tour_id"]: x["meters"] for x in tours.seeded(lists).collect()} == seeds
    plan = tours.plan_tours(stops, 53.5, 13.5).collect()
    assert sorted((x["tour_id"], x["id"]) for x in plan) == sorted((x[0], x[1]) for x in rows)
    assert written and not any("mat" in columns for columns in written)  # these tours are of few nodes


def test_prefixes_are_lengthened_without_joins(spark):
    r = random.Random(5)
    rows = [(i, "a" * 3000 + "".join(r.choices("xyz", k=6)), 3006) for i in range(60)] + [(i, f"{i:02d} alone", 8) for i in range(60, 90)]
    rows += [(100 + i, "a" * 20, 20) for i in range(3)]
    got = filter_audit.with_prefix(spark.createDataFrame(rows, "grp long, text string, size long"), None, 10_000)  # no table between
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    by = {}
    for x in got.collect():
        assert x["text"].startswith(x["prefix"])
        by.setdefault(x["prefix"], set()).add(x["text"])
    assert sum(map(len, by.values())) == len({x[1] for x in rows})  # equal texts have one prefix
    assert len([p for p in by if len(p) == 3006]) > 50


def test_scans_meet_their_candidates_as_one_row(spark):
    places = [(f"n{i:03d}", "Allee", "1", f"{17000 + i}", f"Dorf {i}", 53 + i * 0.01, 13.0, "allee|1", "") for i in range(200)]
    gaz = spark.createDataFrame(places, GAZ)
    scans = spark.range(100).select(F.col("id").alias("scan_id"), F.lit("allee|1").alias("lookupKey"), F.lit("allee|1").alias("matchKey"), F.when(F.col("id") == 5, "17003").otherwise("").alias("postcode"), F.lit("").alias("city"))
    many = {}
    for r in res.resolve(scans, gaz).collect():
        many.setdefault(r["scan_id"], []).append(r)
    once = {r["scan_id"]: r for r in res.resolve_once(scans, gaz).collect()}
    assert len(once) == 100 and sum(map(len, many.values())) == 99 * 200 + 1
    for k, r in once.items():
        assert (r["outcome"], r["canonicalId"], r["n"]) == (many[k][0]["outcome"], many[k][0]["canonicalId"], len(many[k]))
    assert (once[5]["record_id"], once[6]["record_id"]) == ("n003", None)
    rows = spark.createDataFrame([(1, 0, 53.5, 13.0, "a", None), (1, 1, None, None, None, "p"), (1, 2, None, None, None, None)], "tour_id long, seq long, lat double, lng double, record_id string, place string")
    pool = gaz.filter("id in ('n050', 'n090')").select(F.lit("p").alias("place"), F.struct(F.col("id").alias("record_id"), "lat", "lng").alias("c")).groupBy("place").agg(F.collect_list("c").alias("candidates"))
    assert {r["seq"]: r["record_id"] for r in neighbours.choose_by_neighbours(rows, pool).collect()} == {0: "a", 1: "n050", 2: None}


def test_a_range_of_tours_is_few_files(spark, tmp_path):
    edges = spark.range(0, 640 * 4).select(F.floor(F.col("id") / 4).alias("tour_id"), (F.col("id") % 2).alias("i"), (F.floor(F.col("id") / 2) % 2).alias("j"), F.lit(1.0).alias("road"))
    lookups.write_roads(edges, str(tmp_path / "roads"))
    files = list((tmp_path / "roads").glob("tour_range=*/*.parquet"))
    assert len({f.parent for f in files}) == 10 and len(files) <= 10 + 4  # four tasks; tours dealt by hash made about 40
    assert lookups.read_roads(spark, str(tmp_path / "roads")).count() == 640 * 4


def _broadcasts(df) -> int:
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().toString().count("BroadcastExchange")


def test_equal_texts_are_parsed_once(spark):
    rows = [(i, t, i) for i, t in enumerate([None, "", " ", "Anna\nAllee 1\n17000 Dorf", "Allee 1\r\n17000 Dorf", "x"] * 50)]
    df = spark.createDataFrame(rows, "scan_id long, raw string, seq long")
    got, want = parse.parse_once(df), parse.parse_address(df)
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    counted = spark.sparkContext.accumulator(0)

    def told(batches):
        for b in batches:
            counted.add(b.num_rows)
            yield b

    real = parse.parse_address
    parse.parse_address = lambda d, raw="raw": real(d.mapInArrow(told, d.schema), raw)
    try:
        assert parse.parse_once(df).count() == 300
    finally:
        parse.parse_address = real
    assert counted.value == 5  # distinct texts, null as empty; all 300 rows were parsed before


def test_answers_of_places_serve_all_their_scans(spark):
    places = [(f"n{i:03d}", "Allee", "1", f"{17000 + i}", f"Dorf {i % 7}", 53 + i * 0.01, 13.0, "allee|1", "") for i in range(40)]
    gaz = spark.createDataFrame(places, GAZ)
    pick = lambda c, *v: F.element_at(F.array(*map(F.lit, v)), (F.col("id") % len(v) + 1).cast("int")).alias(c)
    scans = spark.range(210).select((F.col("id") % 200).alias("scan_id"), pick("lookupKey", "allee|1", "allee|1", "weg|2"), F.lit("m").alias("matchKey"), pick("postcode", "", "17003", "17004", "99999"), pick("city", "", "Dorf 3", None, "Dorf 5", "Dorf 6"))
    found = res.resolve(scans, gaz)
    quality = gaz.select("id", (F.col("lat") > 53.2).alias("suspicious"), F.lit(7).alias("nearest_m"))
    text = lambda df: sorted(map(str, df.collect()))
    assert text(res.resolve_with_quality(scans, gaz, quality).select("scan_id", "outcome", "record_id", "suspicious", "distance_m", "original_lat")) == text(res.attach_quality(found, quality).select("scan_id", "outcome", "record_id", "suspicious", "distance_m", "original_lat"))
    assert text(res.scans_by_town(scans, gaz)) == text(found.groupBy("outcome", F.coalesce("record_city", F.lit("-")).alias("town")).agg(F.countDistinct("scan_id").alias("n_scans")))
    assert text(res.first_candidates(scans, gaz)) == text(found.filter("outcome = 'ambiguous'").groupBy("scan_id").agg(F.min("record_id").alias("record_id")))
    assert found.select("scan_id").distinct().count() == 200  # a scan without a city was lost before


def test_what_meets_a_batch_is_not_broadcast(spark, sf, tmp_path):
    from postloom.plans import review_queries as review
    from postloom.sources import views

    assert _broadcasts(views.scans(spark, sf)) == 0
    batch = tmp_path / "batch"
    review._resolved_scans(spark, sf).withColumn("seq", F.col("scan_id")).write.parquet(str(batch))
    known = views.points(spark, sf).select("id", "matchKey", "canonicalId", "lookupKey", "postcode", "city", "lat", "lng", "createdAt")
    known.write.parquet(str(tmp_path / "known"))
    for df in points.add_items(spark.read.parquet(str(batch)), spark.read.parquet(str(tmp_path / "known"))):
        assert _broadcasts(df) == 0  # files of a few kilobytes, which were all broadcast before


def test_rounds_of_patches_are_not_broadcast(spark, monkeypatch):
    from postloom.operators import patches

    counts = []
    real = patches.checkpointed
    monkeypatch.setattr(patches, "checkpointed", lambda df: (counts.append(_broadcasts(df)), real(df))[1])
    rows = spark.range(300).select(F.lit("g").alias("g"), F.format_string("r%04d", "id").alias("id"), (53 + (F.col("id") * 37 % 100) * 0.0002).alias("lat"), (13 + (F.col("id") * 61 % 100) * 0.0002).alias("lng"))
    assert patches.keep_first_of_patches(real(rows), ["g"]).count() > 1
    assert counts and not any(counts)  # the rows of the cells around were broadcast before
