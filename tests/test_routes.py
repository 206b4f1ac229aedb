from __future__ import annotations

import random

from pyspark.sql import functions as F

from postloom.operators import points, routes, tours
from postloom.plans import queries


def matrix(n, seed):
    r = random.Random(seed)
    return [0.0 if i == j else round(r.uniform(1, 100), 3) for i in range(n) for j in range(n)]


def test_tours_are_permutations_and_never_longer_than_the_seed(spark):
    rows = [(i, n, matrix(n, i)) for i, n in enumerate([2, 3, 5, 5, 5, 8, 12])]
    table = spark.createDataFrame(rows, "tour_id long, n int, mat array<double>")
    seed = {r["tour_id"]: r["m"] for r in tours.seed_tours(table).select("tour_id", tours.tour_length(F.col("ord")).alias("m")).collect()}
    for r in tours.improve_tours(table, restarts=2).collect():
        n, m, order = r["n"], r["mat"], r["ord"]
        assert sorted(order) == list(range(n)) and order[0] == 0
        assert abs(sum(m[a * n + b] for a, b in zip(order, order[1:] + order[:1])) - r["meters"]) < 1e-6
        assert r["meters"] <= seed[r["tour_id"]] + 1e-6


def test_priority_goes_first_only_when_it_costs_little(spark):
    flat = lambda m: [x for row in m for x in row]
    near = [[0, 10, 10.5, 10], [10, 0, 1, 5], [10.5, 1, 0, 5], [10, 5, 5, 0]]
    far = [[0, 10, 20, 10], [10, 0, 10, 5], [20, 10, 0, 5], [10, 5, 5, 0]]
    rows = [(1, 4, [float(x) for x in flat(near)], [0, 1, 2, 3], [False, False, True, False]), (2, 4, [float(x) for x in flat(far)], [0, 1, 2, 3], [False, False, True, False])]
    out = {r["tour_id"]: r["ord"] for r in tours.priority_reorder(spark.createDataFrame(rows, "tour_id long, n int, mat array<double>, ord array<int>, first array<boolean>")).collect()}
    assert out == {1: [0, 2, 1, 3], 2: [0, 1, 2, 3]}


def test_tours_above_a_hundred_stops_are_planned(spark):
    rows = [(1, i, 53.9 + i / 1000, 13.0, False) for i in range(1, 102)]
    out = tours.plan_tours(spark.createDataFrame(rows, "tour_id long, id long, lat double, lng double, priority boolean"), 53.9, 13.0, restarts=0)
    assert [r["position"] for r in out.orderBy("id").collect()] == list(range(1, 102))


def test_r5_takes_the_restarts_of_the_reference(monkeypatch):
    asked = []

    class Plan:
        def __getattr__(self, name):
            return lambda *a, **b: self

    monkeypatch.setattr(queries.V, "points", lambda *a: None)
    monkeypatch.setattr(queries.routes, "prepare_stops", lambda x: x)
    monkeypatch.setattr(queries.tours, "plan_tours", lambda *a, restarts=None: (asked.append(restarts), Plan())[1])
    monkeypatch.setattr(queries, "F", Plan())
    queries.r5_plan_tours(None, "")
    assert asked == [None]


def test_localities_stay_together_unless_far(spark):
    rows = [(1, "a", 53.90, 13.0, "x", 1), (1, "b", 53.91, 13.0, "x", 2), (1, "c", 53.912, 13.0, "y", 3), (1, "d", 53.913, 13.0, "x", 4)]
    out = routes.consolidate_localities(spark.createDataFrame(rows, "tour_id long, id string, lat double, lng double, group string, position long"), 53.9, 13.0)
    assert [r["id"] for r in out.orderBy("position").collect()] == ["a", "b", "d", "c"]


def test_saved_order_lists(spark):
    rows = [(1, x, 53.9 if x != "d" else None, 13.0, x == "b", i) for i, x in enumerate("abcde")]
    pts = spark.createDataFrame(rows, "tour_id long, id string, lat double, lng double, done boolean, createdAt long")
    saved = spark.createDataFrame([(1, x, i) for i, x in enumerate(["c", "a", "b", "x"])], "tour_id long, id string, rank long")
    out = routes.reorder_from_saved(pts, saved).orderBy("position").collect()
    assert [r["id"] for r in out] == ["c", "a", "e"]


def test_counts_are_of_points_not_items(spark):
    pts = spark.createDataFrame([(1, "p1"), (1, "p2"), (1, "empty")], "tour_id long, id string")
    items = spark.createDataFrame([(1, "p1", 1, "parcel", "pending"), (1, "p1", 2, "parcel", "delivered"), (1, "p2", 3, "letter", "failed")], "tour_id long, point_id string, item_id long, type string, status string")
    r = points.aggregate_counts(pts, items).first()
    assert (r["stops"], r["total"], r["items"], r["parcel"], r["mail"], r["delivered"]) == (2, 2, 3, 2, 1, 1)
    status = {r["id"]: r["status"] for r in points.point_status(pts, items).collect()}
    assert status == {"p1": "pending", "p2": "done", "empty": "empty"}


def test_scan_identity(spark):
    rows = [(1, 0, "index:1", True, "k", ""), (1, 1, "index:1", True, "k", "9"), (1, 2, "k", False, "k", ""), (1, 3, "k", False, "k", ""), (1, 4, "k|5", False, "k", "5"), (1, 5, "", False, "", ""), (1, 6, "", False, "", "")]
    out = points.dedupe_scans(spark.createDataFrame(rows, "tour_id long, seq long, canonicalId string, resolved boolean, lookupKey string, postcode string"))
    assert sorted(r["seq"] for r in out.collect()) == [0, 2, 4, 5, 6]


def test_merge_keeps_items_once_and_is_idempotent(spark):
    pts = spark.createDataFrame([("a", "index:1", None, None, 2), ("b", "index:1", 53.9, 13.0, 1), ("c", "index:1", 53.8, 13.0, 3), ("d", "", None, None, 1)], "id string, canonicalId string, lat double, lng double, createdAt long")
    items = spark.createDataFrame([("a", 1), ("b", 1), ("b", 2), ("c", 3), ("d", 4)], "point_id string, item_id long")
    kept, moved = points.merge_points(pts, items)
    assert {(r["id"], r["lat"], r["merged"]) for r in kept.collect()} == {("b", 53.9, 2), ("d", None, 0)}
    assert sorted((r["point_id"], r["item_id"]) for r in moved.collect()) == [("b", 1), ("b", 2), ("b", 3), ("d", 4)]
    again, same = points.merge_points(kept.drop("merged"), moved)
    assert again.count() == 2 and same.count() == 4


def test_batch_makes_one_point_for_a_place(spark):
    known = spark.createDataFrame([("p1", "index:1", "k|1", "k", "", "", None, None, 0)], "id string, canonicalId string, matchKey string, lookupKey string, postcode string, city string, lat double, lng double, createdAt long")
    scans = spark.createDataFrame([(1, 0, "index:1", True, "k|2", "k", "17109", "Demmin", 53.9, 13.0, 5), (2, 1, "m|9", False, "m|9", "m", "", "", None, None, 5), (3, 2, "m|9", False, "m|9", "m", "", "", 53.7, 13.1, 6)], "scan_id long, seq long, canonicalId string, resolved boolean, matchKey string, lookupKey string, postcode string, city string, lat double, lng double, createdAt long")
    out, placed = points.add_items(scans, known)
    rows = {r["id"]: r for r in out.collect()}
    at = {r["scan_id"]: r["point_id"] for r in placed.collect()}
    assert at[1] == "p1" and at[2] == at[3] and len(rows) == 2
    assert (rows["p1"]["lat"], rows["p1"]["city"]) == (53.9, "Demmin") and rows[at[2]]["lat"] == 53.7
