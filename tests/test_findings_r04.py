"""Matrices of roads that do not travel as pairs."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import functions as F

import __spark_entry__ as entry
from postloom.operators import tours
from postloom.plans import source_queries
from postloom.sources import lookups


def test_roads_fill_matrices_as_they_fill_pairs(spark):
    r = np.random.default_rng(5)
    rows = [(t, f"s{i:02d}", 53 + r.random(), 13 + r.random()) for t in range(4) for i in range(1, 3 + 7 * t)]
    stops = spark.createDataFrame(rows, "tour_id long, id string, lat double, lng double")
    pairs = tours.stop_pairs(stops, 53.5, 13.5)
    edges = pairs.filter("tour_id > 0").select("tour_id", "i", "j", F.when((F.col("i") + F.col("j")) % 3 > 0, F.col("meters") * 1.5).alias("road"))
    roads = tours.matrices(edges.join(pairs.select("tour_id", "n").distinct(), "tour_id").withColumnRenamed("road", "meters")).select("tour_id", F.col("mat").alias("road"))
    got = tours.filled_matrices(tours.stop_lists(stops), roads, 53.5, 13.5)
    want = tours.matrices(tours.fill_matrix(pairs, edges))
    assert {x["tour_id"]: x["mat"] for x in got.collect()} == {x["tour_id"]: x["mat"] for x in want.collect()}


def test_no_pair_is_shuffled_for_a_matrix(spark, sf):
    plan = entry.queries()["j13_fill_matrix"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(tour_id" in plan and not re.search(r"hashpartitioning\(tour_id#\w+, i#", plan)


def test_roads_are_written_in_the_rows_of_their_tours(spark, sf, monkeypatch, tmp_path):
    written = []
    monkeypatch.setattr(source_queries, "checkpointed", lambda df: (written.append(df.columns), df)[1])
    monkeypatch.setattr(source_queries, "new_path", lambda *a: str(tmp_path / "roads"))
    plan = entry.queries()["s11_road_matrix"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert written and not any("j" in columns for columns in written)  # no table of pairs
    assert not re.search(r"hashpartitioning\(tour_id#\w+, i#", plan)
    files = list((tmp_path / "roads").glob("tour_range=*/*.parquet"))
    assert len(files) <= len({f.parent for f in files}) + 4  # a folder gets one file or two
    kept = {r["tour_id"]: len(r["road"]) for r in lookups.read_road_matrices(spark, str(tmp_path / "roads")).collect()}
    ids = sorted(kept)[:3]
    some = lookups.read_road_matrices(spark, str(tmp_path / "roads"), spark.createDataFrame([(i,) for i in ids], "tour_id long").filter("tour_id > -1"))
    assert {r["tour_id"]: len(r["road"]) for r in some.collect()} == {i: kept[i] for i in ids}
    assert "dynamicpruning" in some._jdf.queryExecution().executedPlan().toString().lower()
