"""Outliers, names, patches and tours against brute force, and on groups of thousands."""

from __future__ import annotations

import math
import random
import statistics
import time

import pytest
from pyspark.sql import functions as F

from postloom.operators import names, spacing, tours
from postloom.operators import resolve as res
from postloom.operators.patches import keep_first_of_patches

GAZ = "id string, street string, houseNumber string, postcode string, city string, lat double, lng double, lookupKey string, matchKey string"


def km(a, b):
    la, ga, lb, gb = map(math.radians, (*a, *b))
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((gb - ga) / 2) ** 2
    return 2 * 6371.0 * math.asin(math.sqrt(h))


def houses(n, seed, streets=1, odd=True):
    r, out = random.Random(seed), []
    for i in range(n):
        s = r.randrange(streets)
        lat, lng = 53 + r.random() * 0.03, 13 + r.random() * 0.05
        if odd and i % 40 == 0:
            lat += 0.3
        if odd and i % 17 == 0 and out:
            lat, lng = out[-1][5], out[-1][6]
        pc, city = r.choice([("17000", "Dorf"), ("17000", ""), ("", "Dorf"), ("17001", "Dorf")]) if odd else ("17000", "Dorf")
        out.append((f"n{i:05d}", "Allee", str(r.randint(1, n)), pc, city, lat, lng, "", ""))
        out[-1] = (*out[-1][:7], f"allee{s}|{out[-1][2]}", "")
    return out


def expected_outliers(rows):
    out = {}
    for a in rows:
        others = {}
        for b in sorted(rows):
            pc, city = (a[3], b[3]), (a[4].lower(), b[4].lower())
            fits = lambda x: "" in x or x[0] == x[1]
            same = (pc[0] != "" and pc[0] == pc[1]) or (city[0] != "" and city[0] == city[1])
            if a[7].split("|")[0] == b[7].split("|")[0] and a[2] != b[2] and fits(pc) and fits(city) and same:
                others.setdefault(b[2], b[5:7])
        at = list(others.values())
        if len(at) < 4:
            out[a[0]] = (False, 0, 0)
            continue
        near = min(km(a[5:7], p) for p in at)
        limit = max(0.25, 5 * statistics.median(min(km(p, q) for j, q in enumerate(at) if j != i) for i, p in enumerate(at)))
        out[a[0]] = (near > limit, round(near * 1000), round(limit * 1000))
    return out


@pytest.mark.parametrize("few", [spacing.FEW, 0])
def test_outliers_equal_brute_force(spark, monkeypatch, few):
    """By places compared whole, and by cells only."""
    monkeypatch.setattr(spacing, "FEW", few)
    rows = houses(140, 3, streets=3)
    got = {r["id"]: (r["suspicious"], r["nearest_m"], r["threshold_m"]) for r in spacing.outliers(spark.createDataFrame(rows, GAZ)).collect()}
    want = expected_outliers(rows)
    assert any(x[0] for x in want.values())
    assert {k for k in want if got[k][0] != want[k][0] or max(abs(got[k][i] - want[k][i]) for i in (1, 2)) > 1} == set()


def test_a_street_of_two_thousand_houses(spark):
    own = spark.createDataFrame([(*h[:2], str(i), *h[3:7], f"allee|{i}", "") for i, h in enumerate(houses(2000, 4, odd=False))], GAZ)
    began = time.time()
    assert spacing.outliers(own).count() == 2000
    assert time.time() - began < 60


def test_places_without_coordinates_or_few_houses(spark):
    rows = [(f"n{i}", "Weg", str(i), "1", "X", None if i % 2 else 53.0, 13.0, f"weg|{i}", "") for i in range(8)]
    assert {tuple(r)[1:] for r in spacing.outliers(spark.createDataFrame(rows, GAZ)).collect()} == {(False, 0, 0)}
    assert spacing.outliers(spark.createDataFrame([], GAZ)).isEmpty()


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("share", [0.01, 0.1])
def test_nearest_names_equal_brute_force(spark, monkeypatch, share):
    r = random.Random(8)
    word = lambda n: "".join(r.choices("abcde", k=n))
    known = sorted({word(r.randint(1, 16)) + r.choice(["strasse", "weg", ""]) for _ in range(80)})
    asked = set()
    for k in known:
        c = list(k)
        for _ in range(r.randint(0, 5)):
            at = r.randrange(len(c) + 1)
            c[at : at + r.randint(0, 1)] = r.choice(["", "x", "a"])
        asked.add("".join(c))
    asked |= {"", "q", "qqqqqqqqqqqqqqqqqqqqqqqqqq"}
    most = {n: max(2, int(len(n) * 0.3)) for n in asked}
    first = {k: f"id{r.randrange(30):02d}" for k in known}
    want = {}
    for n in asked:
        best = min(((edits(n, k), first[k]) for k in known), default=None)
        if best and best[0] <= most[n]:
            want[n] = {k for k in known if (edits(n, k), first[k]) == best}
    names_ = spark.createDataFrame(sorted(most.items()), "street_norm string, most int")
    table = spark.createDataFrame([(k, k, first[k]) for k in known], "known_norm string, known_street string, first_id string")
    assert names.common_endings(table) == {} and names.common_endings(table, 1, 0.1)[7] == ["strasse"]
    monkeypatch.setattr(names.common_endings, "__defaults__", (1, share))
    got = {x["street_norm"]: x["known_street"] for x in names.nearest_names(names_, table).collect()}
    assert set(got) == set(want) and all(got[n] in want[n] for n in got)


def test_few_pairs_are_compared(spark):
    """Names of one form, 3,000 known and as many misspelt: less than one pair in a hundred is a candidate."""
    r = random.Random(9)
    known = sorted({"".join(r.choices("abcdefghijklmnoprstuvw", k=r.randint(6, 14))) + "strasse" for _ in range(3000)})
    wrong = sorted({k[:3] + "x" + k[4:] for k in known})
    a = spark.createDataFrame([(n, 2) for n in wrong], "street_norm string, most int")
    b = spark.createDataFrame([(k, k, k) for k in known], "known_norm string, known_street string, first_id string")
    pairs = names.candidates(a, b, 2, names.common_endings(b))
    assert len(wrong) <= pairs.count() < 0.01 * len(known) * len(wrong)


def greedy(rows):
    kept = []
    for r in sorted(rows):
        if r[1] is None or not any(k[1] is not None and km(k[1:3], r[1:3]) <= 0.15 for k in kept):
            kept.append(r)
    return {r[0] for r in kept}


@pytest.mark.parametrize("lat", [53.0, -71.0])
def test_patches_equal_the_fold_in_id_order(spark, lat):
    r = random.Random(2)
    rows = [(f"{r.randrange(10**6):06d}-{i}", lat + r.random() * 0.01, 13 + r.random() * 0.02) for i in range(300)] + [(f"x{i}", None, None) for i in range(3)]
    own = spark.createDataFrame([("g", *x) for x in rows] + [("h", "other", *rows[0][1:])], "g string, id string, lat double, lng double")
    got = keep_first_of_patches(own, ["g"]).collect()
    assert {x["id"] for x in got if x["g"] == "g"} == greedy(rows) and sum(x["g"] == "h" for x in got) == 1


def test_a_crowded_key_is_collapsed_without_a_row_of_it(spark):
    n = 5_000
    own = spark.range(n).select(F.format_string("n%06d", "id").alias("id"), F.lit("Allee").alias("street"), F.lit("1").alias("houseNumber"), F.lit("").alias("postcode"), F.lit("").alias("city"), (53 + (F.col("id") * 7919 % n) * 2e-6).alias("lat"), (13 + (F.col("id") * 104729 % n) * 3e-6).alias("lng"), F.lit("allee|1").alias("lookupKey"), F.lit("allee|1").alias("matchKey"))
    got = res.collapse_geometry(own).collect()
    assert 20 < len(got) < n / 10 and {r["n_raw"] for r in got} == {n}
    assert min(km((a["lat"], a["lng"]), (b["lat"], b["lng"])) for i, a in enumerate(got[:60]) for b in got[:i]) > 0.15 if len(got) > 1 else True


def test_small_and_large_groups_collapse_alike(spark, monkeypatch):
    rows = [(h[0], h[1], "1", h[3], h[4], h[5] - (h[5] > 53.2) * 0.3, h[6], "allee|1", "") for h in houses(200, 5)]
    own = spark.createDataFrame(rows, GAZ)
    whole = sorted(map(tuple, res.collapse_geometry(own).collect()))
    monkeypatch.setattr(res, "FEW", 10_000)
    assert sorted(map(tuple, res.collapse_geometry(own).collect())) == whole and len(whole) < 200


def test_a_tour_of_three_hundred_stops_ends_because_nothing_improves(spark):
    r = random.Random(1)
    stops = [(1, f"s{i:03d}", 53 + r.random(), 13 + r.random(), False) for i in range(300)] + [(1, "lost", None, 13.0, True), (2, "alone", None, None, False)]
    own = spark.createDataFrame(stops, "tour_id long, id string, lat double, lng double, priority boolean")
    plan = tours.plan_tours(own, 53.5, 13.5, restarts=1).collect()
    order = [x["id"] for x in sorted((x for x in plan if not x["skipped"]), key=lambda x: x["position"])]
    assert len(order) == len(set(order)) == 300 and {x["id"] for x in plan if x["skipped"]} == {"lost", "alone"}
    place = {s[1]: s[2:4] for s in stops}
    at = [(53.5, 13.5), *(place[i] for i in order)]
    d = [[km(a, b) * 1000 for b in at] for a in at]
    n = len(at)
    gains = (d[i - 1][k] + d[i][(k + 1) % n] - d[i - 1][i] - d[k][(k + 1) % n] for i in range(1, n - 1) for k in range(i + 1, n))
    assert min(gains) > -1e-3
    assert {x["meters"] for x in plan if x["tour_id"] == 2} == {0.0}


def test_moves_of_one_round_do_not_touch(spark):
    assert tours._apart([[1, 2, 3], [3, 4], [5, 6], [0, 1]], 8) == [0, 2]
