"""Coordinate outliers: how far each record lies from the other houses of its street."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import params as P
from ..functions.geo import has_coords, haversine_km
from ..functions.text import normalize_city
from .rounds import checkpointed

PLACE = ["street_key", "pc", "cn"]
FEW = 64  # a place of so many houses is compared in one row, a larger one by cells
KM_PER_DEGREE = P.EARTH_KM * 3.141592653589793 / 180


def street_records(gaz: DataFrame) -> DataFrame:
    """(id, street_key, pc, cn, house, lat, lng) of the records with coordinates, street and house."""
    house = F.regexp_replace(F.lower("houseNumber"), r"\s+", "")
    own = gaz.select("id", F.substring_index("lookupKey", "|", 1).alias("street_key"), F.coalesce("postcode", F.lit("")).alias("pc"), normalize_city(F.col("city")).alias("cn"), house.alias("house"), "lat", "lng")
    return own.filter(has_coords(F.col("lat"), F.col("lng")) & (F.col("street_key") != "") & (F.col("house") != ""))


def street_houses(records: DataFrame) -> DataFrame:
    """(street_key, pc, cn, house, lat, lng, m): the houses around each place, the first record of each, and how many they are.

    A place is a street in one spelling of postcode and city.  Houses belong to it that share its
    postcode or city, where the other of both may be missing on a side; so places meet, once each,
    by street and postcode, and those that lack a postcode by street and city.
    """
    first = records.groupBy(*PLACE, "house").agg(F.min_by(F.struct("id", "lat", "lng"), "id").alias("o"))
    a = records.select(*PLACE).distinct().alias("a")
    b = first.alias("b")
    street = F.col("a.street_key") == F.col("b.street_key")
    (pa, pb), (ca, cb) = ((F.col(f"a.{c}"), F.col(f"b.{c}")) for c in ("pc", "cn"))
    by_pc = a.join(b, street & (pa == pb) & (pa != "") & ((ca == "") | (cb == "") | (ca == cb))).select("a.*", "b.house", "b.o")
    by_city = a.join(b, street & (ca == cb) & (ca != "") & ((pa == "") | (pb == ""))).select("a.*", "b.house", "b.o")
    both = by_pc.unionByName(by_city)
    own = both.groupBy(*PLACE, "house").agg(F.min_by("o", "o.id").alias("o")).select(*PLACE, "house", "o.lat", "o.lng")
    return own.join(own.groupBy(*PLACE).agg(F.count("*").alias("m")), PLACE)


def _two(near: DataFrame, by: list[str]) -> DataFrame:
    """The two nearest other houses: d1, of n1, and d2; d2 is null where there is one only."""
    best = F.slice(F.sort_array(F.collect_list(F.struct("d", "other"))), 1, 2)
    return near.groupBy(*by).agg(best.alias("best")).select(*by, F.get("best", F.lit(0))["d"].alias("d1"), F.get("best", F.lit(0))["other"].alias("n1"), F.get("best", F.lit(1))["d"].alias("d2"))


def _distances(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """(columns of a, other, d) of the houses that meet ``on`` columns of both."""
    other = b.select(*on, F.col("house").alias("other"), F.col("lat").alias("_lat"), F.col("lng").alias("_lng"))
    return a.join(other, on).filter("house <> other").withColumn("d", haversine_km(F.col("lat"), F.col("lng"), F.col("_lat"), F.col("_lng"))).drop("_lat", "_lng")


def of_few_houses(records: DataFrame, houses: DataFrame) -> DataFrame:
    """(id, nearest, median) of every record of a place with few houses: these stand in one row and are compared there."""
    house = F.struct("house", "lat", "lng")
    apart = lambda x, y: haversine_km(x["lat"], x["lng"], y["lat"], y["lng"])
    others = lambda x: F.transform(F.filter("all", lambda y: y["house"] != x["house"]), lambda y: F.struct(apart(x, y).alias("d"), y["house"].alias("n")))
    rows = houses.groupBy(*PLACE).agg(F.sort_array(F.collect_list(house)).alias("all"))
    # each step behind a generator, which keeps the next one from repeating it
    near = F.transform("all", lambda x: F.slice(F.sort_array(others(x)), 1, 2))
    rows = rows.select(*PLACE, F.inline(F.array(F.struct("all", near.alias("near")))))

    def median(x: Column) -> Column:
        own = F.zip_with("all", "near", lambda y, two: F.when(y["house"] != x["house"], F.when(two[0]["n"] != x["house"], two[0]["d"]).otherwise(two[1]["d"])))
        values = F.sort_array(F.filter(own, lambda d: d.isNotNull()))
        n = F.size("all") - 1
        # both middles at once: the values between them, one or two, by their mean
        middles = F.slice(values, F.floor((n - 1) / 2).cast("int") + 1, F.floor(n / 2).cast("int") - F.floor((n - 1) / 2).cast("int") + 1)
        return F.aggregate(middles, F.lit(0.0), lambda a, d: a + d, lambda a: a / (F.floor(n / 2) - F.floor((n - 1) / 2) + 1))

    rows = rows.select(*PLACE, F.inline(F.array(F.struct("all", F.transform("all", median).alias("medians")))))
    own = records.select("id", *PLACE, "house", "lat", "lng").join(rows, PLACE)
    distances = F.transform(F.filter("all", lambda y: y["house"] != F.col("house")), lambda y: haversine_km(F.col("lat"), F.col("lng"), y["lat"], y["lng"]))
    at = F.array_position(F.transform("all", lambda y: y["house"]), F.col("house")).cast("int")
    return own.select("id", F.array_min(distances).alias("nearest"), F.element_at("medians", at).alias("median"))


def two_nearest(records: DataFrame, houses: DataFrame) -> DataFrame:
    """(id, d1, n1, d2) of every record: its two nearest other houses of its place.

    Cells of a size that fits the place meet their eight neighbours, which is final for whatever
    has two houses within one cell's width; what has not goes on with cells four times as wide,
    until they span the place.
    """
    many = houses.groupBy(*PLACE).agg(F.first("m").alias("m"), *[f(c).alias(f"{n}_{c}") for n, f in (("lo", F.min), ("hi", F.max)) for c in ("lat", "lng")])
    # kilometres to degrees, on the safe side all over the place
    shrink = F.cos(F.radians(F.least(F.lit(89.0), F.greatest(F.abs("lo_lat"), F.abs("hi_lat"))))) * 0.99
    height, width = (F.col("hi_lat") - F.col("lo_lat")) * KM_PER_DEGREE, (F.col("hi_lng") - F.col("lo_lng")) * KM_PER_DEGREE
    span = F.greatest(height, width, F.lit(0.02))
    many = checkpointed(many.select(*PLACE, shrink.alias("shrink"), (span * 1.02).alias("span"), F.greatest(F.lit(0.01), F.sqrt(F.greatest(height, F.lit(0.01)) * F.greatest(width, F.lit(0.01)) / F.col("m")) * 1.5).alias("cell")))
    targets, open_, done = houses, records, []
    across = lambda c, scale: F.floor(F.col(c) * KM_PER_DEGREE * scale / F.col("cell")).cast("long")
    while True:
        sized = lambda df: df.join(many, PLACE).withColumn("x", across("lat", F.lit(0.999))).withColumn("y", across("lng", F.col("shrink")))
        ring = F.explode(F.sequence(F.lit(-1), F.lit(1)))
        asks = sized(open_).withColumn("dx", ring).withColumn("dy", ring).withColumn("x", F.col("x") + F.col("dx")).withColumn("y", F.col("y") + F.col("dy")).drop("dx", "dy")
        cells = sized(targets).select(*PLACE, "x", "y", "house", "lat", "lng")
        found = _two(_distances(asks.select(*open_.columns, "x", "y"), cells, [*PLACE, "x", "y"]), ["id"])
        state = checkpointed(open_.join(many, PLACE).join(found, "id", "left").withColumn("final", F.coalesce(F.col("d2") <= F.col("cell") * 0.99, F.lit(False)) | (F.col("cell") >= F.col("span"))))
        done.append(state.filter("final").select("id", "d1", "n1", "d2"))
        open_ = state.filter("not final").select(open_.columns)
        if open_.isEmpty():
            break
        many = many.withColumn("cell", F.col("cell") * 4)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def spacing_medians(nearest: DataFrame) -> DataFrame:
    """(street_key, pc, cn, house, median): the middle of what a place's other houses have to their own nearest one, the house left out.

    ``nearest``: street_key, pc, cn, house, d1, n1, d2, a row for each house.  Leaving a house out
    changes the few that have it as their nearest, from d1 to d2; so the middle is found among the
    ranks around the middle of all d1, as many as change.
    """
    by = Window.partitionBy(*PLACE)
    ranked = nearest.withColumn("r", F.row_number().over(by.orderBy("d1", "house")) - 1).withColumn("m", F.count("*").over(by))
    moved = ranked.groupBy(*PLACE, F.col("n1").alias("house")).agg(F.collect_list("r").alias("out"), F.collect_list("d2").alias("in"))
    own = ranked.join(moved, [*PLACE, "house"], "left")
    own = own.withColumn("out", F.concat(F.coalesce("out", F.array().cast("array<int>")), F.array("r"))).withColumn("in", F.coalesce("in", F.array().cast("array<double>")))
    k = F.size("in") + 2
    middle = F.floor(F.col("m") / 2).cast("int")
    own = own.withColumn("lo", F.greatest(F.lit(0), middle - k)).withColumn("hi", F.least(F.col("m").cast("int") - 1, middle + k))
    asked = own.select(*PLACE, "house", F.explode(F.sequence("lo", "hi")).alias("r"))
    around = asked.join(ranked.select(*PLACE, "r", "d1"), [*PLACE, "r"]).groupBy(*PLACE, "house").agg(F.sort_array(F.collect_list(F.struct("r", "d1"))).alias("around"))
    own = own.select(*PLACE, "house", "m", "out", "in", "lo", "hi").join(around, [*PLACE, "house"])
    stays = F.transform(F.filter("around", lambda s: ~F.array_contains("out", s["r"])), lambda s: s["d1"])
    least, most = F.get("around", F.lit(0))["d1"], F.element_at("around", -1)["d1"]
    below = lambda v: (F.col("lo") > 0) & (v < least)
    above = lambda v: (F.col("hi") < F.col("m") - 1) & (v > most)
    values = F.sort_array(F.concat(stays, F.filter("in", lambda v: ~below(v) & ~above(v))))
    before = F.col("lo") - F.size(F.filter("out", lambda r: r < F.col("lo"))) + F.size(F.filter("in", below))
    own = own.withColumn("values", values).withColumn("before", before)
    at = lambda i: F.get("values", (i - F.col("before")).cast("int"))
    n = F.col("m") - 1
    return own.select(*PLACE, "house", ((at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2).alias("median"))


def of_many_houses(records: DataFrame, houses: DataFrame) -> DataFrame:
    """(id, nearest, median) of every record, by joins that grow with the records: no row, task or group of pairs holds a place."""
    # houses stand in two_nearest as records of their own, named by place and house
    as_records = houses.select(_house_id().alias("id"), *PLACE, "house", "lat", "lng")
    near = checkpointed(two_nearest(checkpointed(records.select(as_records.columns).unionByName(as_records)), houses))
    spaced = houses.select(*PLACE, "house", _house_id().alias("id")).join(near, "id").select(*PLACE, "house", "d1", "n1", "d2")
    own = records.select("id", *PLACE, "house").join(near, "id").join(spacing_medians(spaced), [*PLACE, "house"])
    return own.select("id", F.col("d1").alias("nearest"), "median")


def outliers(gaz: DataFrame) -> DataFrame:
    """(id, suspicious, nearest_m, threshold_m): records far off the other houses of their street.

    Needs four other houses of the same street and locality; the nearest of them must be farther
    than 250 m and than five times the median of what they have between each other.  Spacings are
    found once for each place, not for each record, in a row where a place has few houses and by
    joins where it has many.
    """
    records = street_records(gaz)
    houses = checkpointed(street_houses(records).filter(F.col("m") > P.OUTLIER_HOUSES))
    own = of_few_houses(records, houses.filter(F.col("m") <= FEW))
    many = houses.filter(F.col("m") > FEW)
    if not many.isEmpty():
        own = own.unionByName(of_many_houses(records.join(many.select(PLACE).distinct(), PLACE, "left_semi"), many))
    threshold = F.greatest(F.lit(P.OUTLIER_KM), F.col("median") * P.OUTLIER_FACTOR)
    meters = lambda c: F.round(c * 1000).cast("long")
    found = own.select("id", (F.col("nearest") > threshold).alias("suspicious"), meters(F.col("nearest")).alias("nearest_m"), meters(threshold).alias("threshold_m"))
    return gaz.select("id").hint("merge").join(found, "id", "left").select("id", F.coalesce("suspicious", F.lit(False)).alias("suspicious"), F.coalesce("nearest_m", F.lit(0)).alias("nearest_m"), F.coalesce("threshold_m", F.lit(0)).alias("threshold_m"))


def _house_id() -> Column:
    return F.concat(F.lit("house:"), F.sha2(F.to_json(F.array(*PLACE, "house")), 256))

