"""Address tables derived from the star-schema tables, all by native columns.

``gazetteer``: places from customer.  ``scans``: scanned addresses from orders.  ``points``,
``items``: delivery points of the tours that the scans make up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import keys
from ..operators.points import item_type_of_mode

# The streets that the derived tables use.
STREETS = ("Hauptstraße", "Dorfstraße", "Gartenstr.", "Goethestrasse", "Am Markt", "Kastanienallee", "Seestraße", "Müllerstr", "Ringstraße", "Clara-Zetkin-Straße", "Strandweg", "Kirchweg")
MODES = ("device", "parcel", "magazine", "letter")
BASE_LAT, BASE_LNG = 53.6, 13.3


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores, should its files make fewer partitions than there are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _pick(values: tuple[str, ...], i: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), i.cast("int"))


def _d(x: float) -> Column:
    return F.lit(x).cast("double")


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each customer: custkey, street, house, postcode, city, lat, lng."""
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    return spread(read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")).select(
        k.alias("custkey"),
        n.cast("long").alias("nation"),
        _pick(STREETS, k % 12).alias("street"),
        (F.floor(k / 12) % 20 + 1).cast("string").alias("houseNumber"),
        F.when(k % 10 == 0, "").otherwise((F.lit(17000) + n * 11).cast("string")).alias("postcode"),
        F.concat(F.lit("Dorf "), F.chr(n + 65)).alias("city"),
        (_d(53.0) + _d(0.05) * n + ((k * 7919) % 100) * _d(0.0001) + F.when(k % 97 == 5, _d(0.02)).otherwise(_d(0.0))).alias("lat"),
        (_d(12.5) + _d(0.07) * n + ((k * 104729) % 100) * _d(0.0001)).alias("lng"),
    )


def gazetteer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Address records; every 29th place has a second geometry 33 m north."""
    own = places(spark, sf_dir)
    k = F.col("custkey")
    twice = F.when(k % 29 == 0, F.array(F.lit("node/"), F.lit("way/"))).otherwise(F.array(F.lit("node/")))
    own = own.withColumn("kind", F.explode(twice))
    lookup, match = keys(F.col("street"), F.col("houseNumber"), F.lit(""), F.col("postcode"))
    return own.select(
        F.concat("kind", k.cast("string")).alias("id"),
        "street",
        "houseNumber",
        "postcode",
        "city",
        (F.col("lat") + F.when(F.col("kind") == "way/", _d(0.0003)).otherwise(_d(0.0))).alias("lat"),
        "lng",
        lookup.alias("lookupKey"),
        match.alias("matchKey"),
    )


def scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scanned addresses: scan_id, tour_id, seq, photo_id, mode, raw, status, createdAt, custkey."""
    o = F.col("o_orderkey")
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    # the file of the places is small beside what it holds, so they are told to shuffle
    own = spread(orders).join(places(spark, sf_dir).hint("merge"), F.col("o_custkey") == F.col("custkey"))
    street = (
        F.when(o % 17 == 0, "Nirgendwoweg")
        .when(o % 13 == 0, F.concat(F.lit("X"), F.col("street")))
        .when(o % 11 == 0, F.replace(F.col("street"), F.lit("straße"), F.lit("straBe")))
        .otherwise(F.col("street"))
    )
    house = (F.col("houseNumber").cast("long") + F.when(o % 19 == 0, 500).otherwise(0)).cast("string")
    tail = (
        F.when(o % 5 == 2, F.trim(F.concat_ws(" ", "postcode", "city")))
        .when(o % 5 == 3, F.concat(F.lit("99999 "), F.col("city")))
        .when(o % 5 == 4, F.concat((F.lit(17000) + ((F.col("nation") + 1) % 25) * 11).cast("string"), F.lit(" "), F.col("city")))
        .otherwise("")
    )
    raw = F.concat(F.lit("Anna Krüger\n"), street, F.lit(" "), house, F.when(tail != "", F.concat(F.lit("\n"), tail)).otherwise(""))
    tour, seq = F.floor(o / 40), o % 40
    photo = tour * 5 + F.floor(seq / 8)
    status = F.when(F.col("o_orderstatus") == "F", "delivered").when(F.col("o_orderstatus") == "O", "pending").otherwise("failed")
    return own.select(
        o.alias("scan_id"),
        tour.cast("long").alias("tour_id"),
        seq.cast("long").alias("seq"),
        photo.cast("long").alias("photo_id"),
        _pick(MODES, photo % 4).alias("mode"),
        raw.alias("raw"),
        status.alias("status"),
        F.col("o_orderdate").alias("createdAt"),
        "custkey",
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positioned text lines of the photos, with a route code on device photos and one title line each."""
    own = scans(spark, sf_dir).withColumn("b", F.col("seq") % 8)
    text = own.select("tour_id", "photo_id", "mode", "b", F.posexplode(F.split("raw", "\n")).alias("l", "text"))
    body = text.select("tour_id", "photo_id", "mode", (F.col("b") * 10 + F.col("l")).alias("line_no"), "text", (F.col("b") * 200 + F.col("l") * 24).cast("double").alias("top"), _d(18.0).alias("height"), _d(20.0).alias("left"), _d(300.0).alias("width"))
    code = own.filter("mode = 'device'").select("tour_id", "photo_id", "mode", (F.col("b") * 10 + 9).alias("line_no"), F.lit("81-11").alias("text"), (F.col("b") * 200 + 10).cast("double").alias("top"), _d(18.0).alias("height"), _d(400.0).alias("left"), _d(60.0).alias("width"))
    title = own.groupBy("tour_id", "photo_id", "mode").agg(F.count("*").alias("n")).select("tour_id", "photo_id", "mode", F.lit(-1).cast("long").alias("line_no"), F.lit("Tour 705").alias("text"), _d(-50.0).alias("top"), _d(18.0).alias("height"), _d(20.0).alias("left"), _d(120.0).alias("width"))
    return body.unionByName(code).unionByName(title)


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One item for each scan: tour_id, point_id, item_id, type, status, addedAt."""
    kind = item_type_of_mode(F.col("mode"))
    return scans(spark, sf_dir).select("tour_id", F.concat(F.lit("p"), F.col("tour_id").cast("string"), F.lit("_"), F.col("custkey").cast("string")).alias("point_id"), "custkey", F.col("scan_id").alias("item_id"), kind.alias("type"), "status", F.col("createdAt").alias("addedAt"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delivery points: a row for each tour and place, without coordinates for every 23rd place."""
    own = items(spark, sf_dir).groupBy("tour_id", F.col("point_id").alias("id"), "custkey").agg(F.min("addedAt").alias("createdAt"), F.bool_or(F.col("type") == "parcel").alias("has_parcel"), F.bool_and(F.col("status").isin("delivered", "failed")).alias("done"))
    own = own.join(places(spark, sf_dir).hint("merge"), "custkey")
    lookup, match = keys(F.col("street"), F.col("houseNumber"), F.lit(""), F.col("postcode"))
    seen = F.col("custkey") % 23 != 0
    return own.select("tour_id", "id", "custkey", "street", "houseNumber", "postcode", "city", lookup.alias("lookupKey"), match.alias("matchKey"), F.concat(F.lit("index:node/"), F.col("custkey").cast("string")).alias("canonicalId"), F.when(seen, F.col("lat")).alias("lat"), F.when(seen, F.col("lng")).alias("lng"), "createdAt", "has_parcel", "done")


def roads(matrices: DataFrame, *more: str) -> DataFrame:
    """(tour_id, road) and ``more``: road distances from straight ones, a flat matrix a tour; every 23rd sum of nodes has none."""
    n = F.col("n")

    def road(m: Column, x: Column) -> Column:
        i, j = F.floor(x / n), x % n
        return F.when((i + j) % 23 != 0, m * (F.lit(1.2).cast("double") + ((i * 31 + j * 17) % 10) * F.lit(0.03).cast("double")))

    return matrices.select("tour_id", F.transform("mat", road).alias("road"), *more)


def saved_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tour_id, id, rank): a saved route without every fifth point and with one unknown id."""
    from pyspark.sql.window import Window

    own = points(spark, sf_dir).select("tour_id", "id", "custkey")
    rank = F.row_number().over(Window.partitionBy("tour_id").orderBy((F.col("custkey") * 31) % 101, "custkey"))
    own = own.withColumn("rank", rank.cast("long"))
    gone = own.filter("rank = 1").select("tour_id", F.lit("gone").alias("id"), F.lit(0).cast("long").alias("rank"))
    return own.filter("rank % 5 <> 0").select("tour_id", "id", "rank").unionByName(gone)
