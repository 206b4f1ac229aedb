"""Tables of what was looked up elsewhere: places of addresses, and road distances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .keyed import read_keyed, write_keyed

CACHE = T.StructType([T.StructField("key", T.StringType()), T.StructField("lat", T.DoubleType()), T.StructField("lng", T.DoubleType())])
CACHE_FOLDERS = 64
TOURS_A_FOLDER = 64


def cache_key(match_key: Column, raw: Column) -> Column:
    """What an address is looked up by: its matchKey, else its raw text."""
    return F.coalesce(F.nullif(match_key, F.lit("")), raw, F.lit(""))


def write_geocode_cache(found: DataFrame, path: str) -> None:
    """``found`` (key, lat, lng) as a cache: one row for each key, looked up in vain included, whose coordinates are null."""
    placed = F.when(F.col("lat").isNotNull() & F.col("lng").isNotNull(), F.struct("lat", "lng"))
    # of several answers for one key, one with a place, always the same
    own = found.groupBy(F.coalesce("key", F.lit("")).alias("key")).agg(F.min(placed).alias("p"))
    write_keyed(own.select("key", "p.lat", "p.lng"), path, "key", CACHE_FOLDERS)


def cached_places(spark: SparkSession, path: str, scans: DataFrame, key: str = "scan_id") -> DataFrame:
    """(key, is_cached, lat, lng): what the cache at ``path`` says of the scans (matchKey, raw), from the folders of their keys.

    A cached null is an answer: the address was looked up in vain and need not be again.
    """
    own = scans.select(key, cache_key(F.col("matchKey"), F.col("raw")).alias("key"))
    cache = read_keyed(spark, path, CACHE, "key", CACHE_FOLDERS, own.select("key"))
    return own.join(cache.withColumn("hit", F.lit(True)), "key", "left").select(*[F.col(key)], F.coalesce("hit", F.lit(False)).alias("is_cached"), "lat", "lng")


def tour_range(tour_id: Column) -> Column:
    return F.floor(tour_id / TOURS_A_FOLDER).cast("long")


def write_roads(edges: DataFrame, path: str) -> None:
    """Road distances (tour_id, i, j, road) in a folder for each range of tours; a null distance means that j cannot be reached from i."""
    own = edges.select("tour_id", "i", "j", "road", tour_range(F.col("tour_id")).alias("tour_range"))
    # ranges of tours that follow one another, so that a folder gets one file or two, however many tasks write
    own.repartitionByRange("tour_range", "tour_id").sortWithinPartitions("tour_range", "tour_id", "i", "j").write.partitionBy("tour_range").parquet(path)


def by_range(tours: DataFrame) -> DataFrame:
    """Rows of tours with their tour_range, dealt so that a range lies in one task or two."""
    own = tours.withColumn("tour_range", tour_range(F.col("tour_id")))
    return own.repartitionByRange("tour_range", "tour_id").sortWithinPartitions("tour_range", "tour_id")


def write_road_matrices(roads: DataFrame, path: str) -> None:
    """Road matrices (tour_id, road, tour_range) in a folder for each range of tours.

    They are written where they are: what they are made from is dealt by ``by_range``, not the matrices.
    """
    roads.select("tour_id", "road", "tour_range").write.partitionBy("tour_range").parquet(path)


def read_road_matrices(spark: SparkSession, path: str, tours: DataFrame | None = None) -> DataFrame:
    """(tour_id, road) of all tours or of the given ones (column tour_id), whose folders alone are opened."""
    own = spark.read.schema("tour_id bigint, road array<double>, tour_range bigint").parquet(path)
    if tours is None:
        return own.drop("tour_range")
    some = tours.select("tour_id", tour_range(F.col("tour_id")).alias("tour_range")).distinct()
    return own.join(F.broadcast(some.select("tour_range").distinct()), "tour_range", "left_semi").join(some.select("tour_id").hint("shuffle_hash"), "tour_id", "left_semi").drop("tour_range")


def read_roads(spark: SparkSession, path: str, tours: DataFrame | None = None) -> DataFrame:
    """(tour_id, i, j, road) of all tours or of the given ones (column tour_id), whose folders alone are opened."""
    edges = spark.read.schema("tour_id bigint, i bigint, j bigint, road double, tour_range bigint").parquet(path)
    if tours is None:
        return edges.drop("tour_range")
    own = tours.select("tour_id", tour_range(F.col("tour_id")).alias("tour_range")).distinct()
    return edges.join(F.broadcast(own.select("tour_range").distinct()), "tour_range", "left_semi").join(own.select("tour_id"), "tour_id", "left_semi").drop("tour_range")
