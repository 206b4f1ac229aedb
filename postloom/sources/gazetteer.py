"""Building, loading and writing the gazetteer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import lookup_from_match
from ..operators.parse import parse_address

OSM_SCHEMA = "elements array<struct<type: string, id: bigint, lat: double, lon: double, center: struct<lat: double, lon: double>, tags: map<string, string>>>"


def read_osm(spark: SparkSession, path: str) -> DataFrame:
    """Elements of map dumps in JSON, one row each."""
    return spark.read.schema(OSM_SCHEMA).option("multiLine", True).json(path).select(F.explode("elements").alias("e")).select("e.*")


def build_gazetteer(osm: DataFrame) -> DataFrame:
    """Address records from map elements, the first of each id.

    The street is addr:street, else addr:place; rows without street, house number or coordinates
    go, rows without postcode stay.
    """
    tag = lambda k: F.nullif(F.try_element_at("tags", F.lit(k)), F.lit(""))
    own = osm.select(
        F.coalesce("type", F.lit("")).alias("osmType"),
        F.col("id").alias("osmId"),
        F.coalesce("lat", "center.lat").alias("lat"),
        F.coalesce("lon", "center.lon").alias("lng"),
        F.coalesce(tag("addr:street"), tag("addr:place")).alias("name"),
        F.when(tag("addr:street").isNotNull(), "street").otherwise("place").alias("addressKind"),
        tag("addr:housenumber").alias("house"),
        F.coalesce(tag("addr:postcode"), F.lit("")).alias("pc"),
        F.coalesce(tag("addr:city"), F.lit("")).alias("town"),
    ).filter("name is not null and house is not null and lat is not null and lng is not null")
    raw = F.trim(F.concat("name", F.lit(" "), "house", F.lit("\n"), "pc", F.lit(" "), "town"))
    own = parse_address(own.withColumn("raw", raw)).filter("lookupKey <> ''")
    key = F.concat(F.when(F.col("matchKey") != "", F.col("matchKey")).otherwise(F.col("lookupKey")), F.lit("@"), F.col("lat").cast("string"), F.lit(","), F.col("lng").cast("string"))
    ident = F.when((F.col("osmType") != "") & F.col("osmId").isNotNull(), F.concat("osmType", F.lit("/"), F.col("osmId").cast("string"))).otherwise(key)
    out = own.select(ident.alias("id"), "osmType", "osmId", "matchKey", "lookupKey", "addressKind", F.col("name").alias("street"), F.concat("houseNumber", "houseLetter").alias("houseNumber"), F.col("pc").alias("postcode"), F.col("town").alias("city"), "lat", "lng")
    # repeated elements are alike; the least row stands for the first
    w = Window.partitionBy("id").orderBy("lookupKey", "matchKey", "lat", "lng")
    return out.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def load_gazetteer(records: DataFrame, order: str = "row_no") -> DataFrame:
    """Older index rows with keys, kind and id filled in; an id seen before gets its row number."""
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    own = records.withColumn("lookupKey", F.coalesce(blank("lookupKey"), lookup_from_match(F.col("matchKey")))).withColumn("addressKind", F.coalesce(blank("addressKind"), F.lit("street")))
    synthetic = F.concat(F.coalesce(blank("matchKey"), "lookupKey"), F.lit("@"), F.col("lat").cast("string"), F.lit(","), F.col("lng").cast("string"))
    osm = F.when(blank("osmType").isNotNull() & F.col("osmId").isNotNull(), F.concat("osmType", F.lit("/"), F.col("osmId").cast("string")))
    own = own.withColumn("id", F.coalesce(blank("id"), osm, synthetic))
    w = Window.partitionBy("id").orderBy(order)
    return own.withColumn("_n", F.row_number().over(w)).withColumn("id", F.when(F.col("_n") > 1, F.concat("id", F.lit("#"), F.col(order).cast("string"))).otherwise(F.col("id"))).drop("_n")


def write_gazetteer(gaz: DataFrame, table: str, path: str | None = None, buckets: int = 64) -> None:
    """The finished index as a table, bucketed and sorted by lookupKey: joins on it read it without a shuffle.

    ``path``: where its files lie, if not where the catalog puts them.
    """
    writer = gaz.write.format("parquet").mode("overwrite").bucketBy(buckets, "lookupKey").sortBy("lookupKey")
    (writer.option("path", path) if path else writer).saveAsTable(table)


def read_gazetteer(spark: SparkSession, table: str) -> DataFrame:
    return spark.table(table)
