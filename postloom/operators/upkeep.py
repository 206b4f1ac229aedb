"""Keeping points, bases and routes right: manual fixes, revalidated coordinates, corrections, route state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import params as P
from ..functions.geo import within_area
from .parse import parse_address, with_context
from .resolve import resolve


def record_gps(points: DataFrame, fixes: DataFrame) -> DataFrame:
    """Points with the latest manual fix of each: coordinates set by hand, no longer suspicious.

    ``fixes``: id, ts, lat, lng, accuracy (metres).  Of fixes of one time the one with the least
    coordinates counts; fixes of unknown points do nothing.  Adds coordinateManual,
    coordinateSuspicious, geocodeStatus and coordinateAccuracyM where ``points`` lacks them.
    """
    last = fixes.groupBy("id").agg(F.max_by(F.struct("lat", "lng", "accuracy"), F.struct("ts", -F.col("lat"), -F.col("lng"))).alias("_fix"))
    for name, default in (("coordinateManual", F.lit(False)), ("coordinateSuspicious", F.lit(False)), ("geocodeStatus", F.lit("notfound")), ("coordinateAccuracyM", F.lit(None).cast("long"))):
        points = points if name in points.columns else points.withColumn(name, default)
    own = points.join(last, "id", "left")
    hit = F.col("_fix").isNotNull()
    made = {
        "lat": F.col("_fix.lat"),
        "lng": F.col("_fix.lng"),
        "coordinateManual": F.lit(True),
        "coordinateSuspicious": F.lit(False),
        "geocodeStatus": F.lit("manual"),
        "coordinateAccuracyM": F.round("_fix.accuracy").cast("long"),
    }
    return own.select(*[F.when(hit, made[c]).otherwise(F.col(c)).alias(c) if c in made else F.col(c) for c in points.columns])


def area_center(limited: Column, lat: Column, lng: Column, base_lat: Column, base_lng: Column, radius: Column) -> Column:
    """The centre and radius of the search area: the chosen place, else the base; null without a limit or either place."""
    chosen, base = lat.isNotNull() & lng.isNotNull(), base_lat.isNotNull() & base_lng.isNotNull()
    place = F.struct(F.when(chosen, lat).otherwise(base_lat).alias("lat"), F.when(chosen, lng).otherwise(base_lng).alias("lng"), F.coalesce(radius, F.lit(P.AREA_RADIUS_KM)).alias("radius_km"))
    return F.when(limited & (chosen | base), place)


def revalidate_coords(points: DataFrame, cache: DataFrame, area: P.Area | None) -> DataFrame:
    """(id, lat, lng, geocodeStatus): points without postcode that lie outside the area take the cached
    coordinates if those are inside, else none; then points without coordinates are filled from the cache.

    ``cache``: matchKey, lat, lng, one row a key, null coordinates for what was looked up in vain.
    """
    known = cache.select("matchKey", F.col("lat").alias("c_lat"), F.col("lng").alias("c_lng"))
    own = points.select("id", "matchKey", F.coalesce("postcode", F.lit("")).alias("postcode"), "lat", "lng").join(known, "matchKey", "left")
    has = F.col("lat").isNotNull() & F.col("lng").isNotNull()
    usable = F.col("c_lat").isNotNull() & F.col("c_lng").isNotNull() & ((F.col("postcode") != "") | within_area(F.col("c_lat"), F.col("c_lng"), area))
    stray = has & (F.col("postcode") == "") & ~within_area(F.col("lat"), F.col("lng"), area)
    take, keep = usable & (stray | ~has), has & ~stray
    at = lambda c: F.when(keep, F.col(c)).when(take, F.col(f"c_{c}"))
    status = F.when(keep, "kept").when(take, "cached").otherwise("notfound")
    return own.select("id", at("lat").alias("lat"), at("lng").alias("lng"), status.alias("geocodeStatus"))


def resolve_base(bases: DataFrame, gaz: DataFrame, cache: DataFrame) -> DataFrame:
    """(base_id, lat, lng, source): an exact index hit, else the earlier place if the text is unchanged, else the cache.

    ``bases``: base_id, matchKey, text, old_text, old_lat, old_lng.
    """
    exact = gaz.filter("matchKey <> ''").groupBy("matchKey").agg(F.min_by(F.struct("lat", "lng"), "id").alias("hit"))
    known = cache.groupBy("matchKey").agg(F.first(F.struct("lat", "lng")).alias("cached"))
    own = bases.join(exact, "matchKey", "left").join(known, "matchKey", "left")
    same = (F.col("text") == F.col("old_text")) & F.col("old_lat").isNotNull() & F.col("old_lng").isNotNull()
    at = lambda c: F.coalesce(F.col(f"hit.{c}"), F.when(same, F.col(f"old_{c}")), F.col(f"cached.{c}"))
    source = F.when(F.col("hit.lat").isNotNull(), "index").when(same, "unchanged").when(F.col("cached.lat").isNotNull(), "cache").otherwise("none")
    return own.select("base_id", at("lat").alias("lat"), at("lng").alias("lng"), source.alias("source"))


def apply_corrections(scans: DataFrame, corrections: DataFrame, gaz: DataFrame, key: str = "scan_id") -> DataFrame:
    """(key, outcome, canonicalId, record_id, selected): corrected scans, parsed with the locality known before and resolved again.

    ``scans``: key, postcode, city.  ``corrections``: key, line (street and house).  Only corrected
    scans run; those still ambiguous are not selected.
    """
    edited = scans.select(key, F.col("postcode").alias("old_pc"), F.col("city").alias("old_city")).join(corrections.select(key, "line"), key)
    parsed = parse_address(edited.select(key, with_context(F.col("line"), F.col("old_pc"), F.col("old_city")).alias("raw")))
    return resolve(parsed, gaz, key).select(key, "outcome", "canonicalId", "record_id", (F.col("outcome") != "ambiguous").alias("selected"))


def manual_reorder(state: DataFrame, orders: DataFrame) -> DataFrame:
    """Route state after a reorder by hand: the current route takes the new order, the previous one stays.

    ``state``: tour_id, slot, order, manual.  ``orders``: tour_id, order.
    """
    own = state.join(orders.select("tour_id", F.col("order").alias("_new")), "tour_id", "left")
    hit = (F.col("slot") == "current") & F.col("_new").isNotNull()
    return own.select("tour_id", "slot", F.when(hit, F.col("_new")).otherwise(F.col("order")).alias("order"), (F.col("manual") | hit).alias("manual"))


def write_route_state(state: DataFrame, path: str) -> None:
    state.write.mode("overwrite").parquet(path)


def read_route_state(stored: DataFrame, tours: DataFrame) -> DataFrame:
    """(tour_id, slot, order, manual) of both slots of every tour; a slot that was never written has no order."""
    slots = tours.select("tour_id").distinct().select("tour_id", F.explode(F.array(F.lit("current"), F.lit("previous"))).alias("slot"))
    return slots.join(stored, ["tour_id", "slot"], "left").select("tour_id", "slot", "order", F.coalesce("manual", F.lit(False)).alias("manual"))
