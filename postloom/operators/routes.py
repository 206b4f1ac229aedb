"""Routes: stop order, closed length, signatures, state and stop checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import params as P
from ..functions.geo import haversine_m


def order_by_route(points: DataFrame, saved: DataFrame) -> DataFrame:
    """(tour_id, id, position): saved rank first, the rest by createdAt, then id."""
    own = points.select("tour_id", "id", "createdAt").join(saved, ["tour_id", "id"], "left")
    w = Window.partitionBy("tour_id").orderBy(F.col("rank").asc_nulls_last(), "createdAt", "id")
    return own.select("tour_id", "id", F.row_number().over(w).cast("long").alias("position"))


def reorder_from_saved(points: DataFrame, saved: DataFrame) -> DataFrame:
    """(tour_id, id, position) of the points still to visit: saved order, then the new ones by createdAt."""
    active = points.filter("lat is not null and lng is not null and not done")
    first = saved.groupBy("tour_id", "id").agg(F.min("rank").alias("rank"))
    return order_by_route(active, first)


def loop_length(stops: DataFrame, base_lat: float, base_lng: float, order: str = "position") -> DataFrame:
    """(tour_id, meters): closed length from the base over the stops in order; stops without coordinates are skipped."""
    own = stops.filter("lat is not null and lng is not null")
    w = Window.partitionBy("tour_id").orderBy(order)
    here = haversine_m(F.lag("lat", 1, base_lat).over(w), F.lag("lng", 1, base_lng).over(w), F.col("lat"), F.col("lng"))
    last = F.when(F.lead("lat").over(w).isNull(), haversine_m(F.col("lat"), F.col("lng"), F.lit(base_lat), F.lit(base_lng))).otherwise(0.0)
    own = own.withColumn("leg", here + last)
    found = own.groupBy("tour_id").agg(F.sum("leg").alias("m"))
    return stops.select("tour_id").distinct().join(found, "tour_id", "left").select("tour_id", F.coalesce("m", F.lit(0.0)).alias("meters"))


def _five(lat: Column, lng: Column) -> Column:
    whole = lambda c: F.floor(c * 100000 + 0.5).cast("string")
    return F.when(lat.isNull() | lng.isNull(), "-").otherwise(F.concat(whole(lat), F.lit(","), whole(lng)))


def route_signature(stops: DataFrame, base_lat: float, base_lng: float, order: str = "position") -> DataFrame:
    """(tour_id, signature): base and stops in order, coordinates to five decimals."""
    part = F.struct(F.col(order).alias("o"), F.concat("id", F.lit(":"), _five(F.col("lat"), F.col("lng"))).alias("s"))
    all_ = F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["s"]), "|")
    base = F.concat(_five(F.lit(base_lat), F.lit(base_lng)), F.lit("#"))
    return stops.groupBy("tour_id").agg(F.concat(base, all_).alias("signature"))


def stale_routes(state: DataFrame, now: DataFrame, lengths: DataFrame) -> DataFrame:
    """(tour_id, meters, stale): the saved length while its signature holds, else the new one.

    ``state``: tour_id, geoSig, provider, totalMeters.
    """
    own = state.join(now, "tour_id").join(lengths, "tour_id")
    holds = (F.col("geoSig") == F.col("signature")) & (F.col("provider") != "legacy") & (F.col("totalMeters") > 0)
    return own.select("tour_id", F.when(holds, F.col("totalMeters")).otherwise(F.col("meters")).alias("meters"), (~F.coalesce(holds, F.lit(False))).alias("stale"))


def push_route(current: DataFrame, previous: DataFrame, built: DataFrame) -> DataFrame:
    """Route state after a build: tour_id, slot and the route's columns; what was current is previous."""
    moved = current.join(built.select("tour_id"), "tour_id", "left_semi").withColumn("slot", F.lit("previous"))
    same_now = current.join(built.select("tour_id"), "tour_id", "left_anti").withColumn("slot", F.lit("current"))
    same_before = previous.join(moved.select("tour_id"), "tour_id", "left_anti").withColumn("slot", F.lit("previous"))
    return built.withColumn("slot", F.lit("current")).unionByName(moved).unionByName(same_now).unionByName(same_before)


def restore_previous(state: DataFrame) -> DataFrame:
    """Swaps the slots of every tour that has a previous route."""
    both = Window.partitionBy("tour_id")
    other = F.when(F.col("slot") == "current", "previous").otherwise("current")
    return state.withColumn("_p", F.bool_or(F.col("slot") == "previous").over(both)).withColumn("slot", F.when(F.col("_p"), other).otherwise(F.col("slot"))).drop("_p")


def legacy_order(points: DataFrame, state: DataFrame) -> DataFrame:
    """(tour_id, order): points with an old rank, as the current route of tours that have none."""
    own = points.filter("routeOrder is not null and not isnan(cast(routeOrder as double))")
    order = F.transform(F.array_sort(F.collect_list(F.struct("routeOrder", "id"))), lambda x: x["id"])
    return own.groupBy("tour_id").agg(order.alias("order")).join(state.filter("slot = 'current'").select("tour_id"), "tour_id", "left_anti")


def prepare_stops(points: DataFrame, priority: bool = True) -> DataFrame:
    """Stops of the route: with coordinates and not done; parcels first if asked, grouped by locality."""
    from .points import locality_group

    own = points.filter("lat is not null and lng is not null and not done")
    first = F.col("has_parcel") if priority else F.lit(False)
    return own.select("tour_id", "id", "lat", "lng", first.alias("priority"), locality_group(F.col("postcode"), F.col("city")).alias("group"))


def tour_summary(points: DataFrame, lengths: DataFrame) -> DataFrame:
    """Stops, skipped and delivered points, kilometres of each tour; the three kinds of points do not overlap."""
    seen = F.col("lat").isNotNull() & F.col("lng").isNotNull()
    own = points.groupBy("tour_id").agg(F.count_if(seen & ~F.col("done")).alias("stops"), F.count_if(~seen & ~F.col("done")).alias("skipped"), F.count_if(seen & F.col("done")).alias("delivered"))
    return own.join(lengths, "tour_id", "left").select("tour_id", "stops", "skipped", "delivered", F.round(F.coalesce("meters", F.lit(0.0)) / 1000, 1).alias("km"))


def validate_stops(stops: DataFrame) -> DataFrame:
    """Each stop with the reason it is refused (null: accepted), and its cleaned priority and group.

    ``stops``: tour_id, job, lat, lng, priority, group.
    """
    w = Window.partitionBy("tour_id")
    twice = F.count("*").over(Window.partitionBy("tour_id", "job")) > 1
    n = F.count("*").over(w)
    ok = F.col("lat").between(-90, 90) & F.col("lng").between(-180, 180) & ~F.isnan("lat") & ~F.isnan("lng")
    reason = F.when(n > P.MAX_JOBS, "too many stops").when(F.col("job").isNull() | (F.col("job") <= 0), "bad id").when(twice, "repeated id").when(~F.coalesce(ok, F.lit(False)), "bad location")
    group = F.trim("group")
    return stops.select("tour_id", "job", reason.alias("reason"), F.when(F.col("priority").between(0, 100), F.col("priority")).alias("priority"), F.when((group != "") & (F.length(group) <= P.MAX_GROUP_CHARS), group).alias("group"))


def export_jobs(stops: DataFrame, priority: bool = True) -> DataFrame:
    """(tour_id, job, id, location, priority, group): numbered jobs for a route provider."""
    usable = stops.filter("lat is not null and lng is not null")
    job = F.row_number().over(Window.partitionBy("tour_id").orderBy("id"))
    first = F.when(F.col("priority"), 100) if priority else F.lit(None).cast("int")
    return usable.select("tour_id", job.cast("long").alias("job"), "id", F.array("lng", "lat").alias("location"), first.alias("priority"), F.nullif("group", F.lit("")).alias("group"))


def export_requests(stops: DataFrame, base_lat: float, base_lng: float, priority: bool = True) -> DataFrame:
    """(tour_id, request, skipped): the request in JSON, jobs and one vehicle from base to base, and the ids without coordinates.

    A tour without a usable stop has no request.
    """
    jobs = export_jobs(stops, priority)
    job = F.struct(F.col("job").alias("id"), "location", "priority", "group")
    base = F.array(F.lit(base_lng), F.lit(base_lat))
    vehicle = F.struct(F.lit(1).alias("id"), F.lit("driving-car").alias("profile"), base.alias("start"), base.alias("end"))
    made = jobs.groupBy("tour_id").agg(F.to_json(F.struct(F.array_sort(F.collect_list(job)).alias("jobs"), F.array(vehicle).alias("vehicles"))).alias("request"))
    out = F.when(F.col("lat").isNull() | F.col("lng").isNull(), F.col("id"))
    skipped = stops.groupBy("tour_id").agg(F.array_sort(F.collect_list(out)).alias("skipped"))
    return skipped.join(made, "tour_id", "left").select("tour_id", "request", "skipped")


def external_or_planned(external: DataFrame, planned: DataFrame) -> DataFrame:
    """(tour_id, id, position, provider): a complete order from outside, else the planned one.

    ``external``: rows of ``apply_external_order``; one with missing or unassigned stops is refused whole.
    """
    good = external.filter("complete").select("tour_id", "id", "position", F.lit("ors").alias("provider"))
    rest = planned.join(good.select("tour_id").distinct(), "tour_id", "left_anti")
    return good.unionByName(rest.select("tour_id", "id", "position", "provider"))


def apply_external_order(stops: DataFrame, steps: DataFrame) -> DataFrame:
    """(tour_id, id, position, complete): a provider's order of job numbers; complete if no stop is missing.

    ``stops``: tour_id, job, id.  ``steps``: tour_id, step, type, job.
    """
    own = steps.filter("type = 'job'").join(stops, ["tour_id", "job"])
    position = F.row_number().over(Window.partitionBy("tour_id").orderBy("step"))
    got = own.groupBy("tour_id").agg(F.countDistinct("job").alias("got"))
    want = stops.groupBy("tour_id").agg(F.count("*").alias("want"))
    full = want.join(got, "tour_id", "left").select("tour_id", (F.coalesce("got", F.lit(0)) == F.col("want")).alias("complete"))
    return own.select("tour_id", "id", position.cast("long").alias("position")).join(full, "tour_id")


def consolidate_localities(stops: DataFrame, base_lat: float, base_lng: float) -> DataFrame:
    """(tour_id, id, position): stops of a locality side by side, unless that makes the loop too long.

    ``stops``: tour_id, id, lat, lng, group, position.
    """
    name = F.when(F.coalesce(F.col("group"), F.lit("")) == "", F.concat(F.lit("single:"), F.col("id"))).otherwise(F.col("group"))
    own = stops.withColumn("_g", name).withColumn("_first", F.min("position").over(Window.partitionBy("tour_id", "_g")))
    own = own.withColumn("grouped", F.row_number().over(Window.partitionBy("tour_id").orderBy("_first", "position")).cast("long"))
    before = loop_length(own, base_lat, base_lng).withColumnRenamed("meters", "m0")
    after = loop_length(own, base_lat, base_lng, "grouped").withColumnRenamed("meters", "m1")
    both = own.join(before, "tour_id").join(after, "tour_id")
    take = F.col("m1") <= F.col("m0") * P.GROUP_FACTOR + P.GROUP_METERS
    return both.select("tour_id", "id", F.when(take, F.col("grouped")).otherwise(F.col("position")).alias("position"))


def tour_path(stops: DataFrame, base_lat: float, base_lng: float, order: str = "position") -> DataFrame:
    """(tour_id, line, box): the closed path as GeoJSON and its bounding box with 15 % around."""
    seen = stops.filter("lat is not null and lng is not null")
    base = F.array(F.lit(base_lng), F.lit(base_lat))
    at = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.array("lng", "lat").alias("p")))), lambda x: x["p"])
    own = seen.groupBy("tour_id").agg(at.alias("mid"), *[f(c).alias(f"{n}_{c}") for c in ("lat", "lng") for f, n in ((F.min, "lo"), (F.max, "hi"))])
    line = F.to_json(F.struct(F.lit("LineString").alias("type"), F.concat(F.array(base), "mid", F.array(base)).alias("coordinates")))
    edges = []
    for c, b in (("lat", base_lat), ("lng", base_lng)):
        lo, hi = F.least(F.col(f"lo_{c}"), F.lit(b)), F.greatest(F.col(f"hi_{c}"), F.lit(b))
        edges += [(lo - (hi - lo) * 0.15).alias(f"south_{c}"), (hi + (hi - lo) * 0.15).alias(f"north_{c}")]
    return own.select("tour_id", line.alias("line"), *edges)
