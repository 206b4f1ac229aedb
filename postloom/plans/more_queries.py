"""Further registered queries: caches, migration, route state, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import keys
from ..operators import points as pts
from ..operators import resolve as res
from ..operators import routes, tours
from ..operators.rounds import checkpointed
from ..sources import views as V
from ..sources.shared import new_path
from ..streaming import streams
from .queries import AREA, _ordered, _parsed, _resolved_scans, query


def _cache(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("s_suppkey")
    own = V.read(spark, d, "supplier").select(s.alias("s"), V._pick(V.STREETS, s % 12).alias("street"), (s % 20 + 501).cast("string").alias("house"))
    lookup, _ = keys(F.col("street"), F.col("house"), F.lit(""), F.lit(""))
    at = lambda x: F.when(F.col("s") % 7 != 0, x)
    own = own.select("s", lookup.alias("matchKey"), at(V._d(53.0) + F.col("s") * V._d(0.01)).alias("lat"), at(V._d(12.9) + F.col("s") * V._d(0.01)).alias("lng"))
    return own.groupBy("matchKey").agg(F.min_by(F.struct("lat", "lng"), "s").alias("x")).select("matchKey", "x.lat", "x.lng")


@query
def j6_geocode_fallback(spark: SparkSession, d: str) -> DataFrame:
    own = res.geocode_fallback(_parsed(spark, d), _cache(spark, d), AREA)
    return own.groupBy("is_cached", F.col("lat").isNotNull().alias("located")).agg(F.count("*").alias("n_scans"))


@query
def p32_geocode_query_text(spark: SparkSession, d: str) -> DataFrame:
    own = _parsed(spark, d)
    return own.select("scan_id", res.geocode_query_text(*[F.col(c) for c in ("street", "houseNumber", "houseLetter", "postcode", "city", "raw")]).alias("query"))


@query
def p19_point_label(spark: SparkSession, d: str) -> DataFrame:
    own = V.points(spark, d)
    return own.select("id", pts.point_label(F.concat_ws(" ", "street", "houseNumber"), F.col("postcode"), F.col("city")).alias("label"), pts.locality_group(F.col("postcode"), F.col("city")).alias("locality"))


@query
def j14_skip_known(spark: SparkSession, d: str) -> DataFrame:
    own = _resolved_scans(spark, d)
    return pts.skip_known(own.filter("scan_id % 2 = 0"), own.filter("scan_id % 2 = 1")).select("scan_id")


@query
def j9_migrate_points(spark: SparkSession, d: str) -> DataFrame:
    old = V.points(spark, d).withColumn("canonicalId", F.lit("")).withColumn("canonicalResolved", F.lit(False)).withColumn("coordinateManual", F.col("custkey") % 5 == 0)
    out = res.migrate_points(old, V.gazetteer(spark, d))
    return out.select("id", "canonicalId", "canonicalResolved")


@query
def r7_provider_ladder(spark: SparkSession, d: str) -> DataFrame:
    own = V.points(spark, d).groupBy("tour_id").agg(F.count("*").alias("stops"))
    t = F.col("tour_id")
    return tours.provider_ladder(own.select("tour_id", "stops", (t % 3 == 0).alias("optimized"), (t % 2 == 0).alias("road"), (t % 5 == 0).alias("trip")))


@query
def r6_apply_external_order(spark: SparkSession, d: str) -> DataFrame:
    jobs = routes.export_jobs(V.points(spark, d).withColumn("priority", F.lit(False)).withColumn("group", F.lit("")))
    w = Window.partitionBy("tour_id").orderBy(F.col("job").desc())
    steps = jobs.filter("not (tour_id % 4 = 0 and job = 1)").select("tour_id", F.row_number().over(w).alias("step"), F.lit("job").alias("type"), "job")
    return routes.apply_external_order(jobs.select("tour_id", "job", "id"), steps)


@query
def w7_stale_routes(spark: SparkSession, d: str) -> DataFrame:
    own = _ordered(spark, d)
    now, lengths = routes.route_signature(own, V.BASE_LAT, V.BASE_LNG), routes.loop_length(own, V.BASE_LAT, V.BASE_LNG)
    t = F.col("tour_id")
    state = now.select("tour_id", F.when(t % 2 == 0, F.col("signature")).otherwise("old").alias("geoSig"), F.when(t % 5 == 0, "legacy").otherwise("osrm").alias("provider"), (t * 1.0 + 1000.0).cast("double").alias("totalMeters"))
    return routes.stale_routes(state, now, lengths).select("tour_id", F.round("meters").cast("long").alias("meters"), "stale")


@query
def r10_push_route(spark: SparkSession, d: str) -> DataFrame:
    all_ = V.points(spark, d).select("tour_id").distinct()
    current = all_.select("tour_id", F.lit("osrm").alias("provider"), F.lit(1).alias("version"))
    previous = all_.filter("tour_id % 3 = 0").select("tour_id", F.lit("ors").alias("provider"), F.lit(0).alias("version"))
    built = all_.filter("tour_id % 2 = 0").select("tour_id", F.lit("straight").alias("provider"), F.lit(2).alias("version"))
    return routes.restore_previous(routes.push_route(current, previous, built))


@query
def o5_legacy_order(spark: SparkSession, d: str) -> DataFrame:
    own = V.points(spark, d).withColumn("routeOrder", F.when(F.col("custkey") % 4 != 0, F.col("custkey") % 7))
    state = own.filter("tour_id % 2 = 0").select("tour_id", F.lit("current").alias("slot")).distinct()
    return routes.legacy_order(own, state).select("tour_id", F.array_join("order", ",").alias("ids"))


@query
def t2_stream_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """The scans, a minute apart, as files through the stream; the kept places.  A tour's scans lie within the watermark."""
    source, out, mark = (new_path(spark, f"t2-{x}") for x in ("in", "out", "mark"))
    rows = _resolved_scans(spark, d).select("scan_id", "tour_id", "resolved", "canonicalId", "lookupKey", "postcode", F.timestamp_seconds(F.col("scan_id") * 60 + 1_700_000_000).alias("ts"))
    streams.write_as_it_comes(checkpointed(rows), source)
    kept = streams.deduped(streams.file_stream(spark, source, rows.schema, 1), "1 hour")
    streams.run_to_end(kept.select("tour_id", "place"), lambda b, i: b.write.mode("overwrite").parquet(f"{out}/batch={i}"), mark)
    return spark.read.parquet(out).select("tour_id", "place")


def streamed_status(spark: SparkSession, d: str) -> DataFrame:
    """Each item's state after all events went through the stream as they came."""
    source, out, mark = (new_path(spark, f"t3-{x}") for x in ("in", "out", "mark"))
    rows = V.read(spark, d, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    streams.write_as_it_comes(rows, source)
    changes = streams.status_changes(streams.file_stream(spark, source, rows.schema, 1))
    streams.run_to_end(changes, lambda b, i: b.write.mode("overwrite").parquet(f"{out}/batch={i}"), mark, "update")
    return streams.merged_status(spark.read.parquet(out))


@query
def t3_stream_status(spark: SparkSession, d: str) -> DataFrame:
    """The events as a stream; each item's state after the last one."""
    return streamed_status(spark, d).select("item_id", "status", F.col("deliveredAt").cast("timestamp_ntz").alias("deliveredAt"))


@query
def t4_live_totals(spark: SparkSession, d: str) -> DataFrame:
    """The totals of every tour with the states that the stream of events left."""
    return streams.live_counts(V.points(spark, d), V.items(spark, d), streamed_status(spark, d))
