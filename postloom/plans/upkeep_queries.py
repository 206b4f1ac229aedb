"""Registered queries of points, bases, corrections and route state, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import points as pts
from ..operators import resolve as res
from ..operators import upkeep
from ..operators.parse import with_context
from ..operators.rounds import checkpointed
from ..sources import views as V
from ..sources import views_sql as S
from ..sources.shared import new_path
from .more_queries import streamed_status
from .more_queries import _cache
from .oracles import CACHE, INSIDE, ORACLES, OUTLIERS_ONLY, RESOLVED, STATUS
from .queries import AREA, _ordered, _parsed, query


@query
def r11_record_gps(spark: SparkSession, d: str) -> DataFrame:
    own = V.points(spark, d).select("id", "custkey", "lat", "lng", F.col("createdAt").cast("timestamp_ntz").alias("ts"))
    some = own.filter("custkey % 6 = 0")
    fix = lambda days, shift: some.select("id", (F.col("ts") + F.expr(f"interval {days} day")).alias("ts"), (V._d(53.0) + F.col("custkey") * V._d(0.001) + V._d(shift)).alias("lat"), (V._d(12.0) + F.col("custkey") * V._d(0.001)).alias("lng"), (F.col("custkey") % 50 + V._d(0.4)).alias("accuracy"))
    out = upkeep.record_gps(own.drop("ts"), fix(1, 0.0).unionByName(fix(2, 0.5)))
    return out.select("id", "lat", "lng", "coordinateManual", "coordinateSuspicious", "geocodeStatus", F.coalesce("coordinateAccuracyM", F.lit(-1)).alias("coordinateAccuracyM"))


@query
def p31_area_center(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("s_suppkey")
    at = F.when(s % 2 == 0, V._d(53.0) + s * V._d(0.01))
    place = upkeep.area_center(s % 3 != 0, at, at, F.when(s % 5 != 0, V._d(V.BASE_LAT)), F.when(s % 5 != 0, V._d(V.BASE_LNG)), F.when(s % 4 == 0, V._d(15.0)))
    return V.read(spark, d, "supplier").select(s.alias("base_id"), place.alias("c")).select("base_id", "c.lat", "c.lng", "c.radius_km")


@query
def r9_revalidate_coords(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("custkey")
    own = V.points(spark, d).withColumn("matchKey", F.concat(F.substring_index("lookupKey", "|", 1), F.lit("|"), (k % 20 + 501).cast("string")))
    return upkeep.revalidate_coords(own, _cache(spark, d), AREA)


@query
def j19_resolve_base(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("custkey")
    own = V.gazetteer(spark, d).filter("id like 'node/%'").withColumn("custkey", F.substring("id", 6, 20).cast("long"))
    key = F.when(k % 3 == 0, F.col("matchKey")).otherwise(F.concat(F.substring_index("lookupKey", "|", 1), F.lit("|"), (k % 20 + 501).cast("string")))
    bases = own.select(k.alias("base_id"), key.alias("matchKey"), F.lit("a").alias("text"), F.when(k % 4 == 0, "a").otherwise("b").alias("old_text"), F.col("lat").alias("old_lat"), F.col("lng").alias("old_lng"))
    return upkeep.resolve_base(bases, V.gazetteer(spark, d), _cache(spark, d)).select("base_id", F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"), "source")


@query
def j18_apply_corrections(spark: SparkSession, d: str) -> DataFrame:
    """Scans of a misspelt street, corrected to the street of their customer, which the index has."""
    own = _parsed(spark, d, True)
    right = V.gazetteer(spark, d).filter("id like 'node/%'").select(F.substring("id", 6, 20).cast("long").alias("custkey"), F.concat_ws(" ", F.col("street"), F.col("houseNumber")).alias("line"))
    corrections = own.filter("scan_id % 13 = 0 and scan_id % 17 <> 0").select("scan_id", "custkey").join(right, "custkey").select("scan_id", "line")
    return upkeep.apply_corrections(own, corrections, V.gazetteer(spark, d)).groupBy("scan_id", "outcome", "selected").agg(F.count("record_id").alias("n_records"), F.min("record_id").alias("first_id"))


@query
def j17_apply_choices(spark: SparkSession, d: str) -> DataFrame:
    """Every ambiguous scan closed by its first candidate."""
    own, gaz = _parsed(spark, d, True), V.gazetteer(spark, d)
    choices = res.first_candidates(own, gaz)
    return res.apply_choices(own.select("scan_id", "lookupKey"), choices, gaz, res.outliers(gaz)).select("scan_id", "canonicalId", "postcode", "city", "matchKey", "confidence")


def _route_state(spark: SparkSession, d: str) -> DataFrame:
    order = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "id"))), lambda x: x["id"]), ",")
    own = _ordered(spark, d).groupBy("tour_id").agg(order.alias("order"))
    now = own.select("tour_id", F.lit("current").alias("slot"), "order", F.lit(False).alias("manual"))
    return now.unionByName(own.filter("tour_id % 3 = 0").select("tour_id", F.lit("previous").alias("slot"), F.md5("order").alias("order"), F.lit(True).alias("manual")))


@query
def r10_manual_reorder(spark: SparkSession, d: str) -> DataFrame:
    state = checkpointed(_route_state(spark, d))
    orders = state.filter("slot = 'current' and tour_id % 2 = 0").select("tour_id", F.reverse("order").alias("order"))
    return upkeep.manual_reorder(state, orders).select("tour_id", "slot", F.md5("order").alias("order_md5"), "manual")


@query
def s8_route_state(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "routes")
    upkeep.write_route_state(_route_state(spark, d).filter("tour_id % 4 <> 0"), path)
    back = upkeep.read_route_state(spark.read.parquet(path), V.points(spark, d))
    return back.select("tour_id", "slot", F.md5("order").alias("order_md5"), "manual")


@query
def t4_stream_counts(spark: SparkSession, d: str) -> DataFrame:
    """Items by the state that their last event left, after all events went through the stream."""
    return streamed_status(spark, d).groupBy("status").agg(F.count("*").alias("n"))


@query
def s6_upsert_points(spark: SparkSession, d: str) -> DataFrame:
    own = V.points(spark, d).select("id", "custkey", "city")
    changed = own.filter("custkey % 4 = 0").withColumn("city", F.upper("city"))
    added = own.filter("custkey % 7 = 0").withColumn("id", F.concat(F.lit("new"), "id"))
    return pts.upsert(own, changed.unionByName(added))


@query
def s7_replace_merged(spark: SparkSession, d: str) -> DataFrame:
    own = V.points(spark, d).select("id", "custkey", "city")
    return pts.replace_merged(own, own.filter("custkey % 5 = 0").withColumn("city", F.lit("merged")), own.filter("custkey % 5 = 1"))


@query
def p20_with_context(spark: SparkSession, d: str) -> DataFrame:
    return V.points(spark, d).select("id", with_context(F.concat_ws(" ", "street", "houseNumber"), F.col("postcode"), F.col("city")).alias("text"))


FIXES = "CAST(53.0 AS DOUBLE) + custkey * CAST(0.001 AS DOUBLE) + CAST(0.5 AS DOUBLE)"
CACHE_KEY = """split_part("lookupKey", '|', 1) || '|' || (custkey % 20 + 501)"""
STATE = """ordered0 AS (SELECT p.tour_id, p.id, row_number() OVER (PARTITION BY p.tour_id ORDER BY s.rank ASC NULLS LAST, "createdAt", p.id) AS position FROM points p LEFT JOIN saved s ON s.tour_id = p.tour_id AND s.id = p.id),
o AS (SELECT tour_id, string_agg(id, ',' ORDER BY position) AS ord FROM ordered0 GROUP BY tour_id),
st AS (SELECT tour_id, 'current' AS slot, ord, false AS manual FROM o UNION ALL SELECT tour_id, 'previous', md5(ord), true FROM o WHERE tour_id % 3 = 0)"""

ORACLES |= {
    "r11_record_gps": f"""WITH {S.POINTS} SELECT id, CASE WHEN custkey % 6 = 0 THEN {FIXES} ELSE lat END AS lat, CASE WHEN custkey % 6 = 0 THEN CAST(12.0 AS DOUBLE) + custkey * CAST(0.001 AS DOUBLE) ELSE lng END AS lng,
      custkey % 6 = 0 AS "coordinateManual", false AS "coordinateSuspicious", CASE WHEN custkey % 6 = 0 THEN 'manual' ELSE 'notfound' END AS "geocodeStatus", CASE WHEN custkey % 6 = 0 THEN custkey % 50 ELSE -1 END AS "coordinateAccuracyM" FROM points""",
    "p31_area_center": """WITH x AS (SELECT s_suppkey AS s, s_suppkey % 3 <> 0 AND (s_suppkey % 2 = 0 OR s_suppkey % 5 <> 0) AS ok FROM supplier)
      SELECT s AS base_id, CASE WHEN ok THEN CASE WHEN s % 2 = 0 THEN CAST(53.0 AS DOUBLE) + s * CAST(0.01 AS DOUBLE) ELSE CAST(53.6 AS DOUBLE) END END AS lat, CASE WHEN ok THEN CASE WHEN s % 2 = 0 THEN CAST(53.0 AS DOUBLE) + s * CAST(0.01 AS DOUBLE) ELSE CAST(13.3 AS DOUBLE) END END AS lng,
      CASE WHEN ok THEN CASE WHEN s % 4 = 0 THEN CAST(15 AS DOUBLE) ELSE CAST(40 AS DOUBLE) END END AS radius_km FROM x""",
    "r9_revalidate_coords": f"""WITH {S.POINTS}, {CACHE}, p AS (SELECT id, postcode, lat, lng, {CACHE_KEY} AS mk FROM points),
      inside AS (SELECT p.id, p.postcode, p.lat, p.lng, c.lat AS c_lat, c.lng AS c_lng, {INSIDE.replace("abs(lat ", "abs(p.lat ").replace("abs(lng ", "abs(p.lng ")} AS own_in, {INSIDE.replace("abs(lat ", "abs(c.lat ").replace("abs(lng ", "abs(c.lng ")} AS cache_in FROM p LEFT JOIN cache c ON c."matchKey" = p.mk),
      v AS (SELECT *, lat IS NOT NULL AND (postcode <> '' OR own_in) AS keep, c_lat IS NOT NULL AND (postcode <> '' OR cache_in) AS usable FROM inside)
      SELECT id, CASE WHEN keep THEN lat WHEN usable THEN c_lat END AS lat, CASE WHEN keep THEN lng WHEN usable THEN c_lng END AS lng, CASE WHEN keep THEN 'kept' WHEN usable THEN 'cached' ELSE 'notfound' END AS "geocodeStatus" FROM v""",
    "j19_resolve_base": f"""WITH {S.GAZ}, {CACHE}, b AS (SELECT CAST(substring(id, 6) AS BIGINT) AS custkey, * FROM gaz WHERE starts_with(id, 'node/')),
      k AS (SELECT custkey, lat, lng, CASE WHEN custkey % 3 = 0 THEN "matchKey" ELSE {CACHE_KEY} END AS mk FROM b),
      f AS (SELECT "matchKey", arg_min(lat, id) AS lat, arg_min(lng, id) AS lng FROM gaz GROUP BY 1)
      SELECT custkey AS base_id, round(coalesce(f.lat, CASE WHEN custkey % 4 = 0 THEN k.lat END, c.lat), 6) AS lat, round(coalesce(f.lng, CASE WHEN custkey % 4 = 0 THEN k.lng END, c.lng), 6) AS lng,
        CASE WHEN f.lat IS NOT NULL THEN 'index' WHEN custkey % 4 = 0 THEN 'unchanged' WHEN c.lat IS NOT NULL THEN 'cache' ELSE 'none' END AS source
      FROM k LEFT JOIN f ON f."matchKey" = k.mk LEFT JOIN cache c ON c."matchKey" = k.mk""",
    "j17_apply_choices": f"""WITH {RESOLVED}, {OUTLIERS_ONLY}, c AS (SELECT scan_id, min("lookupKey") AS lk, min(record_id) AS rid FROM resolved WHERE outcome = 'ambiguous' GROUP BY scan_id)
      SELECT scan_id, 'index:' || rid AS "canonicalId", g.postcode, g.city, lk || CASE WHEN g.postcode <> '' THEN '|' || g.postcode ELSE '' END AS "matchKey", CASE WHEN suspicious THEN 'yellow' ELSE 'green' END AS confidence FROM c JOIN gaz g ON g.id = rid JOIN quality q ON q.id = rid""",
    "r10_manual_reorder": f"WITH {S.ORDER}, {STATE} SELECT tour_id, slot, md5(CASE WHEN slot = 'current' AND tour_id % 2 = 0 THEN reverse(ord) ELSE ord END) AS order_md5, manual OR (slot = 'current' AND tour_id % 2 = 0) AS manual FROM st",
    "s8_route_state": f"""WITH {S.ORDER}, {STATE}, t AS (SELECT tour_id, slot FROM o, (VALUES ('current'), ('previous')) v(slot))
      SELECT t.tour_id, t.slot, md5(ord) AS order_md5, coalesce(manual, false) AS manual FROM t LEFT JOIN st ON st.tour_id = t.tour_id AND st.slot = t.slot AND st.tour_id % 4 <> 0""",
    "t4_stream_counts": f"WITH x AS (SELECT {STATUS} AS status, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS r FROM events) SELECT status, count(*) AS n FROM x WHERE r = 1 GROUP BY 1",
    "s6_upsert_points": f"WITH {S.POINTS} SELECT id, custkey, CASE WHEN custkey % 4 = 0 THEN upper(city) ELSE city END AS city FROM points UNION ALL SELECT 'new' || id, custkey, city FROM points WHERE custkey % 7 = 0",
    "s7_replace_merged": f"WITH {S.POINTS} SELECT id, custkey, CASE WHEN custkey % 5 = 0 THEN 'merged' ELSE city END AS city FROM points WHERE custkey % 5 <> 1",
    "p20_with_context": f"""WITH {S.POINTS} SELECT id, street || ' ' || "houseNumber" || chr(10) || trim(postcode || ' ' || city) AS text FROM points""",
    "s1_build_gazetteer": f"""WITH {S.PLACES}, x AS (SELECT *, {S.norm_street('street')} || '|' || "houseNumber" AS lk FROM places WHERE custkey % 31 <> 0)
      SELECT 'node/' || custkey AS id, lk || CASE WHEN postcode <> '' THEN '|' || postcode ELSE '' END AS "matchKey", lk AS "lookupKey", CASE WHEN custkey % 7 = 0 THEN 'place' ELSE 'street' END AS "addressKind", street, "houseNumber", postcode, city, floor(lat * 10000 + 0.5) / 10000 AS lat, floor(lng * 10000 + 0.5) / 10000 AS lng FROM x""",
}
