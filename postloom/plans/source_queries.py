"""Registered queries of sources and row constructors, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import points as pts
from ..operators import tours
from ..operators.rounds import checkpointed
from ..sources import gazetteer, lookups, ocr
from ..sources import views as V
from ..sources import views_sql as S
from ..sources.shared import new_path
from .oracles import BASE_LAT, BASE_LNG, NODES, ORACLES, PARSED
from .queries import _parsed, query


@query
def s3_write_gazetteer(spark: SparkSession, d: str) -> DataFrame:
    """The index written as a table and read back beside the scans of its keys."""
    table = f"gazetteer_{uuid.uuid4().hex}"
    try:
        gazetteer.write_gazetteer(V.gazetteer(spark, d), table, new_path(spark, "gazetteer"), 16)
        n = _parsed(spark, d).groupBy("lookupKey").agg(F.count("*").alias("n_scans"))
        own = gazetteer.read_gazetteer(spark, table).groupBy("lookupKey").agg(F.count("*").alias("n_records"), F.min("id").alias("first_id"))
        return checkpointed(own.join(n, "lookupKey", "left").select("lookupKey", "n_records", "first_id", F.coalesce("n_scans", F.lit(0)).alias("n_scans")))
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")


@query
def s4_read_overlay(spark: SparkSession, d: str) -> DataFrame:
    """The photos' lines as results in JSON, two pages each, and read again; every 11th body is cut off, every 13th has no lines, every 17th failed."""
    own = V.lines(spark, d).withColumn("page", F.when(F.col("line_no") >= 40, 1).otherwise(0))
    half = lambda at: F.struct(at.alias("Left"), (F.col("width") / 2).alias("Width"))
    line = F.struct("line_no", F.struct(F.concat(F.lit(" "), "text").alias("LineText"), F.when(F.col("top") >= 0, F.col("top")).alias("MinTop"), F.col("height").alias("MaxHeight"), F.array(half(F.col("left")), half(F.col("left") + F.col("width") / 2)).alias("Words")).alias("x"))
    pages = own.groupBy("photo_id", "page").agg(F.array_sort(F.collect_list(line)).alias("l"))
    lines = F.when(F.col("photo_id") % 13 != 0, F.struct(F.transform("l", lambda x: x["x"]).alias("Lines")))
    page = F.struct(F.array_join(F.transform("l", lambda x: F.trim(x["x"]["LineText"])), "\n").alias("ParsedText"), lines.alias("TextOverlay"))
    results = pages.groupBy("photo_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("page", page.alias("x")))), lambda p: p["x"]).alias("ParsedResults"))
    failed = F.when(F.col("photo_id") % 17 == 0, True)
    body = F.to_json(F.struct("ParsedResults", failed.alias("IsErroredOnProcessing"), F.when(failed, F.array(F.lit("timed"), F.lit("out"))).alias("ErrorMessage")))
    body = F.when(F.col("photo_id") % 11 == 0, F.substring(body, 1, 40)).otherwise(body)
    got = ocr.read_overlay(results.select("photo_id", body.alias("body")))
    return got.groupBy("photo_id", F.col("broken").isNotNull().alias("broken"), "error", F.md5("page_text").alias("text_md5")).agg(F.count("line_no").alias("n_lines"), F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "|")).alias("lines_md5"), *[F.sum(c).alias(c) for c in ("top", "height", "left", "width")])


@query
def s5_read_boxes(spark: SparkSession, d: str) -> DataFrame:
    """The photos' lines with boxes, every fifth without one, and read again."""
    box = F.struct(F.col("left").alias("x0"), F.col("top").alias("y0"), (F.col("left") + F.col("width")).alias("x1"), (F.col("top") + F.col("height")).alias("y1"))
    sure = F.when(F.col("line_no") % 3 == 0, "unsure").otherwise((F.col("line_no") % 100).cast("string"))
    own = V.lines(spark, d).select("photo_id", "line_no", F.concat("text", F.lit(" ")).alias("text"), F.when(F.col("line_no") % 5 != 0, box).alias("bbox"), sure.alias("confidence"))
    return ocr.read_boxes(own)


@query
def s10_geocode_cache(spark: SparkSession, d: str) -> DataFrame:
    """Look-ups of the suppliers' addresses, some in vain and some by raw text, asked by the scans; every ninth scan was not parsed."""
    s = F.col("s_suppkey")
    lookup, _ = T.keys(V._pick(V.STREETS, s % 12), (s % 20 + 501).cast("string"), F.lit(""), F.lit(""))
    key = F.when(s % 3 == 0, F.concat(F.lit("unlesbar "), (s % 50).cast("string"))).otherwise(lookup)
    at = lambda x: F.when(s % 7 != 0, x)
    path = new_path(spark, "cache")
    lookups.write_geocode_cache(V.read(spark, d, "supplier").select(key.alias("key"), at(V._d(53.0) + s * V._d(0.01)).alias("lat"), at(V._d(12.9) + s * V._d(0.01)).alias("lng")), path)
    own = _parsed(spark, d)
    lost = F.col("scan_id") % 9 == 0
    own = own.select("scan_id", F.when(~lost, F.col("matchKey")).otherwise("").alias("matchKey"), F.when(lost, F.concat(F.lit("unlesbar "), (F.col("scan_id") % 60).cast("string"))).otherwise(F.col("raw")).alias("raw"))
    return lookups.cached_places(spark, path, own).select("scan_id", "is_cached", F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"))


@query
def s11_road_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Road distances of all tours written by range, and read for the tours of every second range; pairs without a road take the straight way."""
    stops = V.points(spark, d).filter("lat is not null").select("tour_id", "id", "lat", "lng")
    lists = checkpointed(tours.stop_lists(stops))
    path = new_path(spark, "roads")
    roads = V.roads(tours.straight_matrices(lookups.by_range(lists), BASE_LAT, BASE_LNG), "tour_range")
    lookups.write_road_matrices(roads, path)
    some = lists.filter(lookups.tour_range(F.col("tour_id")) % 2 == 0)
    own = tours.filled_matrices(some, lookups.read_road_matrices(spark, path, some), BASE_LAT, BASE_LNG)
    cut = F.size(F.filter("road", lambda x: x.isNull())).cast("long")
    return own.select("tour_id", F.size("mat").cast("long").alias("n_pairs"), cut.alias("n_cut"), F.round(F.aggregate("mat", F.lit(0.0), lambda a, m: a + m) / 1000).cast("long").alias("km"))


@query
def p25_error_messages(spark: SparkSession, d: str) -> DataFrame:
    """Every line of the documents taken for a service's message: what kind of failure it would be."""
    line = F.explode(F.split(F.coalesce("text", F.lit("")), "\n"))
    own = V.spread(V.read(spark, d, "documents").select("text")).select(line.alias("m"))
    reason = T.classify_scan_error(F.col("m"))
    return own.groupBy(F.when(reason.eqNullSafe(F.col("m")) & (F.lower("m") != "network"), "as it is").otherwise(reason).alias("reason")).agg(F.count("*").alias("n"))


@query
def p26_make_points(spark: SparkSession, d: str) -> DataFrame:
    """A new point and a new item of every scan, with their defaults; every fifth is known to the index, every third has coordinates."""
    own = _parsed(spark, d).drop("mode", "createdAt").join(V.scans(spark, d).select("scan_id", "mode", F.col("createdAt").alias("addedAt")), "scan_id")
    known, seen = F.col("scan_id") % 5 == 0, F.col("scan_id") % 3 == 0
    own = own.withColumn("canonicalId", F.when(known, F.concat(F.lit("index:node/"), F.col("scan_id").cast("string")))).withColumn("resolved", F.when(known, True))
    own = own.withColumn("lat", F.when(seen, 53.5)).withColumn("lng", F.when(seen, 13.5)).withColumn("createdAt", F.col("addedAt"))
    points = pts.make_points(own).groupBy("canonicalResolved", "geocodeStatus", "verified", "coordinateManual").agg(F.count("*").alias("n"), F.countDistinct("canonicalId").alias("n_ids"), F.count("routeOrder").alias("n_ordered"))
    items = pts.make_items(own).groupBy("type", "source", "status").agg(F.count("*").alias("n_items"), F.count("deliveredAt").alias("n_delivered"))
    text = lambda c: F.col(c).cast("string")
    points = points.select(F.concat_ws("/", F.lit("point"), text("canonicalResolved"), "geocodeStatus", text("verified"), text("coordinateManual")).alias("kind"), "n", "n_ids", F.col("n_ordered").alias("n_done"))
    return points.unionByName(items.select(F.concat_ws("/", F.lit("item"), "type", "source", "status").alias("kind"), F.col("n_items").alias("n"), F.col("n_items").alias("n_ids"), F.col("n_delivered").alias("n_done")))


# --- SQL --------------------------------------------------------------------------------------

_STREET = f"{S._list(V.STREETS)}[s_suppkey % 12 + 1]"
_LADDER = " ".join(f"WHEN {' OR '.join(f'''contains(l, '{part}')''' for part in parts)} THEN '{verdict}'" for verdict, parts in T.ERROR_LADDER)
_FACTOR = "(CAST(1.2 AS DOUBLE) + ((i * 31 + j * 17) % 10) * CAST(0.03 AS DOUBLE))"
_READ = "photo_id % 11 <> 0 AND photo_id % 17 <> 0"

ORACLES |= {
    "s3_write_gazetteer": f"""WITH {S.GAZ}, p AS (SELECT "lookupKey", count(*) AS n FROM (WITH {PARSED} SELECT * FROM parsed) GROUP BY 1)
      SELECT gaz."lookupKey", count(*) AS n_records, min(id) AS first_id, coalesce(any_value(p.n), 0) AS n_scans FROM gaz LEFT JOIN p ON p."lookupKey" = gaz."lookupKey" GROUP BY 1""",
    "s4_read_overlay": f"""WITH {S.LINES}, p AS (SELECT photo_id, page, string_agg(text, chr(10) ORDER BY line_no) AS t FROM (SELECT *, CASE WHEN line_no >= 40 THEN 1 ELSE 0 END AS page FROM lines) GROUP BY 1, 2),
      t AS (SELECT photo_id, string_agg(t, chr(10) ORDER BY page) AS t FROM p GROUP BY 1),
      l AS (SELECT photo_id, count(*) AS n, string_agg(text, '|' ORDER BY line_no) AS x, sum(greatest(top, 0)) AS top, sum(height) AS height, sum("left") AS "left", sum(width) AS width FROM lines WHERE {_READ} AND photo_id % 13 <> 0 GROUP BY 1)
      SELECT t.photo_id, t.photo_id % 11 = 0 AS broken, CASE WHEN t.photo_id % 11 <> 0 AND t.photo_id % 17 = 0 THEN 'timed out' END AS error, CASE WHEN t.photo_id % 11 <> 0 AND t.photo_id % 17 <> 0 THEN md5(t.t) END AS text_md5,
        coalesce(n, 0) AS n_lines, md5(coalesce(x, '')) AS lines_md5, top, height, "left", width FROM t LEFT JOIN l ON l.photo_id = t.photo_id""",
    "s5_read_boxes": f"""WITH {S.LINES} SELECT photo_id, line_no, text, CASE WHEN line_no % 5 <> 0 THEN top ELSE 0 END AS top, CASE WHEN line_no % 5 <> 0 THEN height ELSE 0 END AS height, CASE WHEN line_no % 5 <> 0 THEN "left" ELSE 0 END AS "left",
      CASE WHEN line_no % 5 <> 0 THEN width ELSE 0 END AS width, CASE WHEN line_no % 3 <> 0 THEN CAST(line_no % 100 AS DOUBLE) END AS confidence FROM lines""",
    "s10_geocode_cache": f"""WITH {PARSED}, c0 AS (SELECT CASE WHEN s_suppkey % 3 = 0 THEN 'unlesbar ' || s_suppkey % 50 ELSE {S.norm_street(_STREET)} || '|' || (s_suppkey % 20 + 501) END AS key, CASE WHEN s_suppkey % 7 <> 0 THEN {{'lat': CAST(53.0 AS DOUBLE) + s_suppkey * CAST(0.01 AS DOUBLE), 'lng': CAST(12.9 AS DOUBLE) + s_suppkey * CAST(0.01 AS DOUBLE)}} END AS p FROM supplier),
      c AS (SELECT key, min(p) AS p FROM c0 GROUP BY key), k AS (SELECT scan_id, CASE WHEN scan_id % 9 = 0 THEN 'unlesbar ' || scan_id % 60 ELSE "matchKey" END AS key FROM parsed)
      SELECT scan_id, c.key IS NOT NULL AS is_cached, round(p.lat, 6) AS lat, round(p.lng, 6) AS lng FROM k LEFT JOIN c ON c.key = k.key""",
    "s11_road_matrix": f"""WITH {NODES}, e AS (
        SELECT a.tour_id, a.i, b.i AS j, CASE WHEN a.i = b.i THEN 0 ELSE {S.km('a', 'b', '6371000.0')} END AS m FROM nodes a JOIN nodes b ON a.tour_id = b.tour_id WHERE a.tour_id // {lookups.TOURS_A_FOLDER} % 2 = 0)
      SELECT tour_id, count(*) AS n_pairs, count(*) FILTER ((i + j) % 23 = 0) AS n_cut, CAST(round(sum(CASE WHEN (i + j) % 23 = 0 THEN m ELSE m * {_FACTOR} END) / 1000) AS BIGINT) AS km FROM e GROUP BY 1""",
    "p25_error_messages": f"""WITH x AS (SELECT unnest(string_split(coalesce(text, ''), chr(10))) AS m FROM documents), y AS (SELECT m, lower(m) AS l FROM x)
      SELECT CASE WHEN l = 'network' THEN 'network' {_LADDER} WHEN l <> '' THEN 'as it is' ELSE 'unknown' END AS reason, count(*) AS n FROM y GROUP BY 1""",
    "p26_make_points": f"""WITH {PARSED}, x AS (SELECT p.scan_id, s.mode, CASE WHEN p.scan_id % 5 = 0 THEN 'index:node/' || p.scan_id WHEN p."matchKey" <> '' THEN p."matchKey" ELSE p."lookupKey" END AS cid FROM parsed p JOIN scans s ON s.scan_id = p.scan_id)
      SELECT 'point/' || (scan_id % 5 = 0) || '/' || CASE WHEN scan_id % 3 = 0 THEN 'matched' ELSE 'notfound' END || '/false/false' AS kind, count(*) AS n, count(DISTINCT cid) AS n_ids, 0 AS n_done FROM x GROUP BY 1
      UNION ALL SELECT 'item/' || CASE WHEN mode = 'device' THEN 'parcel' ELSE mode END || '/manual/pending', count(*), count(*), 0 FROM x GROUP BY 1""",
}
