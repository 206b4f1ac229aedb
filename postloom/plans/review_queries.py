"""Registered queries of whole scan lists, fleets, requests and the ingest stream, and the SQL of these and of five older ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import params as P
from ..functions import text as T
from ..operators import parse, routes, tours
from ..operators import points as pts
from ..operators import resolve as res
from ..operators.review import accumulate_photos
from ..operators.rounds import checkpointed
from ..sources import views as V
from ..sources import views_sql as S
from ..sources.point_store import PointStore
from ..sources.shared import new_path
from ..streaming import streams
from .more_queries import _cache
from .oracles import BASE_LAT, BASE_LNG, CACHE, CONFIDENCE, GAZ_ONLY, INSIDE, KEPT, NODES, ORACLES, ORDERED, OUTLIERS_ONLY, PARSED, POINT_IDS, POINTS_ONLY, POSTCODE, RESOLVED, SCAN_IDS, SYSTEM, blocks, noise, start, strip_code
from .queries import AREA, _ordered, _parsed, _resolved_scans, query


FOLDERS = 8  # of the stores that these queries make


@query
def g2_split_by_gap(spark: SparkSession, d: str) -> DataFrame:
    """All photos; every seventh has lost its positions and is split by postcodes."""
    own = V.lines(spark, d).withColumn("top", F.when(F.col("photo_id") % 7 != 0, F.col("top")))
    return parse.split_by_gap(own, ["photo_id"])


@query
def g4_pick_receiver(spark: SparkSession, d: str) -> DataFrame:
    """Of each photo's blocks, split by postcode, the likeliest recipient's."""
    own = V.lines(spark, d).filter("line_no >= 0 and text <> '81-11'")
    return parse.pick_receiver(parse.split_by_postcode(own, ["photo_id"]), ["photo_id"])


@query
def u2_accumulate_photos(spark: SparkSession, d: str) -> DataFrame:
    own = parse.extract_blocks(V.lines(spark, d), ["tour_id", "photo_id"])
    return accumulate_photos(own, V.gazetteer(spark, d))


@query
def p17_confidence_online(spark: SparkSession, d: str) -> DataFrame:
    own, gaz = _parsed(spark, d, True), V.gazetteer(spark, d)
    out = res.confidence_online(res.confidence(own, gaz), own, _cache(spark, d), AREA)
    return out.select("scan_id", "confidence", "reason", F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"))


@query
def p30_committable(spark: SparkSession, d: str) -> DataFrame:
    own, gaz = _parsed(spark, d, True), V.gazetteer(spark, d)
    rows = res.confidence(own, gaz).join(own.select("scan_id", "matchKey"), "scan_id")
    return res.committable(rows.withColumn("selected", (F.col("confidence") != "red") & (F.col("scan_id") % 3 != 0))).select("scan_id", "canonicalId", "matchKey")


@query
def j16_attach_quality(spark: SparkSession, d: str) -> DataFrame:
    gaz = V.gazetteer(spark, d)
    out = res.resolve_with_quality(_parsed(spark, d, True), gaz, res.outliers(gaz))
    return out.select("scan_id", "outcome", "record_id", "suspicious", "distance_m", "original_lat", "original_lng")


@query
def j8_points(spark: SparkSession, d: str) -> DataFrame:
    """The points after all scans were added to a third of them."""
    after, _ = pts.add_items(*_adding(spark, d))
    return after.select("id", "canonicalId", "matchKey", "lookupKey", "postcode", "city", F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"))


def _known(spark: SparkSession, d: str) -> DataFrame:
    known = V.points(spark, d).filter("custkey % 3 = 0").select("id", "matchKey", "canonicalId", "lookupKey", "postcode", "city", "lat", "lng", "createdAt")
    return known.withColumn("_n", F.row_number().over(Window.partitionBy("canonicalId").orderBy("id"))).filter("_n = 1").drop("_n")


def _adding(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return _resolved_scans(spark, d).withColumn("seq", F.col("scan_id")), _known(spark, d)


@query
def j8_add_items(spark: SparkSession, d: str) -> DataFrame:
    """The point of every scan."""
    _, placed = pts.add_items(*_adding(spark, d))
    return placed


@query
def j9_migrate_merged(spark: SparkSession, d: str) -> DataFrame:
    """Points that lost their identity, migrated, then merged."""
    old = V.points(spark, d).drop("tour_id").withColumn("canonicalId", F.lit("")).withColumn("canonicalResolved", F.lit(False)).withColumn("coordinateManual", F.lit(False))
    items = V.items(spark, d).select("point_id", "item_id", "status")
    kept, moved = pts.merge_points(checkpointed(res.migrate_points(old, V.gazetteer(spark, d))), items)
    n = moved.groupBy("point_id").agg(F.count("*").alias("n_items"))
    return kept.join(n, kept["id"] == n["point_id"], "left").select("id", "canonicalId", F.col("merged").cast("long").alias("merged"), F.coalesce("n_items", F.lit(0)).alias("n_items"))


@query
def a1_rollup_counts(spark: SparkSession, d: str) -> DataFrame:
    """Totals by tour, by region (25 tours each) and of the fleet."""
    own = V.points(spark, d)
    regions = own.select("tour_id").distinct().select("tour_id", F.floor(F.col("tour_id") / 25).cast("long").alias("region"))
    return pts.rollup_counts(own, V.items(spark, d), regions).fillna(-1, ["region", "tour_id"])


@query
def a13_tour_path(spark: SparkSession, d: str) -> DataFrame:
    own = routes.tour_path(_ordered(spark, d), V.BASE_LAT, V.BASE_LNG)
    nodes = F.size(F.from_json("line", "coordinates array<array<double>>")["coordinates"]).cast("long")
    return own.select("tour_id", nodes.alias("n_nodes"), *[F.round(c, 6).alias(c) for c in ("south_lat", "north_lat", "south_lng", "north_lng")])


@query
def s12_export_requests(spark: SparkSession, d: str) -> DataFrame:
    own = V.points(spark, d).withColumn("priority", F.col("has_parcel")).withColumn("group", pts.locality_group(F.col("postcode"), F.col("city")))
    out = routes.export_requests(own, V.BASE_LAT, V.BASE_LNG)
    got = F.from_json("request", "jobs array<struct<id: bigint, priority: int, `group`: string>>, vehicles array<struct<id: int, start: array<double>, end: array<double>>>")
    return out.withColumn("r", got).select("tour_id", F.size("r.jobs").cast("long").alias("n_jobs"), F.size(F.filter("r.jobs", lambda j: j["priority"] == 100)).cast("long").alias("n_priority"), F.array_join(F.transform("r.jobs", lambda j: j["group"]), ";").alias("groups"), F.get("r.vehicles", F.lit(0))["start"][0].alias("start_lng"), F.array_join("skipped", ",").alias("skipped"))


@query
def r6_external_or_planned(spark: SparkSession, d: str) -> DataFrame:
    """Orders from outside of the stops still to visit, of which every fourth lacks a stop; those tours are planned here."""
    points = V.points(spark, d).filter("not done")
    jobs = checkpointed(routes.export_jobs(points.withColumn("priority", F.lit(False)).withColumn("group", F.lit(""))).select("tour_id", "job", "id"))
    step = F.row_number().over(Window.partitionBy("tour_id").orderBy(F.col("job").desc()))
    steps = jobs.filter("not (tour_id % 4 = 0 and job = 1)").select("tour_id", step.alias("step"), F.lit("job").alias("type"), "job")
    external = checkpointed(routes.apply_external_order(jobs, steps))
    bad = jobs.select("tour_id").distinct().join(external.filter("complete").select("tour_id").distinct(), "tour_id", "left_anti")
    planned = tours.plan_tours(routes.prepare_stops(points.join(bad, "tour_id", "left_semi")), V.BASE_LAT, V.BASE_LNG).filter("not skipped").drop("skipped")
    return routes.external_or_planned(external, planned).groupBy("tour_id", "provider").agg(F.count("*").alias("n_stops"), F.max("position").alias("last"), F.countDistinct("id").alias("n_ids"))


@query
def r5_tour_checks(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of every planned tour: its stops once each, without gaps, those without coordinates skipped, no longer than the seed."""
    stops = checkpointed(V.points(spark, d).filter("not done").select("tour_id", "id", "lat", "lng", F.lit(False).alias("priority")))
    plan = tours.plan_tours(stops, V.BASE_LAT, V.BASE_LNG)
    seed = tours.seeded(tours.straight_matrices(tours.stop_lists(stops.filter("lat is not null")), V.BASE_LAT, V.BASE_LNG)).select("tour_id", F.col("meters").alias("seed"))
    own = plan.groupBy("tour_id").agg(F.count_if(~F.col("skipped")).alias("n_stops"), F.count_if("skipped").alias("n_skipped"), F.countDistinct("id").alias("n_ids"), F.countDistinct("position").alias("n_places"), F.max("position").alias("last"), F.max("meters").alias("meters"))
    return own.join(seed, "tour_id").select("tour_id", "n_stops", "n_skipped", "n_ids", "n_places", "last", (F.col("meters") <= F.col("seed") + 0.001).alias("no_longer"))


@query
def w5_priority_reorder(spark: SparkSession, d: str) -> DataFrame:
    """The stops of every tour by id, then parcels ahead where that costs little: ids in order."""
    stops = V.points(spark, d).filter("lat is not null").select("tour_id", "id", "lat", "lng", "has_parcel")
    own = tours.stop_lists(stops, "has_parcel").withColumn("first", F.concat(F.array(F.lit(False)), F.transform("s", lambda x: x["has_parcel"]))).withColumn("ord", F.sequence(F.lit(0), F.col("n") - 1))
    own = tours.straight_matrices(own, V.BASE_LAT, V.BASE_LNG).withColumn("s", F.transform("s", lambda x: x["id"]))
    own = tours.priority_reorder(own)
    return own.select("tour_id", F.array_join(F.transform(F.slice("ord", 2, F.col("n")), lambda i: F.get("s", i - 1)), ",").alias("ids"))


def _streamed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(points, placed) after all scans went through the stream as files, batch by batch."""
    source, out, mark = (new_path(spark, f"t1-{x}") for x in ("in", "out", "mark"))
    rows = V.scans(spark, d).select("scan_id", F.col("scan_id").alias("seq"), "raw", "createdAt")
    rows.repartitionByRange(4, "scan_id").write.parquet(source)
    known = _known(spark, d).limit(0)
    sink = streams.commit(checkpointed(V.gazetteer(spark, d)), checkpointed(known), out, FOLDERS)
    streams.run_to_end(streams.file_stream(spark, source, rows.schema, 2), sink, mark)
    return streams.committed(spark, out, known.schema, FOLDERS)


@query
def t1_stream_ingest(spark: SparkSession, d: str) -> DataFrame:
    """The scans through the stream; the items of every point."""
    points, placed = _streamed(spark, d)
    return placed.groupBy(F.col("point_id").alias("id")).agg(F.count("*").alias("n_items"), F.min("scan_id").alias("first_scan")).hint("merge").join(points.select("id", "canonicalId"), "id")


@query
def t1_ingest_checks(spark: SparkSession, d: str) -> DataFrame:
    """What holds of the ingest stream however the batches fall: of each tour, the items placed by type, scans placed more than once, and scans whose point is not there."""
    points, placed = _streamed(spark, d)
    per = placed.groupBy("scan_id").agg(F.count("*").alias("times"), F.max("point_id").alias("id"))
    per = per.hint("merge").join(points.select("id", F.lit(True).alias("known")), "id", "left")
    own = V.items(spark, d).select("tour_id", "type", F.col("item_id").alias("scan_id")).hint("merge").join(per, "scan_id", "left")
    kinds = [F.count_if((F.col("type") == k) & F.col("times").isNotNull()).alias(k) for k in ("parcel", "magazine", "letter")]
    return own.groupBy("tour_id").agg(*kinds, F.count_if(F.col("times") != 1).alias("n_twice"), F.count_if(~F.coalesce("known", F.lit(False))).alias("n_lost"))


@query
def s6_s7_point_store(spark: SparkSession, d: str) -> DataFrame:
    """Points written to a store, changed, deleted, merged and read again: by id, by canonicalId, whole, and as they were before."""
    own = V.points(spark, d).select("id", "canonicalId", "matchKey", "city", "createdAt")
    store = PointStore(spark, new_path(spark, "store"), own.schema, buckets=FOLDERS)
    first = store.write(own)
    k = F.pmod(F.length("id") + F.ascii(F.reverse("id")), F.lit(4))
    store.commit(put=own.filter(k == 0).withColumn("city", F.upper("city")))
    store.commit(delete=own.filter(k == 1).select("id"))
    now = store.read()
    w = Window.partitionBy("canonicalId").orderBy("createdAt", "id")
    group = now.withColumn("_n", F.row_number().over(w)).withColumn("_all", F.count("*").over(Window.partitionBy("canonicalId"))).filter("_all > 1")
    store.replace_merged(group.filter("_n = 1").withColumn("city", F.concat("city", F.lit("+"))).select(own.columns), group.filter("_n > 1").select("id"))
    got = store.get(own.filter(k == 2).select("id")).select("id", "city", F.lit("by id").alias("view"))
    found = store.find(own.filter(k == 3).select(F.col("canonicalId").alias("value"))).select("id", "city", F.lit("by identity").alias("view"))
    old = store.read(first).select("id", "city", F.lit("before").alias("view"))
    return got.unionByName(found).unionByName(old).unionByName(store.read().select("id", "city", F.lit("now").alias("view")))


# --- SQL --------------------------------------------------------------------------------------


def _leg(i: str, j: str) -> str:
    """Metres between two nodes of the lists la and lo."""
    return S.haversine(f"la[{i} + 1]", f"lo[{i} + 1]", f"la[{j} + 1]", f"lo[{j} + 1]", str(P.EARTH_M))


def median(values: str) -> str:
    """The upper middle of the positive values of a list."""
    own = f"list_sort(list_filter({values}, lambda v: v > 0))"
    return f"coalesce({own}[len({own}) // 2 + 1], 0)"


def gap_blocks(source: str, name: str, keys: str = "photo_id") -> str:
    """Common table expressions: ``name`` holds the lines of ``source`` with block_no; lines without top are split by postcode."""
    return rf"""{name}1 AS (SELECT *, count(top) OVER (PARTITION BY {keys}) >= 2 AS placed FROM (SELECT {keys}, line_no, top, height, {S.trimmed('text')} AS line FROM {source}) WHERE line <> '' AND NOT regexp_matches(line, '{SYSTEM}')),
      {name}2 AS (SELECT *, CASE WHEN placed THEN top END AS pos FROM {name}1 WHERE NOT placed OR top IS NOT NULL),
      {name}3 AS (SELECT *, greatest(0, lead(pos) OVER (PARTITION BY {keys} ORDER BY pos, line_no) - (pos + height)) AS gap FROM {name}2),
      {name}4 AS (SELECT {keys}, count(*) AS n, greatest({median('list(gap)')} * CAST(1.8 AS DOUBLE), {median('list(height)')} * CAST(0.8 AS DOUBLE)) AS lim FROM {name}3 GROUP BY {keys}),
      {name} AS (SELECT x.*, CAST(coalesce(sum(CAST(regexp_matches(line, '{POSTCODE}') OR (placed AND n >= 6 AND lim > 0 AND gap > lim) AS INT)) OVER (PARTITION BY {keys} ORDER BY pos, line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS block_no FROM {name}3 x JOIN {name}4 USING ({keys}))"""


def receiver(source: str) -> str:
    points = rf"CASE WHEN regexp_matches(raw, '{POSTCODE}') THEN 3.0 ELSE 0 END - CASE WHEN regexp_matches(raw, '(?i)\b({T.SENDER_WORDS})\b') THEN 10.0 ELSE 0 END + CASE WHEN regexp_matches(raw, '(?i)\b({T.RECIPIENT_WORDS})\b') THEN 5.0 ELSE 0 END + CASE WHEN regexp_matches(raw, '(?i)[a-zäöüß].*\d') THEN 1.0 ELSE 0 END + least(length(raw) - length(replace(raw, chr(10), '')), 3) * 0.5"
    return f"SELECT photo_id, block_no, raw FROM (SELECT *, row_number() OVER (PARTITION BY photo_id ORDER BY {points} DESC, block_no DESC) AS r FROM {source}) WHERE r = 1"


def sweeps(rows: str, candidates: str) -> str:
    """Common table expressions up to ``swept``: open rows that take the candidate near their neighbours, by five rounds."""
    out, now = [], rows
    for k in range(1, P.SWEEPS + 1):
        out.append(f"""near{k} AS (SELECT tour_id, seq, list_sum(list(lat ORDER BY k)) / count(*) AS a_lat, list_sum(list(lng ORDER BY k)) / count(*) AS a_lng FROM (
        SELECT o.tour_id, o.seq, r.lat, r.lng, row_number() OVER (PARTITION BY o.tour_id, o.seq ORDER BY abs(r.seq - o.seq), r.seq) AS k FROM {now} o JOIN {now} r ON r.tour_id = o.tour_id AND r.lat IS NOT NULL WHERE o.lat IS NULL) WHERE k <= 3 GROUP BY ALL),
      far{k} AS (SELECT *, row_number() OVER w AS k, lead(d) OVER w AS second FROM (SELECT c.*, {S.haversine('a_lat', 'a_lng', 'c.lat', 'c.lng')} AS d FROM {candidates} c JOIN near{k} n ON n.tour_id = c.tour_id AND n.seq = c.seq) WINDOW w AS (PARTITION BY tour_id, seq ORDER BY d, record_id)),
      swept{k} AS (SELECT r.tour_id, r.seq, coalesce(r.lat, f.lat) AS lat, coalesce(r.lng, f.lng) AS lng, coalesce(r.record_id, f.record_id) AS record_id
        FROM {now} r LEFT JOIN far{k} f ON f.tour_id = r.tour_id AND f.seq = r.seq AND f.k = 1 AND d <= {P.NEIGHBOUR_KM} AND (second IS NULL OR d <= second * CAST({P.NEIGHBOUR_RATIO} AS DOUBLE)))""")
        now = f"swept{k}"
    return ",\n".join([*out, f"swept AS (SELECT * FROM {now})"])


RESOLVE_TAIL = RESOLVED.split(KEPT + ",\n")[1]
PARSE_TAIL = PARSED.replace(S.SCANS + ",\n", "")
CARDS = rf"""cards1 AS (SELECT *, {S.trimmed('text')} AS t, min("left") OVER w AS lo, max("left" + width) OVER w AS hi, max(width) OVER w > 0 AS wide FROM lines WHERE mode = 'device' AND {S.trimmed('text')} <> '' WINDOW w AS (PARTITION BY photo_id)),
      cards2 AS (SELECT photo_id, top, line_no, {strip_code('t')} AS line FROM cards1 WHERE NOT (wide AND "left" > lo + (hi - lo) * CAST(0.62 AS DOUBLE) AND length(regexp_replace(t, '[^{T.LETTER}]', '', 'g')) < 3) AND NOT {noise('t')}),
      cards3 AS (SELECT *, CAST(sum(CAST({start('line')} AS INT)) OVER (PARTITION BY photo_id ORDER BY top, line_no) AS BIGINT) AS block_no FROM cards2), cards AS (SELECT * FROM cards3 WHERE block_no > 0)"""
BLOCKS = rf"""{S.LINES}, {CARDS},
      parcel_lines AS (SELECT * FROM lines WHERE mode = 'parcel'), mail_lines AS (SELECT * FROM lines WHERE mode IN ('letter', 'magazine')),
      {gap_blocks('parcel_lines', 'pg')}, {gap_blocks('mail_lines', 'mg')},
      mail_blocks AS ({blocks('mg', 'pos, line_no')}), picked AS ({receiver('mail_blocks')}),
      whole AS (SELECT photo_id, CAST(0 AS BIGINT) AS block_no, string_agg(text, chr(10) ORDER BY line_no, text) AS raw FROM mail_lines GROUP BY photo_id),
      all_blocks AS ({blocks('cards', 'top, line_no')} UNION ALL {blocks('pg', 'pos, line_no')} UNION ALL SELECT * FROM picked UNION ALL SELECT * FROM whole WHERE photo_id NOT IN (SELECT photo_id FROM picked))"""

ADDED = f"""{SCAN_IDS}, {POINTS_ONLY},
known AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY "canonicalId" ORDER BY id) AS r FROM points WHERE custkey % 3 = 0) WHERE r = 1),
spot AS (SELECT scan_id, max(lat) AS lat, max(lng) AS lng FROM resolved WHERE outcome = 'resolved' GROUP BY scan_id),
full_ids AS (SELECT ids.*, p.city, spot.lat, spot.lng FROM ids JOIN parsed p ON p.scan_id = ids.scan_id LEFT JOIN spot ON spot.scan_id = ids.scan_id),
by_id AS (SELECT "canonicalId", min(id) AS p1 FROM known GROUP BY 1), by_key AS (SELECT "matchKey", min(id) AS p2 FROM known GROUP BY 1),
placed AS (SELECT f.*, coalesce(p1, p2, 'n' || substring(sha256(coalesce(nullif(f."canonicalId", ''), nullif(f."matchKey", ''), nullif(f."lookupKey", ''), 'scan:' || scan_id)), 1, 16)) AS point_id
  FROM full_ids f LEFT JOIN by_id ON by_id."canonicalId" = f."canonicalId" LEFT JOIN by_key ON by_key."matchKey" = f."matchKey")"""

ORACLES |= {
    "g2_split_by_gap": f"WITH {S.LINES}, shown AS (SELECT * REPLACE (CASE WHEN photo_id % 7 <> 0 THEN top END AS top) FROM lines), {gap_blocks('shown', 'gb')} {blocks('gb', 'pos, line_no')}",
    "g4_pick_receiver": rf"""WITH {S.LINES}, x AS (SELECT photo_id, line_no, {S.trimmed('text')} AS line FROM lines WHERE line_no >= 0 AND text <> '81-11'),
      y AS (SELECT *, CAST(coalesce(sum(CAST(regexp_matches(line, '{POSTCODE}') AS INT)) OVER (PARTITION BY photo_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS block_no FROM x WHERE line <> '' AND NOT regexp_matches(line, '{SYSTEM}')),
      b AS ({blocks('y', 'line_no')}) {receiver('b')}""",
    "g5_extract_blocks": f"WITH {BLOCKS} SELECT photo_id, block_no, raw FROM all_blocks",
    "u2_accumulate_photos": f"""WITH {BLOCKS}, of_tour AS (SELECT DISTINCT photo_id, tour_id FROM lines),
      shots AS (SELECT tour_id, photo_id, block_no, raw, row_number() OVER (PARTITION BY tour_id ORDER BY photo_id, block_no) AS seq, tour_id || '_' || row_number() OVER (PARTITION BY tour_id ORDER BY photo_id, block_no) AS scan_id FROM all_blocks JOIN of_tour USING (photo_id)),
      {PARSE_TAIL.replace('FROM scans,', 'FROM shots,')}, {GAZ_ONLY}, {KEPT}, {RESOLVE_TAIL},
      name AS (SELECT scan_id, max("canonicalId") AS cid, bool_or(outcome = 'ambiguous') AS open FROM resolved GROUP BY scan_id),
      rows0 AS (SELECT s.tour_id, s.seq, r.lat, r.lng, r.record_id FROM shots s JOIN parsed USING (scan_id) LEFT JOIN resolved r ON r.scan_id = s.scan_id AND outcome = 'resolved'),
      cand0 AS (SELECT s.tour_id, s.seq, r.record_id, r.lat, r.lng FROM shots s JOIN resolved r ON r.scan_id = s.scan_id AND outcome = 'ambiguous'),
      {sweeps('rows0', 'cand0')},
      listed AS (SELECT s.tour_id, s.seq, s.photo_id, s.block_no, "lookupKey", "matchKey", postcode, CASE WHEN w.record_id IS NOT NULL THEN 'index:' || w.record_id ELSE cid END AS "canonicalId", w.record_id IS NOT NULL AS resolved, "matchKey" <> '' AND (w.record_id IS NOT NULL OR NOT open) AS selected
        FROM shots s JOIN parsed USING (scan_id) JOIN name USING (scan_id) JOIN swept w ON w.tour_id = s.tour_id AND w.seq = s.seq),
      keyed AS (SELECT *, row_number() OVER (PARTITION BY tour_id, coalesce(CASE WHEN resolved THEN "canonicalId" WHEN "lookupKey" <> '' THEN "lookupKey" || '#' || postcode END, 'row:' || seq) ORDER BY seq) AS r FROM listed)
      SELECT * EXCLUDE (r) FROM keyed WHERE r = 1""",
    "w3_resolve_by_neighbours": f"""WITH {RESOLVED}, rows0 AS (SELECT s.tour_id, s.seq, r.lat, r.lng, r.record_id FROM scans s JOIN parsed USING (scan_id) LEFT JOIN resolved r ON r.scan_id = s.scan_id AND outcome = 'resolved'),
      cand0 AS (SELECT s.tour_id, s.seq, r.record_id, r.lat, r.lng FROM scans s JOIN resolved r ON r.scan_id = s.scan_id AND outcome = 'ambiguous'),
      {sweeps('rows0', 'cand0')} SELECT tour_id, seq, record_id FROM swept""",
    "p17_confidence_online": f"""WITH {CONFIDENCE}, {CACHE}, x AS (
        SELECT c.scan_id, c.confidence, c.reason, NOT c.resolved AND n_candidates = 0 AND reason <> 'exact' AND p."matchKey" <> '' AND k."matchKey" IS NOT NULL AS open, p.postcode <> '' OR p.city <> '' AS anchored, lat, lng, p.postcode <> '' OR lat IS NULL OR ({INSIDE}) AS fits
        FROM conf c JOIN parsed p ON p.scan_id = c.scan_id LEFT JOIN cache k ON k."matchKey" = p."matchKey")
      SELECT scan_id, CASE WHEN NOT open THEN confidence WHEN NOT fits OR lat IS NULL THEN 'red' WHEN anchored THEN 'green' ELSE 'yellow' END AS confidence, reason, round(CASE WHEN open AND fits THEN lat END, 6) AS lat, round(CASE WHEN open AND fits THEN lng END, 6) AS lng FROM x""",
    "p30_committable": f"""WITH {CONFIDENCE} SELECT c.scan_id, c."canonicalId", p."matchKey" FROM conf c JOIN parsed p ON p.scan_id = c.scan_id WHERE confidence <> 'red' AND c.scan_id % 3 <> 0 AND n_candidates = 0 AND (coalesce(c."canonicalId", '') <> '' OR p."matchKey" <> '')""",
    "j16_attach_quality": f"""WITH {RESOLVED}, {OUTLIERS_ONLY} SELECT scan_id, outcome, record_id, coalesce(suspicious, false) AS suspicious, coalesce(nearest_m, 0) AS distance_m, lat AS original_lat, lng AS original_lng FROM resolved LEFT JOIN quality ON quality.id = record_id""",
    "j8_add_items": f"WITH {ADDED} SELECT scan_id, point_id FROM placed",
    "j8_points": f"""WITH {ADDED}, sure AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY scan_id DESC) AS r FROM placed WHERE lat IS NOT NULL) WHERE r = 1),
      f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY scan_id) AS r FROM placed) WHERE r = 1)
      SELECT k.id, coalesce(nullif(s."canonicalId", ''), k."canonicalId") AS "canonicalId", coalesce(nullif(s."matchKey", ''), k."matchKey") AS "matchKey", k."lookupKey", coalesce(nullif(s.postcode, ''), k.postcode) AS postcode, coalesce(nullif(s.city, ''), k.city) AS city, round(coalesce(s.lat, k.lat), 6) AS lat, round(coalesce(s.lng, k.lng), 6) AS lng FROM known k LEFT JOIN sure s ON s.point_id = k.id
      UNION ALL SELECT f.point_id, coalesce(s."canonicalId", f."canonicalId"), coalesce(s."matchKey", f."matchKey"), f."lookupKey", coalesce(s.postcode, f.postcode), coalesce(s.city, f.city), round(s.lat, 6), round(s.lng, 6) FROM f LEFT JOIN sure s ON s.point_id = f.point_id WHERE f.point_id NOT IN (SELECT id FROM known)""",
    "j9_migrate_merged": f"""WITH {POINT_IDS}, m AS (SELECT p.id, p."createdAt", CASE WHEN hit.pid IS NOT NULL THEN 'index:' || record_id ELSE p."matchKey" END AS c FROM points p LEFT JOIN hit ON hit.pid = p.id),
      g AS (SELECT c, count(*) - 1 AS merged, arg_min(id, ("createdAt", id)) AS id FROM m GROUP BY c), n AS (SELECT c, count(DISTINCT item_id) AS n_items FROM items i JOIN m ON m.id = i.point_id GROUP BY c)
      SELECT id, g.c AS "canonicalId", merged, n_items FROM g JOIN n ON n.c = g.c""",
    "a1_rollup_counts": f"""WITH {S.ITEMS}, x AS (SELECT tour_id, tour_id // 25 AS region, count(*) FILTER (WHERE type = 'parcel') AS parcel, count(*) FILTER (WHERE type = 'magazine') AS magazine, count(*) FILTER (WHERE type = 'letter') AS letter, count(*) FILTER (WHERE status = 'delivered') AS delivered, count(DISTINCT point_id) AS stops FROM items GROUP BY ALL)
      SELECT CASE grouping(region, tour_id) WHEN 0 THEN 'tour' WHEN 1 THEN 'region' ELSE 'fleet' END AS level, coalesce(region, -1) AS region, coalesce(tour_id, -1) AS tour_id, CAST(sum(parcel) AS BIGINT) AS parcel, CAST(sum(magazine) AS BIGINT) AS magazine, CAST(sum(letter) AS BIGINT) AS letter, CAST(sum(delivered) AS BIGINT) AS delivered,
        CAST(sum(magazine + letter) AS BIGINT) AS mail, CAST(sum(parcel + magazine + letter) AS BIGINT) AS items, CAST(sum(stops) AS BIGINT) AS stops, CAST(sum(stops) AS BIGINT) AS total FROM x GROUP BY ROLLUP (region, tour_id)""",
    "a13_tour_path": f"""WITH {ORDERED}, x AS (SELECT tour_id, count(*) + 2 AS n_nodes, least(min(lat), CAST({BASE_LAT} AS DOUBLE)) AS la, greatest(max(lat), CAST({BASE_LAT} AS DOUBLE)) AS lb, least(min(lng), CAST({BASE_LNG} AS DOUBLE)) AS ga, greatest(max(lng), CAST({BASE_LNG} AS DOUBLE)) AS gb FROM ordered WHERE lat IS NOT NULL GROUP BY tour_id)
      SELECT tour_id, n_nodes, round(la - (lb - la) * CAST(0.15 AS DOUBLE), 6) AS south_lat, round(lb + (lb - la) * CAST(0.15 AS DOUBLE), 6) AS north_lat, round(ga - (gb - ga) * CAST(0.15 AS DOUBLE), 6) AS south_lng, round(gb + (gb - ga) * CAST(0.15 AS DOUBLE), 6) AS north_lng FROM x""",
    "s12_export_requests": f"""WITH {S.POINTS}, x AS (SELECT tour_id, count(*) AS n_jobs, count(*) FILTER (WHERE has_parcel) AS n_priority, string_agg(postcode || '|' || lower(city), ';' ORDER BY id) AS groups FROM points WHERE lat IS NOT NULL GROUP BY tour_id),
      o AS (SELECT tour_id, coalesce(string_agg(id, ',' ORDER BY id) FILTER (WHERE lat IS NULL), '') AS skipped FROM points GROUP BY tour_id)
      SELECT o.tour_id, n_jobs, n_priority, groups, CASE WHEN n_jobs IS NOT NULL THEN CAST({BASE_LNG} AS DOUBLE) END AS start_lng, skipped FROM o LEFT JOIN x ON x.tour_id = o.tour_id""",
    "r1_seed_tours": f"""WITH RECURSIVE {NODES},
      walk AS (SELECT DISTINCT tour_id, n, [CAST(0 AS BIGINT)] AS ord FROM pairs
        UNION ALL SELECT w.tour_id, w.n, list_append(w.ord, arg_min(p.j, (p.meters, p.j))) FROM walk w JOIN pairs p ON p.tour_id = w.tour_id AND p.i = w.ord[-1] WHERE NOT list_contains(w.ord, p.j) GROUP BY w.tour_id, w.n, w.ord),
      legs AS (SELECT tour_id, n, ord[k] AS i, ord[k % n + 1] AS j FROM walk, unnest(range(1, n + 1)) AS u(k) WHERE len(ord) = n)
      SELECT l.tour_id, CAST(l.n AS INT) AS n, CAST(round(sum(meters)) AS BIGINT) AS meters FROM legs l JOIN pairs p ON p.tour_id = l.tour_id AND p.i = l.i AND p.j = l.j GROUP BY ALL""",
    "r5_tour_checks": f"WITH {S.POINTS} SELECT tour_id, count(lat) AS n_stops, count(*) - count(lat) AS n_skipped, count(*) AS n_ids, count(lat) AS n_places, count(lat) AS last, true AS no_longer FROM points WHERE NOT done GROUP BY tour_id HAVING count(lat) > 0",
    "w5_priority_reorder": f"""WITH RECURSIVE {S.POINTS},
      t AS (SELECT tour_id, list(id ORDER BY id) AS ids, [false] || list(has_parcel ORDER BY id) AS pri, [CAST({BASE_LAT} AS DOUBLE)] || list(lat ORDER BY id) AS la, [CAST({BASE_LNG} AS DOUBLE)] || list(lng ORDER BY id) AS lo FROM points WHERE lat IS NOT NULL GROUP BY tour_id),
      s AS (
        SELECT tour_id, range(0, len(ids) + 1) AS ord, CAST(1 AS BIGINT) AS p, false AS changed, CAST(0 AS BIGINT) AS step FROM t
        UNION ALL
        SELECT tour_id, CASE WHEN swap THEN list_concat(list_concat(ord[1 : p], [y, x]), ord[p + 3 : ]) ELSE ord END, CASE WHEN p < n - 2 THEN p + 1 ELSE 1 END, CASE WHEN p < n - 2 THEN changed OR swap ELSE false END, step + 1
        FROM (
          SELECT *, pri[y + 1] AND NOT pri[x + 1] AND ay - ax <= ax * {P.PRIORITY_TOLERANCE} AND ay + xb - ax - yb <= ax * {P.PRIORITY_TOLERANCE} AS swap
          FROM (
            SELECT *, {_leg('a', 'x')} AS ax, {_leg('a', 'y')} AS ay, {_leg('x', 'b')} AS xb, {_leg('y', 'b')} AS yb
            FROM (SELECT s.tour_id, ord, p, changed, step, pri, la, lo, len(ord) AS n, ord[p] AS a, ord[p + 1] AS x, ord[p + 2] AS y, ord[(p + 2) % len(ord) + 1] AS b FROM s JOIN t ON t.tour_id = s.tour_id)))
        WHERE n >= 3 AND (p < n - 2 OR changed OR swap))
      SELECT t.tour_id, array_to_string(list_transform(ord[2 : ], lambda i: ids[i]), ',') AS ids
      FROM (SELECT tour_id, arg_max(ord, step) AS ord FROM s GROUP BY tour_id) f JOIN t ON t.tour_id = f.tour_id""",
    "r6_external_or_planned": f"WITH {S.POINTS} SELECT tour_id, CASE WHEN tour_id % 4 = 0 THEN 'straight' ELSE 'ors' END AS provider, count(*) AS n_stops, count(*) AS last, count(*) AS n_ids FROM points WHERE lat IS NOT NULL AND NOT done GROUP BY tour_id",
    "j18_apply_corrections": f"""WITH {PARSED}, {GAZ_ONLY}, {KEPT},
      fixed AS (SELECT p.scan_id, g."lookupKey", p.postcode, p.city, g."lookupKey" || CASE WHEN p.postcode <> '' THEN '|' || p.postcode ELSE '' END AS "matchKey"
        FROM parsed p JOIN scans s ON s.scan_id = p.scan_id JOIN gaz g ON g.id = 'node/' || s.custkey WHERE p.scan_id % 13 = 0 AND p.scan_id % 17 <> 0),
      {RESOLVE_TAIL.replace('FROM parsed s', 'FROM fixed s')}
      SELECT scan_id, outcome, outcome <> 'ambiguous' AS selected, count(record_id) AS n_records, min(record_id) AS first_id FROM resolved GROUP BY ALL""",
}
