"""DuckDB SQL of the registered address and route queries."""

from __future__ import annotations

from ..functions import text as T
from ..sources import views_sql as S
from ..sources.views import BASE_LAT, BASE_LNG

ORACLES: dict[str, str] = {}

POSTCODE = r"\b(\d{5})\b"
POSTCODE_CITY = r"\b(\d{5})\s+([A-Za-zÄÖÜäöüß][A-Za-zÄÖÜäöüß.\- ]*)"
LINES = "doc_lines AS (SELECT doc_id, lang, l - 1 AS line_no, string_split(text, chr(10))[l] AS line FROM documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS u(l))"


def score(x: str) -> str:
    t = S.trimmed(x)
    name = S.trimmed(rf"regexp_replace({t}, '[\s.,]*\d+\s*[a-zA-Z]?\s*$', '')")
    last = rf"regexp_extract({name}, '(\S*)$', 1)"
    letters = f"least(length(regexp_replace({name}, '[^{T.LETTER}]', '', 'g')), 12) * CAST(0.1 AS DOUBLE)"
    return (
        rf"(CASE WHEN regexp_matches({t}, '(?i)\b({T.NON_STREET_WORDS})\b') THEN -100.0 ELSE 0.0 END"
        rf" + CASE WHEN regexp_matches({last}, '(?i)({T.STREET_ENDINGS})$') OR regexp_matches({name}, '(?i)^({T.STREET_PREFIXES})\b') THEN 10.0 ELSE 0.0 END"
        rf" + CASE WHEN regexp_matches({t}, '\d+\s*[a-zA-Z]?$') THEN 3.0 ELSE 0.0 END + {letters})"
    )


def house(x: str, group: int) -> str:
    got = f"regexp_extract({x}, '{T.HOUSE}', {group})"
    has = f"regexp_matches({x}, '{T.HOUSE}')"
    if group == 1:
        return f"CASE WHEN {has} THEN {S.trimmed(got)} ELSE {S.trimmed(x)} END"
    if group == 2:
        return rf"CASE WHEN {has} THEN regexp_replace({got}, '\s+', '', 'g') ELSE '' END"
    return f"CASE WHEN {has} THEN lower({got}) ELSE '' END"


def tidy(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace({x}, '[.,]', ' ', 'g'), '\s+', ' ', 'g'))"


# Parsing by rows: one per line, then the postcode line, the best street line, and the keys.
PARSED = rf"""{S.SCANS},
pl AS (
  SELECT scan_id, raw, l AS n, {S.trimmed("string_split(raw, chr(10))[l]")} AS line
  FROM scans, unnest(range(1, len(string_split(raw, chr(10))) + 1)) AS u(l)),
pc AS (
  SELECT scan_id, min(CASE WHEN regexp_matches(line, '{POSTCODE_CITY}') THEN n END) AS with_city, min(CASE WHEN regexp_matches(line, '{POSTCODE}') THEN n END) AS free
  FROM pl WHERE line <> '' GROUP BY scan_id),
loc AS (
  SELECT pc.scan_id, coalesce(with_city, free) AS pcn,
    CASE WHEN with_city IS NOT NULL THEN regexp_extract(line, '{POSTCODE_CITY}', 1) WHEN free IS NOT NULL THEN regexp_extract(line, '{POSTCODE}', 1) ELSE '' END AS postcode,
    CASE WHEN with_city IS NOT NULL THEN {tidy(f"regexp_extract(line, '{POSTCODE_CITY}', 2)")} WHEN free IS NOT NULL THEN {tidy(f"regexp_extract(line, '{POSTCODE}(.*)$', 2)")} ELSE '' END AS city
  FROM pc LEFT JOIN pl ON pl.scan_id = pc.scan_id AND pl.n = coalesce(with_city, free)),
best AS (
  SELECT scan_id, line FROM (
    SELECT pl.scan_id, line, row_number() OVER (PARTITION BY pl.scan_id ORDER BY {score('line')} DESC, length(line) DESC, n) AS r
    FROM pl JOIN loc ON loc.scan_id = pl.scan_id WHERE n IS DISTINCT FROM pcn AND regexp_matches(line, '[{T.LETTER}]') AND regexp_matches(line, '\d')) WHERE r = 1),
seg AS (
  SELECT loc.scan_id, loc.postcode, loc.city, trim(regexp_replace(regexp_replace(regexp_replace(best.line, '^[^0-9A-Za-zÄÖÜäöüß]+', ''), '[,;]+\s*$', ''), '\s+', ' ', 'g')) AS display
  FROM loc JOIN best ON best.scan_id = loc.scan_id),
parsed0 AS (
  SELECT scan_id, display, {house('display', 1)} AS street, {house('display', 2)} AS "houseNumber", {house('display', 3)} AS "houseLetter", postcode, city FROM seg),
parsed1 AS (
  SELECT *, CASE WHEN {S.norm_street('street')} = '' THEN '' ELSE {S.norm_street('street')} || '|' || "houseNumber" || "houseLetter" END AS "lookupKey" FROM parsed0),
parsed AS (
  SELECT *, CASE WHEN "lookupKey" <> '' AND postcode <> '' THEN "lookupKey" || '|' || postcode ELSE "lookupKey" END AS "matchKey" FROM parsed1)"""

GAZ_ONLY = S.GAZ.replace(S.PLACES + ",\n", "")
KEPT = f"""kept AS (
  SELECT g.*, count(*) OVER (PARTITION BY "lookupKey") AS n_raw, {S.norm_city('city')} AS city_norm FROM gaz g),
pool AS (
  SELECT k.* FROM kept k WHERE NOT EXISTS (
    SELECT 1 FROM kept p WHERE p."lookupKey" = k."lookupKey" AND p.id < k.id AND p.postcode = k.postcode AND p.city_norm = k.city_norm AND {S.km('p', 'k')} <= 0.15))"""

RESOLVED = f"""{PARSED},
{GAZ_ONLY},
{KEPT},
cand AS (
  SELECT s.scan_id, s."lookupKey", s."matchKey", p.id AS record_id, p.postcode AS rpc, p.city AS rcity, p.lat, p.lng, p.n_raw,
    coalesce(s.postcode <> '' AND p.postcode = s.postcode, false) AS is_pc, coalesce({S.norm_city('s.city')} <> '' AND p.city_norm = {S.norm_city('s.city')}, false) AS is_city
  FROM parsed s LEFT JOIN pool p ON p."lookupKey" = s."lookupKey"),
counted AS (
  SELECT *, count(record_id) OVER w AS n_pool, sum(CAST(is_pc AS INT)) OVER w AS n_pc, sum(CAST(is_city AS INT)) OVER w AS n_city, sum(CAST(is_pc AND is_city AS INT)) OVER w AS n_agree
  FROM cand WINDOW w AS (PARTITION BY scan_id)),
narrowed AS (
  SELECT *, n_raw > 1 AND n_pool > 1 AS several, n_pc > 0 AND n_city > 0 AND n_agree = 0 AS conflict FROM counted
  WHERE CASE WHEN record_id IS NULL OR NOT (n_raw > 1 AND n_pool > 1) THEN true WHEN n_pc > 0 AND n_city > 0 AND n_agree = 0 THEN is_pc OR is_city
    WHEN n_agree > 0 THEN is_pc AND is_city WHEN n_pc > 0 THEN is_pc WHEN n_city > 0 THEN is_city ELSE true END),
resolved AS (
  SELECT scan_id, "lookupKey", record_id, rcity, lat, lng, outcome,
    CASE outcome WHEN 'resolved' THEN 'index:' || record_id WHEN 'unknown' THEN CASE WHEN "matchKey" <> '' THEN "matchKey" ELSE "lookupKey" END ELSE '' END AS "canonicalId"
  FROM (SELECT *, CASE WHEN n_pool = 0 THEN 'unknown' WHEN NOT several OR (count(record_id) OVER (PARTITION BY scan_id) = 1 AND NOT conflict) THEN 'resolved' ELSE 'ambiguous' END AS outcome FROM narrowed))"""

SCAN_IDS = f"""{RESOLVED},
one AS (
  SELECT scan_id, max("canonicalId") AS "canonicalId", bool_or(outcome = 'resolved') AS resolved FROM resolved GROUP BY scan_id),
ids AS (
  SELECT s.scan_id, s.tour_id, s.seq, p."lookupKey", p."matchKey", p.postcode, one."canonicalId", one.resolved
  FROM scans s JOIN parsed p ON p.scan_id = s.scan_id JOIN one ON one.scan_id = s.scan_id)"""

POINTS_ONLY = S.POINTS.replace(S.SCANS + ",\n", "")
ORDERED = f"""{S.ORDER},
ordered AS (
  SELECT p.*, row_number() OVER (PARTITION BY p.tour_id ORDER BY s.rank ASC NULLS LAST, "createdAt", p.id) AS position
  FROM points p LEFT JOIN saved s ON s.tour_id = p.tour_id AND s.id = p.id)"""


def length(source: str, order: str) -> str:
    """Closed length by tour over the rows of a table with coordinates."""
    m = lambda a, b, c, e: S.haversine(a, b, c, e, "6371000.0")
    return f"""SELECT tour_id, sum({m('la', 'ga', 'lat', 'lng')} + CASE WHEN nxt IS NULL THEN {m('lat', 'lng', str(BASE_LAT), str(BASE_LNG))} ELSE 0 END) AS m FROM (
      SELECT tour_id, lat, lng, lag(lat, 1, CAST({BASE_LAT} AS DOUBLE)) OVER w AS la, lag(lng, 1, CAST({BASE_LNG} AS DOUBLE)) OVER w AS ga, lead(lat) OVER w AS nxt
      FROM {source} WHERE lat IS NOT NULL WINDOW w AS (PARTITION BY tour_id ORDER BY {order})) GROUP BY tour_id"""


def five(lat: str, lng: str) -> str:
    return f"CASE WHEN {lat} IS NULL THEN '-' ELSE CAST(CAST(floor({lat} * 100000 + 0.5) AS BIGINT) AS VARCHAR) || ',' || CAST(CAST(floor({lng} * 100000 + 0.5) AS BIGINT) AS VARCHAR) END"


NODES = f"""{S.POINTS},
seen AS (SELECT *, count(*) OVER (PARTITION BY tour_id) + 1 AS n FROM points WHERE lat IS NOT NULL),
nodes AS (
  SELECT tour_id, n, row_number() OVER (PARTITION BY tour_id ORDER BY id) AS i, lat, lng FROM seen
  UNION ALL SELECT DISTINCT tour_id, n, 0, CAST({BASE_LAT} AS DOUBLE), CAST({BASE_LNG} AS DOUBLE) FROM seen),
pairs AS (
  SELECT a.tour_id, a.n, a.i, b.i AS j, CASE WHEN a.i = b.i THEN 0.0 ELSE {S.km('a', 'b', '6371000.0')} END AS meters FROM nodes a JOIN nodes b ON a.tour_id = b.tour_id)"""

STATUS = "CASE event_type WHEN 'purchase' THEN 'delivered' WHEN 'error' THEN 'failed' ELSE 'pending' END"
OUTLIERS = f"""{S.GAZ},
h AS (SELECT id, split_part("lookupKey", '|', 1) AS sk, "houseNumber" AS house, postcode AS pc, {S.norm_city('city')} AS cn, lat, lng FROM gaz),
pr AS (
  SELECT a.id, b.house, arg_min(b.lat, b.id) AS lat, arg_min(b.lng, b.id) AS lng, any_value(a.lat) AS alat, any_value(a.lng) AS alng
  FROM h a JOIN h b ON a.sk = b.sk AND a.house <> b.house AND (a.pc = '' OR b.pc = '' OR a.pc = b.pc) AND (a.cn = '' OR b.cn = '' OR a.cn = b.cn)
    AND ((a.pc <> '' AND a.pc = b.pc) OR (a.cn <> '' AND a.cn = b.cn))
  GROUP BY a.id, b.house),
sp AS (SELECT x.id, x.house, min({S.km('x', 'y')}) AS d FROM pr x JOIN pr y ON x.id = y.id AND x.house <> y.house GROUP BY x.id, x.house),
md AS (SELECT id, median(d) AS normal FROM sp GROUP BY id),
nn AS (SELECT id, count(*) AS n, min({S.haversine('alat', 'alng', 'lat', 'lng')}) AS nearest FROM pr GROUP BY id HAVING count(*) >= 4),
quality AS (
  SELECT g.id, coalesce(nearest > greatest(0.25, normal * 5), false) AS suspicious, coalesce(CAST(round(nearest * 1000) AS BIGINT), 0) AS nearest_m, CASE WHEN nearest IS NULL THEN 0 ELSE CAST(round(greatest(0.25, normal * 5) * 1000) AS BIGINT) END AS threshold_m
  FROM gaz g LEFT JOIN nn ON nn.id = g.id LEFT JOIN md ON md.id = g.id AND nn.id IS NOT NULL)"""

SUGGESTED = f"""known AS (SELECT street AS known_street, min(id) AS first_id, {S.norm_street('street')} AS kn FROM gaz GROUP BY street),
own AS (SELECT DISTINCT street, {S.norm_street('street')} AS street_norm FROM parsed),
flagged AS (SELECT *, street_norm IN (SELECT kn FROM known) AS known FROM own),
near AS (
  SELECT street_norm, known_street, first_id, levenshtein(street_norm, kn) AS dd FROM (SELECT DISTINCT street_norm FROM flagged WHERE NOT known), known
  WHERE levenshtein(street_norm, kn) <= greatest(2, CAST(floor(length(street_norm) * CAST(0.3 AS DOUBLE)) AS INT))),
pick AS (SELECT street_norm, known_street AS suggestion FROM (SELECT *, row_number() OVER (PARTITION BY street_norm ORDER BY dd, first_id) AS r FROM near) WHERE r = 1),
hints AS (SELECT f.street, f.street_norm, f.known, suggestion FROM flagged f LEFT JOIN pick ON pick.street_norm = f.street_norm)"""

OUTLIERS_ONLY = OUTLIERS.replace(S.GAZ + ",\n", "")
CONFIDENCE = f"""{RESOLVED},
{OUTLIERS_ONLY},
{SUGGESTED},
per AS (
  SELECT scan_id, max(outcome) AS outcome, max("canonicalId") AS "canonicalId", count(record_id) AS n, bool_or(coalesce(suspicious, false)) AS suspicious
  FROM resolved LEFT JOIN quality ON quality.id = record_id GROUP BY scan_id),
why AS (
  SELECT p.scan_id, per."canonicalId", outcome, n, hints.suggestion,
    CASE WHEN outcome = 'resolved' AND per.suspicious THEN 'index-coordinate-outlier' WHEN outcome = 'resolved' THEN 'index' WHEN outcome = 'ambiguous' THEN 'ambiguous' WHEN p."matchKey" = '' THEN 'unparsed'
      WHEN p."matchKey" IN (SELECT "matchKey" FROM gaz) THEN 'exact' WHEN hints.known THEN 'house-missing' ELSE 'street-missing' END AS reason
  FROM parsed p JOIN per ON per.scan_id = p.scan_id LEFT JOIN hints ON hints.street = p.street),
conf AS (
  SELECT scan_id, CASE WHEN reason IN ('index', 'exact') THEN 'green' WHEN reason = 'unparsed' THEN 'red' ELSE 'yellow' END AS confidence, reason, "canonicalId", outcome = 'resolved' AS resolved,
    CASE WHEN outcome = 'ambiguous' THEN n ELSE 0 END AS n_candidates, CASE WHEN reason = 'street-missing' THEN suggestion END AS suggestion FROM why)"""

ORACLES |= {
    "p1_transliterate": f"WITH {LINES} SELECT doc_id, line_no, md5({S.translit('line')}) AS line_md5 FROM doc_lines",
    "p2_normalize_street": f"WITH {LINES} SELECT doc_id, line_no, {S.norm_street('line')} AS street_norm FROM doc_lines WHERE lang = 'de'",
    "p3_extract_postcode": f"WITH {S.SCANS} SELECT scan_id, regexp_extract(raw, '{POSTCODE}', 1) AS postcode FROM scans",
    "p4_split_house": f"WITH {S.SCANS}, x AS (SELECT scan_id, string_split(raw, chr(10))[2] AS line FROM scans) SELECT scan_id, {house('line', 1)} AS street, {house('line', 2)} AS house, {house('line', 3)} AS letter FROM x",
    "p5_parse_address": f'WITH {PARSED} SELECT scan_id, display, street, "houseNumber", "houseLetter", postcode, city, "lookupKey", "matchKey" FROM parsed',
    "p6_score_street_line": f"WITH {LINES} SELECT doc_id, line_no, CAST(round({score('line')} * 10) AS BIGINT) AS tenths FROM doc_lines",
    "p7_system_lines": rf"WITH {LINES} SELECT lang, count(*) FILTER (WHERE regexp_matches({S.trimmed('line')}, '(?i)^{T.SYSTEM_LINE}\b')) AS n_system, count(*) AS n_lines FROM doc_lines GROUP BY lang",
    "p11_normalize_city": f"SELECT n_nationkey, {S.norm_city('n_name')} AS city_norm FROM nation",
    "p14_haversine": f"WITH {S.POINTS} SELECT id, CAST(round({S.haversine('lat', 'lng', str(BASE_LAT), str(BASE_LNG), '6371000.0')}) AS BIGINT) AS meters FROM points WHERE lat IS NOT NULL",
    "p15_within_area": f"WITH {S.POINTS} SELECT id, lat IS NULL OR (abs(lat - 53.6) <= 40.0 / 111 AND abs(lng - 13.3) <= 40.0 / (111 * greatest(CAST(0.2 AS DOUBLE), cos(radians(CAST(53.6 AS DOUBLE)))))) AS inside FROM points",
    "p25_scan_errors": "SELECT ['network', 'key', 'limit', 'size', 'busy', 'strange'][event_id % 6 + 1] AS reason, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1",
    "a5_a6_streets": f'WITH {S.GAZ} SELECT street, count(*) AS n_records, count(DISTINCT "houseNumber") AS n_houses FROM gaz GROUP BY street',
    "w1_collapse_geometry": f'WITH {S.GAZ}, {KEPT} SELECT id, "lookupKey", n_raw FROM pool',
    "a9_coordinate_outliers": f"WITH {OUTLIERS} SELECT id, suspicious, nearest_m, threshold_m FROM quality",
    "j1_lookup_candidates": f'WITH {PARSED}, {GAZ_ONLY} SELECT scan_id, count(id) AS n_candidates, min(id) AS first_id FROM parsed LEFT JOIN gaz ON gaz."lookupKey" = parsed."lookupKey" GROUP BY scan_id',
    "j2_exact_match": f'WITH {PARSED}, {GAZ_ONLY}, f AS (SELECT "matchKey", min(id) AS record_id FROM gaz GROUP BY "matchKey") SELECT scan_id, record_id FROM parsed LEFT JOIN f ON f."matchKey" = parsed."matchKey"',
    "w2_resolve": f'WITH {RESOLVED} SELECT scan_id, outcome, "canonicalId", record_id FROM resolved',
    "w2_resolution_by_town": f"WITH {RESOLVED} SELECT outcome, coalesce(rcity, '-') AS town, count(DISTINCT scan_id) AS n_scans FROM resolved GROUP BY 1, 2",
    "j5_nearest_street": f"WITH {PARSED}, {GAZ_ONLY}, {SUGGESTED} SELECT * FROM hints",
    "p17_confidence": f"WITH {CONFIDENCE} SELECT * FROM conf",
    "a11_confidence_summary": f"WITH {CONFIDENCE} SELECT confidence, reason, count(*) AS n_scans, count(*) FILTER (WHERE confidence <> 'red' AND n_candidates = 0) AS n_selected FROM conf GROUP BY ALL",
    "w4_dedupe_scans": f"""WITH {SCAN_IDS}, k AS (SELECT *, coalesce(CASE WHEN resolved THEN "canonicalId" WHEN "lookupKey" <> '' THEN "lookupKey" || '#' || postcode END, 'row:' || seq) AS k FROM ids)
      SELECT tour_id, scan_id, "lookupKey" FROM (SELECT *, row_number() OVER (PARTITION BY tour_id, k ORDER BY seq) AS r FROM k) WHERE r = 1""",
    "j7_match_point": f"""WITH {SCAN_IDS}, {POINTS_ONLY},
      a AS (SELECT "canonicalId", min(id) AS p1 FROM points GROUP BY 1), b AS (SELECT "matchKey", min(id) AS p2 FROM points GROUP BY 1)
      SELECT scan_id, coalesce(p1, p2) AS point_id FROM ids LEFT JOIN a ON a."canonicalId" = ids."canonicalId" LEFT JOIN b ON b."matchKey" = ids."matchKey" """,
    "a1_aggregate_counts": f"""WITH {S.ITEMS}, x AS (SELECT tour_id, count(*) FILTER (WHERE type = 'parcel') AS parcel, count(*) FILTER (WHERE type = 'magazine') AS magazine, count(*) FILTER (WHERE type = 'letter') AS letter, count(*) FILTER (WHERE status = 'delivered') AS delivered, count(DISTINCT point_id) AS stops FROM items GROUP BY tour_id)
      SELECT tour_id, parcel, magazine, letter, delivered, magazine + letter AS mail, parcel + magazine + letter AS items, stops, stops AS total FROM x""",
    "a2_item_types": f"WITH {S.ITEMS} SELECT tour_id, point_id, count(*) FILTER (WHERE type = 'parcel') AS parcel, count(*) FILTER (WHERE type = 'magazine') AS magazine, count(*) FILTER (WHERE type = 'letter') AS letter FROM items GROUP BY ALL",
    "a3_point_status": f"WITH {S.POINTS} SELECT tour_id, id, CASE WHEN done THEN 'done' ELSE 'pending' END AS status FROM points",
    "a4_merge_points": f"""WITH {S.POINTS}, g AS (SELECT "canonicalId", count(*) - 1 AS merged, arg_min(id, ("createdAt", id)) AS id FROM points GROUP BY 1),
      n AS (SELECT "canonicalId", count(*) AS n_items FROM items i JOIN points p ON p.id = i.point_id GROUP BY 1) SELECT id, g."canonicalId", merged, n_items FROM g JOIN n ON n."canonicalId" = g."canonicalId" """,
    "o1_order_by_route": f"WITH {ORDERED} SELECT tour_id, id, position FROM ordered",
    "o2_reorder_from_saved": f'WITH {S.ORDER} SELECT p.tour_id, p.id, row_number() OVER (PARTITION BY p.tour_id ORDER BY s.rank ASC NULLS LAST, "createdAt", p.id) AS position FROM points p LEFT JOIN saved s ON s.tour_id = p.tour_id AND s.id = p.id WHERE lat IS NOT NULL AND NOT done',
    "a10_loop_length": f"WITH {ORDERED}, l AS ({length('ordered', 'position')}) SELECT t.tour_id, coalesce(CAST(round(m) AS BIGINT), 0) AS meters FROM (SELECT DISTINCT tour_id FROM ordered) t LEFT JOIN l ON l.tour_id = t.tour_id",
    "a12_tour_summary": f"WITH {ORDERED}, l AS ({length('ordered', 'position')}), c AS (SELECT tour_id, count(*) FILTER (WHERE lat IS NOT NULL AND NOT done) AS stops, count(*) FILTER (WHERE lat IS NULL AND NOT done) AS skipped, count(*) FILTER (WHERE lat IS NOT NULL AND done) AS delivered FROM ordered GROUP BY tour_id) SELECT c.*, round(coalesce(m, 0) / 1000, 1) AS km FROM c LEFT JOIN l ON l.tour_id = c.tour_id",
    "p28_route_signature": f"WITH {ORDERED} SELECT tour_id, md5('{int(BASE_LAT * 100000 + 0.5)},{int(BASE_LNG * 100000 + 0.5)}#' || string_agg(id || ':' || {five('lat', 'lng')}, '|' ORDER BY position)) AS signature_md5 FROM ordered GROUP BY tour_id",
    "w6_consolidate_localities": f"""WITH {ORDERED}, s AS (SELECT tour_id, id, lat, lng, position, postcode || '|' || lower(city) AS g FROM ordered WHERE lat IS NOT NULL),
      f AS (SELECT *, min(position) OVER (PARTITION BY tour_id, g) AS fp FROM s), gg AS (SELECT *, row_number() OVER (PARTITION BY tour_id ORDER BY fp, position) AS grouped FROM f),
      l0 AS ({length('gg', 'position')}), l1 AS ({length('gg', 'grouped')})
      SELECT gg.tour_id, id, CASE WHEN l1.m <= l0.m * CAST(1.12 AS DOUBLE) + 2000 THEN grouped ELSE position END AS position FROM gg JOIN l0 ON l0.tour_id = gg.tour_id JOIN l1 ON l1.tour_id = gg.tour_id""",
    "p24_validate_stops": f"""WITH {S.POINTS}, x AS (SELECT *, row_number() OVER (PARTITION BY tour_id ORDER BY id) AS job, count(*) OVER (PARTITION BY tour_id) AS n, CASE WHEN custkey % 41 = 0 THEN 95.0 ELSE lat END AS la FROM points)
      SELECT tour_id, job, CASE WHEN n > 48 THEN 'too many stops' WHEN la IS NULL OR la > 90 OR lng IS NULL THEN 'bad location' END AS reason, CASE WHEN custkey % 130 <= 100 THEN custkey % 130 ELSE -1 END AS priority, city AS "group" FROM x""",
    "s12_export_jobs": f"""WITH {S.POINTS} SELECT tour_id, row_number() OVER (PARTITION BY tour_id ORDER BY id) AS job, id, CASE WHEN has_parcel THEN 100 ELSE -1 END AS priority, postcode || '|' || lower(city) AS "group" FROM points WHERE lat IS NOT NULL""",
    "j12_stop_pairs": f"WITH {NODES} SELECT tour_id, n, i, j, CAST(round(meters) AS BIGINT) AS meters FROM pairs",
    "j13_fill_matrix": f"WITH {NODES} SELECT tour_id, count(*) AS n_pairs, CAST(round(sum(CASE WHEN (i + j) % 23 <> 0 THEN meters * (CAST(1.2 AS DOUBLE) + (i * 31 + j * 17) % 10 * CAST(0.03 AS DOUBLE)) ELSE meters END) / 1000) AS BIGINT) AS km FROM pairs GROUP BY tour_id",
    "t3_latest_status": f"WITH x AS (SELECT user_id AS item_id, {STATUS} AS status, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) SELECT item_id, status, CASE WHEN status <> 'pending' THEN ts END AS \"deliveredAt\" FROM x WHERE r = 1",
}

SYSTEM = rf"(?i)^{T.SYSTEM_LINE}\b"
COUNTER = r"\b\d{1,4}\s*/\s*\d{1,4}\b"


def noise(x: str) -> str:
    return (
        rf"({x} = '' OR regexp_matches({x}, '{SYSTEM}') OR regexp_matches({x}, '^\s*\d{{1,3}}\s*[-–]\s*\d{{1,3}}\s*$') OR regexp_matches({x}, '(?i)^{T.DEVICE_WORDS}\b')"
        rf" OR (regexp_matches({x}, '{COUNTER}') AND NOT regexp_matches(regexp_replace({x}, '{COUNTER}', '', 'g'), '[{T.LETTER}]')) OR regexp_matches({x}, '^\d{{1,2}}$') OR NOT regexp_matches({x}, '[{T.LETTER}0-9]'))"
    )


def strip_code(x: str) -> str:
    return S.trimmed(rf"regexp_replace({x}, '^(.*\d+[a-zA-Z]?)\s+\d{{1,3}}\s*[-–]\s*\d{{1,3}}\s*$', '\1')")


def start(x: str) -> str:
    return rf"length(regexp_replace(regexp_extract({strip_code(x)}, '^(.+?)[\s.,]*\d+\s*[a-zA-Z]?$', 1), '[^{T.LETTER}]', '', 'g')) >= 2"


def blocks(source: str, order: str) -> str:
    """Address blocks of rows (photo_id, block_no, line)."""
    return rf"""SELECT photo_id, block_no, raw FROM (
      SELECT photo_id, block_no, string_agg(line, chr(10) ORDER BY {order}) AS raw, bool_or({score('line')} > 0) AS street, bool_and(regexp_matches(line, '{SYSTEM}')) AS chrome FROM {source} GROUP BY photo_id, block_no)
      WHERE NOT chrome AND regexp_matches(raw, '[{T.LETTER}]') AND regexp_matches(raw, '\d') AND (street OR regexp_matches(raw, '{POSTCODE}'))"""


def nav(navigator: str, postal: str, place: str) -> str:
    return f"SELECT id, '{navigator}' AS navigator, CASE WHEN manual THEN {place} ELSE {postal} END AS url FROM labelled"


ORACLES |= {
    "p23_address_starts": f"WITH {S.LINES} SELECT photo_id, count(*) FILTER (WHERE {noise('text')}) AS n_noise, count(*) FILTER (WHERE {start('text')}) AS n_starts, count(*) AS n_lines FROM lines GROUP BY photo_id",
    "g1_split_by_postcode": rf"""WITH {S.LINES}, x AS (SELECT photo_id, line_no, {S.trimmed('text')} AS line FROM lines WHERE line_no >= 0 AND text <> '81-11'),
      y AS (SELECT *, CAST(coalesce(sum(CAST(regexp_matches(line, '{POSTCODE}') AS INT)) OVER (PARTITION BY photo_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS block_no FROM x WHERE line <> '' AND NOT regexp_matches(line, '{SYSTEM}'))
      {blocks('y', 'line_no')}""",
    "g3_device_cards": rf"""WITH {S.LINES}, x AS (SELECT *, {S.trimmed('text')} AS t, min("left") OVER w AS lo, max("left" + width) OVER w AS hi, max(width) OVER w > 0 AS wide FROM lines WHERE mode = 'device' AND {S.trimmed('text')} <> '' WINDOW w AS (PARTITION BY photo_id)),
      y AS (SELECT photo_id, top, line_no, {strip_code('t')} AS line FROM x WHERE NOT (wide AND "left" > lo + (hi - lo) * CAST(0.62 AS DOUBLE) AND length(regexp_replace(t, '[^{T.LETTER}]', '', 'g')) < 3) AND NOT {noise('t')}),
      z AS (SELECT *, CAST(sum(CAST({start('line')} AS INT)) OVER (PARTITION BY photo_id ORDER BY top, line_no) AS BIGINT) AS block_no FROM y), cards AS (SELECT * FROM z WHERE block_no > 0)
      {blocks('cards', 'top, line_no')}""",
    "s9_nav_links": f"""WITH {S.POINTS}, labelled AS (SELECT id, custkey % 37 = 0 AS manual, url_encode(street || ' ' || "houseNumber" || ', ' || trim(postcode || ' ' || city)) AS label, CAST(round(coalesce(lat, 0), 4) AS VARCHAR) || ',' || CAST(round(coalesce(lng, 0), 4) AS VARCHAR) AS spot FROM points)
      {nav('google', "'https://www.google.com/maps/dir/?api=1&destination=' || label || '&travelmode=driving'", "'https://www.google.com/maps/dir/?api=1&destination=' || spot || '&travelmode=driving'")}
      UNION ALL {nav('waze', "'https://waze.com/ul?q=' || label || '&navigate=yes'", "'https://waze.com/ul?ll=' || spot || '&navigate=yes'")}
      UNION ALL {nav('geo', "'geo:0,0?q=' || label", "'geo:' || spot || '?q=' || spot || '(' || label || ')'")}
      UNION ALL {nav('apple', "'https://maps.apple.com/?daddr=' || label || '&dirflg=d'", "'https://maps.apple.com/?daddr=' || spot || '&dirflg=d'")}""",
    "s2_load_gazetteer": f"""WITH {S.GAZ}, k AS (SELECT *, CAST(regexp_extract(id, '(\\d+)', 1) AS BIGINT) AS ck FROM gaz),
      r AS (SELECT ck * 2 + CASE WHEN starts_with(id, 'way') THEN 1 ELSE 0 END AS row_no, CASE WHEN ck % 2 = 0 THEN id ELSE 'node/' || ck END AS id0, "lookupKey" FROM k)
      SELECT row_no, CASE WHEN row_number() OVER (PARTITION BY id0 ORDER BY row_no) > 1 THEN id0 || '#' || row_no ELSE id0 END AS id, "lookupKey", 'street' AS "addressKind" FROM r""",
}


POINT_IDS = f"""{S.POINTS},
{GAZ_ONLY},
{KEPT},
cand AS (SELECT s.id AS pid, s."matchKey", p.id AS record_id, p.n_raw, coalesce(s.postcode <> '' AND p.postcode = s.postcode, false) AS is_pc, coalesce(p.city_norm = {S.norm_city('s.city')}, false) AS is_city
  FROM points s LEFT JOIN pool p ON p."lookupKey" = s."lookupKey"),
counted AS (SELECT *, count(record_id) OVER w AS n_pool, sum(CAST(is_pc AS INT)) OVER w AS n_pc, sum(CAST(is_city AS INT)) OVER w AS n_city, sum(CAST(is_pc AND is_city AS INT)) OVER w AS n_agree FROM cand WINDOW w AS (PARTITION BY pid)),
narrowed AS (
  SELECT *, n_raw > 1 AND n_pool > 1 AS several, n_pc > 0 AND n_city > 0 AND n_agree = 0 AS conflict FROM counted
  WHERE CASE WHEN record_id IS NULL OR NOT (n_raw > 1 AND n_pool > 1) THEN true WHEN n_pc > 0 AND n_city > 0 AND n_agree = 0 THEN is_pc OR is_city
    WHEN n_agree > 0 THEN is_pc AND is_city WHEN n_pc > 0 THEN is_pc WHEN n_city > 0 THEN is_city ELSE true END),
hit AS (SELECT pid, record_id FROM (SELECT *, count(record_id) OVER (PARTITION BY pid) AS n_kept FROM narrowed) WHERE n_pool > 0 AND (NOT several OR (n_kept = 1 AND NOT conflict)))"""

CACHE = f"""cache0 AS (SELECT s_suppkey AS s, {S.norm_street(S._list(S.STREETS) + "[s_suppkey % 12 + 1]")} || '|' || (s_suppkey % 20 + 501) AS "matchKey", CASE WHEN s_suppkey % 7 <> 0 THEN CAST(53.0 AS DOUBLE) + s_suppkey * CAST(0.01 AS DOUBLE) END AS lat, CASE WHEN s_suppkey % 7 <> 0 THEN CAST(12.9 AS DOUBLE) + s_suppkey * CAST(0.01 AS DOUBLE) END AS lng FROM supplier),
cache AS (SELECT "matchKey", lat, lng FROM (SELECT *, row_number() OVER (PARTITION BY "matchKey" ORDER BY s) AS r FROM cache0) WHERE r = 1)"""
INSIDE = "abs(lat - 53.6) <= 40.0 / 111 AND abs(lng - 13.3) <= 40.0 / (111 * greatest(CAST(0.2 AS DOUBLE), cos(radians(CAST(53.6 AS DOUBLE)))))"
PLACE = """CASE WHEN resolved THEN "canonicalId" WHEN "lookupKey" <> '' THEN "lookupKey" || '#' || postcode END"""
SIGNED = f"SELECT tour_id, '{int(BASE_LAT * 100000 + 0.5)},{int(BASE_LNG * 100000 + 0.5)}#' || string_agg(id || ':' || {five('lat', 'lng')}, '|' ORDER BY position) AS signature FROM ordered GROUP BY tour_id"

ORACLES |= {
    "j6_geocode_fallback": f"""WITH {PARSED}, {CACHE}, x AS (SELECT c."matchKey" IS NOT NULL AS is_cached, lat IS NOT NULL AND (p.postcode <> '' OR ({INSIDE})) AS located FROM parsed p LEFT JOIN cache c ON c."matchKey" = p."matchKey")
      SELECT is_cached, located, count(*) AS n_scans FROM x GROUP BY ALL""",
    "p32_geocode_query_text": f"""WITH {PARSED} SELECT scan_id, trim(regexp_replace(street || ' ' || "houseNumber" || "houseLetter" || ' ' || postcode || ' ' || city, ' +', ' ', 'g')) AS query FROM parsed""",
    "p19_point_label": f"""WITH {S.POINTS} SELECT id, street || ' ' || "houseNumber" || ', ' || trim(postcode || ' ' || city) AS label, postcode || '|' || lower(city) AS locality FROM points""",
    "j14_skip_known": f"WITH {SCAN_IDS}, k AS (SELECT *, {PLACE} AS k FROM ids) SELECT scan_id FROM k WHERE scan_id % 2 = 0 AND (k IS NULL OR k NOT IN (SELECT k FROM k WHERE scan_id % 2 = 1 AND k IS NOT NULL))",
    "j9_migrate_points": f"""WITH {POINT_IDS} SELECT p.id, CASE WHEN hit.pid IS NOT NULL THEN 'index:' || record_id ELSE p."matchKey" END AS "canonicalId", hit.pid IS NOT NULL AS "canonicalResolved" FROM points p LEFT JOIN hit ON hit.pid = p.id""",
    "r7_provider_ladder": f"WITH {S.POINTS}, x AS (SELECT tour_id, count(*) AS n FROM points GROUP BY 1) SELECT tour_id, CASE WHEN tour_id % 3 = 0 AND n <= 48 THEN 'ors' WHEN tour_id % 2 = 0 AND n <= 100 THEN 'osrm' WHEN tour_id % 5 = 0 THEN 'trip' ELSE 'straight' END AS provider FROM x",
    "r6_apply_external_order": f"""WITH {S.POINTS}, j AS (SELECT tour_id, id, row_number() OVER (PARTITION BY tour_id ORDER BY id) AS job FROM points WHERE lat IS NOT NULL)
      SELECT tour_id, id, row_number() OVER (PARTITION BY tour_id ORDER BY job DESC) AS position, tour_id % 4 <> 0 AS complete FROM j WHERE NOT (tour_id % 4 = 0 AND job = 1)""",
    "w7_stale_routes": f"""WITH {ORDERED}, s AS ({SIGNED}), l AS ({length('ordered', 'position')}), x AS (SELECT s.tour_id, coalesce(m, 0) AS m, s.tour_id % 2 = 0 AND s.tour_id % 5 <> 0 AS holds FROM s LEFT JOIN l ON l.tour_id = s.tour_id)
      SELECT tour_id, CAST(round(CASE WHEN holds THEN tour_id + 1000 ELSE m END) AS BIGINT) AS meters, NOT holds AS stale FROM x""",
    "r10_push_route": f"""WITH {S.POINTS}, t AS (SELECT DISTINCT tour_id FROM points),
      st AS (SELECT tour_id, 'straight' AS provider, 2 AS version, 'current' AS slot FROM t WHERE tour_id % 2 = 0 UNION ALL SELECT tour_id, 'osrm', 1, 'previous' FROM t WHERE tour_id % 2 = 0
        UNION ALL SELECT tour_id, 'osrm', 1, 'current' FROM t WHERE tour_id % 2 = 1 UNION ALL SELECT tour_id, 'ors', 0, 'previous' FROM t WHERE tour_id % 2 = 1 AND tour_id % 3 = 0)
      SELECT tour_id, provider, version, CASE WHEN bool_or(slot = 'previous') OVER (PARTITION BY tour_id) THEN CASE slot WHEN 'current' THEN 'previous' ELSE 'current' END ELSE slot END AS slot FROM st""",
    "o5_legacy_order": f"WITH {S.POINTS} SELECT tour_id, string_agg(id, ',' ORDER BY custkey % 7, id) AS ids FROM points WHERE custkey % 4 <> 0 AND tour_id % 2 = 1 GROUP BY tour_id",
    "t2_stream_dedupe": f"WITH {SCAN_IDS} SELECT DISTINCT tour_id, coalesce({PLACE}, 'row:' || scan_id) AS place FROM ids",
    "t3_stream_status": ORACLES["t3_latest_status"],
    "t4_live_totals": f"""WITH {S.ITEMS}, e AS (SELECT user_id AS item_id, {STATUS} AS now, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events),
      i AS (SELECT items.* EXCLUDE (status), coalesce(now, status) AS status FROM items LEFT JOIN e ON e.item_id = items.item_id AND r = 1),
      x AS (SELECT tour_id, count(*) FILTER (WHERE type = 'parcel') AS parcel, count(*) FILTER (WHERE type = 'magazine') AS magazine, count(*) FILTER (WHERE type = 'letter') AS letter, count(*) FILTER (WHERE status = 'delivered') AS delivered, count(DISTINCT point_id) AS stops FROM i GROUP BY tour_id)
      SELECT tour_id, parcel, magazine, letter, delivered, magazine + letter AS mail, parcel + magazine + letter AS items, stops, stops AS total FROM x""",
    "t1_ingest_checks": f"WITH {S.ITEMS} SELECT tour_id, count(*) FILTER (WHERE type = 'parcel') AS parcel, count(*) FILTER (WHERE type = 'magazine') AS magazine, count(*) FILTER (WHERE type = 'letter') AS letter, CAST(0 AS BIGINT) AS n_twice, CAST(0 AS BIGINT) AS n_lost FROM items GROUP BY tour_id",
    "s6_s7_point_store": f"""WITH {S.POINTS}, p AS (SELECT id, "canonicalId", city, "createdAt", (length(id) + ascii(right(id, 1))) % 4 AS k FROM points),
      a AS (SELECT id, "canonicalId", "createdAt", k, CASE WHEN k = 0 THEN upper(city) ELSE city END AS city FROM p WHERE k <> 1),
      b AS (SELECT *, row_number() OVER (PARTITION BY "canonicalId" ORDER BY "createdAt", id) AS n, count(*) OVER (PARTITION BY "canonicalId") AS many FROM a),
      now AS (SELECT id, "canonicalId", k, CASE WHEN many > 1 THEN city || '+' ELSE city END AS city FROM b WHERE n = 1)
      SELECT id, city, 'by id' AS view FROM now WHERE k = 2
      UNION ALL SELECT id, city, 'by identity' FROM now WHERE "canonicalId" IN (SELECT "canonicalId" FROM p WHERE k = 3)
      UNION ALL SELECT id, city, 'before' FROM p UNION ALL SELECT id, city, 'now' FROM now""",
}
