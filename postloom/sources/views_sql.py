"""The same derived tables as DuckDB common table expressions."""

from __future__ import annotations

from ..functions.text import UMLAUTS
from .views import MODES, STREETS


def translit(x: str) -> str:
    for a, b in UMLAUTS:
        x = f"replace({x}, '{a}', '{b}')"
    return x


def trimmed(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def norm_street(x: str) -> str:
    x = f"regexp_replace(trim(regexp_replace(regexp_replace({translit(trimmed(f'lower({x})'))}, '[^a-z0-9 ]+', ' ', 'g'), '\\s+', ' ', 'g')), 'str$', 'strasse')"
    x = f"regexp_replace(regexp_replace({x}, 'stra(b|ss?)e$', 'strasse'), '\\s+strasse$', 'strasse')"
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def norm_city(x: str) -> str:
    return f"regexp_replace({translit(f'lower(coalesce({x}, {chr(39) * 2}))')}, '[^a-z]', '', 'g')"


def km(a: str, b: str, radius: str = "6371.0") -> str:
    """Haversine between the lat and lng of two aliases."""
    return haversine(f"{a}.lat", f"{a}.lng", f"{b}.lat", f"{b}.lng", radius)


def haversine(la: str, ga: str, lb: str, gb: str, radius: str = "6371.0") -> str:
    return f"(2 * {radius} * asin(sqrt(pow(sin((radians({lb}) - radians({la})) / 2), 2) + cos(radians({la})) * cos(radians({lb})) * pow(sin((radians({gb}) - radians({ga})) / 2), 2))))"


def _list(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


PLACES = f"""places AS (
  SELECT c_custkey AS custkey, CAST(c_nationkey AS BIGINT) AS nation, {_list(STREETS)}[c_custkey % 12 + 1] AS street,
    CAST(c_custkey // 12 % 20 + 1 AS VARCHAR) AS "houseNumber",
    CASE WHEN c_custkey % 10 = 0 THEN '' ELSE CAST(17000 + c_nationkey * 11 AS VARCHAR) END AS postcode,
    'Dorf ' || chr(c_nationkey + 65) AS city,
    CAST(53.0 AS DOUBLE) + CAST(0.05 AS DOUBLE) * c_nationkey + (c_custkey * 7919 % 100) * CAST(0.0001 AS DOUBLE) + CASE WHEN c_custkey % 97 = 5 THEN CAST(0.02 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS lat,
    CAST(12.5 AS DOUBLE) + CAST(0.07 AS DOUBLE) * c_nationkey + (c_custkey * 104729 % 100) * CAST(0.0001 AS DOUBLE) AS lng
  FROM customer)"""

GAZ = f"""{PLACES},
gaz0 AS (
  SELECT 'node/' || custkey AS id, street, "houseNumber", postcode, city, lat + CAST(0 AS DOUBLE) AS lat, lng FROM places
  UNION ALL SELECT 'way/' || custkey, street, "houseNumber", postcode, city, lat + CAST(0.0003 AS DOUBLE), lng FROM places WHERE custkey % 29 = 0),
gaz AS (
  SELECT *, {norm_street('street')} || '|' || "houseNumber" AS "lookupKey",
    {norm_street('street')} || '|' || "houseNumber" || CASE WHEN postcode <> '' THEN '|' || postcode ELSE '' END AS "matchKey" FROM gaz0)"""

SCANS = f"""{PLACES},
scans0 AS (
  SELECT o_orderkey AS o, p.*, o_orderstatus, o_orderdate,
    CASE WHEN o_orderkey % 17 = 0 THEN 'Nirgendwoweg' WHEN o_orderkey % 13 = 0 THEN 'X' || street
      WHEN o_orderkey % 11 = 0 THEN replace(street, 'straße', 'straBe') ELSE street END AS st,
    CAST(CAST("houseNumber" AS BIGINT) + CASE WHEN o_orderkey % 19 = 0 THEN 500 ELSE 0 END AS VARCHAR) AS house,
    CASE o_orderkey % 5 WHEN 2 THEN trim(postcode || ' ' || city) WHEN 3 THEN '99999 ' || city
      WHEN 4 THEN CAST(17000 + (nation + 1) % 25 * 11 AS VARCHAR) || ' ' || city ELSE '' END AS tail,
    o_orderkey // 40 AS tour_id, o_orderkey % 40 AS seq
  FROM orders JOIN places p ON o_custkey = custkey),
scans AS (
  SELECT o AS scan_id, tour_id, seq, tour_id * 5 + seq // 8 AS photo_id, {_list(MODES)}[(tour_id * 5 + seq // 8) % 4 + 1] AS mode,
    'Anna Krüger' || chr(10) || st || ' ' || house || CASE WHEN tail <> '' THEN chr(10) || tail ELSE '' END AS raw,
    CASE o_orderstatus WHEN 'F' THEN 'delivered' WHEN 'O' THEN 'pending' ELSE 'failed' END AS status,
    o_orderdate AS "createdAt", custkey, st, house, tail
  FROM scans0)"""

LINES = f"""{SCANS},
lines AS (
  SELECT tour_id, photo_id, mode, (seq % 8) * 10 + l - 1 AS line_no, string_split(raw, chr(10))[l] AS text,
    CAST((seq % 8) * 200 + (l - 1) * 24 AS DOUBLE) AS top, CAST(18 AS DOUBLE) AS height, CAST(20 AS DOUBLE) AS "left", CAST(300 AS DOUBLE) AS width
  FROM scans, unnest(range(1, len(string_split(raw, chr(10))) + 1)) AS u(l)
  UNION ALL SELECT tour_id, photo_id, mode, (seq % 8) * 10 + 9, '81-11', CAST((seq % 8) * 200 + 10 AS DOUBLE), 18, 400, 60 FROM scans WHERE mode = 'device'
  UNION ALL SELECT DISTINCT tour_id, photo_id, mode, -1, 'Tour 705', CAST(-50 AS DOUBLE), 18, 20, 120 FROM scans)"""

ITEMS = f"""{SCANS},
items AS (
  SELECT tour_id, 'p' || tour_id || '_' || custkey AS point_id, custkey, scan_id AS item_id, CASE WHEN mode = 'device' THEN 'parcel' ELSE mode END AS type, status, "createdAt" AS "addedAt" FROM scans)"""

POINTS = f"""{ITEMS},
points AS (
  SELECT i.tour_id, i.id, i.custkey, street, "houseNumber", postcode, city,
    {norm_street('street')} || '|' || "houseNumber" AS "lookupKey",
    {norm_street('street')} || '|' || "houseNumber" || CASE WHEN postcode <> '' THEN '|' || postcode ELSE '' END AS "matchKey",
    'index:node/' || i.custkey AS "canonicalId", CASE WHEN i.custkey % 23 <> 0 THEN lat END AS lat, CASE WHEN i.custkey % 23 <> 0 THEN lng END AS lng, "createdAt", has_parcel, done
  FROM (SELECT tour_id, point_id AS id, custkey, min("addedAt") AS "createdAt", bool_or(type = 'parcel') AS has_parcel, bool_and(status IN ('delivered', 'failed')) AS done FROM items GROUP BY ALL) i
  JOIN places p ON p.custkey = i.custkey)"""

ORDER = f"""{POINTS},
ranked AS (SELECT tour_id, id, row_number() OVER (PARTITION BY tour_id ORDER BY custkey * 31 % 101, custkey) AS rank FROM points),
saved AS (SELECT tour_id, id, rank FROM ranked WHERE rank % 5 <> 0 UNION ALL SELECT tour_id, 'gone', 0 FROM ranked WHERE rank = 1)"""
