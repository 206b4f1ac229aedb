"""DuckDB SQL for the operators that SQL can express on whole tables."""

from __future__ import annotations

from .filter_audit import LETTERS, SYMBOLS, Limits
from .line_dedup import Lines
from .mixing import Mix
from .quality import Rules
from .urls import RULES, SPAM_LABELS

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WHITE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
MIX, QUALITY, LINES, LIMITS = Mix(), Rules(), Lines(), Limits()


def low(x: str) -> str:
    return f"translate({x}, '{UPPER}', '{LOWER}')"


DECONTAMINATE = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({low("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all({low("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, array_to_string(ws[i : i + n - 1], ' ') AS c FROM (SELECT *, least(len(ws), 10) AS n FROM b WHERE len(ws) > 0), unnest(range(1, len(ws) - n + 2)) AS u(i)),
dw AS (SELECT doc_id, i, x.n, array_to_string(ws[i : i + x.n - 1], ' ') AS c FROM d, (SELECT DISTINCT n FROM bw) x, unnest(range(1, len(ws) - x.n + 2)) AS u(i)),
hit AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.c = bw.c),
words AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM hit, unnest(range(0, n)) AS u(j) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS names FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words ON words.doc_id = d.doc_id LEFT JOIN items ON items.doc_id = d.doc_id"""

MIXING = rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size, md5('{MIX.seed}:' || doc_id) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS r FROM d GROUP BY source),
w AS (SELECT *, {list(MIX.weights)}[(r - 1) % {len(MIX.weights)} + 1] AS weight, sum(source_size) OVER () * CAST({MIX.share_percent} AS DOUBLE) / 100 AS total FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY CAST(source_size * {MIX.max_passes} AS DOUBLE) / weight, r) AS k FROM w),
c AS (SELECT *, total - coalesce(sum(source_size * {MIX.max_passes}) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest, sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_weight FROM o),
f AS (SELECT min(k) AS k FROM c WHERE CAST(source_size * {MIX.max_passes} AS DOUBLE) / weight >= rest / left_weight),
t AS (
  SELECT c.source, c.source_size, CASE WHEN f.k IS NULL OR c.k < f.k THEN CAST(c.source_size * {MIX.max_passes} AS DOUBLE) ELSE e.rest * c.weight / e.left_weight END AS target
  FROM c, f LEFT JOIN c e ON e.k = f.k),
q AS (SELECT *, least(source_size * {MIX.max_passes}, CAST(floor(target) AS BIGINT)) AS flow FROM t),
p AS (SELECT *, CASE WHEN source_size > 0 THEN flow // source_size ELSE 0 END AS passes, CASE WHEN source_size > 0 THEN flow % source_size ELSE 0 END AS extra FROM q),
u AS (SELECT d.*, p.source_size, p.target, p.passes, p.extra, CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key) AS BIGINT) AS until FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, size * (passes + CASE WHEN extra > 0 AND 2 * until - size <= 2 * extra THEN 1 ELSE 0 END) AS taken FROM u"""

QUALITY_RULES = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i : i + {QUALITY.repeat_window - 1}], ' ') AS c FROM d, unnest(range(1, len(ws) - {QUALITY.repeat_window - 2})) AS u(i)),
rep AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, c) AS n FROM win) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT i + j) AS n_repeat_words FROM rep, unnest(range(0, {QUALITY.repeat_window})) AS u(j) GROUP BY doc_id),
l0 AS (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line FROM d),
l AS (SELECT *, len(regexp_extract_all(line, '{WORD}')) AS n, array_to_string(regexp_extract_all({low('line')}, '{WORD}'), ' ') AS norm FROM l0 WHERE regexp_matches(line, '{WORD}')),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM l GROUP BY doc_id),
hosts AS (SELECT source, count(DISTINCT text) AS n FROM d GROUP BY source),
freq AS (SELECT l.source, norm, count(DISTINCT text) AS n FROM l GROUP BY l.source, norm),
bad AS (SELECT freq.source, norm FROM freq JOIN hosts ON freq.source IS NOT DISTINCT FROM hosts.source WHERE freq.n > {QUALITY.line_docs} AND freq.n * 100 > hosts.n * {QUALITY.line_percent}),
cut AS (SELECT doc_id, CAST(sum(l.n) AS BIGINT) AS n_removed_words FROM l JOIN bad ON l.source IS NOT DISTINCT FROM bad.source AND l.norm = bad.norm GROUP BY doc_id),
m AS (
  SELECT d.doc_id, len(ws) AS n_words, length(regexp_replace(text, '{WHITE}', '', 'g')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_removed_words, 0) AS n_removed_words
  FROM d LEFT JOIN dup ON dup.doc_id = d.doc_id LEFT JOIN cov ON cov.doc_id = d.doc_id LEFT JOIN cut ON cut.doc_id = d.doc_id),
v AS (SELECT *, n_words < {QUALITY.min_words} OR 100 * n_repeat_words > {QUALITY.max_repeat_percent} * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND NOT (n_removed_words > 0 AND (n_words - n_removed_words < {QUALITY.min_words} OR (n_words - n_removed_words) * 100 < n_words * {QUALITY.left_percent})) AS kept FROM v"""

JACCARD = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({low("coalesce(text, '')")}, '{WORD}') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS g FROM d, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS u(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
k AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * n_both >= 75 * (x.n + y.n - n_both)),
e AS (SELECT a, b FROM k UNION ALL SELECT b, a FROM k),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.b) AS component_id FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN r ON r.a = d.doc_id GROUP BY d.doc_id"""


def _url_filters() -> str:
    host = low(r"regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1)")
    rules = sorted(RULES, key=lambda r: -len(r.name))
    fits = lambda r: f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')"
    name = " ".join(f"WHEN {fits(r)} THEN '{r.name}'" for r in rules)
    verdict = " ".join(f"WHEN {fits(r)} THEN '{r.verdict}'" for r in rules)
    return rf"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url, {host} AS host, regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path FROM pages),
q AS (SELECT *, array_to_string(list_sort(list_distinct_keep), '&') AS kept FROM (SELECT *, list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref|fbclid|gclid)=')) AS list_distinct_keep FROM u)),
c AS (SELECT *, regexp_replace(host, '^(www|m)\.', '') || regexp_replace(path, '(/|\.html?)+$', '') || CASE WHEN kept <> '' THEN '?' || kept ELSE '' END AS canonical FROM q),
listed AS (SELECT DISTINCT canonical AS key FROM c WHERE list_has_any(string_split(host, '.'), {list(SPAM_LABELS)})),
v AS (SELECT *, canonical IN (SELECT key FROM listed) AS listed, CASE {name} END AS rule, CASE {verdict} END AS ruled FROM c)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN listed THEN 'block' ELSE 'allow' END) AS verdict, listed FROM v"""


_BITS = [f"((m >> {i}) & 1)" for i in range(len(LETTERS))]
FILTER_AUDIT = rf"""
WITH d0 AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents),
lab AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
d AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    CASE WHEN len(ws) < {LIMITS.words} THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(ws)) < {LIMITS.distinct_percent} * len(ws) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > {LIMITS.capital_percent} * length(t) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(t, '[{SYMBOLS.decode()}]') THEN 8 ELSE 0 END + CASE WHEN d0.doc_id > min(d0.doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS m
  FROM d0 LEFT JOIN lab ON lab.doc_id = d0.doc_id),
c AS (SELECT part, m, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS x FROM d GROUP BY part, m),
f AS (SELECT unnest(range(0, {len(LETTERS)})) AS f),
o AS (
  SELECT a.f AS f1, b.f AS f2, c.f AS f3, d.f AS f4, e.f AS f5 FROM f a, f b, f c, f d, f e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
s AS (SELECT array_to_string(list_transform([f1, f2, f3, f4, f5], lambda i: '{LETTERS}'[i + 1]), '') AS filter_order, step, [f1, f2, f3, f4, f5][step] AS own, list_sum(list_transform([f1, f2, f3, f4, f5][1 : step - 1], lambda i: 1 << i)) AS before FROM o, unnest(range(1, 6)) AS u(step)),
v AS (SELECT part, filter_order, step, 1 << own AS bit, CAST(coalesce(before, 0) AS BIGINT) AS before, c.* EXCLUDE (part), {" + ".join(_BITS)} AS bits FROM c, s)
SELECT part, filter_order, CAST(step AS INTEGER) AS step,
  CAST(coalesce(sum(n) FILTER ((m & (before | bit)) = 0), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER ((m & bit) <> 0 AND (m & before) = 0), 0) AS BIGINT) AS removed,
  CAST(coalesce(sum(n) FILTER ((m & bit) <> 0 AND (m & before) <> 0), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (m = bit), 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(sum(g) FILTER ((m & bit) <> 0 AND (m & before) = 0), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(x) FILTER ((m & bit) <> 0 AND (m & before) = 0), 0) AS BIGINT) AS toxic_lost,
  CAST(coalesce(sum(n * (120 // greatest(bits, 1))) FILTER ((m & bit) <> 0), 0) AS BIGINT) AS shapley
FROM v GROUP BY part, filter_order, step"""

LINE_DEDUP = f"""
WITH l AS (SELECT doc_id, row_no, unnest(string_split(t, chr(10))) AS line, unnest(range(0, len(string_split(t, chr(10))))) AS pos FROM (SELECT doc_id, row_number() OVER () AS row_no, coalesce(text, '') AS t FROM documents)),
k AS (SELECT *, {low("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key FROM l),
f AS (SELECT key, max(doc_id) AS last_id FROM k WHERE length(key) >= {LINES.min_chars} GROUP BY key HAVING count(DISTINCT doc_id) >= {LINES.min_docs}),
v AS (SELECT k.*, f.key IS NOT NULL AND k.doc_id <> f.last_id AS gone FROM k LEFT JOIN f ON f.key = k.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM v GROUP BY doc_id, row_no"""


ORACLES: dict[str, str] = {
    "op1_decontaminate": DECONTAMINATE,
    "op3_mixing": MIXING,
    "op5_quality_rules": QUALITY_RULES,
    "op6_ngram_jaccard": JACCARD,
    "op8_url_filters": _url_filters(),
    "op11_filter_audit": FILTER_AUDIT,
    "op13_line_dedup": LINE_DEDUP,
}
