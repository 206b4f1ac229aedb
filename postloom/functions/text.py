"""Text rules for address lines, as native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists and patterns that decide what an address line is.
UMLAUTS = (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss"), ("Ä", "ae"), ("Ö", "oe"), ("Ü", "ue"))
NON_STREET_WORDS = r"brief(e)?|paket(e)?|p(ä|ae)ckchen|sendung\w*|zeitschrift(en)?|zeitung(en)?|magazin(e)?|absender|empf(ä|ae)nger|kunden?\w*|nummer|nr|tel(efon)?|fax|rechnung\w*|bestell\w*|auftrag\w*|datum|seite|blatt|barcode|code|referenz|auch|screenshot|scan"
STREET_ENDINGS = r"stra(ß|ss)e|str|weg|allee|platz|ring|damm|ufer|gasse|steig|steg|chaussee|graben|markt|anger|wall|hof|kamp|koppel|redder|twiete|reihe|zeile|winkel|kehre|pfad|promenade|berg|feld|br(ü|ue)cke|tor"
STREET_PREFIXES = "am|an|auf|bei|beim|hinter|im|in|vor|zum|zur|zu|neben|unter"
SYSTEM_LINE = r"(?:\d{1,2}:\d{2}\s*)?(?:[345]g(?:\+)?|lte|volte|wifi|wlan|nr5g)"
DEVICE_WORDS = r"(q?\s*(search|suche)|stops|info(rmation)?|settings|einstellungen|fertig|gotowe|zrobione|tour|(un)?sortiert|adressen|karte|map)"
SENDER_WORDS = r"absender|abs\.?|retoure|r(ü|ue)cksende\w*|return(\s|-)?to|sender"
RECIPIENT_WORDS = r"empf(ä|ae)nger|z\.?\s?h(d)?\.?|zu\s?h(ä|ae)nden|an:\s|herr(n)?|frau|familie|firma"
LETTER = "a-zA-ZäöüÄÖÜß"
# how a street's ending may be written, in order
STREET_SPELLINGS = (("str$", "strasse"), ("stra(b|ss?)e$", "strasse"), (r"\s+strasse$", "strasse"))
# (verdict, substrings) in order; the first that occurs decides
ERROR_LADDER = (
    ("network", ("failed to fetch", "networkerror")),
    ("key", ("api key", "apikey", "invalid", "unauthorized", "403")),
    ("limit", ("limit", "exceed", "quota", "too many", "requests", "429")),
    ("size", ("size", "large", "big", "maximum", "1024")),
    ("busy", ("busy", "timed out", "timeout", "http 5")),
)

# word edges as ASCII sees them: an umlaut does not belong to a word
EDGE_L, EDGE_R = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))", r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
POSTCODE = EDGE_L + r"(\d{5})" + EDGE_R
POSTCODE_CITY = EDGE_L + r"(\d{5})\s+([A-Za-zÄÖÜäöüß][A-Za-zÄÖÜäöüß.\- ]*)"
HOUSE = r"^(.*?)[\s.,]*?(\d+(?:\s*[-/]\s*\d+)?)\s*([a-zA-Z])?\s*$"


def trimmed(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def transliterate(c: Column) -> Column:
    """Umlauts and sharp s as ASCII; capital umlauts become small pairs."""
    for a, b in UMLAUTS:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def normalize_street(c: Column) -> Column:
    """The comparable form of a street name."""
    c = transliterate(trimmed(F.lower(c)))
    c = F.trim(F.regexp_replace(F.regexp_replace(c, "[^a-z0-9 ]+", " "), r"\s+", " "))
    for written, meant in STREET_SPELLINGS:
        c = F.regexp_replace(c, written, meant)
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def normalize_city(c: Column) -> Column:
    return F.regexp_replace(transliterate(F.lower(F.coalesce(c, F.lit("")))), "[^a-z]", "")


def extract_postcode(c: Column) -> Column:
    return F.regexp_extract(c, POSTCODE, 1)


def split_house(c: Column) -> tuple[Column, Column, Column]:
    """Street part, house number, letter of a line; a line without a number is all street."""
    has = c.rlike(HOUSE)
    return (
        F.when(has, trimmed(F.regexp_extract(c, HOUSE, 1))).otherwise(trimmed(c)),
        F.when(has, F.regexp_replace(F.regexp_extract(c, HOUSE, 2), r"\s+", "")).otherwise(""),
        F.when(has, F.lower(F.regexp_extract(c, HOUSE, 3))).otherwise(""),
    )


def is_system_line(c: Column) -> Column:
    return trimmed(c).rlike("(?iu)^" + SYSTEM_LINE + EDGE_R)


def score_street_line(c: Column) -> Column:
    """How much a line looks like street and house number."""
    t = trimmed(c)
    name = trimmed(F.regexp_replace(t, r"[\s.,]*\d+\s*[a-zA-Z]?\s*$", ""))
    last = F.regexp_extract(name, r"(\S*)$", 1)
    junk = F.when(t.rlike(f"(?iu){EDGE_L}({NON_STREET_WORDS}){EDGE_R}"), -100.0).otherwise(0.0)
    street = F.when(last.rlike(f"(?iu)({STREET_ENDINGS})$") | name.rlike(f"(?iu)^({STREET_PREFIXES}){EDGE_R}"), 10.0).otherwise(0.0)
    house = F.when(t.rlike(r"\d+\s*[a-zA-Z]?$"), 3.0).otherwise(0.0)
    letters = F.least(F.length(F.regexp_replace(name, f"[^{LETTER}]", "")), F.lit(12)) * F.lit(0.1).cast("double")
    return junk + street + house + letters


def is_address_block(c: Column) -> Column:
    """A block with letters and a digit that has a postcode or a line with a street score."""
    block = trimmed(F.coalesce(c, F.lit("")))
    lines = F.split(block, "\n")
    return (
        (block != "")
        & ~F.forall(lines, is_system_line)
        & block.rlike(f"[{LETTER}]")
        & block.rlike(r"\d")
        & (block.rlike(POSTCODE) | F.exists(lines, lambda x: score_street_line(x) > 0))
    )


def strip_route_code(c: Column) -> Column:
    """Without a route code behind a house number."""
    return trimmed(F.regexp_replace(c, r"^(.*\d+[a-zA-Z]?)\s+\d{1,3}\s*[-–]\s*\d{1,3}\s*$", "$1"))


def is_device_noise(c: Column) -> Column:
    """Screen furniture: blank, status bar, route code, chrome words, counters, badges, symbols."""
    s = trimmed(c)
    counter = EDGE_L + r"\d{1,4}\s*/\s*\d{1,4}" + EDGE_R
    return (
        (s == "")
        | is_system_line(s)
        | s.rlike(r"^\s*\d{1,3}\s*[-–]\s*\d{1,3}\s*$")
        | s.rlike(f"(?iu)^{DEVICE_WORDS}{EDGE_R}")
        | (s.rlike(counter) & ~F.regexp_replace(s, counter, "").rlike(f"[{LETTER}]"))
        | s.rlike(r"^\d{1,2}$")
        | ~s.rlike(f"[{LETTER}0-9]")
    )


def is_address_start(c: Column) -> Column:
    """A name of two letters at least, then a house number."""
    s = strip_route_code(c)
    name = F.regexp_extract(s, r"^(.+?)[\s.,]*\d+\s*[a-zA-Z]?$", 1)
    return F.length(F.regexp_replace(name, f"[^{LETTER}]", "")) >= 2


def receiver_score(block: Column) -> Column:
    """How much a block looks like the recipient's."""
    breaks = F.length(block) - F.length(F.replace(block, F.lit("\n"), F.lit("")))
    return (
        F.when(block.rlike(POSTCODE), 3.0).otherwise(0.0)
        - F.when(block.rlike(f"(?iu){EDGE_L}({SENDER_WORDS}){EDGE_R}"), 10.0).otherwise(0.0)
        + F.when(block.rlike(f"(?iu){EDGE_L}({RECIPIENT_WORDS}){EDGE_R}"), 5.0).otherwise(0.0)
        + F.when(block.rlike(r"(?iu)[a-zäöüß].*\d"), 1.0).otherwise(0.0)
        + F.least(breaks, F.lit(3)) * F.lit(0.5).cast("double")
    )


def classify_scan_error(message: Column) -> Column:
    m = F.lower(F.coalesce(message, F.lit("")))
    out = F.when(m == "network", "network")
    for verdict, parts in ERROR_LADDER:
        hit = F.lit(False)
        for p in parts:
            hit = hit | m.contains(p)
        out = out.when(hit, verdict)
    return out.when(m != "", message).otherwise("unknown")


def lookup_from_match(c: Column) -> Column:
    return F.substring_index(F.coalesce(c, F.lit("")), "|", 2)


def keys(street: Column, house: Column, letter: Column, postcode: Column) -> tuple[Column, Column]:
    """lookupKey and matchKey of a parsed address; empty where the street is."""
    norm = normalize_street(street)
    lookup = F.when(norm == "", "").otherwise(F.concat(norm, F.lit("|"), house, letter))
    return lookup, F.when((lookup != "") & (postcode != ""), F.concat(lookup, F.lit("|"), postcode)).otherwise(lookup)
