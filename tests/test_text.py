from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from postloom.functions import text as T
from postloom.operators import parse


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("raw", ["Goethestraße", "Goethestrasse", "Goethestr.", "Goethestr", "GoethestraBe", "Goethestrase", "• Goethestraße"])
def test_street_spellings_share_a_key(spark, raw):
    got = parse.parse_address(spark.createDataFrame([(f"{raw} 12",)], "raw string")).first()
    assert got["lookupKey"] == "goethestrasse|12"


@pytest.mark.parametrize(
    ("raw", "key"),
    [
        ("Clara-Zetkin-Straße 16", "clara zetkinstrasse|16"),
        ("Treptower Straße 6", "treptowerstrasse|6"),
        ("Neubrandenburger Straße 9a", "neubrandenburgerstrasse|9a"),
        ("Strandweg 4", "strandweg|4"),
        ("Am Markt 7", "am markt|7"),
        ("Zeitschrift\nKundennummer 44823\nEmpfängerstraße 2\n54321 Hamburg", "empfaengerstrasse|2"),
        ("Gartenstraße 9a, 17109 Demmin", "gartenstrasse|9a"),
        ("", ""),
        (None, ""),
    ],
)
def test_parse(spark, raw, key):
    got = parse.parse_address(spark.createDataFrame([(raw,)], "raw string")).first()
    assert got["lookupKey"] == key


def test_postcode_prefers_the_line_with_a_city(spark):
    got = parse.parse_address(spark.createDataFrame([("Kundennummer 44823\nHafenstr. 1\n54321 Hamburg",)], "raw string")).first()
    assert (got["postcode"], got["city"], got["matchKey"]) == ("54321", "Hamburg", "hafenstrasse|1|54321")


def test_umlauts_do_not_join_words(spark):
    assert one(spark, "ä12345", T.extract_postcode) == "12345"
    assert one(spark, "a12345", T.extract_postcode) == ""


def test_device_cards(spark):
    rows = ["Q Suche", "Tour 705", "Hartmut Drews", "81-11", "Törpin 79 81-11", "ulrike storch", "Törpin 36", "jan", "Gehmkow 6", "Fertig 24/56"]
    lines = spark.createDataFrame([(1, i, x, float(i), 1.0, 0.0, 0.0) for i, x in enumerate(rows)], "photo_id int, line_no int, text string, top double, height double, left double, width double")
    got = parse.split_device_cards(lines, ["photo_id"]).orderBy("block_no").collect()
    assert [r["raw"].split("\n")[0] for r in got] == ["Törpin 79", "Törpin 36", "Gehmkow 6"]


def test_blocks_end_at_postcodes_and_wide_gaps(spark):
    rows = [("PAKETLISTE 30 Pakete", 0), ("Anna", 200), ("Hauptstr. 1", 220), ("Hof", 240), ("Bert", 320), ("Ringweg 2", 340), ("Hof", 360), ("Carl", 440), ("Seeweg 3", 460), ("Hof", 480)]
    lines = spark.createDataFrame([(1, i, x, float(t), 18.0) for i, (x, t) in enumerate(rows)], "photo_id int, line_no int, text string, top double, height double")
    got = [r["raw"] for r in parse.split_by_gap(lines, ["photo_id"]).orderBy("block_no").collect()]
    assert got == ["Anna\nHauptstr. 1\nHof", "Bert\nRingweg 2\nHof", "Carl\nSeeweg 3\nHof"]


def test_receiver_is_not_the_sender(spark):
    blocks = spark.createDataFrame([(1, 0, "Absender\nMusterstraße 1\n12345 Berlin"), (1, 1, "Max Mustermann\nEmpfängerstraße 2\n54321 Hamburg")], "photo_id int, block_no int, raw string")
    assert "54321" in parse.pick_receiver(blocks, ["photo_id"]).first()["raw"]
