"""The list of scans under review, gathered over several photos."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .neighbours import choose_by_neighbours
from .parse import parse_address
from .points import dedupe_scans
from .resolve import collapse_geometry, once_among, place_candidates
from .rounds import checkpointed


def accumulate_photos(blocks: DataFrame, gaz: DataFrame) -> DataFrame:
    """(tour_id, seq, photo_id, block_no, lookupKey, matchKey, postcode, canonicalId, resolved, selected): one list a tour.

    ``blocks``: tour_id, photo_id, block_no, raw.  Photos follow each other by number.  All blocks
    are added before any is dropped: open candidates are chosen by their neighbours on the whole
    list, and only then does a repeated place go, since its town may have been unknown before.
    Rows with open candidates are not selected.
    """
    order = Window.partitionBy("tour_id").orderBy("photo_id", "block_no")
    own = blocks.select("tour_id", "photo_id", "block_no", "raw").withColumn("seq", F.row_number().over(order).cast("long"))
    own = own.withColumn("row_id", F.concat_ws("_", "tour_id", "seq"))
    own = checkpointed(parse_address(own))
    pool = checkpointed(collapse_geometry(gaz))
    found = checkpointed(once_among(own, pool, "row_id"))
    ambiguous = F.col("outcome") == "ambiguous"
    place = own.select("row_id", "tour_id", "seq").join(found, "row_id").select("tour_id", "seq", "lat", "lng", "record_id", F.when(ambiguous, F.col("place")).alias("place"))
    chosen = choose_by_neighbours(place, place_candidates(own, pool, "row_id"))
    name = found.select("row_id", "canonicalId", ambiguous.alias("open"))
    rows = own.join(name, "row_id").join(chosen.select("tour_id", "seq", "record_id"), ["tour_id", "seq"])
    resolved = F.col("record_id").isNotNull()
    rows = rows.withColumn("canonicalId", F.when(resolved, F.concat(F.lit("index:"), F.col("record_id"))).otherwise(F.col("canonicalId"))).withColumn("resolved", resolved)
    rows = rows.withColumn("selected", (F.col("matchKey") != "") & (resolved | ~F.col("open")))
    return dedupe_scans(rows).select("tour_id", "seq", "photo_id", "block_no", "lookupKey", "matchKey", "postcode", "canonicalId", "resolved", "selected")
