"""Which records of a crowded place stay when each takes away those near it, the lowest id first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import params as P
from ..functions.geo import has_coords, haversine_km
from .rounds import checkpointed

SIDE_KM = P.DUPLICATE_KM / 1.4143  # any two records of one cell are twins
RING = 2  # twins lie within so many cells
KM_PER_DEGREE = P.EARTH_KM * 3.141592653589793 / 180


def _cells(df: DataFrame, group: list[str]) -> DataFrame:
    """Adds x and y: cells of the group, as wide as SIDE_KM where the group lies farthest from the equator's width."""
    # the same scale for a whole group; its widest row makes cells narrower elsewhere, never wider
    scale = df.groupBy(group).agg(F.cos(F.radians(F.min(F.abs("lat")))).alias("_wide"), F.cos(F.radians(F.max(F.abs("lat")))).alias("_narrow"))
    across = lambda c, k: F.floor(F.col(c) * KM_PER_DEGREE * k / SIDE_KM).cast("long")
    own = df.hint("merge").join(scale, group).withColumn("x", across("lat", F.lit(1.0))).withColumn("y", across("lng", F.col("_wide")))
    # the farther from the equator, the fewer kilometres a cell spans, so twins may be more cells apart
    return own.withColumn("reach", F.ceil(F.lit(P.DUPLICATE_KM * 1.01 / SIDE_KM) * F.col("_wide") / F.greatest(F.col("_narrow"), F.lit(0.01))).cast("int")).drop("_wide", "_narrow")


def _near(df: DataFrame) -> DataFrame:
    """Each row once for every cell in its reach."""
    around = lambda r: F.explode(F.sequence(-r, r))
    return df.withColumn("_dx", around(F.lit(RING))).withColumn("_dy", around(F.col("reach"))).withColumn("x", F.col("x") + F.col("_dx")).withColumn("y", F.col("y") + F.col("_dy")).drop("_dx", "_dy")


def _twins() -> Column:
    return haversine_km(F.col("lat"), F.col("lng"), F.col("o_lat"), F.col("o_lng")) <= P.DUPLICATE_KM


def keep_first_of_patches(records: DataFrame, group: list[str]) -> DataFrame:
    """The records that stay: each goes if a kept one of its group, of a lower id, lies within 150 m.

    That is what going through a group in id order gives, found by cells at once everywhere.  All
    records of a cell are twins, so a cell keeps one at most.  In a round the first open record of
    each cell is kept if no open twin has a lower id, and takes its twins away; the lowest id of a
    patch is always kept, so rounds end.  Records meet one candidate of each cell around, never one
    another; no row or task holds a group.  Without coordinates they stay.  Ids are unique.
    """
    placed = has_coords(F.col("lat"), F.col("lng"))
    columns = records.columns
    # a round's tables are small as files and hold a row for each cell around, so none is broadcast
    done = [records.filter(~placed)]
    open_ = checkpointed(_cells(records.filter(placed), group))
    cell = [*group, "x", "y"]
    while not open_.isEmpty():
        first = open_.groupBy(*cell).agg(F.min_by(F.struct("id", "lat", "lng", "reach"), "id").alias("o"))
        first = first.select(*cell, F.col("o.id").alias("o_id"), F.col("o.lat").alias("o_lat"), F.col("o.lng").alias("o_lng"), F.col("o.reach").alias("reach"))
        around = _near(first)
        lower = open_.hint("merge").join(around.drop("reach"), cell).filter((F.col("id") < F.col("o_id")) & _twins()).select(F.col("o_id").alias("_late")).distinct()
        kept = checkpointed(open_.hint("merge").join(first.select(F.col("o_id").alias("id")), "id", "left_semi").hint("merge").join(lower, F.col("id") == F.col("_late"), "left_anti"))
        done.append(kept.select(columns))
        takers = _near(kept.select(*cell, F.col("lat").alias("o_lat"), F.col("lng").alias("o_lng"), "reach")).drop("reach")
        gone = open_.hint("merge").join(takers, cell).filter(_twins()).select("id").distinct()
        open_ = checkpointed(open_.hint("merge").join(gone, "id", "left_anti"))
    out = done[0]
    for own in done[1:]:
        out = out.unionByName(own)
    return out
