"""Delivery points: identity of scans, merging, counts and status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def dedupe_key() -> Column:
    """Scans with equal keys are one place: by record when resolved, else by lookupKey and postcode."""
    return F.when(F.col("resolved"), F.col("canonicalId")).when(F.col("lookupKey") != "", F.concat(F.col("lookupKey"), F.lit("#"), F.col("postcode")))


def dedupe_scans(scans: DataFrame, within: str = "tour_id", seq: str = "seq") -> DataFrame:
    """The first scan of each place; scans without any key all stay."""
    own = scans.withColumn("_key", F.coalesce(dedupe_key(), F.concat(F.lit("row:"), F.col(seq).cast("string"))))
    w = Window.partitionBy(within, "_key").orderBy(seq)
    return own.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_key", "_n")


def skip_known(new: DataFrame, known: DataFrame) -> DataFrame:
    """New scans whose place is not among the known ones."""
    keys = known.select(dedupe_key().alias("_known")).filter("_known is not null").distinct()
    return new.withColumn("_key", dedupe_key()).join(keys, F.col("_key") == F.col("_known"), "left_anti").drop("_key")


def item_type_of_mode(mode: Column) -> Column:
    """What a scan's mode makes of its items: a device scans parcels, any other mode names its own type."""
    return F.when(mode == "device", "parcel").otherwise(mode)


def make_items(scans: DataFrame) -> DataFrame:
    """(scan_id, item_id, type, source, status, rawText, note, addedAt, deliveredAt): a new item for each scan, pending.

    ``scans``: scan_id, mode, raw, addedAt; source and note where they have them.  The id follows
    from the scan, so that making items again makes the same ones.
    """
    have = lambda c, other: F.coalesce(F.col(c), F.lit(other)) if c in scans.columns else F.lit(other)
    item_id = F.concat(F.lit("i"), F.sha2(F.col("scan_id").cast("string"), 256).substr(1, 16))
    return scans.select("scan_id", item_id.alias("item_id"), item_type_of_mode(F.col("mode")).alias("type"), have("source", "manual").alias("source"), F.lit("pending").alias("status"), F.coalesce("raw", F.lit("")).alias("rawText"), have("note", "").alias("note"), "addedAt", F.lit(None).cast("timestamp").alias("deliveredAt"))


def make_points(parsed: DataFrame) -> DataFrame:
    """New points of parsed addresses, with what a point has before anything is known of it.

    ``parsed``: scan_id, the columns of parse_address, createdAt; canonicalId, resolved, lat, lng,
    verified where they are known.  The identity is the canonicalId, else the matchKey, else the
    lookupKey, else empty; the id follows from it.
    """
    have = lambda c, other: F.coalesce(F.col(c), other) if c in parsed.columns else other
    none = F.lit(None).cast("double")
    own = parsed.withColumn("canonicalId", have("canonicalId", F.lit("")))
    identity = F.coalesce(F.nullif("canonicalId", F.lit("")), F.nullif("matchKey", F.lit("")), F.nullif("lookupKey", F.lit("")), F.lit(""))
    address = ("street", "houseNumber", "houseLetter", "postcode", "city", "raw")
    known = have("lat", none).isNotNull() & have("lng", none).isNotNull()
    return own.select(
        new_point_id().alias("id"),
        "matchKey",
        "lookupKey",
        identity.alias("canonicalId"),
        have("resolved", F.lit(False)).alias("canonicalResolved"),
        *address,
        have("lat", none).alias("lat"),
        have("lng", none).alias("lng"),
        F.lit(False).alias("coordinateSuspicious"),
        F.lit(0).alias("coordinateDistanceM"),
        F.lit(False).alias("coordinateManual"),
        F.when(known, "matched").otherwise("notfound").alias("geocodeStatus"),
        have("verified", F.lit(False)).alias("verified"),
        F.lit(None).cast("long").alias("routeOrder"),
        "createdAt",
    )


def item_counts(items: DataFrame) -> DataFrame:
    """Parcels, magazines and letters of each point; other types do not count."""
    kinds = ("parcel", "magazine", "letter")
    return items.groupBy("tour_id", "point_id").agg(*[F.count_if(F.col("type") == k).alias(k) for k in kinds])


def point_status(points: DataFrame, items: DataFrame) -> DataFrame:
    """empty without items, done when every item is delivered or failed, else pending."""
    own = items.groupBy(F.col("point_id").alias("id")).agg(F.bool_and(F.col("status").isin("delivered", "failed")).alias("all_done"))
    status = F.when(F.col("all_done").isNull(), "empty").when(F.col("all_done"), "done").otherwise("pending")
    return points.select("tour_id", "id").join(own, "id", "left").select("tour_id", "id", status.alias("status"))


def aggregate_counts(points: DataFrame, items: DataFrame) -> DataFrame:
    """Totals of each tour; stops and total count points that have items, not items."""
    own = items.groupBy("tour_id").agg(
        F.count_if(F.col("type") == "parcel").alias("parcel"),
        F.count_if(F.col("type") == "magazine").alias("magazine"),
        F.count_if(F.col("type") == "letter").alias("letter"),
        F.count_if(F.col("status") == "delivered").alias("delivered"),
        F.countDistinct("point_id").alias("stops"),
    )
    tours = points.select("tour_id").distinct()
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    own = tours.join(own, "tour_id", "left")
    return own.select("tour_id", *[zero(c).alias(c) for c in ("parcel", "magazine", "letter", "delivered")], (zero("magazine") + zero("letter")).alias("mail"), (zero("parcel") + zero("magazine") + zero("letter")).alias("items"), zero("stops").alias("stops"), zero("stops").alias("total"))


def rollup_counts(points: DataFrame, items: DataFrame, regions: DataFrame) -> DataFrame:
    """Totals of each tour, of each region (tour_id null) and of the fleet (both null).  ``regions``: tour_id, region."""
    own = aggregate_counts(points, items).join(regions, "tour_id", "left")
    sums = ("parcel", "magazine", "letter", "delivered", "mail", "items", "stops", "total")
    level = F.grouping_id().alias("_level")
    return own.rollup("region", "tour_id").agg(level, *[F.sum(c).alias(c) for c in sums]).select(F.when(F.col("_level") == 0, "tour").when(F.col("_level") == 1, "region").otherwise("fleet").alias("level"), "region", "tour_id", *sums)


def merge_points(points: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(points, items) with points of one canonicalId merged.

    The earliest survives, ties by id; it takes the first coordinates of the group when it has
    none, and the group's items, each once.  Points without a canonicalId stay as they are.
    """
    group = F.when(F.coalesce(F.col("canonicalId"), F.lit("")) != "", F.col("canonicalId")).otherwise(F.concat(F.lit("own:"), F.col("id")))
    w = Window.partitionBy("_group").orderBy("createdAt", "id")
    all_ = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    seen = F.when(F.col("lat").isNotNull() & F.col("lng").isNotNull(), F.struct("lat", "lng"))
    own = points.withColumn("_group", group)
    own = own.withColumn("_n", F.row_number().over(w)).withColumn("_keep", F.first("id").over(all_)).withColumn("_at", F.first(seen, ignorenulls=True).over(all_)).withColumn("merged", (F.count("*").over(all_) - 1))
    kept = own.filter("_n = 1").withColumn("lat", F.col("_at.lat")).withColumn("lng", F.col("_at.lng")).drop("_group", "_n", "_keep", "_at")
    moved = items.join(own.select(F.col("id").alias("point_id"), "_keep", "_n"), "point_id").withColumn("point_id", F.col("_keep"))
    once = Window.partitionBy("point_id", "item_id").orderBy("_n")
    moved = moved.withColumn("_i", F.row_number().over(once)).filter("_i = 1 or _n = 1").drop("_keep", "_n", "_i")
    return kept, moved


def match_points(scans: DataFrame, points: DataFrame, key: str = "scan_id") -> DataFrame:
    """(key, point_id): the point by canonicalId, else by matchKey; the lowest id of several."""
    by_id = points.filter("canonicalId <> ''").groupBy("canonicalId").agg(F.min("id").alias("p1"))
    by_key = points.filter("matchKey <> ''").groupBy("matchKey").agg(F.min("id").alias("p2"))
    # scans without a value are dealt out by their own keys; scans may be many, so nothing is broadcast
    own = scans.select(key, *[F.when(F.col(c) != "", F.struct(F.col(c).alias("value"), F.lit("").alias("none"))).otherwise(F.struct(F.lit("").alias("value"), F.coalesce(F.col(key).cast("string"), F.lit("")).alias("none"))).alias(c) for c in ("canonicalId", "matchKey")])
    whole = lambda df, c: df.withColumn(c, F.struct(F.col(c).alias("value"), F.lit("").alias("none")))
    return own.hint("merge").join(whole(by_id, "canonicalId"), "canonicalId", "left").hint("merge").join(whole(by_key, "matchKey"), "matchKey", "left").select(key, F.coalesce("p1", "p2").alias("point_id"))


def new_point_id() -> Column:
    """Id of the point that a scan of an unknown place makes: scans of one identity make one point."""
    return F.concat(F.lit("n"), F.sha2(_identity(), 256).substr(1, 16))


def _identity() -> Column:
    text = lambda c: F.nullif(F.col(c), F.lit(""))
    return F.coalesce(text("canonicalId"), text("matchKey"), text("lookupKey"), F.concat(F.lit("scan:"), F.col("scan_id").cast("string")))


def add_items(scans: DataFrame, points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(points, placed): points after a batch of scans, and (scan_id, point_id) of every scan.

    ``scans``: scan_id, seq, canonicalId, resolved, matchKey, lookupKey, postcode, city, lat, lng,
    createdAt.  Scans of unknown places make one point for each identity, from the first scan in
    seq order.  The last resolved scan with coordinates refreshes coordinates, identity and
    locality of its point unless those were set by hand; other scans only fill empty coordinates.
    """
    found = match_points(scans, points)
    own = scans.hint("merge").join(found, "scan_id")
    own = own.withColumn("_id", F.coalesce("point_id", new_point_id())).withColumn("_point", F.struct("lat", "lng"))
    first = F.struct("canonicalId", "resolved", "matchKey", "lookupKey", "postcode", "city", "createdAt")
    has = F.col("lat").isNotNull() & F.col("lng").isNotNull()
    per = own.groupBy("_id").agg(
        F.min_by(first, "seq").alias("f"),
        F.min_by(F.when(has, F.col("_point")), F.when(has, F.col("seq"))).alias("any"),
        F.max_by(F.when(has & F.col("resolved"), F.struct("lat", "lng", "canonicalId", "matchKey", "postcode", "city")), F.when(has & F.col("resolved"), F.col("seq"))).alias("sure"),
    )
    old = points.hint("merge").join(per, F.col("id") == F.col("_id"), "left")
    manual = F.coalesce(F.col("coordinateManual"), F.lit(False)) if "coordinateManual" in points.columns else F.lit(False)
    fresh = F.col("sure").isNotNull() & ~manual
    pick = lambda c: F.when(fresh & (F.coalesce(F.col(f"sure.{c}"), F.lit("")) != ""), F.col(f"sure.{c}")).otherwise(F.col(c))
    at = lambda c: F.when(fresh, F.col(f"sure.{c}")).when(F.col(c).isNull() & ~manual, F.col(f"any.{c}")).otherwise(F.col(c))
    changed = {c: pick(c) for c in ("canonicalId", "matchKey", "postcode", "city")} | {c: at(c) for c in ("lat", "lng")}
    kept = old.select(*[(changed[c] if c in changed else F.col(c)).alias(c) for c in points.columns])
    new = per.hint("merge").join(points.select(F.col("id").alias("_id")), "_id", "left_anti")
    made = {"id": F.col("_id"), "createdAt": F.col("f.createdAt"), "lat": F.coalesce(F.col("sure.lat"), F.col("any.lat")), "lng": F.coalesce(F.col("sure.lng"), F.col("any.lng"))}
    made |= {c: F.coalesce(F.col(f"sure.{c}"), F.col(f"f.{c}")) for c in ("canonicalId", "matchKey", "postcode", "city")} | {"lookupKey": F.col("f.lookupKey")}
    kinds = dict(points.dtypes)
    new = new.select(*[(made[c] if c in made else F.lit(None)).cast(kinds[c]).alias(c) for c in points.columns])
    return kept.unionByName(new), own.select("scan_id", F.col("_id").alias("point_id"))


def upsert(base: DataFrame, updates: DataFrame, key: str = "id") -> DataFrame:
    """Rows of ``base`` with those of ``updates`` in their place or added."""
    return base.join(updates.select(key), key, "left_anti").unionByName(updates)


def replace_merged(points: DataFrame, survivors: DataFrame, duplicates: DataFrame) -> DataFrame:
    """The points after a merge: survivors in, duplicates out, as one table."""
    return upsert(points, survivors).join(duplicates.select("id"), "id", "left_anti")


def locality_group(postcode: Column, city: Column) -> Column:
    both = F.concat(postcode, F.lit("|"), F.lower(city))
    return F.when((postcode == "") & (city == ""), "").otherwise(both)


def point_label(display: Column, postcode: Column, city: Column) -> Column:
    place = F.nullif(F.trim(F.concat_ws(" ", F.nullif(postcode, F.lit("")), F.nullif(city, F.lit("")))), F.lit(""))
    return F.concat_ws(", ", F.nullif(display, F.lit("")), place)


def nav_links(points: DataFrame) -> DataFrame:
    """(id, navigator, url): by postal address when there is one, unless the place was set by hand; else by coordinates."""
    label = point_label(F.concat_ws(" ", "street", "houseNumber"), F.col("postcode"), F.col("city"))
    own = points.withColumn("_label", F.replace(F.url_encode(label), F.lit("+"), F.lit("%20")))
    manual = F.coalesce(F.col("coordinateManual"), F.lit(False)) if "coordinateManual" in points.columns else F.lit(False)
    postal = (F.trim("street") != "") & (F.trim("houseNumber") != "") & ~manual
    at = F.concat(F.coalesce(F.col("lat"), F.lit(0.0)).cast("string"), F.lit(","), F.coalesce(F.col("lng"), F.lit(0.0)).cast("string"))
    where = F.when(postal, F.col("_label")).otherwise(at)
    urls = {
        "google": F.concat(F.lit("https://www.google.com/maps/dir/?api=1&destination="), where, F.lit("&travelmode=driving")),
        "waze": F.concat(F.when(postal, F.concat(F.lit("https://waze.com/ul?q="), F.col("_label"))).otherwise(F.concat(F.lit("https://waze.com/ul?ll="), at)), F.lit("&navigate=yes")),
        "geo": F.when(postal, F.concat(F.lit("geo:0,0?q="), F.col("_label"))).otherwise(F.concat(F.lit("geo:"), at, F.lit("?q="), at, F.lit("("), F.col("_label"), F.lit(")"))),
        "apple": F.concat(F.lit("https://maps.apple.com/?daddr="), where, F.lit("&dirflg=d")),
    }
    return own.select("id", F.explode(F.array(*[F.struct(F.lit(k).alias("navigator"), v.alias("url")) for k, v in urls.items()])).alias("x")).select("id", "x.navigator", "x.url")
