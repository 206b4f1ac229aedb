"""Address parsing and segmentation of text lines into address blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T


MADE = ["display", "street", "houseNumber", "houseLetter", "postcode", "city", "lookupKey", "matchKey"]


def _made(df: DataFrame, keep: list[str], **columns: Column) -> DataFrame:
    """``keep`` and new columns, through a generator: what uses them reads them instead of computing them again."""
    return df.select(*keep, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def parse_address(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Adds display, street, houseNumber, houseLetter, postcode, city, lookupKey, matchKey.

    All steps are array functions over a row's own lines, so nothing is shuffled.  The postcode
    comes from the first line with postcode and city, else from the first with a free-standing
    five-digit group.  The street line is the best-scoring other line with a letter and a digit;
    ties go to the longer and then to the earlier one; a line without a rival needs no score.
    Null counts as empty.
    """
    made = MADE
    kept = [c for c in df.columns if c not in made]
    own = _made(df, kept, _text=T.trimmed(F.regexp_replace(F.coalesce(F.col(raw), F.lit("")), "\r", "")))
    own = _made(own, [*kept, "_text"], _lines=F.filter(F.transform(F.split("_text", "\n"), T.trimmed), lambda x: x != ""))
    has_digits = F.col("_text").rlike(r"\d{5}")
    with_city = F.when(has_digits, F.array_position(F.transform("_lines", lambda x: x.rlike(T.POSTCODE_CITY)), F.lit(True))).otherwise(0)
    free = F.when(has_digits, F.array_position(F.transform("_lines", lambda x: x.rlike(T.POSTCODE)), F.lit(True))).otherwise(0)
    own = _made(own, [*kept, "_text", "_lines"], _pc_city=with_city.cast("int"), _pc_free=free.cast("int"))
    at = F.when(F.col("_pc_city") > 0, F.col("_pc_city")).otherwise(F.col("_pc_free"))
    could = F.filter("_lines", lambda x, i: (i + 1 != at) & x.rlike(f"[{T.LETTER}]") & x.rlike(r"\d"))
    own = _made(own, [*kept, "_text", "_lines", "_pc_city"], _pc_line=F.coalesce(F.get("_lines", at - 1), F.lit("")), _could=could)
    rank = F.transform("_could", lambda x, i: F.struct(T.score_street_line(x).alias("score"), F.length(x).alias("length"), (-i).alias("back"), x.alias("line")))
    best = F.when(F.size("_could") > 1, F.array_max(rank)["line"]).otherwise(F.get("_could", F.lit(0)))
    tidy = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, "[.,]", " "), r"\s+", " "))
    between = F.coalesce(F.get(F.split("_pc_line", T.EDGE_L + r"\d{5}" + T.EDGE_R), F.lit(1)), F.lit(""))
    postcode = F.when(F.col("_pc_line") == "", "").when(F.col("_pc_city") > 0, F.regexp_extract("_pc_line", T.POSTCODE_CITY, 1)).otherwise(T.extract_postcode(F.col("_pc_line")))
    city = F.when(F.col("_pc_line") == "", "").when(F.col("_pc_city") > 0, tidy(F.regexp_extract("_pc_line", T.POSTCODE_CITY, 2))).otherwise(tidy(between))
    own = _made(own, [*kept, "_text", "_lines"], postcode=postcode, city=city, _best=best)
    before = F.when((F.col("postcode") != "") & (F.instr("_text", F.col("postcode")) > 1), F.substring("_text", F.lit(1), F.instr("_text", F.col("postcode")) - 1))
    segment = F.coalesce("_best", before, F.when(F.col("_text").contains(","), F.substring_index("_text", ",", 1)), F.get("_lines", F.lit(0)), F.col("_text"))
    segment = F.regexp_replace(segment, "\n", " ")
    segment = F.regexp_replace(F.regexp_replace(segment, "^[^0-9A-Za-zÄÖÜäöüß]+", ""), r"[,;]+\s*$", "")
    own = _made(own, [*kept, "_text", "postcode", "city"], _segment=F.trim(F.regexp_replace(segment, r"\s+", " ")))
    street, house, letter = T.split_house(F.col("_segment"))
    display = F.when(F.col("_segment") != "", F.col("_segment")).otherwise(F.col("_text"))
    own = _made(own, [*kept, "postcode", "city"], display=display, street=street, houseNumber=house, houseLetter=letter)
    own = _made(own, [*kept, *made[:6]], _norm=T.normalize_street(F.col("street")))
    lookup = F.when(F.col("_norm") == "", "").otherwise(F.concat("_norm", F.lit("|"), "houseNumber", "houseLetter"))
    own = _made(own, [*kept, *made[:6]], lookupKey=lookup)
    match = F.when((F.col("lookupKey") != "") & (F.col("postcode") != ""), F.concat("lookupKey", F.lit("|"), "postcode")).otherwise(F.col("lookupKey"))
    return _made(own, [*kept, *made[:7]], matchKey=match)


def parse_once(df: DataFrame, raw: str = "raw") -> DataFrame:
    """What ``parse_address`` gives, a text that many rows have parsed once.

    Rows and texts are told to shuffle: files of repeated texts are small beside what they hold.
    """
    spark = df.sparkSession
    kept = [c for c in df.columns if c not in MADE]
    own = df.select(*kept, F.coalesce(F.col(raw), F.lit("")).alias("_raw"))
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    texts = parse_address(own.select("_raw").distinct().repartition(tasks, "_raw"), "_raw")
    return own.hint("merge").join(texts, "_raw").select(*kept, *MADE)


def with_context(street_line, postcode, city):  # noqa: ANN001, ANN201
    """An edited street line with the locality that was known before."""
    tail = F.trim(F.concat_ws(" ", F.nullif(postcode, F.lit("")), F.nullif(city, F.lit(""))))
    return F.when(tail != "", F.concat(street_line, F.lit("\n"), tail)).otherwise(street_line)


def _joined(df: DataFrame, keys: list[str]) -> DataFrame:
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda s: s["line"]), "\n")
    return df.groupBy(*keys, "block_no").agg(text.alias("raw")).filter(T.is_address_block(F.col("raw")))


def split_by_postcode(lines: DataFrame, keys: list[str], order: str = "line_no") -> DataFrame:
    """(keys, block_no, raw): a block ends at a line with a postcode; the rest is a block too."""
    own = lines.select(*keys, F.col(order).alias("ord"), T.trimmed(F.col("text")).alias("line")).filter(F.col("line") != "").filter(~T.is_system_line(F.col("line")))
    w = Window.partitionBy(*keys).orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    ends = F.col("line").rlike(T.POSTCODE).cast("int")
    return _joined(own.withColumn("block_no", F.coalesce(F.sum(ends).over(w), F.lit(0)).cast("long")), keys)


def _upper_median(values):  # noqa: ANN001, ANN202
    """The element in the upper middle of the positive values; 0 without any."""
    own = F.sort_array(F.filter(values, lambda v: v > 0))
    return F.when(F.size(own) > 0, F.get(own, F.floor(F.size(own) / 2).cast("int"))).otherwise(0.0)


def split_by_gap(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Blocks of positioned lines: they end at a postcode or before a gap that is wide for the photo.

    Gaps count only on lists of six lines or more.  Lines with equal top keep their order.  A photo
    with fewer than two positioned lines (top not null) is split by postcode alone, in line order.
    """
    own = lines.select(*keys, F.col("line_no"), "top", "height", T.trimmed(F.col("text")).alias("line")).filter(F.col("line") != "").filter(~T.is_system_line(F.col("line")))
    all_ = Window.partitionBy(*keys)
    own = own.withColumn("placed", F.count("top").over(all_) >= 2).filter(~F.col("placed") | F.col("top").isNotNull())
    own = own.withColumn("at", F.when(F.col("placed"), F.col("top")))
    w = Window.partitionBy(*keys).orderBy("at", "line_no")
    gap = F.greatest(F.lit(0.0), F.lead("at").over(w) - (F.col("at") + F.coalesce("height", F.lit(0.0))))
    own = own.withColumn("gap", gap).withColumn("ord", F.row_number().over(w))
    own = own.withColumn("n", F.count("*").over(all_)).withColumn("gaps", F.collect_list("gap").over(all_)).withColumn("heights", F.collect_list("height").over(all_))
    limit = F.greatest(_upper_median(F.col("gaps")) * 1.8, _upper_median(F.col("heights")) * 0.8)
    own = own.withColumn("limit", limit)
    wide = F.col("placed") & (F.col("n") >= 6) & (F.col("limit") > 0) & (F.coalesce("gap", F.lit(0.0)) > F.col("limit"))
    ends = (F.col("line").rlike(T.POSTCODE) | wide).cast("int")
    own = own.withColumn("block_no", F.coalesce(F.sum(ends).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long"))
    return _joined(own, keys)


def split_device_cards(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Blocks of a device screen: a card begins at a name with house number; screen furniture goes."""
    w = Window.partitionBy(*keys)
    own = lines.withColumn("line", T.trimmed(F.coalesce("text", F.lit("")))).filter(F.col("line") != "")
    own = own.withColumn("wide", F.max("width").over(w) > 0).withColumn("lo", F.min("left").over(w)).withColumn("hi", F.max(F.col("left") + F.col("width")).over(w))
    right = F.col("wide") & (F.col("left") > F.col("lo") + (F.col("hi") - F.col("lo")) * 0.62) & (F.length(F.regexp_replace("line", f"[^{T.LETTER}]", "")) < 3)
    own = own.filter(~right).filter(~T.is_device_noise(F.col("line"))).withColumn("line", T.strip_route_code(F.col("line")))
    order = Window.partitionBy(*keys).orderBy("top", "line_no")
    own = own.withColumn("ord", F.row_number().over(order)).withColumn("block_no", F.sum(T.is_address_start(F.col("line")).cast("int")).over(order).cast("long"))
    return _joined(own.filter("block_no > 0"), keys)


def pick_receiver(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """The recipient's block of each photo: best score, ties to the later one."""
    score = T.receiver_score(F.col("raw"))
    best = blocks.groupBy(*keys).agg(F.max_by(F.struct("block_no", "raw"), F.struct(score.alias("s"), F.col("block_no").alias("b"))).alias("x"))
    return best.select(*keys, "x.block_no", "x.raw")


def extract_blocks(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Address blocks by ``mode``: device screens by cards, parcel lists by gaps, letters and magazines by recipient."""
    device = split_device_cards(lines.filter("mode = 'device'"), keys)
    parcel = split_by_gap(lines.filter("mode = 'parcel'"), keys)
    mail = lines.filter("mode in ('letter', 'magazine')")
    picked = pick_receiver(split_by_gap(mail, keys), keys)
    whole = mail.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda s: s["text"]), "\n").alias("raw"))
    rest = whole.join(picked, keys, "left_anti").select(*keys, F.lit(0).cast("long").alias("block_no"), "raw")
    return device.unionByName(parcel).unionByName(picked).unionByName(rest)
