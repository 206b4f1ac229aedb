"""Text-recognition results as line rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = "struct<Left: double, Width: double>"
LINE = f"struct<LineText: string, MinTop: double, MaxHeight: double, Words: array<{WORD}>>"
OVERLAY = f"ParsedResults array<struct<ParsedText: string, TextOverlay: struct<Lines: array<{LINE}>>>>, IsErroredOnProcessing boolean, ErrorMessage string, _broken string"


def parse_overlay(results: DataFrame, key: str = "photo_id", body: str = "body") -> DataFrame:
    """(key, broken, error, page_text, lines): one row for each result in JSON.

    broken is the body where it is no JSON of this form; error the service's own message where it
    says that it failed.  page_text are the texts of all pages, one under the other; lines their
    lines in order.  A missing or broken body, or one without results, has no text and no lines.
    """
    own = results.select(key, F.from_json(F.col(body), OVERLAY, {"columnNameOfCorruptRecord": "_broken"}).alias("r"))
    messages = F.coalesce(F.array_join(F.from_json("r.ErrorMessage", "array<string>"), " "), F.col("r.ErrorMessage"))
    failed = F.coalesce(F.col("r.IsErroredOnProcessing"), F.lit(False))
    pages = F.when(~failed, F.col("r.ParsedResults"))
    none = F.array().cast(f"array<{LINE}>")
    text = F.array_join(F.transform(pages, lambda p: F.coalesce(p["ParsedText"], F.lit(""))), "\n")
    lines = F.flatten(F.transform(F.coalesce(pages, F.array().cast(f"array<struct<ParsedText: string, TextOverlay: struct<Lines: array<{LINE}>>>>")), lambda p: F.coalesce(p["TextOverlay"]["Lines"], none)))
    return own.select(key, F.when(F.col("r.ParsedResults").isNull(), F.col("r._broken")).alias("broken"), F.when(failed, F.coalesce(F.nullif(messages, F.lit("")), F.lit("OCR error"))).alias("error"), text.alias("page_text"), lines.alias("lines"))


def _extent(words: Column) -> tuple[Column, Column]:
    """(left, width) of a line's words; 0 without any."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    left = F.array_min(F.transform(words, lambda w: zero(w["Left"])))
    right = F.array_max(F.transform(words, lambda w: zero(w["Left"]) + zero(w["Width"])))
    return zero(left), zero(right - left)


def read_overlay(results: DataFrame, key: str = "photo_id", body: str = "body") -> DataFrame:
    """(key, broken, error, page_text, line_no, text, top, height, left, width, confidence): a row for each line.

    Lines are numbered from 0 through all pages of a result; missing numbers are 0, the confidence
    of this form is always null.  A result without lines keeps one row, whose line columns are null.
    """
    own = parse_overlay(results, key, body)
    own = own.select(key, "broken", "error", "page_text", F.posexplode_outer("lines").alias("line_no", "x"))
    left, width = _extent(F.coalesce("x.Words", F.array().cast(f"array<{WORD}>")))
    line = {"text": F.trim(F.coalesce("x.LineText", F.lit(""))), "top": F.coalesce("x.MinTop", F.lit(0.0)), "height": F.coalesce("x.MaxHeight", F.lit(0.0)), "left": left, "width": width}
    there = F.col("line_no").isNotNull()
    return own.select(key, "broken", "error", "page_text", F.col("line_no").cast("long").alias("line_no"), *[F.when(there, c).alias(n) for n, c in line.items()], F.lit(None).cast("double").alias("confidence"))


def read_boxes(lines: DataFrame) -> DataFrame:
    """Lines with a box x0, y0, x1, y1 as top, height, left, width, all 0 without a box; a confidence that is no number is null."""
    b = lambda c: F.coalesce(F.col(f"bbox.{c}"), F.lit(0.0))
    kept = [c for c in lines.columns if c not in ("bbox", "confidence", "text")]
    text = [F.trim(F.coalesce("text", F.lit(""))).alias("text")] if "text" in lines.columns else []
    sure = F.col("confidence").try_cast("double") if "confidence" in lines.columns else F.lit(None).cast("double")
    return lines.select(*kept, *text, b("y0").alias("top"), (b("y1") - b("y0")).alias("height"), b("x0").alias("left"), (b("x1") - b("x0")).alias("width"), F.when(~F.isnan(sure), sure).alias("confidence"))
