"""The nearest known name of a misspelt one, by edit distance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rounds import checkpointed


def _segment(length: Column, i: Column, most: int) -> tuple[Column, Column]:
    """(begin from 0, length) of segment i of a name cut into most + 1 near equal ones, the longer ones last."""
    base, longer = F.floor(length / (most + 1)), length % (most + 1)
    first_long = most + 1 - longer
    return (i * base + F.greatest(F.lit(0), i - first_long)).cast("int"), (base + F.when(i >= first_long, 1).otherwise(0)).cast("int")


def common_endings(known: DataFrame, least: int = 20, share: float = 0.01) -> dict[int, list[str]]:
    """The endings of 3 to 9 letters that many of the known names have, by length; at most 1 / ``share`` of each.

    An ending goes on to the left for as long as one letter leads half of its names on; so that
    "strasse" is one, and neither "trasse" nor "rstrasse".
    """
    total = known.count()
    if total * share < least:  # too few names for segments to be common
        return {}
    own = known.select(F.explode(F.transform(F.sequence(F.lit(3), F.lit(10)), lambda n: F.when(F.char_length("known_norm") > n, F.substring("known_norm", -n, n)))).alias("ending"))
    found = own.filter("ending is not null").groupBy("ending").agg(F.count("*").alias("n")).filter(F.col("n") >= max(least, share * total)).collect()
    n = {r["ending"]: r["n"] for r in found}
    leads = lambda e: 2 * n[e] >= n.get(e[1:], 0)
    goes_on = {e[1:] for e in n if leads(e)}
    out: dict[int, list[str]] = {}
    for e in sorted(n):
        if e not in goes_on and len(e) < 10 and (len(e) == 3 or leads(e)):
            out.setdefault(len(e), []).append(e)
    return out


def ending_of(name: Column, endings: dict[int, list[str]]) -> Column:
    """The longest common ending that a name has; empty without any."""
    out = F.lit("")
    for n in sorted(endings):
        own = F.substring(name, -n, n)
        out = F.when((F.char_length(name) > n) & own.isin(endings[n]), own).otherwise(out)
    return out


def _stem(name: Column, ending: Column) -> Column:
    return F.substring(name, F.lit(1), F.char_length(name) - F.char_length(ending))


def segments(known: DataFrame, most: int) -> DataFrame:
    """The known names (column text) by length, number of a segment, and its text."""
    own = known.withColumn("k_len", F.char_length("text")).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(most))))
    begin, size = _segment(F.col("k_len"), F.col("i"), most)
    return own.withColumn("part", F.substring("text", begin + 1, size)).drop("text")


def parts_of(names: DataFrame, most: int) -> DataFrame:
    """What of each name (column text) may be a segment of a known one within ``most`` edits.

    Of most + 1 segments one at least is untouched.  Before the first such one, i, at most i edits
    lie, and behind it at most ``most`` - i; so it stands near its old place.
    """
    ways = [(delta, i, shift) for delta in range(-most, most + 1) for i in range(most + 1) for shift in range(-i, i + 1) if abs(shift - delta) <= most - i]
    way = F.explode(F.array(*[F.struct(F.lit(d).alias("delta"), F.lit(i).alias("i"), F.lit(s).alias("shift")) for d, i, s in ways]))
    own = names.withColumn("way", way).withColumn("k_len", F.char_length("text") - F.col("way.delta")).filter("k_len >= 0").withColumn("i", F.col("way.i"))
    begin, size = _segment(F.col("k_len"), F.col("i"), most)
    own = own.withColumn("_at", begin + F.col("way.shift")).withColumn("_n", size)
    own = own.filter((F.col("_at") >= 0) & (F.col("_at") + F.col("_n") <= F.char_length("text")))
    return own.withColumn("part", F.substring("text", F.col("_at") + 1, F.col("_n"))).drop("way", "_at", "_n", "text").distinct()


def candidates(names: DataFrame, known: DataFrame, most: int, endings: dict[int, list[str]]) -> DataFrame:
    """The pairs of a name and a known one that share a segment in place: all within ``most`` edits, and others.

    Names of one common ending differ by what their stems do, so these are cut; names of different
    endings are cut whole.  A segment that is part of a common ending thus brings no two together.
    """
    a = names.withColumn("ending", ending_of(F.col("street_norm"), endings))
    b = known.withColumn("ending", ending_of(F.col("known_norm"), endings))
    on = ["k_len", "i", "part"]
    same = parts_of(a.withColumn("text", _stem(F.col("street_norm"), F.col("ending"))), most).join(segments(b.withColumn("text", _stem(F.col("known_norm"), F.col("ending"))), most), [*on, "ending"])
    whole = parts_of(a.withColumn("text", F.col("street_norm")), most).join(segments(b.withColumn("text", F.col("known_norm")).withColumnRenamed("ending", "other"), most), on).filter(F.col("ending") != F.col("other")).drop("other")
    return same.drop(*on).unionByName(whole.drop(*on)).drop("ending").distinct()


def nearest_names(names: DataFrame, known: DataFrame) -> DataFrame:
    """(street_norm, known_street): the nearest known name within each one's ``most`` edits, the least first_id of a tie.

    ``names``: street_norm, most.  ``known``: known_norm, known_street, first_id.  Few edits are
    tried first, when segments are long and few names share one; a name that has found one within
    them is done, the others go on with twice as many.
    """
    most, found, open_ = 2, [], names
    endings = common_endings(known)
    while True:
        pairs = candidates(open_, known, most, endings).withColumn("d", F.levenshtein("street_norm", "known_norm"))
        best = pairs.filter((F.col("d") <= F.col("most")) & (F.col("d") <= most)).groupBy("street_norm").agg(F.min_by("known_street", F.struct("d", "first_id")).alias("known_street"))
        state = checkpointed(open_.join(best, "street_norm", "left"))
        found.append(state.filter("known_street is not null").select("street_norm", "known_street"))
        open_ = state.filter((F.col("known_street").isNull()) & (F.col("most") > most)).select("street_norm", "most")
        if open_.isEmpty():
            break
        most *= 2
    out = found[0]
    for own in found[1:]:
        out = out.unionByName(own)
    return out
