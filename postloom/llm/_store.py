"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import new_path

BROADCAST_BYTES = 64_000_000


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: its lineage ends there."""
    return _written(df, new_path(df.sparkSession, name))


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Intermediate tables of one operator; ``close`` removes them once its result is stored.

    Tables of buckets need names in the catalog: they stand in a database of their own, which goes too.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.path, self.database = spark, new_path(spark, name), ""

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        return _written(df, f"{self.path}/{name}-{uuid.uuid4().hex[:8]}")

    def bucketed(self, df: DataFrame, by: str, buckets: int, name: str) -> DataFrame:
        """``df`` as a table of buckets: groups and joins by ``by`` read it without a shuffle."""
        if not self.database:
            self.database = f"scratch_{uuid.uuid4().hex}"
            self.spark.sql(f"CREATE DATABASE {self.database} LOCATION '{self.path}/{self.database}'")
        table = f"{self.database}.{name}"
        df.write.format("parquet").bucketBy(buckets, by).option("compression", "zstd").saveAsTable(table)
        return self.spark.table(table)

    def remove(self) -> None:
        if self.database:
            self.spark.sql(f"DROP DATABASE IF EXISTS {self.database} CASCADE")
            self.database = ""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def close(self, result: DataFrame, name: str) -> DataFrame:
        """``result`` stored by itself; all else goes."""
        out = stored(result, name)
        self.remove()
        return out


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def small_enough(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its counted rows, of ``row_bytes`` at most, fit the limit, else as it is."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def bytes_of(df: DataFrame) -> int:
    """Size of the rows as text, the longest values included, plus eight bytes a column."""
    own = F.octet_length(F.to_json(F.struct("*"))) + 8 * len(df.columns)
    return df.agg(F.coalesce(F.sum(own), F.lit(0))).first()[0]


def fits(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether the rows of a stored table, as measured, may be broadcast."""
    return bytes_of(df) <= limit


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z, all else as it is."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, upper, lower))
