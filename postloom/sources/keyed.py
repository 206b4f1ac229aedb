"""Tables dealt over folders by a hash of their key, so that a reader opens only the folders of its keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKET = "_bucket"


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def write_keyed(df: DataFrame, path: str, key: str, buckets: int) -> None:
    """``df`` under ``path``, rows of one key in one folder, sorted by it, so that files tell their key ranges."""
    own = df.withColumn(BUCKET, bucket_of(F.col(key), buckets))
    own.repartition(buckets, BUCKET).sortWithinPartitions(BUCKET, key).write.partitionBy(BUCKET).parquet(path)


def read_keyed(spark: SparkSession, path: str, schema: T.StructType, key: str, buckets: int, keys: DataFrame | None = None) -> DataFrame:
    """The table at ``path``; with ``keys`` (a column named as ``key``) only their rows, from their folders."""
    own = spark.read.schema(T.StructType([*schema.fields, T.StructField(BUCKET, T.IntegerType())])).parquet(path)
    if keys is None:
        return own.drop(BUCKET)
    keys = keys.select(key).filter(F.col(key).isNotNull()).distinct()
    mine = [r[0] for r in keys.select(bucket_of(F.col(key), buckets)).distinct().collect()]  # at most one for each folder
    return own.filter(F.col(BUCKET).isin(mine)).drop(BUCKET).join(keys.hint("merge"), key, "left_semi")
