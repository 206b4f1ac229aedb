"""Frames between the rounds of an operator."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..sources.shared import new_path


def checkpointed(df: DataFrame) -> DataFrame:
    """The frame written to the shared checkpoint folder, its lineage cut."""
    path = new_path(df.sparkSession, "rounds")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
