"""Small helpers that the operators of this package share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from convq.sources.workspace import work_folder


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written below the shared folder and read back.

    A later stage, or a retry after a lost executor, starts from these files.
    """
    path = work_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_of(column: str) -> Column:
    """The text, an empty one for null."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def row_key(*columns: str) -> Column:
    """One number for a row's values; rows that are equal in them share it.

    Nulls count as a value: Spark's hash skips them, so a marker is added.
    """
    parts = [part for c in columns for part in (F.col(c), F.col(c).isNull())]
    return F.xxhash64(*parts)
