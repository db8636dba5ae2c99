"""Reading the message table from any Spark source and naming its columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from convq.schema import MESSAGE_SCHEMA


PARTITIONED_READ = ("partitionColumn", "lowerBound", "upperBound", "numPartitions")


def scan(spark: SparkSession, path: str | None = None, format: str = "parquet", **options) -> DataFrame:
    """A table by path, or any source by options, such as JDBC.

    A JDBC source is one task unless its reading is split, so the four options that split it
    must be given.
    """
    if format == "jdbc":
        missing = [name for name in PARTITIONED_READ if name not in options]
        if missing:
            raise ValueError(f"a JDBC source needs {', '.join(missing)}, or one task reads all of it")
    reader = spark.read.format(format).options(**options)
    return reader.load(path) if path else reader.load()


def message_view(source: DataFrame, columns: dict[str, str] | None = None) -> DataFrame:
    """The columns of the model out of ``source``; a null text becomes empty.

    ``columns`` maps our names to the source's.  Names compare without case, and
    columns the source does not have are left out.
    """
    mapping = columns or {}
    present = {name.lower(): name for name in source.columns}
    selected = []
    for field in MESSAGE_SCHEMA.fieldNames():
        origin = present.get(mapping.get(field, field).lower())
        if origin is None:
            continue
        column = F.col(f"`{origin}`")
        if field == "text":
            column = F.coalesce(column, F.lit(""))
        selected.append(column.alias(field))
    return source.select(*selected)

