"""Writers for reports, ids, token tables and verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def write_json_report(report: DataFrame, path: str) -> None:
    """One JSON object per row; tasks write their own parts."""
    report.write.mode("overwrite").json(path)


def write_csv(rows: DataFrame, path: str, partition_by: str | None = None) -> None:
    writer = rows.write.mode("overwrite").option("header", True)
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.csv(path)


def append_verdicts(verdicts: DataFrame, path: str) -> None:
    """Add verdicts to a JSON-lines folder; earlier runs stay."""
    verdicts.write.mode("append").json(path)


def usable_ids_summary(usable: DataFrame) -> DataFrame:
    """Ids per exported folder; segments without ids have neither row nor folder."""
    folder = F.concat(
        F.lit("length_category="),
        F.col("length_category"),
        F.lit("/time_bucket="),
        F.col("time_bucket"),
    )
    return (
        usable.groupBy("length_category", "time_bucket")
        .agg(F.count("*").alias("usable_count"))
        .withColumn("folder", folder)
    )


def write_id_lists(usable: DataFrame, path: str, *by: str) -> None:
    """Text lists of ids below ``path``: one, or one folder per value of ``by``."""
    ids = usable.select(*by, F.col("conversation_id").cast("string"))
    writer = (ids.hint("rebalance", *by) if by else ids).write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).text(path)


def write_usable_ids(usable: DataFrame, path: str) -> None:
    """Lists of ids by segment, by time and all in one, and their summary as JSON."""
    write_id_lists(usable, f"{path}/ids", "length_category", "time_bucket")
    write_id_lists(usable, f"{path}/by_time", "time_bucket")
    write_id_lists(usable, f"{path}/all")
    write_json_report(usable_ids_summary(usable), f"{path}/summary")
