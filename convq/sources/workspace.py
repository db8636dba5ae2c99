"""Where jobs keep intermediate tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one that the session names in spark.checkpoint.dir."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None
    )
    if not shared:
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written below the shared folder and read back.

    What follows reads these rows as often as it likes, and starts from them after a failure.
    """
    path = work_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def name_folder(spark: SparkSession, path: str) -> None:
    """Name ``path`` as the shared folder of a local session that has none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not named and spark.sparkContext.master.startswith("local["):
        spark.conf.set("spark.checkpoint.dir", path)
