"""A table that a stream writes batch by batch, and that stays cheap to read.

Each batch has a folder of its own, which a batch that runs again writes anew.  From time to time all
finished batches are merged into a snapshot; it counts once its row is in ``snapshots``, which switches
readers over in one step.  They read the last snapshot and the batches after it, however many there were before.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType


class BatchTable:
    def __init__(self, spark: SparkSession, path: str, schema: StructType):
        self.spark = spark
        self.path = path.rstrip("/")
        self.schema = schema

    def write(self, rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/batches/batch={number}")

    def snapshot(self) -> int:
        """The last batch that the newest snapshot holds, -1 without one."""
        rows = self._found(f"{self.path}/snapshots", "upto bigint")
        return -1 if rows is None else rows.agg(F.max("upto")).first()[0]

    def _found(self, path: str, schema) -> DataFrame | None:
        try:
            return self.spark.read.schema(schema).parquet(path)
        except AnalysisException as problem:
            if problem.getCondition() == "PATH_NOT_FOUND":
                return None
            raise

    def read(self, before: int | None = None) -> DataFrame:
        """The rows of all batches, or of those before number ``before``."""
        upto = self.snapshot()
        rows = self.spark.createDataFrame([], self.schema)
        if upto >= 0:
            rows = self.spark.read.schema(self.schema).parquet(f"{self.path}/upto={upto}")
        batches = self._found(f"{self.path}/batches", StructType([*self.schema.fields]).add("batch", "long"))
        if batches is not None:
            late = batches.filter(F.col("batch") > upto)
            late = late if before is None else late.filter(F.col("batch") < before)
            rows = rows.unionByName(late.drop("batch"))
        return rows

    def compact(self, upto: int, merge: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> None:
        """Make a snapshot of the batches up to ``upto``, which must be finished; ``merge`` shortens their rows.

        The folders of merged batches are not read again and may be deleted by their owner.
        """
        if upto > self.snapshot():
            merge(self.read(upto + 1)).write.mode("overwrite").parquet(f"{self.path}/upto={upto}")
            marker = self.spark.range(1).select(F.lit(upto).cast("bigint").alias("upto"))
            marker.write.mode("append").parquet(f"{self.path}/snapshots")
