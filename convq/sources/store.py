"""A stored copy of the messages: metadata, pulled messages, status.

Two Parquet folders below ``root``.  ``messages`` is partitioned by the quarter of
the message, so later reads skip quarters.  Every pull appends one batch: it marks
all rows with its own ``pull`` id and counts only once it has written its row to
``pulls``.  A pull that dies half way leaves files no reader looks at, and the
next pull fetches the same conversations again.

``compact`` makes a second copy for reading by id: messages and metadata of all finished pulls in
buckets of conversation ids, in few files however many pulls there were.  Joins by id between them
need no shuffle.  It counts, too, once its row is written.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from convq.operators import filters as f
from convq.operators.joins import fetch_by_ids, pending
from convq.operators.rollup import conversation_metadata


BUCKETS = 256
FILES = 4  # per bucket, so that a large conversation is not written by one task


class MessageStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def _path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def _read(self, table: str) -> DataFrame | None:
        try:
            return self.spark.read.parquet(self._path(table))
        except AnalysisException as problem:
            if problem.getCondition() == "PATH_NOT_FOUND":
                return None
            raise

    def save_metadata(self, metadata: DataFrame) -> None:
        metadata.write.mode("overwrite").parquet(self._path("conversations"))

    def metadata(self) -> DataFrame:
        return self.spark.read.parquet(self._path("conversations"))

    def _committed(self, table: str) -> DataFrame | None:
        pulls = self._read("pulls")
        if pulls is None:
            return None
        return self.spark.read.parquet(self._path(table)).join(pulls.distinct(), "pull", "left_semi")

    def _owners(self) -> DataFrame | None:
        """Each stored id with the pull it belongs to.

        Two pulls at the same time may both fetch an id; the smaller pull counts.
        """
        rows = self._committed("stored_ids")
        return rows and rows.groupBy("conversation_id").agg(F.min("pull").alias("pull"))

    def stored_ids(self) -> DataFrame:
        """Ids of the conversations that finished pulls have stored."""
        owners = self._owners()
        if owners is None:
            return self.metadata().select("conversation_id").limit(0)
        return owners.select("conversation_id")

    def _owned_messages(self) -> DataFrame | None:
        rows = self._committed("messages")
        return rows and rows.join(self._owners(), ["conversation_id", "pull"], "left_semi")

    def messages(self, start: str | None = None, end: str | None = None) -> DataFrame:
        """Messages of fully stored conversations; a date range reads its quarters only."""
        rows = self._owned_messages()
        if rows is None:
            raise ValueError("nothing stored yet: pull messages first")
        if start:
            first = F.trunc(F.lit(start).cast("date"), "quarter")
            rows = rows.filter((F.col("quarter") >= first) & (F.col("sent_at") >= f.timestamp(start)))
        if end:
            last = F.lit(end).cast("date")
            rows = rows.filter((F.col("quarter") <= last) & (F.col("sent_at") <= f.timestamp(end)))
        return rows.drop("pull", "quarter")

    def pull(self, source: DataFrame, **date_range) -> None:
        """Fetch the conversations of the metadata that are not stored yet."""
        wanted = pending(self.metadata(), self.stored_ids()).select("conversation_id")
        if wanted.isEmpty():
            return
        pull_id = uuid.uuid4().hex
        rows = fetch_by_ids(f.date_range_filter(source, **date_range), wanted)
        (
            rows.withColumn("pull", F.lit(pull_id))
            .withColumn("quarter", F.date_trunc("quarter", "sent_at").cast("date"))
            .hint("rebalance", "quarter")  # evenly sized files, not one per task and quarter
            .write.mode("append")
            .partitionBy("quarter")
            .parquet(self._path("messages"))
        )
        stored = wanted.withColumn("pull", F.lit(pull_id))
        stored.write.mode("append").parquet(self._path("stored_ids"))
        done = self.spark.range(1).select(F.lit(pull_id).alias("pull"))
        done.write.mode("append").parquet(self._path("pulls"))

    def compact(self, buckets: int = BUCKETS) -> None:
        """Write the finished pulls anew, dealt over buckets by conversation id; see ``by_id``.

        Rows that two pulls fetched are kept once, of the pull that owns them.
        """
        rows = self._owned_messages()
        if rows is None:
            raise ValueError("nothing stored yet: pull messages first")
        copy = uuid.uuid4().hex
        pulls = [r["pull"] for r in self._committed_pulls().collect()]  # one short name per pull
        rows = rows.filter(F.col("pull").isin(pulls)).drop("pull", "quarter")
        bucket = F.pmod(F.hash("conversation_id"), F.lit(buckets))  # as Spark deals buckets
        file = F.pmod(F.xxhash64("sent_at", "message_id"), F.lit(FILES))
        dealt = rows.repartition(buckets * FILES, bucket, file)
        self._write_buckets(dealt, "messages", copy, buckets)
        known = self.metadata().join(self.stored_ids(), "conversation_id", "left_semi")
        self._write_buckets(known.repartition(buckets, bucket), "conversations", copy, buckets)
        names = self.spark.createDataFrame([(pull, copy) for pull in pulls], "pull string, copy string")
        names.write.mode("append").parquet(self._path("copied_pulls"))
        number = self._copies().count()
        done = self.spark.range(1).select(F.lit(copy).alias("copy"), F.lit(buckets).alias("buckets"), F.lit(number).alias("number"))
        done.write.mode("append").parquet(self._path("copies"))

    def _write_buckets(self, rows: DataFrame, table: str, copy: str, buckets: int) -> None:
        writer = rows.write.format("parquet").bucketBy(buckets, "conversation_id").sortBy("conversation_id")
        writer.option("path", self._path(f"by_id/{copy}/{table}")).saveAsTable(f"{table}_{copy}")

    def _committed_pulls(self) -> DataFrame:
        return self._read("pulls").select("pull").distinct()

    def _copies(self) -> DataFrame:
        return self._found("copies", "copy string, buckets int, number int")

    def _found(self, table: str, schema: str) -> DataFrame:
        """A small table of the store, empty if it is not there."""
        try:
            return self.spark.read.schema(schema).parquet(self._path(table))
        except AnalysisException as problem:
            if problem.getCondition() == "PATH_NOT_FOUND":
                return self.spark.createDataFrame([], schema)
            raise

    def by_id(self) -> tuple[DataFrame, DataFrame]:
        """(metadata, messages) of the newest copy in buckets; later pulls are not in it before the next one.

        A session that did not write the copy is told of its tables first.
        """
        newest = self._copies().orderBy(F.desc("number")).first()
        if newest is None:
            raise ValueError("no copy by id yet: compact the store first")
        return tuple(self._bucketed(table, newest["copy"], newest["buckets"]) for table in ("conversations", "messages"))

    def _bucketed(self, table: str, copy: str, buckets: int) -> DataFrame:
        name, path = f"{table}_{copy}", self._path(f"by_id/{copy}/{table}")
        if not self.spark.catalog.tableExists(name):
            columns = ", ".join(f"`{c}` {kind}" for c, kind in self.spark.read.parquet(path).dtypes)
            self.spark.sql(
                f"create table {name} ({columns}) using parquet clustered by (conversation_id) "
                f"sorted by (conversation_id) into {buckets} buckets location '{path}'"
            )
        return self.spark.table(name)

    def not_copied(self) -> DataFrame:
        """Finished pulls that no copy holds yet."""
        copied = self._found("copied_pulls", "pull string, copy string").join(self._copies(), "copy", "left_semi")
        return self._committed_pulls().join(copied, "pull", "left_anti")

    def refresh(self, source: DataFrame, **date_range) -> None:
        """Metadata of everything in range, then the messages still missing."""
        self.save_metadata(conversation_metadata(source, **date_range))
        self.pull(source, **date_range)

    def status(self) -> DataFrame:
        """Total, stored, remaining, messages, progress in percent: one row."""
        marked = self.metadata().join(
            self.stored_ids().withColumn("stored", F.lit(True)), "conversation_id", "left"
        )
        messages = self._owned_messages()
        return store_status(marked, messages)


def store_status(marked: DataFrame, messages: DataFrame | None) -> DataFrame:
    """Status of metadata with a ``stored`` mark, and of the stored messages."""
    counts = marked.agg(
        F.count("*").alias("total_conversations"),
        F.count_if(F.coalesce(F.col("stored"), F.lit(False))).alias("stored"),
    ).withColumn("total_messages", F.lit(0).cast("bigint"))
    parts = counts
    if messages is not None:
        zero = F.lit(0).cast("bigint")
        n = messages.agg(F.count("*").alias("total_messages"))
        parts = counts.unionByName(
            n.select(zero.alias("total_conversations"), zero.alias("stored"), "total_messages")
        )
    total, stored = F.col("total_conversations"), F.col("stored")
    return parts.agg(
        F.sum(total).alias("total_conversations"),
        F.sum(stored).alias("stored"),
        F.sum("total_messages").alias("total_messages"),
    ).select(
        "total_conversations",
        "stored",
        (total - stored).alias("remaining"),
        "total_messages",
        F.coalesce(stored * 100.0 / F.nullif(total, F.lit(0)), F.lit(0.0)).alias("progress_pct"),
    )
