"""The batch operators on a growing folder of messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from convq.functions import rules
from convq.functions import text as tx
from convq.functions.rules import OPTIMIZED, Profile
from convq.operators import filters as f
from convq.streaming.batches import BatchTable

COMPACT_EVERY = 50  # batches between two snapshots
DEALS = 2  # tasks per core that share the messages of a batch
DAILY_COUNTS = ["n_messages", *[f"n_{name}" for name in rules.FLAGS]]


def read_messages(spark: SparkSession, path: str, schema: StructType, **options) -> DataFrame:
    return spark.readStream.schema(schema).options(**options).parquet(path)


def _run(writer, path: str, checkpoint: str) -> StreamingQuery:
    return (
        writer.outputMode("append")
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_pull(messages: DataFrame, path: str, checkpoint: str, **date_range) -> StreamingQuery:
    """Append all new messages in range to a Parquet table.

    The checkpoint knows which files are done: a restart adds nothing twice.
    """
    return _run(f.date_range_filter(messages, **date_range).writeStream, path, checkpoint)


def stream_dedup(messages: DataFrame, watermark: str = "30 days") -> DataFrame:
    """The first message of each normalised text within the watermark.

    State is bounded by time, so a text may come back after the watermark has
    passed; ``stream_first_texts`` keeps none of those.
    """
    return (
        messages.withColumn("text_key", F.sha2(tx.normalise(F.coalesce("text", F.lit(""))), 256))
        .withWatermark("sent_at", watermark)
        .dropDuplicatesWithinWatermark(["text_key"])
        .drop("text_key")
    )


def daily_flag_counts(messages: DataFrame, profile: Profile = OPTIMIZED) -> DataFrame:
    """Messages and flags per day; the same expression serves batch and stream."""
    flags = rules.with_message_flags(messages, profile)
    return (
        flags.groupBy(F.window("sent_at", "1 day").alias("day"))
        .agg(
            F.count("*").alias("n_messages"),
            *[F.count_if(F.col(name)).alias(f"n_{name}") for name in rules.FLAGS],
        )
        .select(F.col("day.start").alias("day"), "n_messages", *[f"n_{n}" for n in rules.FLAGS])
    )


def _every(writer, checkpoint: str) -> StreamingQuery:
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_message_flags(
    messages: DataFrame, path: str, checkpoint: str, profile: Profile = OPTIMIZED, compact_every: int = COMPACT_EVERY
) -> StreamingQuery:
    """Write each batch's flag counts per day; ``read_daily_flag_counts`` sums them.

    No row is too late and no day has to be over: counts of batches add up however the files
    fall into them.  A batch that runs again writes its own folder anew.  Every ``compact_every``
    batches those before are merged to one row per day.

    A batch may be one file that one task must read; its messages are dealt over all cores before
    the flags are worked out, which takes far longer than reading them.
    """
    table = _daily_table(messages.sparkSession, path)

    def write(batch: DataFrame, number: int) -> None:
        if number % compact_every == 0:
            table.compact(number - 1, _add_days)  # they are finished, since this one has begun
        dealt = batch.select("sent_at", "text").repartition(DEALS * batch.sparkSession.sparkContext.defaultParallelism)
        table.write(daily_flag_counts(dealt, profile), number)

    return _every(messages.writeStream.foreachBatch(write), checkpoint)


def _daily_table(spark: SparkSession, path: str) -> BatchTable:
    schema = StructType().add("day", "timestamp")
    for name in DAILY_COUNTS:
        schema = schema.add(name, "long")
    return BatchTable(spark, path, schema)


def _add_days(rows: DataFrame) -> DataFrame:
    return rows.groupBy("day").agg(*[F.sum(name).alias(name) for name in DAILY_COUNTS]).coalesce(1)


def read_daily_flag_counts(spark: SparkSession, path: str) -> DataFrame:
    """Days and counts of all batches that ``stream_message_flags`` has written."""
    return _add_days(_daily_table(spark, path).read())


def stream_first_texts(
    messages: DataFrame, path: str, checkpoint: str, compact_every: int = COMPACT_EVERY
) -> StreamingQuery:
    """Append the first message of each normalised text, however long ago it was seen; see ``read_first_texts``.

    The seen-set is a table of text keys, one folder per batch, dealt over key prefixes and joined by key:
    it may grow beyond any memory.  Within a batch the earliest message by time and id is kept.  A batch that
    runs again looks at the keys of the batches before it only, and replaces its own rows.
    """
    spark = messages.sparkSession
    keys = BatchTable(spark, f"{path}/keys", StructType().add("prefix", "integer").add("text_key", "binary"))
    kept = BatchTable(spark, f"{path}/texts", messages.schema)

    def write(batch: DataFrame, number: int) -> None:
        if number % compact_every == 0:
            keys.compact(number - 1, lambda rows: rows.repartition("prefix").sortWithinPartitions("prefix", "text_key"))
        norm = tx.normalise(F.coalesce(F.col("text"), F.lit("")))
        rows = batch.withColumn("text_key", F.unhex(F.sha2(norm, 256))).withColumn("prefix", _prefix())
        # one row per key leaves each task, so a text that fills the batch meets nowhere
        place = F.struct("sent_at", "message_id")
        first = rows.groupBy("prefix", "text_key").agg(F.min_by(F.struct(*batch.columns), place).alias("first"))
        new = first.join(keys.read(before=number), ["prefix", "text_key"], "left_anti")
        kept.write(new.select("first.*"), number)
        own = spark.read.schema(messages.schema).parquet(f"{kept.path}/batches/batch={number}")
        found = F.unhex(F.sha2(norm, 256)).alias("text_key")
        keys.write(own.select(found).select(_prefix().alias("prefix"), "text_key"), number)

    return _every(messages.writeStream.foreachBatch(write), checkpoint)


def _prefix() -> Column:
    """The first byte of a key."""
    return F.conv(F.hex(F.substring("text_key", 1, 1)), 16, 10).cast("int")


def read_first_texts(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The messages that ``stream_first_texts`` has kept."""
    return BatchTable(spark, f"{path}/texts", schema).read()
