"""Message tables derived from the given test tables (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

EPOCH = "2023-06-15 00:00:00"


def _sent_at(days: Column, hours: Column) -> Column:
    step = F.make_dt_interval(days.cast("int"), hours.cast("int"))
    return F.lit(EPOCH).cast("timestamp") + step


def _side(number: Column) -> Column:
    return F.when(number % 2 == 0, "HUMAN_TO_AI").otherwise("AI_TO_HUMAN")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def conv_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations table: two to eight turns each."""
    role = F.col("role")
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("conversation_id"),
        F.col("turn").alias("message_id"),
        "text",
        F.when(role == "user", "HUMAN_TO_AI")
        .when(role == "assistant", "AI_TO_HUMAN")
        .otherwise("SYSTEM")
        .alias("type"),
        _sent_at((F.col("conv_id") * 37) % 640, F.col("conv_id") % 24 + F.col("turn") * 5).alias("sent_at"),
    )


def doc_messages_from(documents: DataFrame) -> DataFrame:
    """Documents as messages of conversations of 1, 3, 5, ... messages."""
    doc = F.col("doc_id")
    c = F.floor(F.sqrt(doc.cast("double"))).cast("bigint")
    return documents.select(
        c.alias("conversation_id"),
        doc.alias("message_id"),
        "text",
        _side(doc).alias("type"),
        _sent_at((c * 37) % 640, doc - c * c).alias("sent_at"),
    )


def doc_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc_messages_from(table(spark, sf_dir, "documents"))


def doc_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a conversation of two messages: its two halves."""
    half = F.floor(F.length("text") / 2.0).cast("int")
    doc = F.col("doc_id")
    halves = F.array(
        F.struct(F.lit(0).cast("bigint").alias("turn"), F.substr("text", F.lit(1), half).alias("part")),
        F.struct(F.lit(1).cast("bigint").alias("turn"), F.substr("text", half + 1).alias("part")),
    )
    return (
        table(spark, sf_dir, "documents")
        .select("doc_id", F.inline(halves))
        .select(
            doc.alias("conversation_id"),
            F.col("turn").alias("message_id"),
            F.col("part").alias("text"),
            _side(F.col("turn")).alias("type"),
            _sent_at((doc * 37) % 640, doc % 24 + F.col("turn") * 5).alias("sent_at"),
        )
    )


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stands in for judge output: one verdict per labelled document."""
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    doc = F.col("doc_id")
    third = (doc % 3).cast("int")
    return d.join(lab, "doc_id").select(
        doc.alias("conversation_id"),
        (F.when(F.col("quality") == 1, 6).otherwise(1) + (doc % 5).cast("int")).alias("quality"),
        (F.col("toxic") == 0).alias("is_safe"),
        F.col("text").contains("@").alias("contains_pii"),
        (doc % 7 == 0).alias("contains_sensitive_content"),
        F.when(third == 0, "high").when(third == 1, "medium").otherwise("low").alias("response_accuracy"),
        F.col("lang").alias("language"),
    )
