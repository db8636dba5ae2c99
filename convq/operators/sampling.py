"""Seeded samples.  The order is md5 of id and seed: the same on every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from convq.operators import filters as f
from convq.operators.rollup import conversation_rollup

SEED = 42
PREFIX_DIGITS = 4
SEGMENTS = 28  # seven buckets times four length classes


def sample_order(*ids: Column, seed: int = SEED) -> Column:
    return F.md5(F.concat_ws(":", *[i.cast("string") for i in ids], F.lit(str(seed))))


def _below_rate(order: Column, rate: float) -> Column:
    return F.conv(F.substring(order, 1, 8), 16, 10).cast("double") / 4294967296.0 < rate


def random_conversations(messages: DataFrame, n: int, seed: int = SEED) -> DataFrame:
    """Ids of ``n`` conversations, those of the lowest order.

    One group of ``lowest_per_group``: no task gets more than ``n`` rows and one prefix.
    """
    ids = messages.select("conversation_id").filter("conversation_id is not null").distinct()
    ordered = ids.select("*", sample_order(F.col("conversation_id"), seed=seed).alias("order"))
    return lowest_per_group(ordered, [], "order", n).select("conversation_id")


def percent_sample(
    messages: DataFrame, rate: float, by: str = "conversation", seed: int = SEED
) -> DataFrame:
    """Ids of about ``rate`` of all conversations.

    ``by="message"`` draws messages and takes their conversations, which favours
    long conversations.
    """
    messages = messages.filter(F.col("conversation_id").isNotNull())
    ids = [F.col("conversation_id")]
    if by == "message":
        ids.append(F.col("message_id"))
        return messages.filter(_below_rate(sample_order(*ids, seed=seed), rate)).select(
            "conversation_id"
        ).distinct()
    conversations = messages.select("conversation_id").distinct()
    return conversations.filter(_below_rate(sample_order(*ids, seed=seed), rate))


def lowest_per_group(df: DataFrame, by: list[str], order: str, n: int) -> DataFrame:
    """The ``n`` rows of each group with the lowest hex ``order``, exactly.

    Counts per prefix of ``PREFIX_DIGITS`` digits give the prefixes that can hold a
    wanted row; all other rows drop out before the shuffle.  So a group that holds
    most of the table brings ``n`` rows and one prefix, a 65,536th of the group, to
    its task.  The prefix table has at most 65,536 rows per group.
    """
    prefix = F.substring(order, 1, PREFIX_DIGITS)
    counts = df.groupBy(*by, prefix.alias("prefix")).agg(F.count("*").alias("n_prefix"))
    running = F.sum("n_prefix").over(W.partitionBy(*by).orderBy("prefix"))
    wanted = (
        counts.withColumn("n_before", running - F.col("n_prefix"))
        .filter(F.col("n_before") < n)
        .select(*by, "prefix")
    )
    rank = F.row_number().over(W.partitionBy(*by).orderBy(order, "conversation_id"))
    return (
        df.withColumn("prefix", prefix)
        .join(wanted, [*by, "prefix"], "left_semi")
        .withColumn("rank", rank)
        .filter(F.col("rank") <= n)
        .select(*df.columns)
    )


def segment_candidates(messages: DataFrame) -> DataFrame:
    """Two-sided conversations per bucket; counts are taken inside the bucket."""
    bucketed = messages.withColumn("time_bucket", f.sampling_bucket(F.col("sent_at"))).filter(
        F.col("time_bucket").isNotNull()
    )
    return f.two_sided(conversation_rollup(bucketed, "time_bucket")).select(
        "conversation_id",
        "time_bucket",
        f.length_category(F.col("message_count")).alias("length_category"),
    )


def stratified_sample(messages: DataFrame, target: int = 1_000_000, seed: int = SEED) -> DataFrame:
    """``target // 28`` conversations of each bucket and length class.

    A conversation that spans two quarters can be drawn in both; take distinct
    ids before fetching its messages.
    """
    candidates = segment_candidates(messages).withColumn(
        "order", sample_order(F.col("conversation_id"), seed=seed)
    )
    by = ["time_bucket", "length_category"]
    return lowest_per_group(candidates, by, "order", target // SEGMENTS).drop("order")
