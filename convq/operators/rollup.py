"""Per-conversation counts and the volume tables built on them.

The rollup reads the narrow columns only and pre-aggregates before its single
shuffle, so one conversation with very many messages costs no more than others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from convq import schema as s
from convq.operators import filters as f


RSD = 0.01  # relative standard deviation of the approximate count
LOG_K = 14  # of a day's sketch: 2**LOG_K registers


def sketch_error(log_k: int = LOG_K) -> float:
    """Relative standard deviation of counts from sketches that were merged."""
    return 1.04 / 2 ** (log_k / 2)


def conversation_rollup(messages: DataFrame, *keys: str) -> DataFrame:
    """Counts per conversation; messages without a conversation id are set aside, here as in
    flags, samples and transcripts (see ``unassigned_messages``)."""
    return messages.filter(F.col("conversation_id").isNotNull()).groupBy("conversation_id", *keys).agg(
        F.count("*").alias("message_count"),
        F.count_if(F.col("type") == s.HUMAN).alias("human_count"),
        F.count_if(F.col("type") == s.AI).alias("ai_count"),
        F.min("sent_at").alias("first_sent_at"),
        F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("total_chars"),
    )


def unassigned_messages(messages: DataFrame) -> DataFrame:
    """Messages in all, and those that belong to no conversation: one row."""
    return messages.agg(
        F.count("*").alias("n_messages"), F.count_if(F.col("conversation_id").isNull()).alias("n_unassigned")
    )


def two_sided_conversations(messages: DataFrame, **date_range) -> DataFrame:
    """Rollup of the conversations with a human and an AI side inside the range."""
    return f.two_sided(conversation_rollup(f.date_range_filter(messages, **date_range)))


def conversation_metadata(messages: DataFrame, **date_range) -> DataFrame:
    return two_sided_conversations(messages, **date_range).select(
        "conversation_id", "message_count", F.col("first_sent_at").alias("first_message_date")
    )


def distinct_conversations(messages: DataFrame, approximate: bool = False, rsd: float = RSD) -> DataFrame:
    """Number of conversations in range.

    The exact count groups by id first: no task ever holds the whole set of ids.  The approximate one
    has a relative error of ``rsd`` as one standard deviation.
    """
    in_range = f.date_range_filter(messages)
    if approximate:
        return in_range.agg(F.approx_count_distinct("conversation_id", rsd).alias("n_conversations"))
    ids = in_range.select("conversation_id").distinct()
    return ids.agg(F.count("*").alias("n_conversations"))


def daily_sketches(messages: DataFrame, log_k: int = LOG_K) -> DataFrame:
    """``day, sketch``: a mergeable sketch of the conversations of each day, a few kilobytes at most.

    Write them once: the conversations of any range of days follow without reading a message again,
    and a new day, or more messages of an old one, only add rows.  Messages without a time are left out.
    """
    known = messages.filter("sent_at is not null and conversation_id is not null")
    return known.groupBy(F.to_date("sent_at").alias("day")).agg(
        F.hll_sketch_agg(F.col("conversation_id"), F.lit(log_k)).alias("sketch")
    )


def sketched_conversations(sketches: DataFrame, ranges: DataFrame) -> DataFrame:
    """``ranges`` (``first_day, last_day``, both included) with ``n_conversations``, an estimate.

    One standard deviation is ``1.04 / sqrt(2**log_k)`` of the count, 0.8 % for the default, whatever the
    range.  The sketches are read once for all ranges; one without a day in it has 0.
    """
    # a range becomes its days, so that the join has a key
    days = ranges.withColumn("day", F.explode(F.sequence("first_day", "last_day")))
    merged = days.join(sketches, "day").groupBy("first_day", "last_day").agg(F.hll_union_agg("sketch").alias("sketch"))
    found = ranges.join(merged, ["first_day", "last_day"], "left")
    estimate = F.coalesce(F.hll_sketch_estimate("sketch"), F.lit(0))
    return found.select("first_day", "last_day", estimate.alias("n_conversations"))


def _two_sided_lengths(messages: DataFrame) -> DataFrame:
    """One row per distinct message count: at most sqrt(2 x messages) rows."""
    return two_sided_conversations(messages).groupBy("message_count").agg(F.count("*").alias("n"))


def length_stats(messages: DataFrame) -> DataFrame:
    count = F.col("message_count")
    return two_sided_conversations(messages).agg(
        F.count("*").alias("n_conversations"),
        F.min(count).alias("min_messages"),
        F.max(count).alias("max_messages"),
        F.avg(count).alias("mean_messages"),
        F.median(count).alias("median_messages"),
    )


def length_histogram(messages: DataFrame, bins: int = 50) -> DataFrame:
    """Equal-width bins over [min, max], the last one closed; empty bins included."""
    low, high = F.col("low"), F.col("high")
    # one row per distinct length, so a single partition holds them all easily
    every = W.partitionBy(F.lit(0))
    lengths = (
        _two_sided_lengths(messages)
        .withColumn("low", F.min("message_count").over(every).cast("double"))
        .withColumn("high", F.max("message_count").over(every).cast("double"))
        # all lengths equal: widen the range by half a message on both sides
        .withColumn("pad", F.when(low == high, 0.5).otherwise(0.0))
        .select("message_count", "n", (low - F.col("pad")).alias("low"), (high + F.col("pad")).alias("high"))
    )
    place = F.floor((F.col("message_count") - low) * bins / (high - low))
    placed = lengths.select(F.least(place, F.lit(bins - 1)).cast("int").alias("bin"), "n")
    all_bins = (
        lengths.agg(F.min("low").alias("low"), F.max("high").alias("high"))
        .filter(low.isNotNull())
        .select(F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), "low", "high")
        .withColumn("bin_start", low + F.col("bin") * (high - low) / bins)
        .withColumn("bin_end", low + (F.col("bin") + 1) * (high - low) / bins)
    )
    filled = placed.groupBy("bin").agg(F.sum("n").alias("n_conversations"))
    return (
        all_bins.join(filled, "bin", "left")
        .select("bin", "bin_start", "bin_end", F.coalesce("n_conversations", F.lit(0)).alias("n_conversations"))
        .orderBy("bin")
    )


def length_distribution(messages: DataFrame) -> DataFrame:
    """Exactly 2, 3-5, 6-20 and 21 or more messages: count and share of all."""
    lengths = _two_sided_lengths(messages)
    count, n = F.col("message_count"), F.col("n")
    classes = [
        ("one_off", count == 2),
        ("short", count.between(3, 5)),
        ("medium", count.between(6, 20)),
        ("long", count >= 21),
    ]
    totals = lengths.agg(
        F.sum("n").alias("total"),
        *[F.coalesce(F.sum(F.when(test, n)), F.lit(0)).alias(label) for label, test in classes],
    )
    return totals.filter(F.col("total") > 0).select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(label).alias("length_category"),
                        F.col(label).alias("n_conversations"),
                        (F.col(label) * 100.0 / F.col("total")).alias("percentage"),
                    )
                    for label, _ in classes
                ]
            )
        )
    )


def sized_conversations(messages: DataFrame) -> DataFrame:
    """Two-sided conversations of class short, medium or long."""
    return (
        two_sided_conversations(messages)
        .withColumn("length_category", f.length_category(F.col("message_count")))
        .filter(F.col("length_category").isin("short", "medium", "long"))
    )


def totals_by_category(messages: DataFrame) -> DataFrame:
    return (
        sized_conversations(messages)
        .groupBy("length_category")
        .agg(F.count("*").alias("total_conversations"))
        .orderBy(f.length_rank(F.col("length_category")))
    )


def quarterly_volume(messages: DataFrame) -> DataFrame:
    return (
        sized_conversations(messages)
        .groupBy(F.date_trunc("quarter", "first_sent_at").alias("time_quarter"), "length_category")
        .agg(
            F.count("*").alias("total_conversations"),
            F.avg("total_chars").alias("avg_chars_per_convo"),
            F.sum("total_chars").alias("total_chars_in_bucket"),
        )
        .orderBy("time_quarter", f.length_rank(F.col("length_category")))
    )


def totals_by_class_and_quarter(messages: DataFrame) -> DataFrame:
    """Two-sided conversations per length class and quarter of the first message."""
    return (
        two_sided_conversations(messages)
        .groupBy(
            f.length_category(F.col("message_count")).alias("length_category"),
            f.time_bucket(F.col("first_sent_at")).alias("time_bucket"),
        )
        .agg(
            F.count("*").alias("n_conversations"),
            F.sum("message_count").alias("n_messages"),
            F.sum("total_chars").alias("n_chars"),
        )
    )
