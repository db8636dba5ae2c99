"""Token rows, their statistics and the price of reading them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from convq.functions import tokens as tk
from convq.operators import filters as f
from convq.operators import rollup
from convq.operators.transcripts import PART_CHARS, transcript_plain

# ---- fixed values: price model in USD per million tokens ----
INPUT_PRICE = 0.55
OUTPUT_PRICE = 2.19
BUFFER = 1.20
INPUT_SHARE = 0.9
OUTPUT_SHARE = 0.1
# ---- end of fixed values ----


def token_rows(
    messages: DataFrame, tokenizer=None, all_messages: bool = False, part_chars: int = PART_CHARS
) -> DataFrame:
    """One row per short, medium or long two-sided conversation in range.

    The default estimate needs lengths only, so no transcript is built: the
    joined text has all characters plus one separator between messages.  A
    ``tokenizer`` (see ``tokens.tokenizer_counts``) gets the transcript itself, part by
    part; ``estimated_parts`` tells how many parts it failed on.
    ``all_messages`` counts messages outside the range as well.
    """
    sized = rollup.sized_conversations(messages).withColumn(
        "time_quarter", F.date_trunc("quarter", "first_sent_at")
    )
    if all_messages:
        sizes = messages.groupBy("conversation_id").agg(
            F.count("*").alias("message_count"),
            F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("total_chars"),
        )
        sized = sized.drop("message_count", "total_chars").join(sizes, "conversation_id")
    rows = sized.select(
        "conversation_id",
        "length_category",
        "time_quarter",
        "message_count",
        (F.col("total_chars") + F.col("message_count") - 1).alias("char_count"),
    )
    if tokenizer is None:
        return rows.withColumn("token_count", tk.estimate_tokens(F.col("char_count")))
    source = messages if all_messages else f.date_range_filter(messages)
    wanted = source.join(rows.select("conversation_id"), "conversation_id", "left_semi")
    counted = (
        transcript_plain(wanted, part_chars)
        .select("conversation_id", tokenizer(F.col("combined_text")).alias("counted"))
        .groupBy("conversation_id")
        .agg(
            F.sum("counted.n").alias("token_count"),
            F.count_if("counted.estimated").alias("estimated_parts"),
        )
    )
    return rows.join(counted, "conversation_id")


def _rounded(column: Column, name: str) -> Column:
    return F.bround(column, 2).alias(name)


def token_stats(rows: DataFrame) -> DataFrame:
    return rows.groupBy("length_category").agg(
        F.count("token_count").alias("token_count_count"),
        _rounded(F.avg("token_count"), "token_count_mean"),
        _rounded(F.stddev_samp("token_count"), "token_count_std"),
        F.min("token_count").alias("token_count_min"),
        F.max("token_count").alias("token_count_max"),
        F.sum("token_count").alias("token_count_sum"),
        _rounded(F.avg("char_count"), "char_count_mean"),
        _rounded(F.stddev_samp("char_count"), "char_count_std"),
        _rounded(F.avg("message_count"), "message_count_mean"),
        _rounded(F.stddev_samp("message_count"), "message_count_std"),
    )


def cost_breakdown(stats: DataFrame) -> DataFrame:
    tokens, millions = F.col("token_count_sum"), F.col("token_count_sum") / 1_000_000
    rate = INPUT_PRICE * BUFFER * INPUT_SHARE + OUTPUT_PRICE * BUFFER * OUTPUT_SHARE
    return stats.select(
        "length_category",
        tokens.alias("total_tokens"),
        F.col("token_count_count").alias("total_conversations"),
        millions.alias("tokens_millions"),
        (millions * rate).alias("estimated_cost_usd"),
        (tokens / F.col("token_count_count")).alias("avg_tokens_per_conversation"),
    )


def cost_summary(breakdown: DataFrame) -> DataFrame:
    totals = breakdown.agg(
        F.sum("total_conversations").alias("total_conversations"),
        F.sum("total_tokens").alias("total_tokens"),
    )
    millions = F.col("total_tokens") / 1_000_000
    priced = totals.select(
        "*",
        millions.alias("total_tokens_millions"),
        (millions * INPUT_SHARE).alias("input_tokens_millions"),
        (millions * OUTPUT_SHARE).alias("output_tokens_millions"),
        (millions * INPUT_SHARE * INPUT_PRICE * BUFFER).alias("input_cost_usd"),
        (millions * OUTPUT_SHARE * OUTPUT_PRICE * BUFFER).alias("output_cost_usd"),
    )
    total_cost = F.col("input_cost_usd") + F.col("output_cost_usd")
    return priced.select(
        "*",
        total_cost.alias("total_cost_usd"),
        (total_cost / F.col("total_conversations")).alias("avg_cost_per_conversation"),
        (F.col("total_tokens") / F.col("total_conversations")).alias("avg_tokens_per_conversation"),
    )

