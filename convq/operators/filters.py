"""Date range, two-sided, length and time-bucket operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from convq import schema as s
from convq.functions import text as tx


def timestamp(day: str) -> Column:
    return F.lit(day).cast("timestamp")


def in_date_range(
    sent_at: Column,
    start: str = s.START_DATE,
    end: str = s.END_DATE,
    end_inclusive_day: bool = False,
) -> Column:
    """``start <= sent_at <= end``, where ``end`` is the midnight that begins that day.

    ``end_inclusive_day=True`` takes in the whole last day instead.
    """
    if end_inclusive_day:
        return (sent_at >= timestamp(start)) & (sent_at < timestamp(end) + F.expr("interval 1 day"))
    return sent_at.between(timestamp(start), timestamp(end))


def date_range_filter(messages: DataFrame, start=s.START_DATE, end=s.END_DATE, **kw) -> DataFrame:
    return messages.filter(in_date_range(F.col("sent_at"), start, end, **kw))


def length_category(message_count: Column) -> Column:
    cases = F.lit("unknown")
    for label, low, high in reversed(s.LENGTH_CLASSES):
        inside = message_count >= low if high is None else message_count.between(low, high)
        cases = F.when(inside, label).otherwise(cases)
    return cases


def length_rank(category: Column) -> Column:
    """Sort key: one_off < short < medium < long."""
    return F.array_position(F.array(*[F.lit(x) for x in s.LENGTH_LABELS]), category)


def time_bucket(sent_at: Column) -> Column:
    """Quarter label of the day, ``unknown`` outside the seven buckets."""
    day = sent_at.cast("date")
    inside = day.between(
        F.lit(s.TIME_BUCKETS[0][1]).cast("date"), F.lit(s.TIME_BUCKETS[-1][2]).cast("date")
    )
    label = F.concat(F.year(day).cast("string"), F.lit("-Q"), F.quarter(day).cast("string"))
    return F.when(inside, label).otherwise("unknown")


def bucket_bounds(messages: DataFrame) -> DataFrame:
    """First and last day of each bucket that occurs in the data."""
    label = time_bucket(F.col("sent_at"))
    first = F.trunc(F.col("sent_at"), "quarter")
    last = F.least(F.last_day(F.add_months(first, 2)), F.lit(s.TIME_BUCKETS[-1][2]).cast("date"))
    return (
        messages.select(
            label.alias("time_bucket"),
            first.cast("date").alias("start_date"),
            last.alias("end_date"),
        )
        .filter(F.col("time_bucket") != "unknown")
        .distinct()
    )


def sampling_bucket(sent_at: Column) -> Column:
    """Bucket by its date bounds as instants: after midnight of the last day is outside."""
    return F.coalesce(
        *[
            F.when(sent_at.between(timestamp(start), timestamp(end)), label)
            for label, start, end in s.TIME_BUCKETS
        ]
    )


def two_sided(rollup: DataFrame) -> DataFrame:
    return rollup.filter((F.col("human_count") >= 1) & (F.col("ai_count") >= 1))


def length_range_filter(rollup: DataFrame, category: str, max_long: int | None = None) -> DataFrame:
    low, high = {label: (lo, hi) for label, lo, hi in s.LENGTH_CLASSES}[category]
    high = max_long if category == "long" else high
    count = F.col("message_count")
    return rollup.filter(count >= low if high is None else count.between(low, high))


def _counts(transcripts: DataFrame, text: str) -> tuple[Column, Column]:
    """Characters and letters: as counted before (``transcripts.authored_counts``), or of the column ``text``."""
    if text in transcripts.columns:
        return F.length(text), tx.letters(F.col(text))
    return F.col("n_chars"), F.col("n_letters")


def _enough_letters(n_chars: Column, n_letters: Column, min_ratio: float) -> Column:
    return (n_chars > 0) & (tx.ratio(n_letters, n_chars) >= min_ratio)


def min_chars_filter(transcripts: DataFrame, text: str = "full_conversation", min_chars: int = 50) -> DataFrame:
    """Transcripts of at least ``min_chars`` characters; like all filters here it takes texts or their counts."""
    return transcripts.filter(_counts(transcripts, text)[0] >= min_chars)


def has_enough_letters(text: Column, min_ratio: float = 0.7) -> Column:
    return _enough_letters(F.length(text), tx.letters(text), min_ratio)


def alpha_ratio_filter(transcripts: DataFrame, text: str = "full_conversation", min_ratio: float = 0.7) -> DataFrame:
    return transcripts.filter(_enough_letters(*_counts(transcripts, text), min_ratio))


def prefilter(transcripts: DataFrame, text: str = "full_conversation") -> DataFrame:
    """Transcripts long enough and made of letters enough to be judged."""
    return alpha_ratio_filter(min_chars_filter(transcripts, text), text)


def prefilter_funnel(transcripts: DataFrame, text: str = "full_conversation") -> DataFrame:
    """How many transcripts each of the two filters takes away, in one pass."""
    n_chars, n_letters = _counts(transcripts, text)
    long_enough = n_chars >= 50
    readable = _enough_letters(n_chars, n_letters, 0.7)
    return transcripts.agg(
        F.count("*").alias("initial"),
        F.count_if(~long_enough).alias("removed_short"),
        F.count_if(long_enough & ~readable).alias("removed_gibberish"),
        F.count_if(long_enough & readable).alias("final"),
    )
