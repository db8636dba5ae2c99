"""Report tables over the conversation flags.

``quality_metrics`` is one row and ``stratified_metrics`` at most 40 rows; the
other reports are arithmetic on one of the two.  Pass a written or cached metrics
table to several reports and the corpus is read once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from convq import schema as s
from convq.operators import filters as f
from convq.operators import quality as q

BUCKETS = [*s.BUCKET_LABELS, "unknown"]


def _percent(part: Column, whole: Column, digits: int) -> Column:
    """Share of the whole, half-even as Python rounds; 0 when there is nothing."""
    share = part * 100.0 / F.nullif(whole, F.lit(0))
    return F.coalesce(F.bround(share, digits), F.lit(0.0))


def _issue_counts() -> list[Column]:
    return [F.count_if(F.col(name)).alias(name) for name in s.ISSUES]


def quality_metrics(flags: DataFrame) -> DataFrame:
    """Conversations, messages, the fourteen issue counts and the usable ids."""
    return flags.agg(
        F.count("*").alias("total_conversations"),
        F.coalesce(F.sum("message_count"), F.lit(0)).alias("total_messages"),
        *_issue_counts(),
        F.count_if(q.is_usable()).alias("usable"),
    )


def issue_flag_counts(flags: DataFrame) -> DataFrame:
    """How often each flag is true and false; values that never occur have no row."""
    counts = quality_metrics(flags)
    sides = []
    for name in s.ISSUES:
        sides.append(F.struct(F.lit(name).alias("issue"), F.lit(True).alias("flag"), F.col(name).alias("n")))
        n_false = (F.col("total_conversations") - F.col(name)).alias("n")
        sides.append(F.struct(F.lit(name).alias("issue"), F.lit(False).alias("flag"), n_false))
    return counts.select(F.inline(F.array(*sides))).filter(F.col("n") > 0)


def issue_report(metrics: DataFrame, digits: int = 2) -> DataFrame:
    total = F.col("total_conversations")
    rows = [
        F.struct(
            F.lit(name).alias("issue"),
            F.col(name).alias("count"),
            _percent(F.col(name), total, digits).alias("percentage"),
        )
        for name in s.ISSUES
    ]
    return metrics.select(F.inline(F.array(*rows)))


def top_issues(metrics: DataFrame, n: int = 5) -> DataFrame:
    return issue_report(metrics).orderBy(F.desc("percentage"), "issue").limit(n)


def _usable_reported() -> Column:
    """All but ``too_long`` subtracted from the total; issues overlap, so it can go below 0."""
    unusable = sum((F.col(name) for name in s.ISSUES if name != "too_long"), F.lit(0))
    total = F.col("total_conversations")
    share = (total - unusable) / F.nullif(total, F.lit(0)) * 100
    return F.coalesce(share, F.lit(0.0))


def usable_percentage(metrics: DataFrame) -> DataFrame:
    """As reported (from overlapping counts) and from the ids that are really usable."""
    total = F.col("total_conversations")
    return metrics.select(
        "total_conversations",
        "usable",
        _usable_reported().alias("usable_pct_reported"),
        F.coalesce(F.col("usable") * 100.0 / F.nullif(total, F.lit(0)), F.lit(0.0)).alias(
            "usable_pct_ids"
        ),
    )


def usable_by_time(flags: DataFrame) -> DataFrame:
    return (
        q.usable_conversations(flags)
        .groupBy("time_bucket")
        .agg(F.count("*").alias("usable_count"))
    )


def projection(metrics: DataFrame, sample_rate: float) -> DataFrame:
    """Scale the counts of a sample up to the full table, cut to whole numbers."""
    scale = F.lit(1 / sample_rate)
    total = F.col("total_conversations")
    per_conversation = F.coalesce(F.col("total_messages") / F.nullif(total, F.lit(0)), F.lit(0.0))
    scaled = metrics.withColumn("n", (total * scale).cast("bigint"))
    return scaled.select(
        F.col("n").alias("estimated_total_conversations"),
        (F.col("n") * per_conversation).cast("bigint").alias("estimated_total_messages"),
        F.bround(per_conversation, 2).alias("average_messages_per_conversation"),
        (F.col("n") * (_usable_reported() / 100)).cast("bigint").alias("estimated_usable_conversations"),
        (F.col("n") - (F.col("n") * (_usable_reported() / 100)).cast("bigint")).alias(
            "estimated_unusable_conversations"
        ),
        *[(F.col(name) * scale).cast("bigint").alias(f"projected_{name}") for name in s.ISSUES],
    )


def run_summary(
    metrics: DataFrame,
    start: str = s.START_DATE,
    end: str = s.END_DATE,
    method: str = "full",
    sample_rate: float = 1.0,
) -> DataFrame:
    return metrics.select(
        "total_conversations",
        "total_messages",
        F.col("usable").alias("total_usable_conversations"),
        F.bround(_usable_reported(), 2).alias("usable_conversation_percentage"),
        F.lit(f"{start} to {end}").alias("date_range"),
        F.lit(method).alias("sampling_method"),
        F.lit(float(sample_rate)).alias("sample_rate"),
    )


def stratified_metrics(flags: DataFrame) -> DataFrame:
    """Per length class and bucket: size, issue counts and shares, usable share."""
    return with_shares(
        q.with_segment(flags)
        .groupBy("length_category", "time_bucket")
        .agg(
            F.count("*").alias("total_conversations"),
            F.count_if(q.is_usable()).alias("usable"),
            *_issue_counts(),
        )
    )


def with_shares(counts: DataFrame) -> DataFrame:
    """Counts per segment with their shares in percent."""
    total = F.col("total_conversations")
    return counts.select(
        "*",
        _percent(F.col("usable"), total, 1).alias("usable_percentage"),
        *[_percent(F.col(name), total, 1).alias(f"{name}_pct") for name in s.ISSUES],
    )


def _all_lengths(segments: DataFrame) -> DataFrame:
    """The four length classes, present or not, as rows."""
    labels = F.array(*[F.lit(x) for x in s.LENGTH_LABELS])
    return segments.agg(F.count("*").alias("n")).select(F.explode(labels).alias("length_category"))


def usability_matrix(segments: DataFrame) -> DataFrame:
    """Four classes by seven buckets of usable share, 0 where there is none."""
    shares = [
        F.coalesce(
            F.max(F.when(F.col("time_bucket") == label, F.col("usable_percentage"))), F.lit(0.0)
        ).alias(label)
        for label in s.BUCKET_LABELS
    ]
    return _all_lengths(segments).join(segments, "length_category", "left").groupBy(
        "length_category"
    ).agg(*shares)


def length_totals(segments: DataFrame) -> DataFrame:
    return (
        _all_lengths(segments)
        .join(segments, "length_category", "left")
        .groupBy("length_category")
        .agg(F.coalesce(F.sum("total_conversations"), F.lit(0)).alias("total_conversations"))
    )


def usable_by_length(segments: DataFrame) -> DataFrame:
    """Per class the exact usable count, and the one rebuilt from rounded shares."""
    rebuilt = (F.col("total_conversations") * F.col("usable_percentage") / 100).cast("bigint")
    return (
        segments.groupBy("length_category")
        .agg(
            F.sum("total_conversations").alias("total_conversations"),
            F.sum("usable").alias("usable"),
            F.sum(rebuilt).alias("usable_reported"),
        )
        .withColumn("usable_pct", F.col("usable") * 100.0 / F.col("total_conversations"))
        .withColumn(
            "usable_pct_reported", F.col("usable_reported") * 100.0 / F.col("total_conversations")
        )
    )


def _large_segments(segments: DataFrame, min_conversations: int) -> DataFrame:
    return segments.filter(F.col("total_conversations") >= min_conversations).select(
        "length_category", "time_bucket", "total_conversations", "usable_percentage"
    )


def _best_first() -> list[Column]:
    return [
        F.desc("usable_percentage"),
        f.length_rank(F.col("length_category")),
        F.asc("time_bucket"),
    ]


def top_segments(segments: DataFrame, min_conversations: int = 1000, n: int = 10) -> DataFrame:
    return _large_segments(segments, min_conversations).orderBy(*_best_first()).limit(n)


def recommended_segments(
    segments: DataFrame, min_conversations: int = 1000, min_usable: float = 70.0, n: int = 5
) -> DataFrame:
    """Segments with a high usable share: the first ``n``, and how many there are in all."""
    good = _large_segments(segments, min_conversations).filter(
        F.col("usable_percentage") >= min_usable
    )
    ranked = good.agg(
        F.count("*").alias("n_segments"),
        F.sum("total_conversations").alias("n_conversations"),
        # at most 40 segments exist
        F.array_sort(
            F.collect_list(
                F.struct(
                    (-F.col("usable_percentage")).alias("order"),
                    f.length_rank(F.col("length_category")).alias("rank"),
                    "time_bucket",
                    "length_category",
                    "total_conversations",
                    "usable_percentage",
                )
            )
        ).alias("ranked"),
    )
    return ranked.select(
        "n_segments", "n_conversations", F.posexplode(F.slice("ranked", 1, n)).alias("pos", "segment")
    ).select(
        "n_segments",
        "n_conversations",
        (F.col("pos") + 1).alias("rank"),
        "segment.length_category",
        "segment.time_bucket",
        "segment.total_conversations",
        "segment.usable_percentage",
    )


def usable_segment_counts(usable: DataFrame) -> DataFrame:
    """Usable conversations per segment, largest first, with a grand total row."""
    counts = usable.groupBy("length_category", "time_bucket").agg(
        F.count("*").alias("usable_count")
    )
    total = counts.agg(
        F.lit("all").alias("length_category"),
        F.lit("all").alias("time_bucket"),
        F.coalesce(F.sum("usable_count"), F.lit(0)).alias("usable_count"),
    )
    return counts.unionByName(total).orderBy(
        F.desc("usable_count"), "length_category", "time_bucket"
    )


def judge_summary(verdicts: DataFrame) -> DataFrame:
    """Quality statistics and safety counts; a column that is absent gives 0."""

    def when_present(name: str, result: Column) -> Column:
        return result if name in verdicts.columns else F.lit(0)

    quality = F.col("quality")
    return verdicts.agg(
        F.count("*").alias("total_conversations"),
        when_present("quality", F.avg(quality)).alias("quality_mean"),
        when_present("quality", F.median(quality)).alias("quality_median"),
        when_present("quality", F.stddev_samp(quality)).alias("quality_std"),
        when_present("is_safe", F.count_if(F.col("is_safe"))).alias("safe_conversations"),
        when_present("contains_pii", F.count_if(F.col("contains_pii"))).alias("contains_pii"),
        when_present(
            "contains_sensitive_content", F.count_if(F.col("contains_sensitive_content"))
        ).alias("contains_sensitive"),
    )


def judge_distribution(verdicts: DataFrame) -> DataFrame:
    """Value counts of language and accuracy in one pass; nulls are left out."""
    present = [n for n in ("language", "response_accuracy") if n in verdicts.columns]
    pairs = [F.struct(F.lit(n).alias("field"), F.col(n).alias("value")) for n in present]
    return (
        verdicts.select(F.inline(F.array(*pairs)))
        .filter(F.col("value").isNotNull())
        .groupBy("field", "value")
        .agg(F.count("*").alias("n"))
    )
