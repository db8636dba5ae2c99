"""The fourteen conversation flags and the numbers derived from them.

One scan of the text: rules run where the messages are read, and only counters
travel.  Counters are first summed per conversation and repeated text, then per
conversation, both with map-side pre-aggregation, so no hot conversation and no
often-repeated message collects in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from convq import schema as s
from convq.functions import rules
from convq.functions import text as tx
from convq.functions.rules import OPTIMIZED, Profile
from convq.operators import duplicates as dup
from convq.operators import filters as f
from convq.operators import placing
from convq.sources.workspace import stored

# ---- fixed values: thresholds of the conversation rules ----
MIN_TEXT = 10
MEANINGFUL = 3
MAX_MESSAGES = 50
SHARES = {
    "gibberish": 0.5,
    "non_text_heavy": 0.5,
    "encoding_issues": 0.3,
    "language_issues": 0.5,
    "non_conversational": 0.7,
}
ANY = ["offensive", "spam"]
REPEATS = 3
REPEAT_MIN_CHARS = 6
LOW_QUALITY_FROM = 3
# ---- end of fixed values ----


def message_flags(
    messages: DataFrame, profile: Profile = OPTIMIZED, duplicate: bool = True
) -> DataFrame:
    """All eleven flags per message; only ids, flags and text keys leave the scan.

    They are written once, and copies are found among these narrow rows.
    """
    flagged = rules.with_message_flags(messages, profile)
    if not duplicate:
        return flagged.select("conversation_id", "message_id", *rules.FLAGS)
    rows = flagged.select(*dup.PLACE, *rules.FLAGS, *dup.keys_of("norm"))
    marked = dup.mark_duplicates(stored(rows, "message-flags"), profile)
    return marked.select("conversation_id", "message_id", *rules.FLAGS, "duplicate")


def message_flag(messages: DataFrame, name: str, profile: Profile = OPTIMIZED) -> DataFrame:
    if name == "duplicate":
        return dup.message_duplicates(messages, profile)
    return rules.with_message_flags(messages, profile).select("conversation_id", "message_id", name)


def _count(flag: str) -> Column:
    return F.count_if(F.col(flag)).alias(flag)


def message_features(messages: DataFrame, profile: Profile = OPTIMIZED) -> DataFrame:
    """All that the conversation flags need to know of a message; its text is left behind.

    Use it as it is, and every step computes just the columns it reads; or write
    it, as ``plans.quality_run`` does, and the text is read once.
    """
    known = messages.filter(F.col("conversation_id").isNotNull())
    given = F.coalesce(F.col("text"), F.lit(""))
    flagged = rules.with_message_flags(known, profile).withColumns(
        {
            "mark": placing.mark("text"),
            "row": F.monotonically_increasing_id(),
            "n_stripped": F.length("stripped"),
            "n_norm": F.length("norm"),
            "text_key": dup.text_key(F.col("norm")),
            "signature": dup.signature("norm", profile),
        }
    )
    outer = ["n_chars", "n_lead"] if profile.classic else []
    if profile.classic:
        after = F.ltrim(given, F.lit(tx.WHITESPACE))
        flagged = flagged.withColumns({"n_chars": F.length(given), "n_lead": F.length(given) - F.length(after)})
    return flagged.select(
        "conversation_id",
        *placing.ORDER,
        "row",
        "n_stripped",
        "n_norm",
        *outer,
        "text_key",
        "signature",
        *SHARES,
        *ANY,
    )


def conversation_counters(features: DataFrame) -> DataFrame:
    """Per conversation: messages, lengths, first time, messages per rule, repeats."""
    counted = [*SHARES, *ANY]
    # short texts never count as repeats; they share one key
    repeated = F.when(F.col("n_norm") > REPEAT_MIN_CHARS, F.col("text_key")).alias("text_key")
    per_text = features.groupBy("conversation_id", repeated).agg(
        F.count("*").alias("n_messages"),
        F.sum("n_stripped").alias("n_stripped"),
        F.count_if(F.col("n_stripped") >= MEANINGFUL).alias("n_meaningful"),
        F.min("sent_at").alias("first_sent_at"),
        *[_count(name) for name in counted],
        dup.signature_sum(),
    )
    return per_text.groupBy("conversation_id").agg(
        F.sum("n_messages").alias("n_messages"),
        F.sum("n_stripped").alias("n_stripped"),
        F.sum("n_meaningful").alias("n_meaningful"),
        F.min("first_sent_at").alias("first_sent_at"),
        *[F.sum(name).alias(f"n_{name}") for name in counted],
        F.sum("words").alias("words"),
        F.max(
            F.when(F.col("text_key").isNotNull(), F.col("n_messages") >= REPEATS).otherwise(False)
        ).alias("repetitive_spam"),
    )


def _is_empty(profile: Profile) -> Column:
    # classic measures the joined text, separators and inner white space included
    chars = F.col("joined_chars") if profile.classic else F.col("n_stripped")
    return (chars < MIN_TEXT) | (F.col("n_meaningful") == 0)


def gate_columns(profile: Profile = OPTIMIZED) -> dict[str, Column]:
    return {
        "empty": _is_empty(profile),
        "too_short": F.col("n_meaningful") < 2,
        "single_turn": F.col("n_messages") == 1,
    }


def checked_conversations(counters: DataFrame) -> DataFrame:
    """Ids whose messages the optimized profile looks at: not empty, short or single."""
    gate = gate_columns(OPTIMIZED)
    return counters.filter(~(gate["empty"] | gate["too_short"] | gate["single_turn"])).select("conversation_id")


def gate_counters(features: DataFrame) -> DataFrame:
    """The part of ``conversation_counters`` that tells whether messages are looked at, and the signatures."""
    return features.groupBy("conversation_id").agg(
        F.count("*").alias("n_messages"),
        F.sum("n_stripped").alias("n_stripped"),
        F.count_if(F.col("n_stripped") >= MEANINGFUL).alias("n_meaningful"),
        dup.signature_sum(),
    )


def conversation_flags(
    messages: DataFrame,
    profile: Profile = OPTIMIZED,
    dedup_scope: str | None = "shared",
) -> DataFrame:
    """One row per conversation with all fourteen flags, its size and first time.

    ``dedup_scope``: "shared" compares a conversation with earlier conversations
    and their messages, "conversation" only with conversations; ``None`` leaves
    duplicates unmarked and saves that work.

    The features of the messages are written once, so the text is read once; only conversations
    that may be duplicates are read again.  Runs jobs, but for ``dedup_scope=None``.
    """
    features = message_features(messages, profile)
    if dedup_scope or profile.classic:  # several branches read them
        features = stored(features, "features")
    return flags_from_features(features, messages, profile, dedup_scope)


def flags_from_features(
    features: DataFrame, messages: DataFrame, profile: Profile = OPTIMIZED, dedup_scope: str | None = "shared"
) -> DataFrame:
    """The flags from the features of ``messages``, a written table if duplicates are looked for."""
    rows = conversation_counters(features)
    if dedup_scope or profile.classic:
        rows = stored(rows, "counters")
    counters = rows
    if profile.classic:
        rows = rows.join(_joined_chars(features, counters), "conversation_id", "left")
        rows = rows.withColumn("joined_chars", F.coalesce("joined_chars", "n_stripped"))
    if dedup_scope is None:
        return _flags_from_counters(rows.withColumn("duplicate", F.lit(False)), profile)
    checked = None if profile.classic else checked_conversations(counters)
    repeated = dup.repeated_conversations(counters, features, messages, profile, checked, dedup_scope)
    duplicate = F.lit(False)
    if repeated is not None:
        rows = rows.join(repeated.withColumn("is_repeat", F.lit(True)), "conversation_id", "left")
        duplicate = F.col("is_repeat").isNotNull()
    if profile.classic:  # here blank texts count as equal
        first = dup.first_blank(counters, features if dedup_scope == "shared" else None)
        later = (F.col("words") == 0) & (F.col("conversation_id") > first)
        duplicate = duplicate | F.coalesce(later, F.lit(False))
    return _flags_from_counters(rows.withColumn("duplicate", duplicate), profile)


def _joined_chars(features: DataFrame, counters: DataFrame) -> DataFrame:
    """``joined_chars`` of conversations that may be too short: from the first visible character to the last.

    The separators and white space between count, and only these few conversations need them: for all others
    the visible texts alone are long enough.
    """
    few = counters.filter((F.col("n_stripped") < MIN_TEXT) & (F.col("n_meaningful") > 0)).select("conversation_id")
    rows = features.join(few, "conversation_id", "left_semi").withColumn("place", F.struct(*placing.ORDER))
    visible = F.col("signature") > 0
    trail = F.col("n_chars") - F.col("n_lead") - F.col("n_stripped")
    ends = rows.filter(visible).groupBy("conversation_id").agg(
        F.min(F.struct("place", F.col("n_lead").alias("outside"))).alias("first"),
        F.max(F.struct("place", trail.alias("outside"))).alias("last"),
    )
    between = rows.join(ends, "conversation_id").filter(F.col("place").between(F.col("first.place"), F.col("last.place")))
    return between.groupBy("conversation_id").agg(
        (F.sum(F.col("n_chars") + 1) - 1 - F.first("first.outside") - F.first("last.outside")).alias("joined_chars")
    )


def _flags_from_counters(rows: DataFrame, profile: Profile) -> DataFrame:
    rows = rows.withColumns(gate_columns(profile))
    total = F.col("n_messages").cast("double")
    flags = {
        name: F.col(f"n_{name}").cast("double") / total > limit for name, limit in SHARES.items()
    }
    flags |= {name: F.col(f"n_{name}") > 0 for name in ANY}
    if not profile.classic:
        gated = F.col("empty") | F.col("too_short") | F.col("single_turn")
        masked = {"encoding_issues": F.lit(False), "offensive": F.lit(False), "spam": F.lit(False)}
        flags = {
            name: F.when(gated, masked.get(name, F.col("empty"))).otherwise(flag)
            for name, flag in flags.items()
        }
    flags["too_long"] = F.col("n_messages") > MAX_MESSAGES
    rows = rows.withColumns(flags)
    n_issues = sum((F.col(name).cast("int") for name in s.LOW_QUALITY_ISSUES), F.lit(0))
    return rows.withColumn("low_quality", n_issues >= LOW_QUALITY_FROM).select(
        "conversation_id", F.col("n_messages").alias("message_count"), "first_sent_at", *s.ISSUES
    )


def is_usable() -> Column:
    """None of the eight major issues."""
    any_major = F.lit(False)
    for name in s.MAJOR_ISSUES:
        any_major = any_major | F.col(name)
    return ~any_major


def usable_conversations(flags: DataFrame) -> DataFrame:
    """Ids of usable conversations with their class and bucket."""
    return with_segment(flags.filter(is_usable())).select(
        "conversation_id", "length_category", "time_bucket"
    )


def with_segment(flags: DataFrame) -> DataFrame:
    return flags.withColumns(
        {
            "length_category": f.length_category(F.col("message_count")),
            "time_bucket": f.time_bucket(F.col("first_sent_at")),
        }
    )
