"""Message model, fixed dates, length classes and issue names."""

from __future__ import annotations

from pyspark.sql import types as T

MESSAGE_SCHEMA = T.StructType(
    [
        T.StructField("conversation_id", T.StringType(), False),
        T.StructField("text", T.StringType()),
        T.StructField("sent_at", T.TimestampType(), False),
        T.StructField("type", T.StringType()),
        T.StructField("channel", T.StringType()),
        T.StructField("message_id", T.LongType(), False),
        T.StructField("mode", T.StringType()),
        T.StructField("sharing_restricted", T.BooleanType()),
        T.StructField("sid", T.StringType()),
        T.StructField("user_id", T.StringType()),
    ]
)

VERDICT_SCHEMA = T.StructType(
    [
        T.StructField("quality", T.IntegerType()),
        T.StructField("topic", T.StringType()),
        T.StructField("summary", T.StringType()),
        T.StructField("classification_reasoning", T.StringType()),
        T.StructField("contains_pii", T.BooleanType()),
        T.StructField("contains_sensitive_content", T.BooleanType()),
        T.StructField("is_safe", T.BooleanType()),
        T.StructField("response_accuracy", T.StringType()),
        T.StructField("ai_assistant_is_wrong", T.BooleanType()),
        T.StructField("language", T.StringType()),
    ]
)

# ---- fixed values: they decide results, so they are stated as they are ----
HUMAN = "HUMAN_TO_AI"
AI = "AI_TO_HUMAN"
START_DATE = "2023-07-01"
END_DATE = "2025-01-31"
TIME_BUCKETS = [
    ("2023-Q3", "2023-07-01", "2023-09-30"),
    ("2023-Q4", "2023-10-01", "2023-12-31"),
    ("2024-Q1", "2024-01-01", "2024-03-31"),
    ("2024-Q2", "2024-04-01", "2024-06-30"),
    ("2024-Q3", "2024-07-01", "2024-09-30"),
    ("2024-Q4", "2024-10-01", "2024-12-31"),
    ("2025-Q1", "2025-01-01", "2025-01-31"),
]
LENGTH_CLASSES = [("one_off", 1, 2), ("short", 3, 5), ("medium", 6, 20), ("long", 21, None)]
ISSUES = [
    "empty",
    "too_short",
    "too_long",
    "duplicate",
    "gibberish",
    "non_text_heavy",
    "offensive",
    "spam",
    "non_conversational",
    "encoding_issues",
    "language_issues",
    "single_turn",
    "low_quality",
    "repetitive_spam",
]
MAJOR_ISSUES = [
    "empty",
    "too_short",
    "gibberish",
    "spam",
    "offensive",
    "encoding_issues",
    "low_quality",
    "repetitive_spam",
]
LOW_QUALITY_ISSUES = [
    "empty",
    "too_short",
    "gibberish",
    "non_text_heavy",
    "offensive",
    "spam",
    "encoding_issues",
    "language_issues",
    "non_conversational",
    "repetitive_spam",
]
# ---- end of fixed values ----

BUCKET_LABELS = [label for label, _, _ in TIME_BUCKETS]
LENGTH_LABELS = [label for label, _, _ in LENGTH_CLASSES]
