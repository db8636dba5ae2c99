"""Fetching messages of chosen conversations.

A join by conversation id deals all messages of a conversation to one task.  Where some conversations are
very large, give the joins their ids (``heavy_ids``): the rows of the other side that belong to
them, one per id and so a bounded number, are broadcast to the messages, which then stay where they are read.
All others are joined as usual.  The result is the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from convq import schema as s
from convq.operators import filters as f
from convq.sources.workspace import stored

HEAVY = 1_000_000  # messages from which on a conversation is heavy
MOST_HEAVY = 10_000  # ids that may be broadcast
KEY = "conversation_id"


def heavy_ids(messages: DataFrame, least: int = HEAVY, most: int = MOST_HEAVY) -> DataFrame:
    """Ids of the conversations of at least ``least`` messages, a written table of at most ``most`` rows.

    Reads the ids only and counts with pre-aggregation.  Where there are more of them, the largest are taken:
    the others have at most a ``most``-th of all messages each, and need no special way.
    """
    counts = messages.filter(F.col(KEY).isNotNull()).groupBy(KEY).agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    return stored(counts.orderBy(F.desc("n"), KEY).limit(most).select(KEY), "heavy-ids")


def _join(messages: DataFrame, rows: DataFrame, how: str, heavy: DataFrame | None) -> DataFrame:
    """Messages joined to ``rows``, which holds an id once, or any number of times for a semi join."""
    if heavy is None:
        return messages.join(rows, KEY, how)
    ids = F.broadcast(heavy.select(KEY))
    few = rows.join(ids, KEY, "left_semi")
    if how == "left_semi":
        few = few.distinct()
    light = messages.join(ids, KEY, "left_anti").join(rows.join(ids, KEY, "left_anti"), KEY, how)
    return light.unionByName(messages.join(ids, KEY, "left_semi").join(F.broadcast(few), KEY, how))


def fetch_by_ids(messages: DataFrame, ids: DataFrame, heavy: DataFrame | None = None) -> DataFrame:
    """Messages of the given conversations; ids may repeat.

    Spark broadcasts the ids while they are below its size threshold and otherwise shuffles, with the
    messages of ``heavy`` conversations left in place.
    """
    return _join(messages, ids.select(KEY), "left_semi", heavy)


def sampled_messages(messages: DataFrame, sample: DataFrame, heavy: DataFrame | None = None) -> DataFrame:
    """Messages joined to the sampled conversations, keeping the sample's columns."""
    return _join(messages, sample, "inner", heavy)


def in_group_having(messages: DataFrame) -> DataFrame:
    """Messages in range of the conversations that have both sides in range."""
    in_range = f.date_range_filter(messages)
    both_sides = (
        in_range.groupBy("conversation_id")
        .agg(
            F.count_if(F.col("type") == s.HUMAN).alias("human_count"),
            F.count_if(F.col("type") == s.AI).alias("ai_count"),
        )
        .transform(f.two_sided)
    )
    return fetch_by_ids(in_range, both_sides)


def metadata_messages(metadata: DataFrame, messages: DataFrame, heavy: DataFrame | None = None) -> DataFrame:
    """Stored metadata with its messages; metadata without messages drops out."""
    joined = _join(messages, metadata, "inner", heavy)
    return joined.select(KEY, *[c for c in (*metadata.columns, *messages.columns) if c != KEY])


def pending(metadata: DataFrame, stored_ids: DataFrame) -> DataFrame:
    """Conversations whose messages are not stored yet."""
    return metadata.join(stored_ids.select("conversation_id"), "conversation_id", "left_anti")


def ordered_messages(messages: DataFrame) -> DataFrame:
    """All messages by conversation and time; the message id settles equal times."""
    return messages.orderBy("conversation_id", "sent_at", "message_id")
