"""Conversations as text, in ordered parts of bounded size.

A transcript may be longer than any cell, so it comes as parts: joined in their order they are
the whole text, of every conversation, whatever its length.  Parts end between messages; a part
holds the messages that begin within the same ``part_chars`` characters.

Where a message begins is the sum of the characters before it, which ``placing`` works out for
conversations of any size.  What only depends on lengths and letters needs no text to be joined:
see ``authored_counts``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from convq.functions import text as tx
from convq.operators import placing
from convq.sources.workspace import stored

PART_CHARS = 1 << 20
CELL_PARTS = 128  # parts that may be joined into one cell
ORDER = ("sent_at", "message_id")


def oversize_conversations(messages: DataFrame, max_chars: int) -> DataFrame:
    size = F.sum(F.coalesce(F.length("text"), F.lit(0)) + 1)
    return (
        messages.groupBy("conversation_id")
        .agg(size.alias("n_chars"))
        .filter(F.col("n_chars") > max_chars)
        .select("conversation_id")
    )


def oversize_messages(messages: DataFrame, max_chars: int) -> DataFrame:
    """Messages, in order, of the conversations of more than ``max_chars`` characters."""
    large = oversize_conversations(messages, max_chars)
    return messages.join(large, "conversation_id", "left_semi").orderBy("conversation_id", *ORDER)


def _parts(
    messages: DataFrame,
    piece: Column,
    separator: str,
    name: str,
    part_chars: int,
    bucket: int = placing.BUCKET,
    most: int | None = None,
) -> DataFrame:
    pieces = messages.select("conversation_id", *ORDER, piece.alias("piece"))
    pieces = pieces.withColumns({"mark": placing.mark("piece"), "size": F.length("piece") + len(separator)})
    placed = placing.with_before(pieces, bucket, most).withColumn("part", F.floor(F.col("before") / part_chars))
    in_order = F.array_sort(F.collect_list(F.struct(*placing.ORDER, "piece")))["piece"]
    lead = F.when(F.col("part") > 0, separator).otherwise("")
    return placed.groupBy("conversation_id", "part").agg(F.array_join(in_order, separator).alias(name)).withColumn(
        name, F.concat(lead, F.col(name))
    )


def transcript_plain(
    messages: DataFrame, part_chars: int = PART_CHARS, bucket: int = placing.BUCKET
) -> DataFrame:
    """``conversation_id, part, combined_text``; a null text counts as empty.

    ``bucket`` is the number of messages that a task may put in order.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    return _parts(messages, text, " ", "combined_text", part_chars, bucket)


def transcript_stripped(
    messages: DataFrame, part_chars: int = PART_CHARS, bucket: int = placing.BUCKET
) -> DataFrame:
    text = tx.strip(F.coalesce(F.col("text"), F.lit("")))
    return _parts(messages, text, " ", "combined_text", part_chars, bucket)


def first_messages(messages: DataFrame, n: int = 15) -> DataFrame:
    """The first ``n`` messages of each conversation.

    Spark applies the rank limit before the shuffle as well, so a hot
    conversation sends ``n`` rows per task.
    """
    rank = F.row_number().over(W.partitionBy("conversation_id").orderBy(*ORDER))
    return messages.withColumn("position", rank).filter(F.col("position") <= n)


def _author() -> Column:
    return F.coalesce(F.col("type"), F.lit(""))


def _text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def authored_parts(
    messages: DataFrame, part_chars: int = PART_CHARS, bucket: int = placing.BUCKET, most: int | None = None
) -> DataFrame:
    """``author: text`` lines of all messages, in parts; a null text reads as empty."""
    line = F.concat(_author(), F.lit(": "), _text())
    return _parts(messages, line, "\n", "full_conversation", part_chars, bucket, most)


def authored_counts(messages: DataFrame, n: int | None = None) -> DataFrame:
    """``conversation_id, n_messages, n_chars, n_letters`` of the authored transcript, without putting it together.

    Both are sums over messages, added up where the messages are read; the characters include
    ``": "`` after each author and the line breaks between messages.
    """
    chosen = messages if n is None else first_messages(messages, n)
    line_chars = F.length(_author()) + F.length(_text()) + F.lit(len(": ") + len("\n"))
    return (
        chosen.filter(F.col("conversation_id").isNotNull())
        .groupBy("conversation_id")
        .agg(
            F.count("*").alias("n_messages"),
            (F.sum(line_chars) - F.lit(len("\n"))).alias("n_chars"),
            F.sum(tx.letters(_author()) + tx.letters(_text())).alias("n_letters"),
        )
    )


def parts_of(messages: DataFrame, kept: DataFrame, n: int | None = None, part_chars: int = PART_CHARS) -> DataFrame:
    """The authored parts of the conversations in ``kept``, rows of ``authored_counts``; only their text is read again.

    Runs jobs: what is kept is a written table.
    """
    kept = stored(kept.select("conversation_id", "n_messages"), "kept")
    most = kept.agg(F.max("n_messages")).first()[0] or 0
    chosen = messages.join(kept.select("conversation_id"), "conversation_id", "left_semi")
    return authored_parts(chosen if n is None else first_messages(chosen, n), part_chars, most=most)


def whole(parts: DataFrame, cell_parts: int = CELL_PARTS) -> DataFrame:
    """Authored parts joined to one text per conversation, null for those of more than ``cell_parts`` parts.

    So one that is too long for a cell takes nothing away from the others, and its own first parts are all that is collected.
    """
    fits = F.when(F.col("part") < cell_parts, F.struct("part", "full_conversation"))
    in_order = F.array_sort(F.collect_list(fits))["full_conversation"]
    text = F.when(F.max("part") < cell_parts, F.array_join(in_order, ""))
    return parts.groupBy("conversation_id").agg(text.alias("full_conversation"))


def transcript_authored(messages: DataFrame, n: int | None = None) -> DataFrame:
    """One text per conversation, as a reader or a judge gets it: all messages, or the first ``n``.

    Null for a conversation longer than a cell, as it would be longer than any prompt; see
    ``authored_parts`` for these.
    """
    return whole(authored_parts(messages if n is None else first_messages(messages, n)))
