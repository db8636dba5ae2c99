"""Where messages stand in their conversation, for conversations of any size.

The place of a message is a sum over all messages before it.  Sums are added up along levels, each a
column whose order is that of the messages: the hour, the second, the instant, three ranges of
message ids, the id, and a hash for messages that agree in all of these.  A small table per level
holds the sums of its groups, and running sums go down the levels: inside a group only as many
children are ordered as a level can have.  Messages themselves are ordered inside the groups of the last level only.

How many levels are needed is measured: none where no conversation has more than ``BUCKET``
messages, the hour where none has more in an hour, and so on.  With all of them, messages share a group only if
they agree in time, id and hash.  So no task orders a whole hot conversation, nor one that says it all in one
instant or without times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

BUCKET = 1 << 16  # messages that one task may order
MARKS = 4096
KEY = "conversation_id"
ORDER = ("sent_at", "message_id", "mark")
LEVELS = ("hour", "second", "instant", "id_high", "id_middle", "id_low", "id", "mark")


def mark(*columns: str) -> Column:
    """Orders messages of one time and id; rows that share it are told apart by their text, if at all."""
    return F.pmod(F.xxhash64(*columns), F.lit(MARKS)).cast("int")


def _levels() -> dict[str, Column]:
    """The columns of ``LEVELS``; nulls come before all others, as Spark sorts them."""
    at, number = F.col("sent_at"), F.col("message_id")
    no_time, no_id = F.lit("0001-01-01").cast("timestamp"), F.lit(-(1 << 63))
    return {
        "hour": F.coalesce(F.date_trunc("hour", at), no_time),
        "second": F.coalesce(F.date_trunc("second", at), no_time),
        "instant": F.coalesce(at, no_time),
        "id_high": F.coalesce(F.shiftright(number, 48), no_id),
        "id_middle": F.coalesce(F.shiftright(number, 32), no_id),
        "id_low": F.coalesce(F.shiftright(number, 16), no_id),
        "id": F.coalesce(number, no_id),
    }


def with_levels(rows: DataFrame, names: list[str]) -> DataFrame:
    """``rows`` with the level columns ``names``; ``mark`` must be there already."""
    return rows.withColumns({name: column for name, column in _levels().items() if name in names})


def levels_needed(rows: DataFrame, bucket: int = BUCKET) -> list[str]:
    """The first levels whose groups hold at most ``bucket`` messages each, all levels if need be.

    Counts messages, with pre-aggregation, once per level tried; most tables need none.
    """
    for depth in range(len(LEVELS)):
        counts = with_levels(rows, list(LEVELS[:depth])).groupBy(KEY, *LEVELS[:depth]).count()
        if (counts.agg(F.max("count")).first()[0] or 0) <= bucket:
            return list(LEVELS[:depth])
    return list(LEVELS)


def _offsets(sized: DataFrame, names: list[str]) -> DataFrame:
    """``before`` per group of the levels ``names``: the sum of all earlier groups of the conversation."""
    sums = {len(names): sized.groupBy(KEY, *names).agg(F.sum("size").alias("size"))}
    for depth in range(len(names) - 1, 0, -1):
        sums[depth] = sums[depth + 1].groupBy(KEY, *names[:depth]).agg(F.sum("size").alias("size"))
    found = None
    for depth in range(1, len(names) + 1):
        parent = [KEY, *names[: depth - 1]]
        earlier = W.partitionBy(*parent).orderBy(names[depth - 1]).rowsBetween(W.unboundedPreceding, -1)
        here = sums[depth].select(*parent, names[depth - 1], F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("here"))
        if found is None:
            found = here.withColumnRenamed("here", "before")
        else:
            found = here.join(found, parent).withColumn("before", F.col("before") + F.col("here")).drop("here")
    return found


def with_before(rows: DataFrame, bucket: int = BUCKET, most: int | None = None) -> DataFrame:
    """``rows`` (``conversation_id``, ``ORDER``, ``piece``, ``size``) with ``before``, the sum of ``size`` of the messages before.

    Messages come in the order of time, id, mark and piece; those equal in all four may stand in
    any order.  Rows without a conversation are left out.  ``most`` messages in a conversation, where
    that is known, can save the count.
    """
    known = rows.filter(F.col(KEY).isNotNull())
    few = most is not None and most <= bucket
    names = [] if few else levels_needed(known.select(KEY, *ORDER), bucket)
    placed = with_levels(known, names)
    within = W.partitionBy(KEY, *names).orderBy(*ORDER, "piece").rowsBetween(W.unboundedPreceding, -1)
    inside = placed.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0)))
    if not names:
        return inside.withColumnRenamed("inside", "before")
    joined = inside.join(_offsets(placed, names), [KEY, *names])
    return joined.select(*rows.columns, (F.col("before") + F.col("inside")).alias("before"))
