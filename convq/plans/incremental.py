"""Quality metrics that grow with the data: each pull adds its counts, old text is never read again.

A pull brings whole conversations.  All flags but one depend on a conversation alone, so the counts of
pulls add up.  Duplicates depend on the others: for them every text leaves a key, and an index holds where
each key occurs first.  A new conversation is looked up there; and where a new text comes before an old
copy of it, in the order of ids, the pull also writes a correction to the old counts.

Folders below ``root``, one sub-folder per pull in each: ``flags`` (rows of conversations),
``firsts`` (key, first conversation), ``wholes`` (key of each whole text) and ``counts`` (per
segment).  A pull counts once its row is in ``pulls``; one that died half way is written anew.
There must be one writer at a time.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from convq import schema as s
from convq.functions.rules import OPTIMIZED, Profile
from convq.operators import duplicates as dup
from convq.operators import quality, reports
from convq.sources.workspace import stored

SEGMENT = ("length_category", "time_bucket")
COUNTS = ("total_conversations", "total_messages", "usable", *s.ISSUES)


class MetricsStore:
    def __init__(self, spark: SparkSession, root: str, profile: Profile = OPTIMIZED):
        self.spark = spark
        self.root = root.rstrip("/")
        self.profile = profile

    def _pulls(self) -> DataFrame | None:
        try:
            return self.spark.read.schema("pull string").parquet(f"{self.root}/pulls")
        except AnalysisException as problem:
            if problem.getCondition() == "PATH_NOT_FOUND":
                return None
            raise

    def _read(self, table: str) -> DataFrame:
        """The rows of finished pulls."""
        pulls = self._pulls()
        if pulls is None:
            raise ValueError("nothing stored yet: add a pull first")
        names = [r["pull"] for r in pulls.distinct().collect()]  # one short name per pull
        kept = [f"{self.root}/{table}/pull={name}" for name in names]
        return self.spark.read.parquet(*kept)

    def _write(self, rows: DataFrame, table: str, pull: str) -> DataFrame:
        path = f"{self.root}/{table}/pull={pull}"
        rows.write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def add(self, messages: DataFrame, pull: str) -> None:
        """Add the conversations of ``messages`` as ``pull``; one that is finished is not added again.

        They must be whole and not in an earlier pull.  Work grows with the pull, but for narrow
        lookups: its keys are joined with those of the index.
        """
        pulls = self._pulls()
        if pulls is not None and not pulls.filter(F.col("pull") == pull).isEmpty():
            return
        features = stored(quality.message_features(messages, self.profile), "features")
        flags = quality.flags_from_features(features, messages, self.profile, None)
        flags = self._write(quality.with_segment(flags), "flags", pull)

        checked = None
        if not self.profile.classic:
            checked = flags.filter("not (empty or too_short or single_turn)").select("conversation_id")
        texts = stored(dup.exact_keys(messages, self.profile, checked), "keys")
        firsts = self._write(texts.groupBy("key").agg(F.min("conversation_id").alias("first_id")), "firsts", pull)
        own = texts.filter(F.col("kind") == dup.WHOLE).select("conversation_id", "key")
        wholes = self._write(own.join(flags.select("conversation_id", *SEGMENT), "conversation_id"), "wholes", pull)

        known, corrections = firsts, None
        if pulls is not None:
            old = self._read("firsts").join(firsts.select("key"), "key", "left_semi")
            old = old.groupBy("key").agg(F.min("first_id").alias("old_id"))
            known = firsts.join(old, "key", "left").withColumn("first_before", F.col("first_id"))
            # the first of old copies is no longer the first
            turned = known.filter(F.col("first_before") < F.col("old_id")).select("key", F.col("old_id").alias("conversation_id"))
            corrections = self._read("wholes").join(turned, ["key", "conversation_id"], "left_semi")
            known = known.select("key", F.least("first_id", F.coalesce("old_id", "first_id")).alias("first_id"))
        repeated = wholes.join(known, "key").filter(F.col("first_id") < F.col("conversation_id"))
        marked = flags.drop("duplicate").join(
            repeated.select("conversation_id", F.lit(True).alias("duplicate")), "conversation_id", "left"
        )
        counts = segment_counts(marked.withColumn("duplicate", F.coalesce("duplicate", F.lit(False))))
        if corrections is not None:
            zero = {name: F.lit(0).cast("bigint") for name in COUNTS}
            more = corrections.groupBy(*SEGMENT).agg(F.count("*").alias("n")).withColumns(zero | {"duplicate": F.col("n")})
            counts = counts.unionByName(more.drop("n"))
        self._write(counts, "counts", pull)
        self.spark.range(1).select(F.lit(pull).alias("pull")).write.mode("append").parquet(f"{self.root}/pulls")

    def quality_metrics(self) -> DataFrame:
        """Like ``reports.quality_metrics`` over all pulls, from a few rows per pull."""
        total = self._read("counts").agg(*[F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in COUNTS])
        return total.select("total_conversations", "total_messages", *s.ISSUES, "usable")

    def stratified_metrics(self) -> DataFrame:
        """Like ``reports.stratified_metrics`` over all pulls."""
        totals = self._read("counts").groupBy(*SEGMENT).agg(*[F.sum(name).alias(name) for name in COUNTS])
        return reports.with_shares(totals.drop("total_messages"))

    def conversation_flags(self) -> DataFrame:
        """Like ``quality.conversation_flags`` over all pulls: rows of pulls, duplicates from the index."""
        firsts = self._read("firsts").groupBy("key").agg(F.min("first_id").alias("first_id"))
        repeated = self._read("wholes").join(firsts, "key").filter(F.col("first_id") < F.col("conversation_id"))
        rows = self._read("flags").drop("duplicate", *SEGMENT)
        marked = rows.join(repeated.select("conversation_id", F.lit(True).alias("duplicate")), "conversation_id", "left")
        again = F.coalesce("duplicate", F.lit(False))
        return marked.withColumn("duplicate", again).select("conversation_id", "message_count", "first_sent_at", *s.ISSUES)


def segment_counts(flags: DataFrame) -> DataFrame:
    """``COUNTS`` per segment of flagged conversations."""
    return flags.groupBy(*SEGMENT).agg(
        F.count("*").alias("total_conversations"),
        F.sum("message_count").alias("total_messages"),
        F.count_if(quality.is_usable()).alias("usable"),
        *[F.count_if(F.col(name)).alias(name) for name in s.ISSUES],
    )
