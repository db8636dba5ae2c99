"""Repeated texts across the whole corpus, without shuffling any text.

Order decides which copy is the first: conversations by id, and in each its whole
text before its messages.  Instead of ranking all copies of a text in one task,
every text key keeps its earliest place (a pre-aggregated minimum), and rows find
out by their own number whether they hold that place.  A text that makes up a
third of the corpus is therefore no hot spot.

A message is known by the hash of its text.  A whole conversation is cut into messages in
any way, and two that read the same need not be cut alike.  So each message carries a
signature of its words that adds up over messages in any order: equal texts have equal
signatures.  Only conversations whose signature occurs twice, or among the messages, are
suspects; their texts alone are read again, hashed and joined in order (``functions.fingerprint``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from convq.functions import fingerprint as fp
from convq.functions import text as tx
from convq.functions.rules import OPTIMIZED, Profile
from convq.operators import placing
from convq.sources.workspace import stored

WHOLE, MESSAGE = 0, 1
BROADCAST_IDS = 1_000_000  # of some 16 bytes each
BROADCAST_SIGNATURES = 100_000  # of some 40 bytes each; more are joined by a shuffle

# ---------------------------------------------------------------- signatures


def signature(norm: str, profile: Profile = OPTIMIZED) -> Column:
    """Of a normalised text: the sum of a number from each word's hash, 0 for a blank text only.

    Messages are joined by spaces, so words stay as they are, and the number of a conversation is the
    sum of those of its messages.  In the classic profile other white space may stand between messages too.
    """
    between = f"(?U)[{tx.WS}]+" if profile.classic else " "
    words = f"array_remove(split({norm}, '{between}'), '')".replace("\\", "\\\\")
    return F.expr(f"aggregate({words}, 0L, (a, w) -> a + (xxhash64(w) & 4294967295L | 1L))")


EXACT = "decimal(38,0)"  # the sum over all words there can be fits


def signature_sum() -> Column:
    """Aggregate that adds signatures up."""
    return F.sum(F.col("signature").cast("decimal(20,0)")).alias("words")


def _texts(wholes: DataFrame, messages: DataFrame | None) -> DataFrame:
    """(conversation_id, kind, signature) of all visible texts that take part."""
    rows = wholes.select("conversation_id", F.lit(WHOLE).alias("kind"), F.col("words").cast(EXACT).alias("signature"))
    if messages is not None:
        rows = rows.unionByName(messages.select("conversation_id", F.lit(MESSAGE).alias("kind"), F.col("signature").cast(EXACT)))
    return rows.filter("signature <> 0")


def suspects(wholes: DataFrame, messages: DataFrame | None, both_ways: bool = False) -> DataFrame | None:
    """Ids of conversations with a text whose signature shows up again, or None where there is no such text.

    That is: a whole conversation, and an earlier text of the same signature.  With ``both_ways``
    the whole may also be the earlier of the two.  The signatures are a written table.
    """
    texts = _texts(wholes, messages)
    last_whole = F.max(F.when(F.col("kind") == WHOLE, F.col("conversation_id")))
    groups = texts.groupBy("signature").agg(
        F.min("conversation_id").alias("first"), last_whole.alias("last"), F.count("*").alias("n")
    )
    again = F.col("last").isNotNull() & (F.col("n") > 1) if both_ways else F.col("first") < F.col("last")
    found = stored(groups.filter(again).select("signature"), "signatures")
    n = found.count()
    if n == 0:
        return None
    found = F.broadcast(found) if n <= BROADCAST_SIGNATURES else found
    return texts.join(found, "signature", "left_semi").select("conversation_id").distinct()


def first_blank(wholes: DataFrame, messages: DataFrame | None) -> Column:
    """The smallest id of a conversation that is blank or, if ``messages`` count, holds a blank one."""
    rows = wholes.filter("words = 0").select("conversation_id")
    if messages is not None:
        rows = rows.unionByName(messages.filter("signature = 0").select("conversation_id"))
    return rows.agg(F.min("conversation_id")).scalar()


# -------------------------------------------------------------- fingerprints


def _given() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def _pieces(profile: Profile) -> tuple[Column, Column, Column]:
    """Separator and leading space, visible text, trailing space of one message."""
    t = _given()
    core = tx.strip(t)
    if not profile.classic:
        return F.lit(" "), core, F.lit("")
    after = F.ltrim(t, F.lit(tx.WHITESPACE))
    lead = F.concat(F.lit(" "), F.substr(t, F.lit(1), F.length(t) - F.length(after)))
    trail = F.substr(after, F.length(core) + 1)
    return lead, core, trail


def with_pieces(messages: DataFrame, profile: Profile = OPTIMIZED) -> DataFrame:
    """Messages plus ``pieces``, the fingerprints of their text."""
    names = ["lead", "core", "trail"]
    cut = messages.withColumns(dict(zip(names, _pieces(profile))))
    to_hash = names if profile.classic else ["core"]
    hashes = {f"{name}_hash": fp.hashed(F.lower(F.col(name))) for name in to_hash}
    core = fp.piece("core <> ''", "core", "core_hash")
    if profile.classic:
        lead = fp.piece("false", "lead", "lead_hash")
        pieces = f"array({lead}, {core}, {fp.piece('false', 'trail', 'trail_hash')})"
    else:
        pieces = f"array({fp.separator()}, {core})"
    return cut.withColumns(hashes).withColumn("pieces", F.expr(pieces)).drop(*names, *hashes)


def message_fingerprints(messages: DataFrame, profile: Profile = OPTIMIZED) -> DataFrame:
    """(conversation_id, sent_at, message_id, mark, text_key, pieces): fingerprints, no text."""
    known = messages.filter(F.col("conversation_id").isNotNull())
    named = known.withColumns({"mark": placing.mark("text"), "text_key": text_key(tx.normalise(_given()))})
    return with_pieces(named, profile).select("conversation_id", *placing.ORDER, "text_key", "pieces")


def instants(fingerprints: DataFrame) -> DataFrame:
    """Messages of one conversation that stand together, as ordered arrays of bounded size.

    They share the levels of ``placing`` that are needed to keep the arrays small: mostly just the
    conversation, down to one instant, id and hash where one holds very many messages.  Runs a count.
    """
    names = placing.levels_needed(fingerprints.select("conversation_id", *placing.ORDER))
    messages = F.array_sort(F.collect_list(F.struct(*[F.col(f"own.{c}").alias(c) for c in placing.ORDER], "pieces")))
    own = F.struct(*placing.ORDER).alias("own")
    placed = placing.with_levels(fingerprints.select("conversation_id", *placing.ORDER, own, "pieces"), names)
    return placed.groupBy("conversation_id", *names).agg(messages.alias("messages"))


def _fold(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    in_order = f"array_sort(collect_list(struct({order}, pieces)))"
    collected = rows.groupBy(*keys).agg(F.expr(f"flatten({in_order}.pieces)").alias("pieces"))
    return fp.compress(collected)


def conversation_fingerprints(instants: DataFrame) -> DataFrame:
    """One fingerprint per conversation, joined in the order of its messages, level by level.

    What a task collects at once is bounded by the children that a level can have.
    """
    names = [name for name in placing.LEVELS if name in instants.columns]
    step = fp.compress(instants.withColumn("pieces", F.expr("flatten(messages.pieces)")).drop("messages"))
    for depth in reversed(range(len(names))):
        step = _fold(step, ["conversation_id", *names[:depth]], names[depth])
    return step


def _exact(prints: DataFrame, checked_ids: DataFrame | None, scope: str) -> DataFrame:
    """(conversation_id, kind, text_key, exact): whole texts and, if shared, the messages that are looked at."""
    exact = F.struct(fp.core()["h"].alias("h"), fp.core()["w"].alias("w")).alias("exact")
    no_key = F.lit(None).cast("binary").alias("text_key")
    rows = conversation_fingerprints(instants(prints)).select("conversation_id", F.lit(WHOLE).alias("kind"), no_key, exact)
    if scope == "shared":
        messages = prints if checked_ids is None else prints.join(checked_ids, "conversation_id", "left_semi")
        rows = rows.unionByName(messages.select("conversation_id", F.lit(MESSAGE).alias("kind"), "text_key", exact))
    return rows


def exact_keys(messages: DataFrame, profile: Profile = OPTIMIZED, checked_ids: DataFrame | None = None) -> DataFrame:
    """(conversation_id, kind, key) of all whole texts and of the messages that are looked at.

    Keys are equal where the normalised texts are, however they are cut into messages.  The optimized
    profile leaves blank texts out.  Hashes every text; for an index that later texts are compared with.
    """
    rows = _exact(stored(message_fingerprints(messages, profile), "fingerprints"), checked_ids, "shared")
    if not profile.classic:
        rows = rows.filter(F.exists("exact.h", lambda x: x != 0))
    numbers = [F.col(f"exact.{part}").cast("array<string>") for part in ("h", "w")]
    return rows.select("conversation_id", "kind", F.unhex(F.md5(F.concat_ws(",", *numbers))).alias("key"))


def _prints(messages: DataFrame, ids: DataFrame, profile: Profile) -> DataFrame:
    """Written fingerprints of the messages of some conversations; texts of the others are not shuffled
    as long as the ids are few enough to be broadcast."""
    ids = stored(ids, "suspects")
    chosen = messages.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "conversation_id", "left_semi")
    return stored(message_fingerprints(chosen, profile), "fingerprints")


# ------------------------------------------------------------------- repeats


def repeated_conversations(
    wholes: DataFrame,
    features: DataFrame,
    messages: DataFrame,
    profile: Profile = OPTIMIZED,
    checked_ids: DataFrame | None = None,
    scope: str = "shared",
) -> DataFrame | None:
    """Ids of conversations whose visible whole text occurs in an earlier one, or None where no text is suspect.

    ``wholes`` has ``conversation_id`` and the sums of its signatures, ``features`` the message
    features; both are written tables.  ``checked_ids`` limits the messages to conversations whose messages are
    looked at.  ``messages`` are read again for suspects only.  Runs jobs.

    Inside a conversation the whole text comes before the messages, so the smallest id per text is enough to tell.
    """
    texts = None
    if scope == "shared":
        texts = features if checked_ids is None else features.join(checked_ids, "conversation_id", "left_semi")
    ids = suspects(wholes, texts)
    if ids is None:
        return None
    prints = _prints(messages, ids, profile)
    first_whole = F.min(F.when(F.col("kind") == WHOLE, F.col("conversation_id")))
    originals = (
        _exact(prints, checked_ids, scope)
        .groupBy("exact")
        .agg(F.min("conversation_id").alias("first_id"), first_whole.alias("conversation_id"))
        .filter(F.col("first_id") == F.col("conversation_id"))
        .select("conversation_id")
    )
    return prints.select("conversation_id").distinct().join(originals, "conversation_id", "left_anti")


def first_occurrence(
    features: DataFrame,
    wholes: DataFrame,
    messages: DataFrame,
    profile: Profile = OPTIMIZED,
    checked_ids: DataFrame | None = None,
) -> DataFrame:
    """Every conversation text and message text, and whether it was seen before.

    ``features`` are the features of ``messages`` and ``wholes`` the sums of their signatures per
    conversation, both written tables; the text is read again for suspects only.  The optimized profile leaves
    blank texts out.  Runs jobs.
    """
    texts = features if checked_ids is None else features.join(checked_ids, "conversation_id", "left_semi")
    blank_whole = first_blank(wholes, None)
    blank_text = first_blank(wholes, texts)
    if not profile.classic:
        wholes, texts = wholes.filter("words <> 0"), texts.filter("signature <> 0")

    # messages among themselves
    place = F.struct("conversation_id", *placing.ORDER, "row")
    firsts = texts.groupBy("text_key").agg(F.min(place).alias("first")).select(F.col("first.row").alias("row"))
    rows = texts.select("conversation_id", "sent_at", "message_id", "row", "text_key", (F.col("signature") == 0).alias("blank"))
    rows = rows.join(firsts.withColumn("is_first", F.lit(True)), "row", "left")

    # whole texts, and messages that read like one
    ids = suspects(wholes, texts, both_ways=True)
    repeated_whole, repeats_whole = F.lit(False), F.lit(False)
    if ids is not None:
        first_whole = F.min(F.when(F.col("kind") == WHOLE, F.col("conversation_id")))
        exact = stored(_exact(_prints(messages, ids, profile), checked_ids, "shared"), "exact")
        # a row per text; copies find out by their own id or the key of their message
        known = exact.groupBy("exact").agg(
            F.min("conversation_id").alias("first_id"), first_whole.alias("first_whole"), F.max("text_key").alias("text_key")
        )
        originals = known.filter(F.col("first_id") == F.col("first_whole")).select(F.col("first_whole").alias("conversation_id"))
        later = exact.filter(F.col("kind") == WHOLE).select("conversation_id").join(originals, "conversation_id", "left_anti")
        wholes = wholes.join(later.withColumn("later", F.lit(True)), "conversation_id", "left")
        repeated_whole = F.col("later").isNotNull()
        like_whole = stored(known.filter("first_whole is not null and text_key is not null").select("text_key", "first_whole"), "like-whole")
        few = like_whole.count() <= BROADCAST_SIGNATURES
        rows = rows.join(F.broadcast(like_whole) if few else like_whole, "text_key", "left")
        repeats_whole = F.coalesce(F.col("first_whole") <= F.col("conversation_id"), F.lit(False))

    blank_later = (F.col("words") == 0) & (F.col("conversation_id") > blank_text)
    whole_rows = wholes.select(
        "conversation_id",
        F.lit(WHOLE).alias("kind"),
        F.lit(None).cast("timestamp").alias("sent_at"),
        F.lit(None).cast("bigint").alias("message_id"),
        (repeated_whole | F.coalesce(blank_later, F.lit(False))).alias("duplicate"),
    )
    blank_again = F.coalesce(F.col("blank") & (F.col("conversation_id") >= blank_whole), F.lit(False))
    return whole_rows.unionByName(
        rows.select(
            "conversation_id",
            F.lit(MESSAGE).alias("kind"),
            "sent_at",
            "message_id",
            (F.col("is_first").isNull() | repeats_whole | blank_again).alias("duplicate"),
        )
    )


def message_duplicates(messages: DataFrame, profile: Profile = OPTIMIZED) -> DataFrame:
    """Whether the same normalised text occurs in an earlier message.

    Earlier means a smaller (conversation_id, sent_at, message_id).  Blank texts
    never count as repeats in the optimized profile.
    """
    rows = messages.withColumn("norm", tx.normalise(_given())).select(*PLACE, *keys_of("norm"))
    return mark_duplicates(stored(rows, "text-keys"), profile).select("conversation_id", "message_id", "duplicate")


PLACE = ("conversation_id", "sent_at", "message_id")


def text_key(norm: Column) -> Column:
    return F.unhex(F.sha2(norm, 256))


def keys_of(norm: str) -> list[Column]:
    """``blank``, ``text_key`` and ``row`` of a normalised text: all that its copies are found by."""
    return [
        (F.col(norm) == "").alias("blank"),
        text_key(F.col(norm)).alias("text_key"),
        F.monotonically_increasing_id().alias("row"),
    ]


def mark_duplicates(rows: DataFrame, profile: Profile = OPTIMIZED) -> DataFrame:
    """``rows`` (``PLACE``, ``keys_of`` and others) with ``duplicate``; a written table, so ``row`` is fixed."""
    firsts = rows.groupBy("text_key").agg(F.min(F.struct(*PLACE, "row")).alias("first")).select(F.col("first.row").alias("row"))
    marked = rows.drop("text_key").join(firsts.withColumn("is_first", F.lit(True)), "row", "left")
    again = F.col("is_first").isNull()
    if not profile.classic:
        again = again & ~F.col("blank")
    return marked.withColumn("duplicate", again).drop("row", "is_first", "blank")
