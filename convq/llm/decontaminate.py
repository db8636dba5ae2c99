"""Benchmark decontamination by a prefix-filtered set join.

A benchmark item is cut into windows of ``window`` words (a shorter item is one window).  A
document contains a window only if it contains all of the window's shingles, so one of them is
a sufficient prefix: the one that is rarest in all documents.  The documents' occurrences are
joined with these prefixes alone.  A pair passes if the window fits into the document at that
place (length and positional bound) and then only if all words agree there.

The documents are read once: the places of shingles that the benchmark has at all, with the
words around them, are written as a table.  Frequencies, the join and the comparison need no
more than that.

Shingles travel as 64-bit numbers; since every pair is verified on the words themselves, two
shingles that share a number cost time but change nothing.

Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from convq.llm.tables import row_key, stored, text_of

# ---- fixed values: the words of the contract ----
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
NOT_A_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# ---- end of fixed values ----
WINDOW = 13
SHINGLE = 3
#: One hit word in so many makes a document contaminated.
SHARE = 20
#: Up to so many windows (some 30 MB) the benchmark is broadcast; above, both sides shuffle.
BROADCAST_WINDOWS = 100_000


def words(column: str) -> Column:
    """The words of a text, A-Z in lower case; none for null."""
    lower = F.translate(text_of(column), UPPER, UPPER.lower())
    return F.filter(F.split(lower, NOT_A_WORD), lambda w: w != "")


def _shingles(length: int) -> Column:
    """The numbers of the shingles of ``length`` words in the array ``words``, in order."""
    at = ", ".join(f"words[i + {k}]" for k in range(length))
    return F.expr(
        f"if(size(words) >= {length}, "
        f"transform(sequence(0, size(words) - {length}), i -> xxhash64({at})), cast(array() as array<bigint>))"
    )


def windows(benchmark: DataFrame, window: int = WINDOW, id_col: str = "item_id") -> DataFrame:
    """The different windows of the items: ``words``, ``items`` (their ids as strings, sorted)."""
    cut = F.expr(
        f"if(size(words) <= {window}, array(words), "
        f"transform(sequence(1, size(words) - {window} + 1), i -> slice(words, i, {window})))"
    )
    return (
        benchmark.select(F.col(id_col).cast("string").alias("item"), words("text").alias("words"))
        .filter(F.size("words") > 0)
        .select("item", F.explode(cut).alias("words"))
        .groupBy("words")
        .agg(F.collect_set("item").alias("items"))
    )


def _all(frames: list[DataFrame]) -> DataFrame:
    whole = frames[0]
    for frame in frames[1:]:
        whole = whole.unionByName(frame)
    return whole


def _places(texts: DataFrame, wanted: DataFrame, length: int, window: int, small: bool, marks: bool) -> DataFrame:
    """Where the documents have one of the ``wanted`` shingles of ``length`` words.

    ``texts`` has ``doc_id, key, words``.  Gives ``doc_id, key, n_words, length, place, shingle``
    and ``near``: the words from ``near_from`` on, enough for any window around the shingle.
    With ``marks`` each document also has a row with place -1, so that one scan gives both.
    """
    first, n = F.greatest(F.col("place") - (window - 1), F.lit(0)), 2 * window
    near = F.when(F.col("place") >= 0, F.slice("words", first + 1, F.lit(n)))
    numbers = _shingles(length)
    start = 0
    if marks:
        numbers, start = F.concat(F.array(F.lit(0).cast("bigint")), numbers), 1
        wanted = wanted.unionByName(texts.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("shingle"))).distinct()
    exploded = texts.withColumn("n_words", F.size("words")).select("*", F.posexplode(numbers).alias("i", "shingle"))
    exploded = exploded.withColumn("place", F.col("i") - start)
    columns = ["doc_id", "key", "n_words", F.lit(length).alias("length"), "place", "shingle"]
    if small:
        # Split, explode, join and slice run in one stage: only what matches leaves it.
        kept = exploded.join(F.broadcast(wanted), "shingle", "left_semi")
        return kept.select(*columns, near.alias("near"), first.alias("near_from"))
    kept = exploded.select("key", "place", "shingle").join(wanted, "shingle", "left_semi")
    # Per document at most its own places.
    by_document = kept.groupBy("key").agg(F.collect_set(F.struct("place", "shingle")).alias("found"))
    rows = texts.withColumn("n_words", F.size("words")).join(by_document, "key")
    return rows.select("*", F.inline("found")).select(*columns, near.alias("near"), first.alias("near_from"))


def _matches(places: DataFrame, cut: DataFrame, length: int, small: bool) -> DataFrame:
    """Verified windows: ``key, start, end, items``."""
    found = places.filter((F.col("length") == length) & (F.col("place") >= 0))
    frequency = found.groupBy("shingle").agg(F.count("*").alias("frequency"))
    own = cut.select("words", "items", F.posexplode(_shingles(length)).alias("offset", "shingle"))
    # A shingle that no document has rules its window out; ties go to the first place.
    prefixes = (
        own.join(frequency, "shingle", "left")
        .fillna(0, ["frequency"])
        .groupBy("words")
        .agg(
            F.min_by(F.struct("shingle", "offset"), F.struct("frequency", "offset")).alias("rarest"),
            F.first("items").alias("items"),
            F.min("frequency").alias("frequency"),
        )
        .filter("frequency > 0")
        .select("rarest.*", F.col("words").alias("window"), "items")
    )
    start = F.col("place") - F.col("offset")
    fits = (start >= 0) & (start + F.size("window") <= F.col("n_words"))
    equal = F.expr("slice(near, place - offset - near_from + 1, size(window)) = window")
    return (
        found.join(F.broadcast(prefixes) if small else prefixes, "shingle")
        .filter(fits)
        .filter(equal)
        .select("key", start.alias("start"), (start + F.size("window")).alias("end"), "items")
    )


def report(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """One row per row of ``documents``: ``doc_id, key, n_words, n_hit, items, contaminated``.

    ``n_hit`` counts the words inside any occurrence of a window, ``items`` are the ids of the
    items with an occurring window, as sorted strings.  ``key`` is ``row_key("doc_id", "text")``.

    A null or empty text has no words and no hit.  Items with the same id count as one; an item
    without id makes words hit but is not listed.  Repeated rows each get a row; an empty
    benchmark hits nothing, empty documents give an empty table.  Other columns are not read.
    """
    cut = windows(benchmark, window).withColumn("length", F.least(F.size("words"), F.lit(shingle)))
    counts = cut.groupBy("length").agg(F.count("*").alias("n")).collect()  # at most `shingle` rows
    small = sum(r["n"] for r in counts) <= BROADCAST_WINDOWS
    lengths = sorted((r["length"] for r in counts), reverse=True) or [shingle]
    texts = documents.select("doc_id", row_key("doc_id", "text").alias("key"), words("text").alias("words"))
    wanted = {
        n: cut.filter(F.col("length") == n).select(F.explode(_shingles(n)).alias("shingle")).distinct() for n in lengths
    }
    places = stored(
        _all([_places(texts, wanted[n], n, window, small, marks=i == 0) for i, n in enumerate(lengths)]), "places"
    )
    matches = _all([_matches(places, cut.filter(F.col("length") == n), n, small) for n in lengths])
    covered = F.expr(
        """aggregate(spans, struct(0L as n, 0 as upto), (s, x) -> struct(
            s.n + greatest(0, x.end - greatest(s.upto, x.start)) as n, greatest(s.upto, x.end) as upto)).n"""
    )
    hits = (
        matches.groupBy("key")
        .agg(
            F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        )
        .select("key", covered.alias("n_hit"), "items")
    )
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("bigint")
    return (
        places.filter("place < 0")
        .join(hits, "key", "left")
        .select(
            "doc_id",
            "key",
            F.col("n_words").cast("bigint").alias("n_words"),
            n_hit.alias("n_hit"),
            F.coalesce("items", F.array().cast("array<string>")).alias("items"),
            ((n_hit > 0) & (n_hit * SHARE >= F.col("n_words"))).alias("contaminated"),
        )
    )


def clean(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """The rows of ``documents`` that are not contaminated, with all their columns."""
    bad = report(documents, benchmark, window, shingle).filter("contaminated").select(F.col("key").alias("__key"))
    keyed = documents.withColumn("__key", row_key("doc_id", "text"))
    return keyed.join(bad.distinct(), "__key", "left_anti").drop("__key")
