"""Message-level quality rules in two profiles, as plain Columns.

``with_message_flags`` adds the character counts in one projection and the ten
stateless flags in the next, so each pass over the text happens once.  The
eleventh flag, ``duplicate``, depends on other rows: see ``operators.duplicates``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from convq.functions import text as tx

# ---- fixed values: word lists, phrases and patterns that decide the flags ----
OFFENSIVE_TERMS = [
    ["fuck", "shit", "damn", "bitch", "ass", "crap", "hell"],
    ["stupid", "idiot", "moron", "retard"],
    ["hate", "kill", "die", "death"],
    ["nazi", "hitler", "terrorist"],
]
PROMO = [
    "click here",
    "visit (our )?website",
    "buy now",
    "free (offer|gift|trial)",
    "limited time (offer|deal)",
    "act now",
]
PROMO_EXTRA = ["discount code", "huge sale"]
PRICE = [r"\$\d{2,}", r"\d{2,}% (off|discount)"]
CONTROL_CHARS = r"[\x00-\x1f\x7f-\x9f&&[^\t\n\r]]"
ESCAPED_CODE_POINT = r"\\u[0-9a-fA-F]{4}"
REPLACEMENT_PAIR = "\ufffd\ufffd"
REPEATED_CHAR = r"([^\n])\1{9,}"
# ---- end of fixed values ----

FLAGS = [
    "empty",
    "too_short",
    "too_long",
    "gibberish",
    "non_text_heavy",
    "offensive",
    "spam",
    "non_conversational",
    "encoding_issues",
    "language_issues",
]
COUNTS = ["n_chars", "n_alpha", "n_ascii", "n_vowel", "n_text"]


@dataclass(frozen=True)
class Profile:
    """Which of the two rule sets to apply; term lists can be replaced.

    Terms are lower-case patterns that begin and end with a letter or digit.
    """

    name: str = "optimized"
    offensive_terms: tuple[str, ...] = tuple(w for group in OFFENSIVE_TERMS for w in group)

    @property
    def classic(self) -> bool:
        return self.name == "classic"


OPTIMIZED = Profile()
CLASSIC = Profile(name="classic")


def _bounded(alternatives) -> str:
    """Any alternative as a whole word of a lower-case text.

    The only other character that equals an ASCII letter without regard to case
    and survives ``lower`` is the long s.  Java's own case folding also takes the
    dotless i for an i, which it is not.
    """
    pattern = re.sub(r"(?<!\\)s", "[sſ]", "|".join(alternatives))
    return rf"(?U)\b(?:{pattern})\b"


def is_empty(stripped: Column) -> Column:
    return stripped == ""


def is_too_short(stripped: Column, min_chars: int = 2) -> Column:
    return F.length(stripped) < min_chars


def is_too_long(t: Column, profile: Profile = OPTIMIZED) -> Column:
    if profile.classic:
        spaces = F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit("")))
        return (F.length(t) >= 1000) & (spaces + 1 > 1000)
    return (F.length(t) >= 2000) & tx.has_more_words_than(t, 500)


def is_gibberish(t: Column, c: dict[str, Column]) -> Column:
    """Too short, few letters, few vowels, an overlong word, or a repeated character.

    A text of only digits, only ASCII letters without space, or only symbols is
    always caught by the first four tests, so no pattern of its own is needed.
    """
    consonants = c["n_alpha"] - c["n_vowel"]
    long_word = F.when(t.contains(" "), tx.has_word_longer_than(t, 20)).otherwise(c["n_chars"] > 20)
    return (
        (c["n_chars"] < 3)
        | (tx.ratio(c["n_alpha"], c["n_chars"]) < 0.3)
        | ((consonants > 0) & (tx.ratio(c["n_vowel"], consonants) < 0.1))
        | long_word
        | t.rlike(REPEATED_CHAR)
    )


def is_non_text_heavy(c: dict[str, Column]) -> Column:
    return tx.ratio(c["n_text"], c["n_chars"]) < 0.5


def is_offensive(t: Column, profile: Profile = OPTIMIZED) -> Column:
    lower = F.lower(t)
    long_enough = F.length(t if profile.classic else lower) >= 3
    # no ASCII letter before the term: cheaper than, and implied by, the word boundary
    return long_enough & lower.rlike("(?<![a-z])" + _bounded(profile.offensive_terms))


def is_spam(t: Column, profile: Profile = OPTIMIZED) -> Column:
    lower = F.lower(t)
    if profile.classic:
        both = lower.rlike(_bounded(PROMO)) & lower.rlike(_bounded(PRICE + PROMO_EXTRA))
        return (lower.contains("free") & lower.contains("click")) | both
    # a price needs one of two signs: most texts end here
    maybe_price = t.contains("$") | t.contains("%")
    return maybe_price & lower.rlike(_bounded(PRICE)) & lower.rlike(_bounded(PROMO + PROMO_EXTRA))


def is_non_conversational(
    t: Column, clean: Column, n_alpha: Column, profile: Profile = OPTIMIZED
) -> Column:
    """One character, or nothing that reads as language.

    The punctuation-only and symbol-only forms hold no letter, so the letter
    (classic: letter or digit) test covers them.
    """
    single = F.length(clean) == 1
    if profile.classic:
        no_alnum = ~clean.rlike(r"[\p{L}\p{N}]")
        return single | no_alnum | clean.rlike(r"(?U)\A[\d\s()\-]+\z")
    return (t == "") | single | ((clean != "") & (n_alpha == 0))


def has_encoding_issues(t: Column, c: dict[str, Column], profile: Profile = OPTIMIZED) -> Column:
    broken = (
        t.contains(REPLACEMENT_PAIR) | t.rlike(CONTROL_CHARS) | t.rlike(ESCAPED_CODE_POINT)
    )
    if profile.classic:
        return broken
    return broken | (
        (tx.ratio(c["n_ascii"], c["n_chars"]) < 0.5) & (tx.ratio(c["n_alpha"], c["n_chars"]) > 0.7)
    )


def has_language_issues(c: dict[str, Column]) -> Column:
    return tx.ratio(c["n_ascii"], c["n_chars"]) < 0.8


def flag_columns(profile: Profile = OPTIMIZED) -> dict[str, Column]:
    """The stateless flags over the columns that ``with_message_flags`` prepares."""
    t = F.col("text")
    c = {name: F.col(name) for name in COUNTS}
    return {
        "empty": is_empty(F.col("stripped")),
        "too_short": is_too_short(F.col("stripped")),
        "too_long": is_too_long(t, profile),
        "gibberish": is_gibberish(t, c),
        "non_text_heavy": is_non_text_heavy(c),
        "offensive": is_offensive(t, profile),
        "spam": is_spam(t, profile),
        "non_conversational": is_non_conversational(t, F.col("norm"), c["n_alpha"], profile),
        "encoding_issues": has_encoding_issues(t, c, profile),
        "language_issues": has_language_issues(c),
    }


def with_message_flags(messages: DataFrame, profile: Profile = OPTIMIZED) -> DataFrame:
    """Messages plus ``stripped``, ``norm``, the character counts and ten flags.

    A null text counts as empty.
    """
    known = messages.withColumn("text", F.coalesce(F.col("text"), F.lit("")))
    prepared = (
        tx.with_char_counts(known)
        .withColumn("stripped", tx.strip(F.col("text")))
        .withColumn("norm", F.lower("stripped"))
    )
    return prepared.withColumns(flag_columns(profile))


def char_stats(messages: DataFrame) -> DataFrame:
    """Counts and ratios per message over the whole text."""
    known = messages.withColumn("text", F.coalesce(F.col("text"), F.lit("")))
    c = {name: F.col(name) for name in COUNTS}
    return tx.with_char_counts(known).select(
        "conversation_id",
        "message_id",
        *COUNTS,
        (c["n_alpha"] - c["n_vowel"]).alias("n_consonant"),
        tx.ratio(c["n_alpha"], c["n_chars"]).alias("alpha_ratio"),
        tx.ratio(c["n_ascii"], c["n_chars"]).alias("ascii_ratio"),
        tx.ratio(c["n_vowel"], c["n_chars"]).alias("vowel_ratio"),
        tx.ratio(c["n_text"], c["n_chars"]).alias("text_char_ratio"),
    )
