"""String helpers whose results equal Python's ``str`` methods, as Columns.

Everything stays inside Spark expressions: no function here leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Characters for which Python's str.isspace() holds.
WHITESPACE = "".join(
    chr(c)
    for c in [
        *range(0x09, 0x0E),
        *range(0x1C, 0x21),
        0x85,
        0xA0,
        0x1680,
        *range(0x2000, 0x200B),
        0x2028,
        0x2029,
        0x202F,
        0x205F,
        0x3000,
    ]
)
# The same inside a regex class under (?U); far faster than listing the characters.
WS = r"\s\x1c-\x1f"


def strip(text: Column) -> Column:
    """Drop Unicode whitespace at both ends; linear, unlike an anchored regex."""
    return F.btrim(text, F.lit(WHITESPACE))


def normalise(text: Column) -> Column:
    """Form in which two texts count as the same: stripped and lower case."""
    return F.lower(strip(text))


def remaining(text: Column, drop: str) -> Column:
    """Number of characters left after removing every run that matches ``drop``."""
    return F.length(F.regexp_replace(text, drop, ""))


def letters(text: Column) -> Column:
    return remaining(text, r"\P{L}+")


def has_more_words_than(text: Column, n: int) -> Column:
    """More than ``n`` whitespace-separated words; reads no further than it must."""
    return text.rlike(rf"(?U)\A[{WS}]*+(?:[^{WS}]++[{WS}]++){{{n}}}[^{WS}]")


def has_word_longer_than(text: Column, n: int) -> Column:
    """Some word has more than ``n`` characters.

    The first test knows only the common white space.  It is cheap, and where it
    finds no long run there is no long word.
    """
    return text.rlike(rf"(?:\A|[ \t\n\r])[^ \t\n\r]{{{n + 1}}}") & text.rlike(f"(?U)[^{WS}]{{{n + 1}}}")


def with_char_counts(df: DataFrame, name: str = "text") -> DataFrame:
    """Add the character counts shared by the rules.

    ASCII letters, most of a text, are taken out once; the classes that need
    Unicode tables are counted on the rest.
    """
    text, rest, n = F.col(name), F.col("rest"), F.length(name)
    counts = {
        "n_chars": n,
        "n_alpha": n - remaining(rest, r"\p{L}+"),
        "n_ascii": F.when(F.octet_length(text) == n, n).otherwise(n - remaining(rest, r"[\x00-\x7f]+")),
        "n_vowel": n - remaining(text, "[aeiouAEIOU]+"),
        "n_text": n - remaining(rest, rf"(?U)[\p{{L}}{WS}]+"),
    }
    return (
        df.withColumn("rest", F.regexp_replace(text, "[A-Za-z]+", "")).withColumns(counts).drop("rest")
    )


def ratio(part: Column, whole: Column) -> Column:
    """``part / whole`` as a double, 0 for an empty text."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(
        part.cast("double") / F.greatest(whole, F.lit(1)).cast("double")
    )
