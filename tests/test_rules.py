import random

import pytest
from pyspark.sql import functions as F

from convq.functions import rules
from convq.functions import text as tx
from convq.functions.rules import CLASSIC, OPTIMIZED
from spec import message

COLUMNS = [
    "gibberish", "non_text_heavy", "offensive", "spam", "non_conversational", "encoding_issues",
    "language_issues",
]
TABLE = [
    ("", "TTFFTFT"),
    ("   ", "TFFFFFF"),
    ("ok", "TFFFFFF"),
    ("hello there friend", "FFFFFFF"),
    ("aaaaaaaaaa", "TFFFFFF"),
    ("aaaaaaaaa", "FFFFFFF"),
    ("supercalifragilisticexpialidocious", "TFFFFFF"),
    ("rhythm myths", "TFFFFFF"),
    ("123!", "TTFFTFF"),
    ("go to hell now", "FFTFFFF"),
    ("hello shell", "FFFFFFF"),
    ("click here for 50% off today", "FFFTFFF"),
    ("click here now please", "FFFFFFF"),
    ("free stuff if you click", "FFFFFFF"),
    ("bell \x07 rings today", "FFFFFTF"),
    ("see \\u00e9 escaped here", "FFFFFTF"),
    ("日本語 の テキスト", "TFFFFTT"),
]
CLASSIC_CHANGES = {
    "   ": {"non_conversational": True},
    "123!": {"non_conversational": False},
    "free stuff if you click": {"spam": True},
    TABLE[-1][0]: {"encoding_issues": False},
}
SPACES = list(tx.WHITESPACE)
ADVERSARIAL = (
    [f"{s}word{s}" for s in SPACES]
    + [f"one{s}two" for s in SPACES]
    + [
        "\n" * 10, "\r" * 10, "a " * 9, " " * 12, "x" * 20, "x" * 21, "a b" + "c" * 20,
        "a b" + "c" * 21, "a " + "b" * 21, "ſhit happens", "Kill it", "ébitch",
        "bitch́ please", "_hell_", "hell\n", "100% off", "99% off click here", "click here $100",
        "x$100 click here", "x$100abc click here", "CLICK HERE 20% DISCOUNT", "visit website 10% off",
        "buy now ١٢% off", "discount code 50% off", "huge sale", "click here huge sale",
        "�", "��", "� �", "tab\there", "nul\x00", "del\x7f", "nel\x85 nel",
        "\\u12g4", "\\U0041", "0" * 15, "0" * 15 + "\n", "a" * 9 + "\n", "!" * 20, "?!." * 7, "(12) 34-56",
        "12 34", "12\x1c34", "١٢", "_", "_ _", "5", "½", "一", "İstanbul", "AEIOU bcdfg",
        "äöüäöü", "naïve café", "\U0001f600" * 10, "\U0001f600 hi there", "\U00020000" * 21,
        "word " * 500, "word " * 501, "a " * 1000, "a " * 1001, "abcd " * 400 + "x" * 21, "é" * 2000,
        "line\nbreak " * 60, " lead", "trail ", "die", "DIE!", "diet", "so-die-so", "it's death's door",
    ]
)


def flags_of(spark, texts, profile):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    rows = rules.with_message_flags(df, profile).select("i", *rules.FLAGS).collect()
    return {r.i: {n: r[n] for n in rules.FLAGS} for r in rows}


@pytest.mark.parametrize("profile", [OPTIMIZED, CLASSIC])
def test_hand_written_table(spark, profile):
    got = flags_of(spark, [t for t, _ in TABLE], profile)
    for i, (text, expected) in enumerate(TABLE):
        want = {n: e == "T" for n, e in zip(COLUMNS, expected)}
        if profile.classic:
            want |= CLASSIC_CHANGES.get(text, {})
        assert {n: got[i][n] for n in COLUMNS} == want, text


@pytest.mark.parametrize("profile", [OPTIMIZED, CLASSIC])
def test_adversarial_strings(spark, profile):
    got = flags_of(spark, ADVERSARIAL, profile)
    for i, text in enumerate(ADVERSARIAL):
        assert got[i] == message(text, profile.classic), repr(text)


@pytest.mark.parametrize("profile", [OPTIMIZED, CLASSIC])
def test_random_strings(spark, profile):
    rng = random.Random(7)
    parts = [
        "click here", "50% off", "hell", "é", "中文", "abc", "zzz", " ", "  ", "\n", "\t", " ", "\x1d", " ",
        "1", "42", "$99", "!", "...", "-", "(", "_", "a" * 10, "qwrtpsdfgh", "free", "click", "�", "\x01", "\\u0041",
        "the quick brown fox ", "İ", "ß", "١", "\U0001f600",
    ]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(1500)]
    got = flags_of(spark, texts, profile)
    for i, text in enumerate(texts):
        assert got[i] == message(text, profile.classic), repr(text)


def test_null_text_counts_as_empty(spark):
    assert flags_of(spark, [None], OPTIMIZED)[0] == message("")


def test_long_texts_are_read_whole(spark):
    text = "fine words here " * 400 + "中" * 60_000
    assert flags_of(spark, [text], OPTIMIZED)[0] == message(text)


def test_strip_and_words_equal_python(spark):
    texts = ADVERSARIAL + ["".join(SPACES), ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    rows = df.select(
        "i", tx.strip(F.col("text")).alias("s"), tx.normalise(F.col("text")).alias("n"), tx.has_more_words_than(F.col("text"), 2).alias("w")
    ).collect()
    for r in rows:
        text = texts[r.i]
        assert r.s == text.strip()
        assert r.w == (len(text.split()) > 2)
        if "İ" not in text:
            assert r.n == text.strip().lower()


def test_term_lists_can_be_replaced(spark):
    profile = rules.Profile(offensive_terms=("banana",))
    got = flags_of(spark, ["a banana here", "go to hell"], profile)
    assert got[0]["offensive"] and not got[1]["offensive"]
