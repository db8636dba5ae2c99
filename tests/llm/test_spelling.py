"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from . import brute
from convq.llm import spelling


def result(df, **options):
    return sorted(map(tuple, spelling.variants(df, **options).collect()))


def key(row):
    return row[0]


def noisy(n, seed, letters="abcdeéüß"):
    """Words of a few letters, so that many are near each other, with chains of counts."""
    rng, counts = random.Random(seed), {}
    while len(counts) < n:
        word = "".join(rng.choices(letters, k=rng.randint(6, 9)))
        counts[word] = 5 ** rng.randint(1, 6)
        for _ in range(3):
            at = rng.randrange(len(word))
            word = rng.choice([word[:at] + word[at + 1 :], word[:at] + rng.choice(letters) + word[at:], word[:at] + rng.choice(letters) + word[at + 1 :]])
            counts[word] = 5 ** rng.randint(1, 6)
    return counts


@pytest.mark.parametrize("seed", [1, 2])
def test_near_words_and_forms(table, monkeypatch, seed):
    monkeypatch.setattr(spelling, "CELL", 40)  # many cells
    counts = noisy(700, seed)
    got = result(table(list(counts.items()), "word string, n bigint"))
    assert got == sorted(brute.spelling(counts))
    assert any(f is not None and f != r for _, f, r, *_ in got)  # chains


def test_cells_do_not_depend_on_the_sample(table, monkeypatch):
    monkeypatch.setattr(spelling, "CELL", 25)
    counts = noisy(300, 3, "abc")
    df = table(list(counts.items()), "word string, n bigint")
    assert result(df, sample_words=60) == result(df) == sorted(brute.spelling(counts))


def test_anagrams_in_bulk(table):
    """Words that no letter count tells apart."""
    rng = random.Random(4)
    counts = {"".join(rng.sample("aabbccdd", 8)): 5 for _ in range(600)} | {"aabbccd": 100, "aabbccdé": 25, "aabbccdü": 5}
    assert result(table(list(counts.items()), "word string, n bigint")) == sorted(brute.spelling(counts))


def test_odd_words(table):
    long_word = "a" * 30_000
    counts = {long_word: 5, long_word + "b": 30, "": 5, "x": 5, "y": 25, "日本語文字列": 5, "日本語文字": 50, "ÀÉÎ": 3, "ÀÉÏ": 15}
    df = table([*counts.items(), (None, 4)], "word string, n bigint").selectExpr("*", "'clash' as near", "1 as n_near")
    assert result(df) == sorted(brute.spelling(counts))
    assert result(df.limit(0)) == []


def test_ties_take_the_first_form(table):
    counts = {"aaaaaa": 1, "aaaaab": 9, "aaaaac": 9, "aaaaaé": 9}
    assert dict((w, f) for w, f, *_ in result(table(list(counts.items()), "word string, n bigint")))["aaaaaa"] == "aaaaab"


def counted(rows, damage, min_chars, min_count):
    out = Counter()
    for doc, text in rows:
        for run in re.findall(spelling.RUN, text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            out[run[: h % len(run)] + run[h % len(run) + 1 :] if damage and h % damage == 0 else run] += 1
    return {w: n for w, n in out.items() if len(w) >= min_chars and n >= min_count}


@pytest.mark.parametrize("options", [(0, 6, 5), (0, 1, 1), (3, 3, 2)])
def test_counting(odd_documents, monkeypatch, options):
    rows = [(r["doc_id"], r["text"]) for r in odd_documents.collect()]
    want = counted(rows, *options)
    assert want and dict(map(tuple, spelling.count_words(odd_documents, *options).collect())) == want
    monkeypatch.setattr(spelling, "HELD", 3)  # passed on in pieces
    assert dict(map(tuple, spelling.count_words(odd_documents, *options).collect())) == want


def test_a_tree_reaches_all_that_one_edit_can(monkeypatch):
    monkeypatch.setattr(spelling, "CELL", 10)
    rng = np.random.default_rng(5)
    x = rng.integers(0, 3, (500, spelling.DIMS)).astype(np.int32)
    tree, n = spelling.cells(x, 1.0)
    home = np.full(len(x), -1)
    for cell, rows in spelling.reached(tree, x, 0, 0):
        assert (home[rows] == -1).all()
        home[rows] = cell
    assert n > 20 and (home >= 0).all()
    seen = {(c, r) for c, rows in spelling.reached(tree, x, 1, 1) for r in rows}
    for i in range(len(x)):
        apart = x - x[i]
        close = (np.maximum(apart, 0).sum(1) <= 1) & (np.maximum(-apart, 0).sum(1) <= 1)
        assert all((home[j], i) in seen for j in np.flatnonzero(close))
    assert len(seen) < n * len(x) / 2  # and prunes
