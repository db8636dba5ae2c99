"""Substring dedup of words by minimizers.

Of each window of ``LENGTH`` words its anchor, the window of ``SEED`` words with the smallest
number, is compared over all texts.  Only where an anchor occurs in more than one document are the
windows looked at: runs of them that agree as a whole are settled as one, the others are compared
one by one at the full length.  There are no levels in between.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from convq.llm import repeats
from convq.llm.tables import stored

LENGTH = 13
SEED = 7


def word_numbers(data: bytes) -> np.ndarray:
    """A number for each word; words are separated by the six ASCII white spaces."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    return np.array([digest(w) for w in data.split()], np.uint64)


def kept_words(data: bytes, gone: np.ndarray) -> bytes:
    words = data.split()
    return b" ".join(words if not gone.any() else [words[i] for i in np.flatnonzero(~gone)])


def _windows(length: int):
    def pieces(data, tokens, anchors, firsts, lasts):
        if not len(firsts):
            return
        starts = np.concatenate([np.arange(f, l + 1) for f, l in zip(firsts, lasts)])
        ends = starts + length
        first = repeats.Numbers(tokens).of(starts, ends).view(np.int64).tolist()
        second = repeats.Numbers(repeats._mixed(tokens)).of(starts, ends).view(np.int64).tolist()
        for a, b, start in zip(first, second, starts.tolist()):
            yield a, b, start, start, None

    return pieces


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, seed: int = SEED, with_kept: bool = True) -> DataFrame:
    """``doc, n_tokens, n_removed, n_spans, kept_sha256, kept`` for every row of ``docs``.

    A word is removed if it is in a window of ``length`` words that also starts in a document
    with a smaller id; windows are judged on the texts as they are.  ``kept`` is the other words
    in UTF-8, joined by one space; without ``with_kept`` it is null.

    A null text has no words.  Null ids come after all others: their windows are removed for
    any id's, not for one another's.  Rows that share an id are not smaller than each other.  Empty
    tables give empty ones; other columns are not read.  Two windows count as equal if two
    64-bit numbers made from all their words agree.
    """
    kind = repeats.Kind(word_numbers, length, seed, True, kept_words)
    texts = repeats.documents_of(docs, id_col, text_col)
    found = stored(repeats.statuses(texts, kind), "segments")
    mixed = stored(repeats.look(texts, found, kind, _windows(length), with_kept), "looked")
    windows = mixed.filter(F.col("step") == repeats.PIECE).select("a", "b", "row", "doc", "place")
    first = windows.groupBy("a", "b").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).filter("low < high")
    removed = windows.join(first, ["a", "b"]).filter("doc > low").select("row", "place")
    return repeats.finish(mixed, removed, kind, with_kept)
