"""Token counts: two native estimates and a pluggable tokenizer."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, functions as F

from convq.functions import slices

CHARS_PER_TOKEN = 4


def estimate_tokens(n_chars: Column) -> Column:
    """A quarter of the characters, cut to a whole number."""
    return F.call_function("div", n_chars, F.lit(CHARS_PER_TOKEN))


def count_words_and_marks(text: Column) -> Column:
    """Runs of word characters plus single other visible characters."""
    one_char_words = F.regexp_replace(text, r"(?U)\w+", "x")
    return F.length(F.regexp_replace(one_char_words, r"(?U)\s+", "")).cast("bigint")


def tokenizer_counts(tokenize: Callable[[Sequence[str]], Sequence[Sequence]]):
    """Column function that counts the tokens of ``tokenize(texts)`` per text.

    The column has the count ``n`` and ``estimated``.  Texts reach the tokenizer in slices of
    Arrow batches (see ``slices``), so a task holds the tokens of one slice; if it fails on a
    slice, the character estimate stands in and is marked.
    """

    @F.arrow_udf("n bigint, estimated boolean")
    def count(texts: pa.Array) -> pa.Array:
        counts, estimated = [], []
        for start, end in slices.bounds(texts):
            known = [text or "" for text in texts.slice(start, end - start).to_pylist()]
            try:
                found, failed = [len(tokens) for tokens in tokenize(known)], False
            except Exception:
                found, failed = [len(text) // CHARS_PER_TOKEN for text in known], True
            if len(found) != len(known):
                raise ValueError(f"{len(found)} tokenized texts of {len(known)}")
            counts += found
            estimated += [failed] * len(found)
        return pa.StructArray.from_arrays([pa.array(counts, pa.int64()), pa.array(estimated, pa.bool_())], ["n", "estimated"])

    return count
