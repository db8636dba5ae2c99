"""Fingerprints of texts that can be joined without seeing the texts again.

``fingerprint(a + b)`` follows from the fingerprints of ``a`` and ``b``.  So the
fingerprint of a whole conversation comes from small per-message rows, however
the text is cut into messages: no transcript is built or shuffled to find copies.

A fingerprint holds four polynomial hashes modulo 2**31 - 1 of the code points
(``h``) and, for joining, each base to the power of the length (``w``).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

PRIME = 2**31 - 1
BASES = (911382323, 972663749, 1597334677, 2013265921)
BLOCK = 2048  # 2**11 products below 2**52 each: their sum fits in 64 bits

HASH_TYPE = T.StructType(
    [T.StructField("h", T.ArrayType(T.LongType())), T.StructField("w", T.ArrayType(T.LongType()))]
)


def _powers() -> np.ndarray:
    rows = [[1] * len(BASES)]
    for _ in range(BLOCK):
        rows.append([x * b % PRIME for x, b in zip(rows[-1], BASES)])
    return np.array(rows, dtype=np.uint64)


def _text_hasher():
    """Function text -> (h, w), as a closure that travels to the executors."""
    powers, bases, prime, block_size = _powers(), BASES, PRIME, BLOCK

    def hash_text(text: str) -> tuple[list[int], list[int]]:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        codes = codes.astype(np.uint64) + np.uint64(1)
        h = [0] * len(bases)
        for start in reversed(range(0, len(codes), block_size)):
            block = codes[start : start + block_size]
            part = block @ powers[: len(block)]
            step = powers[len(block)]
            h = [(int(p) + int(s) * x) % prime for p, s, x in zip(part, step, h)]
        return h, [pow(b, len(codes), prime) for b in bases]

    return hash_text


def _hash_column():
    hash_one = _text_hasher()

    @F.pandas_udf(HASH_TYPE)
    def hash_texts(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([hash_one(t) for t in text], columns=["h", "w"])

    return hash_texts


hash_text = _text_hasher()
_hash_udf = _hash_column()


def hashed(text: Column) -> Column:
    return _hash_udf(text)


# A piece of text is (visible, n, h, w): whether it holds more than white space,
# its length in characters, and its fingerprint.  The expressions are SQL text:
# one call builds them, where nested lambdas of Columns take hundreds.


def _literal(text: str) -> tuple[str, str]:
    return tuple(f"array({', '.join(f'{v}L' for v in values)})" for values in hash_text(text))


def separator() -> str:
    h, w = _literal(" ")
    return f"named_struct('visible', false, 'n', 1L, 'h', {h}, 'w', {w})"


def piece(visible: str, text: str, hashes: str) -> str:
    return (
        f"named_struct('visible', {visible}, 'n', cast(length({text}) as bigint), "
        f"'h', {hashes}.h, 'w', {hashes}.w)"
    )


def joined(pieces: str, visible: str) -> str:
    """All pieces of an array, one after the other, as a single piece."""
    h, w = _literal("")
    step = (
        "named_struct('n', a.n + p.n, "
        f"'h', zip_with(a.h, zip_with(a.w, p.h, (w, h) -> w * h), (x, y) -> (x + y) % {PRIME}L), "
        f"'w', zip_with(a.w, p.w, (x, y) -> x * y % {PRIME}L))"
    )
    return (
        f"aggregate({pieces}, named_struct('n', 0L, 'h', {h}, 'w', {w}), (a, p) -> {step}, "
        f"a -> named_struct('visible', {visible}, 'n', a.n, 'h', a.h, 'w', a.w))"
    )


def compress(df: DataFrame, name: str = "pieces") -> DataFrame:
    """Shorten the array ``name`` to white space, visible core, white space."""
    marked = df.withColumn("marks", F.expr(f"transform({name}, p -> p.visible)")).withColumns(
        {
            "first": F.expr("cast(array_position(marks, true) as int)"),
            "last": F.expr("cast(size(marks) + 1 - array_position(reverse(marks), true) as int)"),
        }
    )
    before = joined(f"slice({name}, 1, first - 1)", "false")
    core = joined(f"slice({name}, first, last - first + 1)", "true")
    after = joined(f"slice({name}, last + 1, size({name}))", "false")
    short = f"if(first = 0, array({joined(name, 'false')}), array({before}, {core}, {after}))"
    return marked.withColumn(name, F.expr(short)).drop("marks", "first", "last")


def core(pieces: str = "pieces") -> Column:
    """The visible part, of which a message or compressed array has one at most."""
    h, w = _literal("")
    nothing = f"named_struct('visible', true, 'n', 0L, 'h', {h}, 'w', {w})"
    return F.expr(f"coalesce(get(filter({pieces}, p -> p.visible), 0), {nothing})")
