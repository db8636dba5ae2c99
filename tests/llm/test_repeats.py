"""Both dedup operators on repeated passages against brute force."""

import numpy as np
import pytest

from . import brute
from convq.llm import repeats, substring, suffix


def texts_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def key(row):
    return tuple((x is None, x) if not isinstance(x, bytes) else (False, x) for x in row)


def words_result(df, length=13, **options):
    rows = substring.dedup(df, length=length, **options).collect()
    return sorted([(r["doc"], r["n_tokens"], r["n_removed"], bytes(r["kept"])) for r in rows], key=key)


def bytes_result(df, length=400, **options):
    rows = suffix.dedup(df, length=length, **options).collect()
    return sorted([(r["doc"], r["n_tokens"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in rows], key=key)


def test_words_on_documents(documents):
    got = words_result(documents.repartition(3))
    assert got == sorted(brute.substring_dedup(texts_of(documents), 13), key=key)
    assert sum(r[2] for r in got) > 0


def test_words_on_odd_rows(odd_documents):
    assert words_result(odd_documents) == sorted(brute.substring_dedup(texts_of(odd_documents), 13), key=key)


def test_bytes_on_documents(documents):
    got = bytes_result(documents.repartition(3))
    assert got == sorted(brute.suffix_dedup(texts_of(documents), 400), key=key)
    assert sum(r[2] for r in got) > 0


@pytest.mark.parametrize("group_bytes", [1, 2 << 20])
def test_bytes_on_odd_rows(odd_documents, group_bytes):
    small = odd_documents.filter("length(text) < 5000 or text is null")
    got = bytes_result(small, length=80, seed=16, group_bytes=group_bytes)
    assert got == sorted(brute.suffix_dedup(texts_of(small), 80), key=key)


def test_shared_passages_in_varied_context(table):
    rng = np.random.default_rng(7)
    word = lambda: "".join(rng.choice(list("abcdefg"), 5))
    passage = " ".join(word() for _ in range(30))
    rows = [(i, " ".join([word() for _ in range(rng.integers(0, 20))] + [passage[rng.integers(0, 40) :]] + [word() for _ in range(12)])) for i in range(40)]
    df = table(rows, "doc_id bigint, text string", 5)
    assert words_result(df, length=6, seed=3) == sorted(brute.substring_dedup(rows, 6), key=key)
    for group_bytes in (1, 2000, 1 << 20):
        got = bytes_result(df, length=40, seed=16, group_bytes=group_bytes)
        assert got == sorted(brute.suffix_dedup(rows, 40), key=key)


def test_periodic_text(table):
    rows = [(1, "abab" * 100), (2, "xyz" * 200 + "abab" * 5), (3, "xyz" * 90)]
    df = table(rows, "doc_id bigint, text string")
    assert bytes_result(df, length=50, seed=16) == sorted(brute.suffix_dedup(rows, 50), key=key)


def test_crowded_anchors_are_settled_in_steps(documents, monkeypatch):
    want = words_result(documents)
    monkeypatch.setattr(repeats, "OPEN", 2)
    monkeypatch.setattr(repeats, "HELD", 50)
    kind = repeats.Kind(substring.word_numbers, 13, 7, True, substring.kept_words)
    rows = documents.select("doc_id", "text").collect()
    sent = _local_statuses(rows, kind)
    monkeypatch.undo()
    assert {(d, p) for d, p, s in sent if s == repeats.FULL} == {
        (d, p) for d, p, s in _local_statuses(rows, kind) if s == repeats.FULL
    }
    assert want


def _local_statuses(rows, kind):
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays(
        [pa.array([r["doc_id"] for r in rows]), pa.array([r["text"].encode() for r in rows])], ["doc", "text"]
    )
    sent = [b.to_pandas() for b in repeats._anchors(kind)([batch])]
    import pandas as pd

    table = pd.concat(sent).sort_values(repeats.NAMES)
    batches = [pa.RecordBatch.from_pandas(table.iloc[i : i + 7], preserve_index=False) for i in range(0, len(table), 7)]
    out = pd.concat([b.to_pandas() for b in repeats._statuses(kind)(batches)])
    # weights are no part of a place
    return [(d, p & ~3, s) for d, p, s in zip(out["doc"], out["place"], out["status"])]


def test_sorted_suffixes():
    rng = np.random.default_rng(1)
    symbols = np.concatenate((rng.integers(1, 4, 300), [0], rng.integers(1, 3, 200), [0]))
    order = suffix.sorted_suffixes(symbols, 400)
    assert [tuple(symbols[i:]) for i in order] == sorted(tuple(symbols[i:]) for i in range(len(symbols)))


def test_empty_tables(table):
    empty = table([], "doc_id bigint, text string")
    assert substring.dedup(empty).count() == 0 and suffix.dedup(empty).count() == 0


def test_rows_without_id_are_told_apart(table):
    import zlib

    rng = np.random.default_rng(22)
    words = lambda n: " ".join("".join(rng.choice(list("abcdefgh"), 6)) for _ in range(n))
    passage, by_sum = words(30), {}
    while True:  # two texts whose checksums agree in 22 bits, one with the passage, one without
        number = len(by_sum)
        text = f"{passage} {number}" if number % 2 else f"{words(25)} {number}"
        other = by_sum.setdefault(zlib.crc32(text.encode()) & 0x3FFFFF, text)
        if other != text and other.startswith(passage) != text.startswith(passage):
            break
        if other != text:
            by_sum[len(by_sum) - (1 << 40)] = text
    rows = [(1, passage), (None, text), (None, other), (None, text), (2, other), (2, text)]
    df = table(rows, "doc_id bigint, text string")
    assert words_result(df) == sorted(brute.substring_dedup(rows, 13), key=key)
    assert bytes_result(df, length=80, seed=16) == sorted(brute.suffix_dedup(rows, 80), key=key)
