"""The Merkle manifest against a plain version."""

import zlib

import pytest
from pyspark.sql import functions as F

from . import brute
from convq.llm import merkle

SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string"


def result(df):
    tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return sorted(map(tuple, merkle.manifest(df, tampered).collect()), key=repr)


def plain(df):
    is_tampered = lambda r: r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0
    return sorted(brute.merkle([r.asDict() for r in df.collect()], is_tampered), key=repr)


def rows_of(sizes):
    return [(i * 7 % n, s, "en", 5, f"Text {s} {i}") for s, n in sizes.items() for i in range(n)]


@pytest.mark.parametrize(
    "sizes",
    [{"a": 1}, {"a": 16}, {"a": 17, None: 1}, {"a": 256, "b": 257, "": 3}, {"a": 4200, "ä": 2, "Z": 33}, {f"s{i}": 2 for i in range(300)}],
)
def test_shapes_of_trees(table, sizes):
    df = table(rows_of(sizes), SCHEMA)
    assert result(df) == plain(df)


def test_odd_rows(table):
    long_text = "Wörd und Satz " * 50_000
    rows = [
        (1, "a", None, None, None), (2, "a", "en", 0, ""), (None, "a", "en", 1, "No Id"), (None, "a", "en", 1, "No Id"),
        (None, "a", "en", 1, "Another"), (3, None, None, 3, "ABC"), (3, None, None, 3, "abc"), (3, None, None, 3, "abc"),
        (4, "", "en", 9, long_text), (5, "a:b", "e:n", 2, "1:x"), (-6, "a", "en", 4, "☃ S"), (12, "a", "en", 4, "UPPER"),
    ]
    df = table(rows, SCHEMA).withColumns({"tree": F.lit("x"), "idx": F.lit(7), "root": F.lit("y")})
    assert result(df) == plain(df)


def test_equal_rows_and_empty_table(table):
    df = table([(9, "a", "en", 4, "Same")] * 600, SCHEMA, partitions=5)
    assert result(df) == plain(df)
    assert merkle.manifest(df.limit(0)).count() == 0


def test_every_change_shows(table):
    df = table(rows_of({"a": 40, "b": 3}), SCHEMA)
    whole = merkle.manifest(df).collect()
    assert all(r["verified"] for r in whole)
    changed = merkle.manifest(df, F.col("doc_id") == 2).collect()
    assert {r["root"] for r in changed} == {r["root"] for r in whole}
    assert sorted(r["doc_id"] for r in changed if not r["verified"]) == [2, 2]
    other = merkle.manifest(df.filter("not (source = 'a' and doc_id = 39)")).first()
    assert other["root"] != whole[0]["root"]
