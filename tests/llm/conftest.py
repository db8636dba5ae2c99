import pytest

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


@pytest.fixture(scope="session")
def table(spark):
    """A frame from rows and a schema text, over several partitions."""

    def build(rows, schema, partitions=3):
        return spark.createDataFrame(rows, schema).repartition(partitions)

    return build


@pytest.fixture(scope="session")
def odd_documents(table):
    """Nulls, empty and long texts, repeated rows and ids, and a clashing column."""
    long_text = " ".join(f"word{i % 997}" for i in range(30_000))
    same = "the very same text that is long enough to hold one whole window of thirteen words and more"
    rows = [
        (1, None, "a"), (2, "", "a"), (3, "   \n\t ", None), (4, long_text, "b"), (4, long_text, "b"),
        (5, same, "b"), (6, same, "b"), (6, same, "b"), (6, "other text under the same id", "b"),
        (None, same, None), (None, None, None), (7, same.upper(), "c"), (8, "ünï cödé wörds ☃ " * 40, "c"),
    ]
    return table([(*r, 0.5) for r in rows], "doc_id bigint, text string, source string, score double")
