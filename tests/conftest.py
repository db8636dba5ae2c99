import datetime as dt
import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from pyspark.sql import SparkSession  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"
BASE = dt.datetime(2024, 2, 1, 12, 0)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


SCHEMA = "conversation_id bigint, message_id bigint, text string, type string, sent_at timestamp"


@pytest.fixture(scope="session")
def make(spark):
    """Messages from {conversation id: [text, ...]}, one minute apart, sides in turn."""

    def build(conversations, partitions=None, reverse=False, step=dt.timedelta(minutes=1)):
        rows = []
        for cid, texts in conversations.items():
            for i, text in enumerate(texts):
                side = "AI_TO_HUMAN" if i % 2 else "HUMAN_TO_AI"
                rows.append((cid, cid * 1000 + i, text, side, BASE + i * step))
        if reverse:
            rows.reverse()
        df = spark.createDataFrame(rows, SCHEMA)
        return df.repartition(partitions) if partitions else df

    return build


@pytest.fixture(scope="session")
def messages_at(spark):
    """Messages from (conversation id, time, type) rows."""

    def build(rows):
        return spark.createDataFrame(
            [(c, i, "some text", side, at) for i, (c, at, side) in enumerate(rows)], SCHEMA
        )

    return build
