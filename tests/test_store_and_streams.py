import datetime as dt

import pytest
from pyspark.sql import functions as F

from convq.operators import joins, quality, rollup
from convq.plans import quality_run
from convq.sources import sinks
from convq.sources.store import MessageStore
from convq.sources.workspace import work_folder
from convq.streaming import streams


@pytest.fixture
def talks(make):
    return make({i: ["how is the weather", "it is sunny", f"and on day {i}?"][: 2 + i % 2] for i in range(1, 31)})


def test_refresh_twice_equals_once(spark, talks, tmp_path):
    store = MessageStore(spark, str(tmp_path))
    half = talks.filter("conversation_id <= 10")
    store.refresh(half)
    assert store.status().first().asDict() == {
        "total_conversations": 10, "stored": 10, "remaining": 0, "total_messages": 25, "progress_pct": 100.0,
    }
    store.save_metadata(rollup.conversation_metadata(talks))
    assert store.status().first().remaining == 20
    for _ in range(3):
        store.refresh(talks)
    assert store.messages().count() == talks.count()
    assert store.messages().exceptAll(talks).isEmpty()
    day = store.messages("2024-02-01", "2024-02-02")
    assert day.count() == talks.count() and store.messages("2024-02-02").isEmpty()
    plan = day._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(quarter" in plan
    assert store.status().first().progress_pct == 100.0


def test_an_unfinished_pull_leaves_no_trace(spark, talks, tmp_path):
    store = MessageStore(spark, str(tmp_path))
    store.save_metadata(rollup.conversation_metadata(talks))
    half = talks.filter("conversation_id <= 10")
    # a pull that died before it marked itself finished
    (
        half.withColumn("pull", F.lit("dead")).withColumn("quarter", F.to_date("sent_at"))
        .write.mode("append").partitionBy("quarter").parquet(f"{tmp_path}/messages")
    )
    half.select("conversation_id", F.lit("dead").alias("pull")).write.mode("append").parquet(f"{tmp_path}/stored_ids")
    assert store.status().first().stored == 0
    with pytest.raises(ValueError):
        store.messages()
    store.pull(talks)
    assert store.messages().count() == talks.count()


def test_status_of_an_empty_store(spark, talks, tmp_path):
    store = MessageStore(spark, str(tmp_path))
    store.save_metadata(rollup.conversation_metadata(talks).limit(0))
    assert store.status().first().progress_pct == 0.0


def test_stored_run_equals_direct_flags(spark, talks, tmp_path):
    store = MessageStore(spark, str(tmp_path / "store"))
    store.refresh(talks)
    run = quality_run.stored_run(store.metadata(), store.messages(), str(tmp_path / "run"))
    assert run.flags.exceptAll(quality.conversation_flags(talks)).isEmpty()
    run.save(str(tmp_path / "reports"))
    summary = spark.read.json(str(tmp_path / "reports/summary")).first()
    assert summary.total_conversations == 30 and summary.sampling_method == "stored copy"
    ids = spark.read.text(str(tmp_path / "reports/usable_ids/ids"))
    assert ids.count() == summary.total_usable_conversations


def test_classic_run_with_limit_and_rate(spark, talks, tmp_path):
    run = quality_run.classic_run(talks, str(tmp_path / "a"), limit=6)
    assert run.flags.count() == 6 and run.sample_rate == pytest.approx(6 / 30)
    assert run.reports()["projection"].first().estimated_total_conversations == 30
    full = quality_run.classic_run(talks, str(tmp_path / "b"), two_sided=True)
    assert full.flags.count() == 30 and "projection" not in full.reports()
    some = quality_run.classic_run(talks, str(tmp_path / "c"), sample_rate=0.5)
    assert 0 < some.flags.count() < 30


def test_stratified_run_takes_whole_conversations(talks, tmp_path):
    run = quality_run.stratified_run(talks, str(tmp_path), target=28 * 4)
    assert run.flags.count() == 8  # four of each of two classes in one bucket
    assert set(r.message_count for r in run.flags.collect()) == {2, 3}


def test_usable_ids_have_a_folder_per_segment(spark, talks, tmp_path):
    usable = quality.usable_conversations(quality.conversation_flags(talks))
    sinks.write_usable_ids(usable, str(tmp_path))
    for r in spark.read.json(f"{tmp_path}/summary").collect():
        assert spark.read.text(f"{tmp_path}/ids/{r.folder}").count() == r.usable_count


def test_metadata_without_messages_drops_out(talks):
    metadata = rollup.conversation_metadata(talks)
    some = talks.filter("conversation_id < 4")
    assert joins.metadata_messages(metadata, some).count() == some.count()
    assert joins.pending(metadata, some.select("conversation_id").distinct()).count() == 27


def test_stream_pull_restarts_without_repeats(spark, talks, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    talks.filter("conversation_id <= 15").write.mode("append").parquet(source)

    def pull():
        stream = streams.read_messages(spark, source, talks.schema)
        streams.stream_pull(stream, out, state).awaitTermination()
        return spark.read.parquet(out)

    assert pull().count() == talks.filter("conversation_id <= 15").count()
    assert pull().count() == talks.filter("conversation_id <= 15").count()
    talks.filter("conversation_id > 15").write.mode("append").parquet(source)
    assert pull().exceptAll(talks).isEmpty() and pull().count() == talks.count()


@pytest.mark.parametrize("files", [1, 6])
def test_stream_flags_equal_the_batch_however_files_fall(spark, make, tmp_path, files):
    m = make({i: ["go to hell now", "12345 678", "fine words"] for i in range(20)}, step=dt.timedelta(days=5))
    m.repartition(files).write.parquet(str(tmp_path / "in"))
    stream = streams.read_messages(spark, str(tmp_path / "in"), m.schema, maxFilesPerTrigger=1)
    for _ in range(2):  # a restart adds nothing
        streams.stream_message_flags(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = streams.read_daily_flag_counts(spark, str(tmp_path / "out"))
    batch = streams.daily_flag_counts(m)
    assert got.count() == batch.count() == 3 and got.exceptAll(batch).isEmpty()


def test_the_copy_by_id_is_read_without_a_shuffle(spark, talks, tmp_path):
    store = MessageStore(spark, str(tmp_path / "store"))
    with pytest.raises(ValueError, match="pull messages first"):
        store.refresh(talks.limit(0))
        store.compact()
    store.refresh(talks.filter("conversation_id <= 10"))
    store.compact(buckets=4)
    store.refresh(talks)
    assert store.not_copied().count() == 1 and store.by_id()[1].count() == 25
    store.compact(buckets=8)
    assert store.not_copied().isEmpty()
    for name in (r.name for r in spark.catalog.listTables() if r.name.startswith("messages_")):
        spark.sql(f"drop table {name}")  # as in a session that did not write them; the files stay
    metadata, messages = store.by_id()
    assert messages.count() == talks.count() and messages.exceptAll(store.messages()).isEmpty()
    assert metadata.exceptAll(store.metadata()).isEmpty() and metadata.count() == 30
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
        joined = joins.metadata_messages(metadata, messages)
        assert "Exchange" not in plan(joined) and joined.count() == talks.count()
        ids = spark.createDataFrame([(3,), (17,)], "conversation_id bigint")
        fetched = joins.fetch_by_ids(messages, ids)
        assert plan(fetched).count("Exchange hashpartitioning") == 1 and fetched.count() == 6  # of the ids alone
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_two_pulls_at_once_store_nothing_twice(spark, talks, tmp_path, monkeypatch):
    store = MessageStore(spark, str(tmp_path))
    store.save_metadata(rollup.conversation_metadata(talks))
    nothing = store.stored_ids()
    with monkeypatch.context() as patch:  # neither pull sees the other's ids
        patch.setattr(store, "stored_ids", lambda: nothing)
        store.pull(talks)
        store.pull(talks)
    assert store.messages().count() == talks.count() and store.messages().exceptAll(talks).isEmpty()
    status = store.status().first()
    assert (status.stored, status.total_messages, status.progress_pct) == (30, talks.count(), 100.0)


def test_stream_dedup_keeps_one_of_each(spark, make, tmp_path):
    m = make({i: ["Same text", "same text ", f"own {i}"] for i in range(10)})
    m.write.parquet(str(tmp_path / "in"))
    kept = streams.stream_dedup(streams.read_messages(spark, str(tmp_path / "in"), m.schema))
    query = (
        kept.writeStream.format("parquet").option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 11


def test_work_folder_is_in_the_shared_folder(spark):
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert work_folder(spark, "x").startswith(shared)
    assert work_folder(spark, "x") != work_folder(spark, "x")


@pytest.mark.parametrize("every", [2, 50])
def test_a_text_comes_once_however_much_later(spark, make, tmp_path, every):
    """Seven files over years, the same texts in most of them, and a restart after each."""
    source, table, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    seen = set()
    for k in range(7):
        texts = [f"Text {i}" for i in range(k, k + 4)] + [" text 0 ", "TEXT 1", f"text {k + 3}"]
        m = make({k: texts}, step=dt.timedelta(days=100 * k))
        m.coalesce(1).write.mode("append").parquet(source)
        stream = streams.read_messages(spark, source, m.schema)
        streams.stream_first_texts(stream, table, state, compact_every=every).awaitTermination()
        seen |= {t.strip().lower() for t in texts}
        kept = streams.read_first_texts(spark, table, m.schema).collect()
        assert sorted(r.text.strip().lower() for r in kept) == sorted(seen)
    assert {r.conversation_id for r in kept if r.text.strip().lower() in ("text 0", "text 1")} == {0}


def test_a_batch_that_runs_again_replaces_itself(spark, make, tmp_path):
    source, table, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for k in range(3):
        make({k: ["same text", f"own {k}"]}).coalesce(1).write.mode("append").parquet(source)
        schema = make({0: ["x"]}).schema
        streams.stream_first_texts(streams.read_messages(spark, source, schema), table, state, 2).awaitTermination()
    (tmp_path / "state" / "commits" / "2").unlink()  # the stream died before it noted the last batch
    for crc in (tmp_path / "state" / "commits").glob(".2.crc"):
        crc.unlink()
    streams.stream_first_texts(streams.read_messages(spark, source, schema), table, state, 2).awaitTermination()
    kept = streams.read_first_texts(spark, table, schema).collect()
    assert sorted(r.text for r in kept) == ["own 0", "own 1", "own 2", "same text"]


def test_snapshots_bound_what_is_read(spark, make, tmp_path):
    source, table, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    rows = [make({k: ["hello there", "x"]}, step=dt.timedelta(days=1)) for k in range(12)]
    for m in rows:
        m.coalesce(1).write.mode("append").parquet(source)
    stream = streams.read_messages(spark, source, rows[0].schema, maxFilesPerTrigger=1)
    streams.stream_message_flags(stream, table, state, compact_every=5).awaitTermination()
    counts = streams._daily_table(spark, table)
    assert counts.snapshot() == 9
    files = counts.read().select(F.regexp_extract(F.input_file_name(), "(upto|batch)=[0-9]+", 0).alias("f")).distinct()
    assert sorted(r.f for r in files.collect()) == ["batch=10", "batch=11", "upto=9"]
    everything = rows[0]
    for m in rows[1:]:
        everything = everything.unionByName(m)
    got, want = streams.read_daily_flag_counts(spark, table), streams.daily_flag_counts(everything)
    assert got.count() == want.count() and got.exceptAll(want).isEmpty()


def test_a_snapshot_counts_only_once_it_is_marked(spark, tmp_path):
    from convq.streaming.batches import BatchTable
    from pyspark.sql.types import StructType

    table = BatchTable(spark, str(tmp_path), StructType().add("n", "long"))
    assert table.read().count() == 0
    for k in range(4):
        table.write(spark.range(k, k + 1).toDF("n"), k)
    table.write(spark.range(3, 5).toDF("n"), 3)  # again
    spark.range(99).toDF("n").write.parquet(str(tmp_path / "upto=2"))  # died before its mark
    values = lambda df: sorted(r.n for r in df.collect())
    assert values(table.read()) == [0, 1, 2, 3, 4] and values(table.read(before=2)) == [0, 1]
    table.compact(2)
    assert table.snapshot() == 2 and values(table.read()) == [0, 1, 2, 3, 4]
    table.compact(1)
    assert table.snapshot() == 2


def test_a_batch_of_one_file_is_dealt_over_the_cores(spark, make, tmp_path, monkeypatch):
    m = make({i: ["go to hell now", "12345 678", "fine words"] for i in range(40)}, step=dt.timedelta(days=5))
    m.coalesce(1).write.parquet(str(tmp_path / "in"))
    tasks, counts = [], streams.daily_flag_counts

    def counted(rows, profile):
        tasks.append(rows.select(F.spark_partition_id()).distinct().count())
        return counts(rows, profile)

    monkeypatch.setattr(streams, "daily_flag_counts", counted)
    stream = streams.read_messages(spark, str(tmp_path / "in"), m.schema)
    streams.stream_message_flags(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert tasks and min(tasks) >= spark.sparkContext.defaultParallelism > 1
    got = streams.read_daily_flag_counts(spark, str(tmp_path / "out"))
    assert got.exceptAll(counts(m)).isEmpty() and got.count() == counts(m).count()
