import pytest
from pyspark.sql import functions as F

from convq.llm import mixing


def sizes(spark, n):
    return spark.createDataFrame(list(n.items()), "source_key string, n bigint")


@pytest.mark.parametrize("weights", [{"a": 1.0, "b": 2.0, "c": 4.0}, {"a": 0.001, "b": 0.5, "c": 0.499}, {"a": 1.0}, {}])
def test_pattern_holds_deadlines_and_deviation(spark, weights):
    shares = mixing.quotas(sizes(spark, {"=a": 10, "=b": 20, "=c": 5, "": 1}), weights, 120)
    quota = {r["source_key"]: r["quota"] for r in shares.collect()}
    assert sum(quota.values()) == 120 and min(quota.values()) >= 1
    slots = sorted(mixing.pattern(shares, 120).collect(), key=lambda r: r["slot"])
    assert [r["slot"] for r in slots] == list(range(120))
    done = dict.fromkeys(quota, 0)
    for r in slots:
        q, k = quota[r["source_key"]], r["turn"]
        assert k == done[r["source_key"]]
        assert k * 120 // q <= r["slot"] < -(-(k + 1) * 120 // q)
        done[r["source_key"]] += 1
        assert all(abs(done[s] - quota[s] * (r["slot"] + 1) / 120) < 1 for s in quota)


def test_too_many_sources(spark):
    many = sizes(spark, {str(i): 1 for i in range(20)})
    with pytest.raises(Exception, match="longer period"):
        mixing.quotas(many, None, 10).collect()


def test_mix_keeps_all_rows_and_the_weights(table):
    rows = [(i, "hot" if i % 3 else f"s{i % 5}", "x", i) for i in range(900)]
    rows += [(None, None, None, 1), (None, None, None, 1), (5, "", "y", 2), (5, "", "y", 2)]
    docs = table(rows, "doc_id bigint, source string, text string, mix_slot int", 4)
    out = mixing.mix(docs, weights={"hot": 1, "s0": 1}, period=20, block=4).collect()
    assert len(out) == len(rows)
    assert sorted((r["doc_id"] or -1, r["text"] or "") for r in out) == sorted((r[0] or -1, r[2] or "") for r in rows)
    places = [(r["source"], r["mix_block"], r["mix_place"]) for r in out]
    assert len(set(places)) == len(places)
    by_slot = {}
    for r in out:
        by_slot.setdefault(r["mix_slot"], set()).add(r["source"])
    assert all(len(s) == 1 for s in by_slot.values())  # a slot has blocks of one source
    level = {r["mix_slot"] for r in out if r["mix_level"]}
    assert level == set(range(len(level)))


def test_order_does_not_depend_on_partitions(table):
    rows = [(i, f"s{i % 3}") for i in range(200)]
    one, other = (mixing.mix(table(rows, "doc_id bigint, source string", n)).collect() for n in (1, 7))
    assert sorted(map(tuple, one)) == sorted(map(tuple, other))


def test_empty(table):
    out = mixing.mix(table([], "doc_id bigint, source string"))
    assert out.count() == 0
    assert out.columns == ["doc_id", "source", "mix_block", "mix_slot", "mix_place", "mix_level"]


def test_no_python_on_the_executors(documents):
    plan = mixing.mix(documents)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and F
