import numpy as np

from . import brute
from convq.llm import simhash
from convq.llm.graph import components


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def expected(df):
    rows = [(r["doc_id"], brute.fingerprint(r["text"])) for r in df.select("doc_id", "text").collect()]
    return sorted(((d, signed(f), c) for (d, f), c in zip(rows, brute.components(rows))), key=str)


def result(df, **options):
    rows = simhash.near_duplicates(df, **options).collect()
    return sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in rows), key=str)


def test_documents(documents):
    assert result(documents.repartition(3)) == expected(documents)


def test_odd_rows(odd_documents):
    assert result(odd_documents) == expected(odd_documents)


def test_every_close_pair_meets(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    near = [int(b) ^ sum(1 << int(i) for i in rng.choice(64, rng.integers(1, 8), replace=False)) for b in base]
    values = sorted({signed(int(v)) for v in [*base, *near]})
    want = {}
    for i, c in enumerate(brute.components([(v, v & (2**64 - 1)) for v in values])):
        want[values[i]] = c
    for cell in (1, 50_000):
        df = spark.createDataFrame([(v,) for v in values], "fingerprint bigint")
        got = {r["node"]: r["component"] for r in components(simhash.links(df, 4, cell)).collect()}
        assert {v: got.get(v, v) for v in values} == want


def test_golay_anchors():
    values = np.random.default_rng(5).integers(0, 1 << 63, 500, dtype=np.int64)
    index, anchor, home = simhash.covering(values, 4)
    assert np.array_equal(np.bincount(index[home], minlength=500), np.full(500, 3))
    low = (1 << simhash.LENGTH) - 1
    shifts = np.cumsum((0, *simhash.WIDTHS[:-1]))
    block = anchor >> simhash.LENGTH
    own = (values[index].view(np.uint64) >> shifts[block].astype(np.uint64)) & np.array([(1 << w) - 1 for w in simhash.WIDTHS], np.uint64)[block]
    distance = np.bitwise_count(own ^ (anchor & low).astype(np.uint64))
    assert distance[home].max() <= 3 and distance.max() == 4
    assert (simhash._syndrome(anchor & low) == 0).all()


def test_one_of_each_group_stays(odd_documents):
    kept = simhash.keep_one(odd_documents).collect()
    assert odd_documents.columns == ["doc_id", "text", "source", "score"]
    groups = {c for *_, c in expected(odd_documents)}
    assert sorted(r["doc_id"] for r in kept) == sorted(groups)


def test_chain_of_links(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a bigint, b bigint")
    got = {r["node"]: r["component"] for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_empty(table):
    empty = table([], "doc_id bigint, text string")
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0
