import numpy as np
from pyspark.sql import functions as F

from . import brute
from convq.llm import ann

SCHEMA = "vec_id bigint, embedding array<float>"


def clusters(n, seed=0, dimension=32):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dimension))
    return (centres[rng.integers(0, 12, n)] + 0.6 * rng.normal(size=(n, dimension))).astype(np.float32)


def found(df, every=10, **options):
    out = {}
    for r in ann.nearest(df, F.col("id") % every == 0, **options).orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


def test_recall_over_shards_and_blocks(table):
    vectors = clusters(1500)
    got = found(table([(i, v.tolist()) for i, v in enumerate(vectors)], SCHEMA), shard_rows=400, block_rows=60)
    want = brute.nearest(list(enumerate(vectors.astype(float))), 5, 10)
    assert set(got) == set(want)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits / (5 * len(want)) >= 0.9


def test_index_finds_all_within_the_radius():
    codes = np.random.default_rng(1).integers(0, 256, (700, 8), dtype=np.uint8)
    codes[300:500] = codes[:200]
    index = ann.MultiIndex(codes)
    for radius in (0, 3, 20, 27, 64):
        for code in codes[:20]:
            near = np.flatnonzero(np.bitwise_count(codes ^ code).sum(axis=1) <= radius)
            assert np.array_equal(index.within(code, radius), near)


def test_odd_vectors_ties_and_clashes(table):
    same = [1.0, 2.0, 3.0]
    rows = [(0, same), (10, same), *[(i, same) for i in range(1, 10)], (20, None), (30, [0.0, 0.0, 0.0]), (40, [1.0, None, 2.0]),
            (50, [float("nan"), 1.0, 1.0]), (60, [float("inf"), 1.0, 1.0]), (None, same), (70, []), (80, [1.0]), (90, [-1.0, 0.0, 0.5]), (90, [-1.0, 0.0, 0.5])]
    got = found(table([(*r, 1) for r in rows], SCHEMA + ", id int"))
    assert set(got) == {0, 10, 90}
    assert [i for i, _ in got[0]] == [1, 2, 3, 4, 5] and [i for i, _ in got[10]] == [0, 1, 2, 3, 4]
    assert len({s for _, s in got[0]}) == 1 and [i for i, _ in got[90]] == [0, 1, 2, 3, 4]


def test_fewer_rows_than_asked_for(table):
    got = found(table([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], SCHEMA))
    assert [i for i, _ in got[0]] == [2, 1]
    assert found(table([(0, [1.0, 0.0])], SCHEMA)) == {}


def test_empty(table):
    assert found(table([], SCHEMA)) == {}
