"""Nearest neighbours by cosine: multi-index hashing over learned binary codes.

A rotation is learned on a bounded sample (principal axes, then alternating between signs and
the best rotation towards them); the signs of a rotated vector are its code.  Codes are cut
into substrings, each with its own index.  Codes within Hamming radius r of a query agree with
it up to ``r // m`` bits in at least one of m substrings, so probing all buckets within that
distance finds every one; a full comparison keeps those within r, and the vectors themselves
rank them.

Rows are dealt by hash into shards of bounded size and queries into blocks of bounded size;
each pair of shard and block is one group, so neither side is ever sent whole to a task.  A
shard answers with its nearest k, at most shards * k rows per query are merged.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from convq.llm.tables import stored

NEIGHBOURS = 5
SUBSTRINGS = 4
#: At most so many vectors, those of the smallest hash of their id, fit rotation and radius.
SAMPLE_ROWS = 8000
SAMPLE_QUERIES = 300
#: Share of the sample's true neighbours that the radius must hold.
COVERED = 0.985
SHARD_ROWS = 8192
BLOCK_ROWS = 4096


@dataclass(frozen=True)
class Coder:
    mean: np.ndarray
    rotation: np.ndarray
    radius: int

    def codes(self, vectors: np.ndarray) -> np.ndarray:
        """Packed bits, one row of bytes per vector; a multiple of ``SUBSTRINGS`` bytes."""
        unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        signs = (unit - self.mean) @ self.rotation > 0
        spare = -signs.shape[1] % (8 * SUBSTRINGS)
        return np.packbits(np.pad(signs, ((0, 0), (0, spare))), axis=1)


def _cosines(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Cosine of each pair of rows, in double precision; equal vectors give equal numbers."""
    dots = (queries * rows).sum(axis=1)
    return dots / (np.sqrt((queries * queries).sum(axis=1)) * np.sqrt((rows * rows).sum(axis=1)))


def learn(sample: np.ndarray, neighbours: int = NEIGHBOURS, rounds: int = 30, seed: int = 42) -> Coder:
    """Rotation and radius from a sample of vectors (one per row, none zero)."""
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    mean = unit.mean(axis=0)
    centred = unit - mean
    _, axes = np.linalg.eigh(centred.T @ centred)
    turned = centred @ axes
    rotation = np.linalg.qr(np.random.default_rng(seed).normal(size=(turned.shape[1],) * 2))[0]
    for _ in range(rounds):
        u, _, v = np.linalg.svd(turned.T @ np.sign(turned @ rotation))
        rotation = u @ v
    coder = Coder(mean, axes @ rotation, 0)
    codes, queries = coder.codes(sample), min(SAMPLE_QUERIES, len(sample))
    distances = []
    for i in range(queries):
        cosine = unit @ unit[i]
        cosine[i] = -2
        best = np.argsort(-cosine, kind="stable")[: min(neighbours, len(sample) - 1)]
        distances.append(np.bitwise_count(codes[best] ^ codes[i]).sum(axis=1))
    found = np.concatenate(distances) if distances else np.zeros(0)
    radius = int(np.quantile(found, COVERED, method="higher")) if len(found) else codes.shape[1] * 8
    return Coder(mean, coder.rotation, radius)


class MultiIndex:
    """The codes of one shard, by the value of each substring."""

    def __init__(self, codes: np.ndarray):
        self.codes, width = codes, codes.shape[1] // SUBSTRINGS
        self.parts = []
        for m in range(SUBSTRINGS):
            part = np.ascontiguousarray(codes[:, m * width : (m + 1) * width])
            values, bucket = np.unique(part, axis=0, return_inverse=True)
            rows = np.argsort(bucket.reshape(-1), kind="stable")
            ends = np.cumsum(np.bincount(bucket.reshape(-1), minlength=len(values)))
            self.parts.append((slice(m * width, (m + 1) * width), values, rows, np.concatenate(([0], ends))))

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """The rows whose code is within ``radius`` of ``code``, all of them, in order."""
        found = np.zeros(len(self.codes), bool)
        for place, values, rows, bounds in self.parts:
            near = np.bitwise_count(values ^ code[place]).sum(axis=1, dtype=np.int64) <= radius // SUBSTRINGS
            sizes = np.diff(bounds)
            found[rows[np.repeat(near, sizes)]] = True
        rows = np.flatnonzero(found)
        return rows[np.bitwise_count(self.codes[rows] ^ code).sum(axis=1, dtype=np.int64) <= radius]


def search(ids, vectors, query_ids, queries, coder: Coder, k: int):
    """``query, rank order, id, score`` of the k nearest of one shard for each query.

    The radius grows until k rows other than the query's own are within it, or all are.
    """
    index, asked, bits = MultiIndex(coder.codes(vectors)), coder.codes(queries), 8 * coder.codes(vectors[:1]).shape[1]
    for i, query in enumerate(query_ids):
        radius = coder.radius
        while True:
            rows = index.within(asked[i], radius)
            rows = rows[ids[rows] != query]
            if len(rows) >= k or radius >= bits:
                break
            radius = min(bits, radius + max(SUBSTRINGS, radius // 4))
        scores = _cosines(np.broadcast_to(queries[i], (len(rows), queries.shape[1])), vectors[rows])
        best = np.lexsort((ids[rows], -scores))[:k]
        yield query, ids[rows[best]], scores[best]


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``id, vector`` (doubles) of the rows that take part.

    Left out are rows without id and vectors that are null, empty, zero, or hold nulls or
    numbers that are not finite.
    """
    vector = F.col("vector")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    return rows.filter(F.col("id").isNotNull() & vector.isNotNull()).filter(finite & F.exists(vector, lambda x: x != 0))


def nearest(
    vectors: DataFrame,
    is_query,
    k: int = NEIGHBOURS,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    sample_rows: int = SAMPLE_ROWS,
    shard_rows: int = SHARD_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest found for each row that ``is_query`` (a
    condition on ``id``) picks, among all rows but those of the query's own id.

    Scores are cosines in double precision, ties go to the smaller id.  Every row is indexed;
    only rotation and radius come from the sample.  Rows that repeat id and vector count once;
    an id with several vectors keeps the best k of all its searches.  Vectors of another length
    than most of the sample's take no part.  Other columns are not read.
    """
    rows = stored(usable(vectors, id_col, vector_col).distinct(), "vectors")
    names = "query_id bigint, rank int, vec_id bigint, score double"
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(sample_rows).collect()
    if not sample:
        return vectors.sparkSession.createDataFrame([], names)
    lengths = [len(r["vector"]) for r in sample]
    dimension = max(set(lengths), key=lambda n: (lengths.count(n), n))
    coder = learn(np.array([r["vector"] for r in sample if len(r["vector"]) == dimension]), k)
    rows = rows.filter(F.size("vector") == dimension)
    asked = rows.filter(is_query)
    sizes = rows.agg(F.count("*"), F.count_if(is_query)).first()
    shards, blocks = max(1, -(-sizes[0] // shard_rows)), max(1, -(-sizes[1] // block_rows))
    dealt = F.xxhash64("id", "vector")
    every_shard, every_block = (F.explode(F.expr(f"sequence(0L, {n - 1}L)")) for n in (shards, blocks))
    held = rows.withColumn("shard", F.pmod(dealt, F.lit(shards))).withColumn("block", every_block)
    queries = asked.withColumn("block", F.pmod(dealt, F.lit(blocks))).withColumn("shard", every_shard)

    def matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        flat = table.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        return table.column("id").to_numpy(), flat.reshape(-1, dimension)

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            found = list(search(*matrix(left), *matrix(right), coder, k))
        return pa.table(
            {
                "query_id": pa.array(np.repeat([q for q, *_ in found], [len(i) for _, i, _ in found]).astype(np.int64)),
                "vec_id": pa.array(np.concatenate([i for _, i, _ in found]) if found else np.zeros(0, np.int64)),
                "score": pa.array(np.concatenate([s for *_, s in found]) if found else np.zeros(0)),
            }
        )

    keys = ["shard", "block"]
    pairs = held.groupBy(*keys).cogroup(queries.groupBy(*keys))
    local = pairs.applyInArrow(answer, "query_id bigint, vec_id bigint, score double").distinct()
    # At most shards * k rows per query.
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = local.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
