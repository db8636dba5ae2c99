"""SimHash near-duplicates by anchor-point covering.

A 64-bit fingerprint is cut into three blocks.  Two fingerprints that differ in at most
``bits`` places differ in at most ``bits // 3`` places of some block.  Anchors of a block are
the 4,096 words of the perfect binary Golay code of length 23 (shorter blocks have zeros in
front): every value lies within 3 places of exactly one of them, its home.  A fingerprint is
replicated to every anchor within ``3 + bits // 3`` places; so for every linked pair one of
the two meets the other at its home, and fingerprints are compared per anchor, those at home
against all.

Equal fingerprints are one row from the start.  An anchor sends a forest, not all its pairs,
and a crowded anchor is dealt out as a grid of cells of bounded size.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from convq.llm.graph import components
from convq.llm.tables import stored

SHINGLE = 4
BITS = 4
SEED = 42
#: Fingerprints of one side that are compared in one cell of an anchor.
CELL = 50_000
#: Hashes that are held at once for one text.
BLOCK = 1 << 16

# ---- fixed values: generator of the binary Golay code of length 23; bits of the three blocks ----
GENERATOR = 0b101011100011
LENGTH = 23
RADIUS = 3
WIDTHS = (22, 21, 21)
# ---- end of fixed values ----


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The signed 64-bit SimHash of a text in UTF-8."""
    import xxhash

    words = (text or b"").lower().split()  # bytes: A-Z only, and the six ASCII white spaces
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    size = min(shingle, len(words))
    starts, ends = starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist()
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(starts), BLOCK):
        pieces = zip(starts[at : at + BLOCK], ends[at : at + BLOCK])
        hashes = np.array([digest(joined[a:b], SEED) for a, b in pieces], np.uint64)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(starts), bitorder="little").view(np.int64)[0])


def with_fingerprints(docs: DataFrame, text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with a column ``fingerprint`` (long), which replaces one of that name.

    A null text counts as empty; a text without words has fingerprint zero.
    """
    kept = docs.drop("fingerprint")
    rows = kept.withColumn("__text", F.col(text_col).cast("binary"))
    schema = kept.withColumn("fingerprint", F.lit(0).cast("bigint")).schema

    def add(batches):
        for batch in batches:
            values = [fingerprint(t.as_py(), shingle) for t in batch.column("__text")]
            names = [n for n in batch.schema.names if n != "__text"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), pa.array(values, pa.int64())], [*names, "fingerprint"]
            )

    return rows.mapInArrow(add, schema)


def _syndrome(values: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words divided by the generator, over the field of two elements."""
    rest = values.copy()
    for shift in range(LENGTH - 12, -1, -1):
        rest = np.where((rest >> (shift + 11)) & 1, rest ^ (GENERATOR << shift), rest)
    return rest


def _error_table(radius: int) -> tuple[np.ndarray, np.ndarray]:
    """For each syndrome the errors of at most ``radius`` bits, the lightest first, and their number."""
    errors = [sum(1 << b for b in bits) for weight in range(radius + 1) for bits in combinations(range(LENGTH), weight)]
    errors = np.array(errors, np.int64)
    syndromes = _syndrome(errors)
    order = np.argsort(syndromes, kind="stable")
    counts = np.bincount(syndromes, minlength=2048)
    table = np.zeros((2048, counts.max()), np.int64)
    place = np.arange(len(order)) - np.repeat(np.cumsum(counts) - counts, counts)
    table[syndromes[order], place] = errors[order]
    return table, counts


def covering(fingerprints: np.ndarray, bits: int = BITS):
    """``(index, anchor, home)`` of every replica; an anchor's number names its block too."""
    table, counts = _error_table(RADIUS + bits // 3)
    values, shift, parts = fingerprints.view(np.uint64), 0, []
    for block, width in enumerate(WIDTHS):
        value = ((values >> np.uint64(shift)) & np.uint64((1 << width) - 1)).astype(np.int64)
        shift += width
        syndrome = _syndrome(value)
        n = counts[syndrome]
        index = np.repeat(np.arange(len(value)), n)
        place = np.arange(len(index)) - np.repeat(np.cumsum(n) - n, n)
        anchor = value[index] ^ table[syndrome[index], place]
        parts.append((index, anchor | (block << LENGTH), place == 0))
    return tuple(np.concatenate(column) for column in zip(*parts))


def _replicas(bits: int):
    def replicate(batches):
        for batch in batches:
            values = batch.column("fingerprint").to_numpy(zero_copy_only=False)
            for at in range(0, len(values), BLOCK):
                part = values[at : at + BLOCK]
                index, anchor, home = covering(part, bits)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part[index]), pa.array(anchor), pa.array(home)], ["fingerprint", "anchor", "home"]
                )

    return replicate


def forest(values: np.ndarray, home: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the same fingerprints as all pairs of a home and another within ``bits``."""
    if len(values) < 2 or not home.any():
        return values[:0], values[:0]
    numbers, tree = values.view(np.uint64), np.arange(len(values))
    for i in np.flatnonzero(home):
        near = np.flatnonzero(np.bitwise_count(numbers ^ numbers[i]) <= bits)
        if len(near) > 1:
            trees = np.unique(tree[near])
            if len(trees) > 1:
                tree[np.isin(tree, trees[1:])] = trees[0]
    moved = np.flatnonzero(tree != np.arange(len(values)))
    return values[moved], values[tree[moved]]


def _compare(bits: int):
    def compare(batches):
        rest = None  # the last cell may go on in the next batch
        for batch in batches:
            columns = [batch.column(n).to_numpy(zero_copy_only=False) for n in ("cell", "fingerprint", "home")]
            if rest is not None:
                columns = [np.concatenate(pair) for pair in zip(rest, columns)]
            ends = np.flatnonzero(np.diff(columns[0])) + 1
            rest = [c[ends[-1] :] for c in columns] if len(ends) else columns
            yield from _links(columns, [0, *ends.tolist()], bits)
        if rest is not None:
            yield from _links(rest, [0, len(rest[0])], bits)

    return compare


def _links(columns, bounds, bits):
    found = [forest(columns[1][a:b], columns[2][a:b], bits) for a, b in zip(bounds[:-1], bounds[1:])]
    found = [f for f in found if len(f[0])]
    if found:
        a, b = (np.concatenate(side) for side in zip(*found))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def links(fingerprints: DataFrame, bits: int = BITS, cell: int = CELL) -> DataFrame:
    """Links ``a, b`` that connect all of ``fingerprints`` (distinct) within ``bits`` of each other.

    They are a forest per anchor cell: two fingerprints are connected by them exactly if they
    are by all the pairs.
    """
    replicas = fingerprints.select("fingerprint").mapInArrow(_replicas(bits), "fingerprint bigint, anchor bigint, home boolean")
    replicas = stored(replicas, "replicas")
    # One row per anchor, 3 * 4,096 at most.
    sizes = replicas.groupBy("anchor").agg(
        F.ceil(F.count("*") / cell).alias("columns"), F.ceil(F.count_if("home") / cell).alias("rows")
    )
    grid = replicas.join(F.broadcast(sizes.filter("columns > 1")), "anchor", "left").fillna(1, ["columns", "rows"])
    place = F.xxhash64("fingerprint")
    own_row, own_column = F.pmod(place, F.greatest("rows", F.lit(1))), F.pmod(place, F.col("columns"))
    as_home = grid.filter("home").select(
        "anchor", "fingerprint", F.lit(True).alias("home"), own_row.alias("row"), F.explode(F.expr("sequence(0L, columns - 1)")).alias("column")
    )
    as_other = grid.filter("rows > 0").select(
        "anchor", "fingerprint", F.lit(False).alias("home"), F.explode(F.expr("sequence(0L, rows - 1)")).alias("row"), own_column.alias("column")
    )
    # A fingerprint at home in its own cell is there twice, which links it to itself alone.
    cells = as_home.unionByName(as_other).withColumn("cell", F.xxhash64("anchor", "row", "column"))
    dealt = cells.select("cell", "fingerprint", "home").repartition("cell").sortWithinPartitions("cell")
    return dealt.mapInArrow(_compare(bits), "a bigint, b bigint")


def clusters(fingerprints: DataFrame, bits: int = BITS) -> DataFrame:
    """``fingerprint, cluster`` for the fingerprints that have a near one; the others are their own."""
    found = components(links(fingerprints.select("fingerprint").distinct(), bits))
    return found.select(F.col("node").alias("fingerprint"), F.col("component").alias("cluster"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """``id, fingerprint, component_id`` for every row: the smallest id of its group.

    Null and empty texts share fingerprint zero and are linked like any other.  A row without
    id gets its group's id, null only if no row of the group has one.  Repeated rows each get
    a row; an empty table gives an empty one.  Other columns are not read.
    """
    rows = with_fingerprints(docs.select(id_col, text_col), text_col, shingle).select(id_col, "fingerprint")
    rows = stored(rows, "fingerprints")
    classes = rows.groupBy("fingerprint").agg(F.min(id_col).alias("first"))
    joined = classes.join(clusters(rows, bits), "fingerprint", "left")
    joined = joined.withColumn("cluster", F.coalesce("cluster", "fingerprint"))
    smallest = joined.groupBy("cluster").agg(F.min("first").alias("component_id"))
    group = joined.join(smallest, "cluster").select("fingerprint", "component_id")
    return rows.join(group, "fingerprint").select(id_col, "fingerprint", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """One row of each group of near duplicates, with its columns: the one of the smallest id.

    A row without id stays only where its whole group has none.  Of rows that share that id
    the smallest fingerprint stays, of copies with the same id any one.
    """
    rows = stored(with_fingerprints(docs, text_col, shingle).withColumnRenamed("fingerprint", "__fingerprint"), "fingerprints")
    prints = rows.select(F.col("__fingerprint").alias("fingerprint"), F.col(id_col).alias("id"))
    order = F.struct(F.col("id").isNull().alias("none"), "id", "fingerprint")
    classes = prints.groupBy("fingerprint").agg(F.min(order).alias("first"))
    joined = classes.join(clusters(prints, bits), "fingerprint", "left")
    kept = joined.groupBy(F.coalesce("cluster", "fingerprint").alias("cluster")).agg(F.min("first").alias("first"))
    kept = kept.select(F.col("first.id").alias("__id"), F.col("first.fingerprint").alias("__kept"))
    chosen = rows.join(kept, rows["__fingerprint"].eqNullSafe(kept["__kept"]) & rows[id_col].eqNullSafe(kept["__id"]), "left_semi")
    return chosen.dropDuplicates([id_col, "__fingerprint"]).select(*docs.columns)
