"""Merkle manifest of a dataset: one tree per source, one tree over the sources.

A level of a tree is the concatenation of its digests as hex text, so 16 nodes that follow each
other are one substring of 1,024 characters, and its hash is their parent.  An aligned block of
``BLOCK`` nodes keeps each of its levels as one such string, in one row: fixed-width substrings
give its parents, and those to the left and right of a node are its siblings.  The last nodes of
the blocks are the nodes of the next round, whose blocks are made the same way, until one node
is left per tree; a tree of any size takes ``log(size) / log(BLOCK)`` rounds, and no task holds more
than a block, however many rows a source has.

Positions are exact: rows are sorted by ranges over the cluster and numbered within a range, and
a small table counts the rows of each tree in the ranges before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from convq.llm.tables import stored

FANOUT = 16
STEPS = 2  # levels inside a block
BLOCK = FANOUT**STEPS
HEX = 64  # characters of a digest
RUN = FANOUT * HEX

PATH = "array<struct<left: binary, right: binary>>"


def _field(column: Column) -> Column:
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(text: Column) -> Column:
    """Digest of a row; every field says how long it is, so no two rows read alike."""
    fields = [_field(F.col(name)) for name in ("doc_id", "source", "lang", "n_chars")]
    return F.sha2(F.concat(*fields, _field(text)), 256)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def numbered(rows: DataFrame, order: list[str], name: str) -> tuple[DataFrame, int]:
    """``rows`` with ``idx``, the place in its ``tree`` from 0, and ``n``, the rows of that tree; and
    the size of the largest tree.

    ``rows`` must be a written table: its ranges are found by a scan of their own.  Ties in
    ``order`` keep the order of that scan; a number of the row settles them, so a key that a
    third of the rows share is dealt over many ranges too.
    """
    keys = ["tree", *order, "row"]
    ranged = rows.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(*keys)
    in_order = ranged.sortWithinPartitions(*keys).withColumn("seq", F.monotonically_increasing_id())
    in_order = in_order.withColumns({"part": F.shiftright("seq", 33), "seq": F.col("seq").bitwiseAND((1 << 33) - 1)})
    placed = stored(in_order.drop("row"), name)
    counts = placed.groupBy("tree", "part").agg(F.min("seq").alias("first"), F.count("*").alias("here"))
    # one row per range of a tree: at most as many as there are ranges
    before = F.sum("here").over(W.partitionBy("tree").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    starts = counts.select(
        "tree",
        "part",
        (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"),
        F.sum("here").over(W.partitionBy("tree")).alias("n"),
    )
    most = placed.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    idx = F.col("seq") + F.col("shift")
    return placed.join(starts, ["tree", "part"]).withColumn("idx", idx).drop("seq", "part", "shift"), most


def _parents(level: str) -> str:
    """Digests of the runs of a level, as the level above; one node stays below no other."""
    runs = f"transform(sequence(0, cast((length({level}) - 1) div {RUN} as int)), i -> sha2(substring({level}, i * {RUN} + 1, {RUN}), 256))"
    return f"cast(array_join({runs}, '') as binary)"


def blocks(nodes: DataFrame, name: str, carried: tuple[str, ...] = ()) -> DataFrame:
    """``tree, block, n_blocks, levels, items``: a written row per aligned block of nodes.

    ``nodes`` has ``tree, idx, n, digest`` and the ``carried`` columns, which are kept per node in
    ``items``.  A block goes up two levels, or until one node is left where it is alone in its tree.
    """
    item = F.struct("idx", "digest", *carried)
    grouped = nodes.groupBy("tree", F.floor(F.col("idx") / BLOCK).alias("block")).agg(
        F.array_sort(F.collect_list(item)).alias("items"), F.first("n").alias("n")
    )
    level = grouped.select(
        "tree",
        "block",
        F.ceil(F.col("n") / BLOCK).alias("n_blocks"),
        F.expr("cast(array_join(transform(items, x -> x.digest), '') as binary)").alias("level"),
        F.expr(f"transform(items, x -> struct({', '.join(f'x.{c}' for c in ('idx', *carried))}))").alias("items"),
    )
    more = f"n_blocks > 1 or length(element_at(a, -1)) > {HEX}"
    top = "element_at(a, -1)"
    up = f"aggregate(sequence(1, {STEPS}), array(level), (a, k) -> if({more}, concat(a, array({_parents(top)})), a))"
    return stored(level.withColumn("levels", F.expr(up)).drop("level"), name)


def flanks(idx: str) -> str:
    """SQL for the path of node ``idx`` inside its block: what lies left and right of it, per level."""
    place = f"cast(shiftright({idx} % {BLOCK}, 4 * k) as int)"
    row = "element_at(levels, k + 1)"
    left = f"substring({row}, ({place} - {place} % {FANOUT}) * {HEX} + 1, {place} % {FANOUT} * {HEX})"
    right = f"substring({row}, {place} * {HEX} + {HEX + 1}, ({FANOUT - 1} - {place} % {FANOUT}) * {HEX})"
    steps = f"slice(array({', '.join(map(str, range(STEPS)))}), 1, size(levels) - 1)"
    return f"transform({steps}, k -> struct({left} as left, {right} as right))"


def _top() -> Column:
    return F.element_at("levels", -1).cast("string")


def rounds(nodes: DataFrame, name: str, most: int, carried: tuple[str, ...] = ()) -> list[DataFrame]:
    """The blocks of all rounds, from the leaves up; ``most`` is the size of the largest tree."""
    found = [blocks(nodes, f"{name}-0", carried)]
    while (most := -(-most // BLOCK)) > 1:
        open_ = found[-1].filter("n_blocks > 1")
        up = open_.select("tree", F.col("block").alias("idx"), F.col("n_blocks").alias("n"), _top().alias("digest"))
        found.append(blocks(up, f"{name}-{len(found)}"))
    return found


def roots(found: list[DataFrame]) -> DataFrame:
    """``tree, root`` of every tree."""
    tops = [b.filter("n_blocks = 1").select("tree", _top().alias("root")) for b in found]
    out = tops[0]
    for top in tops[1:]:
        out = out.unionByName(top)
    return out


def with_upper(found: list[DataFrame], above: DataFrame) -> DataFrame:
    """The blocks of the first round with ``upper``, the path of their top to the root of all, and the
    columns of ``above`` (``tree, upper`` and others), the same for what lies above each tree.

    From the top down: the path of a block's node is its flanks and then the path of the block.
    """
    extra = [c for c in above.columns if c not in ("tree", "upper")]
    done, paths = None, None
    for b in reversed(found):
        done = b.filter("n_blocks = 1").join(above, "tree")
        if paths is not None:
            done = done.unionByName(b.filter("n_blocks > 1").join(paths, ["tree", "block"]))
        steps = f"transform(items, x -> struct(x.idx as block, concat({flanks('x.idx')}, upper) as upper))"
        paths = done.select("tree", *extra, F.inline(F.expr(steps)))
    return done


def _fold(start: str, path: str) -> str:
    """SQL that hashes from ``start`` up a path."""
    return f"aggregate({path}, {start}, (a, s) -> sha2(concat(s.left, cast(a as binary), s.right), 256))"


def _siblings(path: str) -> str:
    return f"aggregate({path}, cast('' as binary), (a, s) -> concat(a, s.left, s.right))"


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """One row per row of ``docs``: its leaf, the roots, and a proof that was checked.

    ``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``.  The proof is the siblings
    of the leaf, then of its ancestors up to the root of its source, then of that among the
    sources; ``proof_sha256`` hashes them.  ``folded_root`` is worked out again from the leaf
    and the proof; rows where ``tampered`` (a condition) holds take the leaf of their lower-cased text
    instead, so ``verified`` is false there unless that is the same text.

    Leaves of a source are in the order of doc_id, null first, then of their digest; sources by
    their UTF-8 bytes, null first.  Null fields count as ``-``, an empty text as ``0:``.  Rows that
    are equal in all five fields are leaves of their own, next to each other.  Texts are hashed
    whole.  An empty table has no rows.  Other columns are neither hashed nor returned; a missing
    one of the five is an error.

    Building it runs jobs: leaves, their order and the blocks are tables below the shared folder.
    """
    text = F.col("text")
    is_tampered = F.lit(False) if tampered is None else F.coalesce(tampered, F.lit(False))
    leaves = docs.select(
        F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("tree"),
        "doc_id",
        leaf(text).alias("digest"),
        F.when(is_tampered, leaf(lower_ascii(text))).alias("other"),
    )
    leaves, most = numbered(stored(leaves, "leaves"), ["doc_id", "digest"], "leaf-order")
    trees = rounds(leaves, "leaf-blocks", most, ("doc_id", "other"))

    # the sources are the leaves of one more tree, whose nodes are the roots below
    sources = stored(roots(trees).select(F.lit("").alias("tree"), F.col("tree").alias("source_key"), F.col("root").alias("digest")), "roots")
    sources, most = numbered(sources, ["source_key"], "source-order")
    crown = rounds(sources, "source-blocks", most, ("source_key",))
    nothing = roots(crown).select("tree", "root", F.expr(f"cast(array() as {PATH})").alias("upper"))
    top = with_upper(crown, nothing)
    steps = f"transform(items, x -> struct(x.source_key as tree, concat({flanks('x.idx')}, upper) as upper))"
    above = top.select("root", F.inline(F.expr(steps))).join(
        sources.select(F.col("source_key").alias("tree"), F.col("digest").alias("subroot")), "tree"
    )
    rows = with_upper(trees, stored(above, "source-paths"))
    own = _own_digest("x.idx")
    each = f"""transform(items, x -> struct(x.doc_id as doc_id, {own} as leaf, subroot, root,
        sha2(concat({_siblings(flanks('x.idx'))}, above_siblings), 256) as proof_sha256,
        {_fold(_fold(f"coalesce(x.other, {own})", flanks('x.idx')), 'upper')} as folded_root))"""
    rows = rows.withColumn("above_siblings", F.expr(_siblings("upper")))
    return rows.select(F.inline(F.expr(each))).withColumn("verified", F.col("folded_root") == F.col("root"))


def _own_digest(idx: str) -> str:
    return f"cast(substring(element_at(levels, 1), cast({idx} % {BLOCK} as int) * {HEX} + 1, {HEX}) as string)"
