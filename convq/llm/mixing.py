"""Mixing sources to target weights with a Pfair schedule.

A source of weight ``q / period`` is cut into blocks of ``block`` documents.  Its k-th
block (from 0) is released at slot ``floor(k * period / q)`` and due at slot
``ceil((k + 1) * period / q)``.  Earliest deadline first, among the released blocks,
keeps every source less than one block away from its share at every slot.

All shares are whole numbers of slots, so the schedule repeats after ``period`` slots and
all sources are level there.  One period is worked out once, from the weights alone; a
block finds its slot by its number modulo the quota.  The only shuffle is of documents by
(source, hash bucket), which also splits a hot source.

Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

PERIOD = 1000
BLOCK = 16
SEED = 42
#: Parts of one source that are numbered on their own: hex digits of the order hash.
DIGITS = 3


def _source_key(column: str) -> Column:
    """Never null: a null source is a source of its own, apart from the empty one."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit(""))


def quotas(sizes: DataFrame, weights: dict[str, float] | None = None, period: int = PERIOD) -> DataFrame:
    """Slots of each source in one period: ``source_key, n, quota``, which add up to ``period``.

    ``sizes`` has ``source_key, n``.  Without ``weights`` the target of a source is the square
    root of its number of documents, which lifts small sources.  Every source gets one slot;
    the rest goes by weight, what is left over to the largest remainders, ties by name.
    Weights are taken in whole thousandths, so that every engine gets the same numbers.  A
    source that ``weights`` does not name weighs nothing and keeps its one slot.
    """
    if weights is None:
        weight = F.floor(F.sqrt(F.col("n").cast("double")) * 1000)
    else:
        weight = F.lit(0).cast("bigint")
        for name, value in sorted(weights.items()):
            weight = F.when(F.col("source_key") == f"={name}", F.lit(round(value * 1000))).otherwise(weight)
    everything = Window.partitionBy()
    spare = F.lit(period) - F.col("sources")
    shared = F.col("weight") * F.col("spare")
    counted = (
        sizes.withColumn("weight", weight.cast("bigint"))
        .withColumn("sources", F.count("*").over(everything))
        .withColumn("total", F.greatest(F.sum("weight").over(everything), F.lit(1)))
        .withColumn("spare", spare)
        .withColumn(
            "fits",
            F.when(spare < 0, F.raise_error(F.lit(f"more than {period} sources: choose a longer period"))).otherwise(
                F.lit(True)
            ),
        )
        .filter("fits")
        .withColumn("base", F.expr("(weight * spare) div total"))
        .withColumn("rest", shared - F.col("base") * F.col("total"))
        .withColumn("left", F.col("spare") - F.sum("base").over(everything))
    )
    by_rest = Window.orderBy(F.desc("rest"), "source_key")
    # With no weight at all the left-over slots go round the sources.
    extra = F.expr("left div sources").cast("bigint") + (
        F.row_number().over(by_rest) <= F.col("left") % F.col("sources")
    ).cast("bigint")
    return counted.select("source_key", "n", (1 + F.col("base") + extra).alias("quota"))


def pattern(shares: DataFrame, period: int = PERIOD) -> DataFrame:
    """One period of the schedule: ``source_key, turn, slot``, exactly ``period`` rows.

    ``shares`` has ``source_key, quota``, at most ``period`` rows.  Ties between deadlines go
    to the first source by name.
    """
    open_blocks = f"""
        transform(quotas, (q, i) -> if(
            s.done[i] < q and (s.done[i] * {period}L) div q <= t,
            struct(((s.done[i] + 1) * {period}L + q - 1) div q as due, i as i),
            cast(null as struct<due: bigint, i: int>)))
    """
    fold = f"""
        aggregate(
            sequence(0, {period} - 1),
            struct(transform(quotas, q -> 0L) as done, cast(array() as array<int>) as picks),
            (s, t) -> transform(
                array(array_min(filter({open_blocks}, x -> x is not null)).i),
                pick -> struct(
                    transform(s.done, (d, i) -> if(i = pick, d + 1L, d)) as done,
                    concat(s.picks, array(pick)) as picks))[0]
        ).picks
    """
    ordered = F.array_sort(F.collect_list(F.struct("source_key", "quota")))
    return (
        shares.groupBy()
        .agg(ordered.alias("all"))
        .filter(F.size("all") > 0)
        .select(F.col("all.source_key").alias("names"), F.col("all.quota").alias("quotas"))
        .select("names", F.posexplode(F.expr(fold)).alias("slot", "pick"))
        .select(F.expr("names[pick]").alias("source_key"), F.col("slot").cast("bigint").alias("slot"))
        .withColumn("turn", F.row_number().over(Window.partitionBy("source_key").orderBy("slot")).cast("bigint") - 1)
    )


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    weights: dict[str, float] | None = None,
    period: int = PERIOD,
    block: int = BLOCK,
    seed: int = SEED,
) -> DataFrame:
    """Every row of ``docs`` with its place in the mixed order.

    Adds ``mix_block`` (number of its block within the source), ``mix_slot`` (slot of the
    schedule), ``mix_place`` (place within the block) and ``mix_level``: true for the slots
    before the first in which some source has no full block left.  Up to there the order by
    (mix_slot, mix_place) holds the target weights; later slots keep their order, those of
    sources that have run out stay empty, and no document is left out.

    Within a source the order is that of md5(id:seed), then of the id.  Rows that share an id
    take neighbouring places; null ids come first as one such group.  An empty table gives an
    empty one.  Columns of ``docs`` with the names of the four new ones are replaced.
    """
    added = ["mix_block", "mix_slot", "mix_place", "mix_level"]
    kept = [c for c in docs.columns if c not in added]
    label = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.struct(*kept).alias("doc"),
        F.col(id_col).alias("id"),
        _source_key(source_col).alias("source_key"),
        F.md5(F.concat(label, F.lit(f":{seed}"))).alias("place_hash"),
    ).withColumn("bucket", F.substring("place_hash", 1, DIGITS))
    counts = rows.groupBy("source_key", "bucket").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("source_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(
        "source_key", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")
    )
    shares = quotas(counts.groupBy("source_key").agg(F.sum("n").alias("n")), weights, period)
    slots = pattern(shares, period)
    first_gap = (
        shares.withColumn("full", F.expr(f"n div {block}"))
        .withColumn("turn", F.col("full") % F.col("quota"))
        .join(slots, ["source_key", "turn"])
        .select(
            "source_key", "quota", F.min(F.expr(f"(full div quota) * {period} + slot")).over(Window.partitionBy()).alias("gap")
        )
    )
    within = Window.partitionBy("source_key", "bucket").orderBy("place_hash", "id")
    numbered = (
        rows.withColumn("row", F.row_number().over(within))
        .join(before, ["source_key", "bucket"])
        .withColumn("row", F.col("before") + F.col("row") - 1)
        .withColumn("mix_block", F.expr(f"row div {block}"))
        .withColumn("mix_place", (F.col("row") % block).cast("int"))
    )
    # Both have at most `period` rows; more sources than that raise an error in quotas().
    placed = (
        numbered.join(F.broadcast(first_gap), "source_key")
        .withColumn("turn", F.col("mix_block") % F.col("quota"))
        .join(F.broadcast(slots), ["source_key", "turn"])
        .withColumn("mix_slot", F.expr(f"(mix_block div quota) * {period} + slot"))
        .withColumn("mix_level", F.col("mix_slot") < F.col("gap"))
    )
    return placed.select("doc.*", *added)
