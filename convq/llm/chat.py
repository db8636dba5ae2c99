"""Chat formatting with minimum-cost role repair.

A legal conversation is a system turn or none, then user and assistant in turn, ending with
the assistant.  A turn that does not fit is merged into the one before it, relabelled, or
preceded by empty turns, each at a cost; dynamic programming over the states of the automaton
finds the cheapest repair of the whole conversation.

The effect of a run of turns is a matrix: the least cost from each state to each state.  So
runs of ``CHUNK`` turns are solved where they lie, their matrices are multiplied up a tree of
``CHUNK`` children per node, and the states between runs are handed down again.  No task holds
more than one node, however long a conversation is, and the rendered text comes in parts, one
per run, that follow each other.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from convq.llm.tables import stored, text_of

# ---- fixed values: roles, their other names, the states and legal steps, costs, the format ----
ROLES = ("system", "user", "assistant")
OTHER_NAMES = {
    "human": "user", "customer": "user", "prompter": "user",
    "ai": "assistant", "bot": "assistant", "gpt": "assistant", "model": "assistant", "chatgpt": "assistant",
    "instruction": "system", "context": "system", "developer": "system",
}
START, SYSTEM, USER, ASSISTANT = range(4)
STEPS = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
ENDS = (START, ASSISTANT)
UNKNOWN = 4
KEEP, MERGE, RELABEL, MERGE_OTHER = "keep", "merge", "relabel", "merge_relabelled"
#: Merging two turns of one role, giving a turn another role, giving an unknown role one,
#: merging turns of different roles, and inserting an empty turn.
COST_MERGE, COST_RELABEL, COST_NAME, COST_MERGE_OTHER, COST_INSERT = 1, 3, 2, 4, 2
OPEN, CLOSE = "<|im_start|>{role}\n", "<|im_end|>\n"
# ---- end of fixed values ----
CHUNK = 64
NEVER = 1 << 40


@functools.cache
def ways_in() -> dict[int, tuple[int, tuple[int, ...]]]:
    """The cheapest empty turns that lead from a state to each state: ``(from, to) -> turns``."""
    best = {(q, q): () for q in range(4)}
    for _ in range(4):
        for (start, end), path in list(best.items()):
            for after in STEPS[end]:
                longer = (*path, after)
                if (start, after) not in best or len(best[start, after]) > len(longer):
                    best[start, after] = longer
    return best


@functools.cache
def moves(symbol: int) -> dict[tuple[int, int], tuple[int, str, tuple[int, ...]]]:
    """``(state before, after) -> cost, action, inserted turns`` for a turn of role ``symbol``.

    Of equal costs the first action as listed at the top wins, then fewer insertions.
    """
    options: dict[tuple[int, int], list] = {}
    for before in range(4):
        for role in (SYSTEM, USER, ASSISTANT):
            kept = role == symbol
            action, cost = (KEEP, 0) if kept else (RELABEL, COST_NAME if symbol == UNKNOWN else COST_RELABEL)
            for (start, end), inserted in ways_in().items():
                if start == before and role in STEPS[end]:
                    total = cost + COST_INSERT * len(inserted)
                    options.setdefault((before, role), []).append((total, 2 * (not kept), len(inserted), action, inserted))
        if before != START:
            same = before == symbol
            action, cost = (MERGE, COST_MERGE) if same else (MERGE_OTHER, COST_MERGE_OTHER)
            options.setdefault((before, before), []).append((cost, 1 if same else 3, 0, action, ()))
    return {pair: (best[0], best[3], best[4]) for pair, found in options.items() for best in [min(found)]}


@functools.cache
def matrix(symbol: int) -> np.ndarray:
    costs = np.full((4, 4), NEVER, np.int64)
    for (before, after), (cost, *_) in moves(symbol).items():
        costs[before, after] = cost
    return costs


def product(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return np.minimum((left[:, :, None] + right[None, :, :]).min(axis=1), NEVER)


@functools.cache
def finish() -> tuple[tuple[int, tuple[int, ...]], ...]:
    """Per state the cost and the empty turns that end a conversation legally."""
    found = []
    for state in range(4):
        path = min((ways_in()[state, end] for end in ENDS if (state, end) in ways_in()), key=len)
        found.append((COST_INSERT * len(path), path))
    return tuple(found)


def path_through(matrices: list[np.ndarray], start: int, end: int) -> list[int]:
    """The states after each matrix on the cheapest way from ``start`` to ``end``, ties to the lowest."""
    left = [np.where(np.arange(4) == end, 0, NEVER)]  # cost still to come, from each state
    for m in reversed(matrices):
        left.append(np.minimum((m + left[-1][None, :]).min(axis=1), NEVER))
    left.reverse()
    states, at = [], start
    for m, rest in zip(matrices, left[1:]):
        at = int(np.argmin(m[at] + rest))
        states.append(at)
    return states


def role_number(column: str) -> Column:
    """1 to 3 for a known role, whatever its case or blanks around it, else ``UNKNOWN``."""
    name = F.lower(F.trim(F.col(column).cast("string")))
    number = F.lit(UNKNOWN)
    for other, role in [*OTHER_NAMES.items(), *((r, r) for r in ROLES)]:
        number = F.when(name == other, ROLES.index(role) + 1).otherwise(number)
    return number


def _nodes(children: DataFrame) -> DataFrame:
    """Parents of at most ``CHUNK`` nodes: the product of their matrices, and the matrices."""
    parts = F.array_sort(F.collect_list(F.struct("node", "costs")))
    parents = children.groupBy("conv", F.floor(F.col("node") / CHUNK).alias("parent")).agg(parts.alias("parts"))

    def multiply(batches):
        for batch in batches:
            costs = []
            for parts in batch.column("parts").to_pylist():
                matrices = [np.array(p["costs"], np.int64).reshape(4, 4) for p in parts]
                costs.append(functools.reduce(product, matrices).reshape(-1).tolist())
            names = [*batch.schema.names, "costs"]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(costs, pa.list_(pa.int64()))], names)

    schema = parents.withColumn("costs", F.lit(None).cast("array<bigint>")).schema
    return parents.mapInArrow(multiply, schema).withColumnRenamed("parent", "node")


def _hand_down(parents: DataFrame) -> DataFrame:
    """``conv, node, start, end`` of the children of ``parents``, which has ``parts, start, end``."""

    def walk(batches):
        for batch in batches:
            out = []
            columns = [batch.column(n).to_pylist() for n in ("parts", "start", "end")]
            for conv, parts, start, end in zip(batch.column("conv").to_pylist(), *columns):
                states = path_through([np.array(p["costs"], np.int64).reshape(4, 4) for p in parts], start, end)
                for part, before, after in zip(parts, [start, *states[:-1]], states):
                    out.append((conv, part["node"], before, after))
            conv, node, before, after = zip(*out) if out else ((), (), (), ())
            kinds = (batch.schema.field("conv").type, pa.int64(), pa.int32(), pa.int32())
            arrays = [pa.array(values, kind) for values, kind in zip((conv, node, before, after), kinds)]
            yield pa.RecordBatch.from_arrays(arrays, ["conv", "node", "start", "end"])

    schema = parents.select("conv", F.lit(0).cast("bigint").alias("node"), "start", "end").schema
    return parents.select("conv", "parts", "start", "end").mapInArrow(walk, schema)


def repair(turns: list[tuple[int, str]], start: int, end: int, last: bool) -> dict:
    """The repaired and rendered run of ``(symbol, text)`` turns from state ``start`` to ``end``."""
    counts, cost, out = {KEEP: 0, MERGE: 0, RELABEL: 0, MERGE_OTHER: 0}, 0, []
    inserted_turns, state = 0, start

    def opened(role: int) -> None:
        if state != START:
            out.append(CLOSE)
        out.append(OPEN.format(role=ROLES[role - 1]))

    for (symbol, text), after in zip(turns, path_through([matrix(s) for s, _ in turns], start, end)):
        price, action, inserted = moves(symbol)[state, after]
        cost, inserted_turns = cost + price, inserted_turns + len(inserted)
        counts[action] += 1
        for role in inserted:
            opened(role)
            state = role
        if action in (MERGE, MERGE_OTHER):
            out.append("\n\n")
        else:
            opened(after)
        out.append(text)
        state = after
    if last:
        price, inserted = finish()[state]
        cost, inserted_turns = cost + price, inserted_turns + len(inserted)
        for role in inserted:
            opened(role)
            state = role
        if state != START:
            out.append(CLOSE)
    return {
        "n_turns": len(turns),
        "n_merged": counts[MERGE] + counts[MERGE_OTHER],
        "n_relabelled": counts[RELABEL] + counts[MERGE_OTHER],
        "n_inserted": inserted_turns,
        "cost": cost,
        "rendered": "".join(out),
    }


REPAIRED = "n_turns bigint, n_merged bigint, n_relabelled bigint, n_inserted bigint, cost bigint, rendered string"


def format_chats(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """The repaired conversations, one row per run of turns: ``conv, part``, the counts, ``rendered``.

    Joined in the order of ``part``, the texts of a conversation are its rendering; a
    conversation of less than ``CHUNK`` turns is one row.  Parts are numbered from 0 as they
    come.  Turns are ordered by number, null first, then by role and text; turns that repeat
    all of these are all kept.  A null text is empty, a null or unknown role gets one.  A null
    conversation id is a conversation of its own; an empty table gives an empty one.  Other
    columns are not read.  Turn numbers may have gaps; a run holds the turns of ``CHUNK``
    numbers, so memory grows with turns that share one number alone.
    """
    number = F.coalesce(F.col(turn_col).cast("bigint"), F.lit(-1))
    rows = turns.select(
        F.col(conv_col).alias("id"),
        F.struct(F.col(conv_col).isNull().alias("none"), F.col(conv_col).alias("id")).alias("conv"),
        F.floor(number / CHUNK).alias("node"),
        F.struct(number.alias("turn"), role_number(role_col).alias("symbol"), text_of(text_col).alias("text")).alias("row"),
    )
    runs = rows.groupBy("conv", "node").agg(F.array_sort(F.collect_list("row")).alias("rows"))

    def measure(batches):
        for batch in batches:
            runs = batch.column("symbols").to_pylist()
            costs = [functools.reduce(product, [matrix(s) for s in run]).reshape(-1).tolist() for run in runs]
            arrays = [batch.column("conv"), batch.column("node"), pa.array(costs, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, ["conv", "node", "costs"])

    # Runs are written once; measuring reads only roles, rendering the rest.
    columns = F.col("rows.symbol").alias("symbols"), F.col("rows.text").alias("texts")
    runs = stored(runs.select("conv", "node", *columns), "runs")
    schema = runs.select("conv", "node", F.lit(None).cast("array<bigint>").alias("costs")).schema
    level = stored(runs.select("conv", "node", "symbols").mapInArrow(measure, schema), "costs")
    levels = []
    while True:
        level = stored(_nodes(level), "nodes")
        levels.append(level)
        wide = level.agg(F.min("node"), F.max("node")).first()
        if wide[0] is None or (wide[0] >= -1 and wide[1] <= 0):
            break
    parts = F.array_sort(F.collect_list(F.struct("node", "costs")))
    top = levels[-1].groupBy("conv").agg(parts.alias("parts"))  # nodes -1 and 0
    states = _hand_down(_choose_ends(top))
    for level in reversed(levels):
        states = _hand_down(level.join(states, ["conv", "node"]))
    last = runs.groupBy("conv").agg(F.max("node").alias("last"))
    ready = runs.join(states, ["conv", "node"]).join(last, "conv")

    def render(batches):
        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in ("symbols", "texts", "start", "end", "is_last")]
            out = [repair(list(zip(s, t)), start, end, is_last) for s, t, start, end, is_last in zip(*columns)]
            arrays = [pa.array([r[n] for r in out], pa.string() if n == "rendered" else pa.int64()) for n in names]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("node"), *arrays], ["conv", "part", *names])

    names = [c.split()[0] for c in REPAIRED.split(", ")]
    is_last = (F.col("node") == F.col("last")).alias("is_last")
    ready = ready.select(F.col("conv.id").alias("id"), "node", "symbols", "texts", "start", "end", is_last)
    kind = dict(turns.dtypes)[conv_col]
    return ready.mapInArrow(render, f"conv {kind}, part bigint, {REPAIRED}")


def _choose_ends(top: DataFrame) -> DataFrame:
    """``conv, parts, start, end``: every conversation begins at START and ends where it is cheapest."""

    def choose(batches):
        for batch in batches:
            ends = []
            for parts in batch.column("parts").to_pylist():
                costs = functools.reduce(product, [np.array(p["costs"], np.int64).reshape(4, 4) for p in parts])[START]
                ends.append(int(np.argmin([c + price for c, (price, _) in zip(costs, finish())])))
            added = [pa.array([START] * len(ends), pa.int32()), pa.array(ends, pa.int32())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, "start", "end"])

    schema = top.withColumn("start", F.lit(0)).withColumn("end", F.lit(0)).schema
    return top.mapInArrow(choose, schema)
