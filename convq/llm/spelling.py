"""Spelling variants: words one edit apart, found by k-d trees over their letter counts.

A word becomes a vector that counts its letters.  An inserted letter raises one count by one; a
replaced one raises one count and lowers another, so the L1 distance is at most two.  Per word
length a k-d tree splits the space into cells; a word looks for near words of its length, and of
the next, only in the cells whose boxes such a step can reach.  The cells are the groups of one
shuffle: every word is sent to the cell it lies in and to the others it looks into.  Inside a
cell a second tree over the words themselves prunes again, and what is left is compared letter by letter.
So no task sees more than a cell with the words that look into it, and each pair of lengths is searched
once, from the shorter word or the lower cell.

The first trees are cut along a sample of the words; the sample only decides how even the cells are.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from convq.llm.tables import stored

RUN = r"[A-Za-zÀ-ÿ]+"
MIN_CHARS = 6
MIN_COUNT = 5
RATIO = 5  # a form occurs so many times as often as its variant
LETTERS, OTHERS = 26, 6  # dimensions: a-z, and all other letters dealt over six
DIMS = LETTERS + OTHERS
SAMPLE_WORDS = 100_000  # that the cells are cut along
CELL = 2_000  # words a cell is meant to hold
LEAST_SAMPLE = 16  # of a cell that is cut
LEAF = 32  # words in a leaf of the tree inside a cell
HELD = 200_000  # words a task counts before it passes them on


# ---- counting


def count_words(docs: DataFrame, damage: int = 0, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT) -> DataFrame:
    """``word, n``: runs of letters, A-Z lower-cased, of at least ``min_chars`` that occur ``min_count`` times.

    With ``damage`` d, a run loses one letter where d divides the crc32 of ``<doc_id>:<run>``, in every
    place of that document; a null id counts as an empty one.  Texts are read whole, a null one has no words.
    """
    pattern = re.compile(RUN)
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def packed(counts: Counter) -> Iterator[pa.RecordBatch]:
        rows = [(w, n) for w, n in ((b.decode(), n) for b, n in counts.items()) if len(w) >= min_chars]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in rows]), pa.array([n for _, n in rows], pa.int64())], schema=schema)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                start = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                for run, n in Counter(pattern.findall(text.as_py() or "")).items():
                    word = run.encode().lower()  # of bytes: only A-Z
                    if damage:
                        h = zlib.crc32(word, start)
                        if h % damage == 0:
                            at = h % len(run)
                            word = (run[:at] + run[at + 1 :]).encode().lower()
                    if len(word) >= min_chars:
                        held[word] += n
                if len(held) >= HELD:
                    yield from packed(held)
                    held.clear()
        yield from packed(held)

    texts = docs.select(F.col("doc_id").cast("string"), F.col("text").cast("string"))
    counts = texts.mapInArrow(scan, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.filter(F.col("n") >= min_count)


# ---- vectors and trees


def codes(words: list[str], length: int) -> np.ndarray:
    """Code points of words of one length, a row per word."""
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), length)


def vectors(points: np.ndarray) -> np.ndarray:
    """Letter counts of rows of code points."""
    plain = (points >= 97) & (points <= 122)
    dim = np.where(plain, points - 97, LETTERS + points % OTHERS).astype(np.int64)
    flat = np.arange(len(points))[:, None] * DIMS + dim
    return np.bincount(flat.ravel(), minlength=len(points) * DIMS).reshape(len(points), DIMS).astype(np.int32)


@dataclass
class Node:
    """A cut ``vector[dim] <= at`` with two children, or a cell."""

    cell: int = -1
    dim: int = 0
    at: int = 0
    sides: list[Node] = field(default_factory=list)


def best_cut(x: np.ndarray) -> tuple[int, int] | None:
    """The dimension and count that halve the rows best, none where all rows are equal."""
    best, found = 0, None
    for dim in range(DIMS):
        value, n = np.unique(x[:, dim], return_counts=True)
        below = np.cumsum(n)[:-1]
        if len(below):
            k = int(np.argmax(np.minimum(below, len(x) - below)))
            even = min(below[k], len(x) - below[k])
            if even > best:
                best, found = even, (dim, int(value[k]))
    return found


def cells(x: np.ndarray, weight: float, first: int = 0) -> tuple[Node, int]:
    """A tree over sampled vectors that stand for ``weight`` words each, and the next free cell number."""
    cut = best_cut(x) if len(x) >= LEAST_SAMPLE and len(x) * weight > CELL else None
    if cut is None:
        return Node(cell=first), first + 1
    dim, at = cut
    low = x[:, dim] <= at
    left, first = cells(x[low], weight, first)
    right, first = cells(x[~low], weight, first)
    return Node(-1, dim, at, [left, right]), first


def reached(node: Node, x: np.ndarray, up: int, down: int) -> Iterator[tuple[int, np.ndarray]]:
    """``cell, rows of x`` whose counts, ``up`` raised by one and ``down`` lowered, can lie in the cell.

    ``lack`` and ``excess`` are how far a row lies below and above the box of the node, summed over the
    dimensions; a box out of reach is pruned with all below it.
    """

    def walk(node, rows, lack, excess, low, high):
        if node.cell >= 0:
            yield node.cell, rows
            return
        value, (lo, hi) = x[rows, node.dim], (low.get(node.dim, -1), high.get(node.dim, math.inf))
        # below: the counts must be at most ``at``
        more = excess + np.maximum(value - node.at, 0) - np.maximum(value - hi, 0) if hi < math.inf else excess + np.maximum(value - node.at, 0)
        keep = more <= down
        if keep.any():
            yield from walk(node.sides[0], rows[keep], lack[keep], more[keep], low, high | {node.dim: node.at})
        # above: at least ``at + 1``
        more = lack + np.maximum(node.at + 1 - value, 0) - np.maximum(lo - value, 0)
        keep = more <= up
        if keep.any():
            yield from walk(node.sides[1], rows[keep], more[keep], excess[keep], low | {node.dim: node.at + 1}, high)

    zero = np.zeros(len(x), np.int64)
    if len(x):
        yield from walk(node, np.arange(len(x)), zero, zero, {}, {})


# ---- search inside a cell


def near_pairs(members: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows ``(query, member)`` one edit apart; queries are as long as members, or one letter shorter.

    Both are rows of code points, all words of a side of one length.
    """
    shorter = queries.shape[1] < members.shape[1]
    m, q = vectors(members), vectors(queries)
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]

    def compare(a: np.ndarray, b: np.ndarray) -> None:
        """All queries ``a`` against all members ``b`` of a leaf: counts, then letters."""
        apart = m[b][None, :, :] - q[a][:, None, :]
        lack, excess = np.maximum(apart, 0).sum(2), np.maximum(-apart, 0).sum(2)
        if shorter:
            close = (lack == 1) & (excess == 0)
        else:
            # letters that share a dimension can replace each other and leave the counts alike
            alike = (lack == 0) & (excess == 0) & (m[b][:, LETTERS:].sum(1) > 0)[None, :]
            close = (lack == 1) & (excess == 1) | alike
        i, j = np.nonzero(close)
        i, j = a[i], b[j]
        if shorter:
            left, right = queries[i], members[j]
            width = left.shape[1]
            ahead = np.cumprod(left == right[:, :-1], axis=1).sum(1)
            behind = np.cumprod((left == right[:, 1:])[:, ::-1], axis=1).sum(1)
            good = ahead + behind >= width
        else:
            good = (queries[i] != members[j]).sum(1) == 1
        found.append((i[good], j[good]))

    def descend(rows: np.ndarray, asking: np.ndarray) -> None:
        if not len(asking):
            return
        cut = best_cut(m[rows]) if len(rows) > LEAF else None
        if cut is None:
            for start in range(0, len(rows), 4 * LEAF):  # rows that no count tells apart may be many
                for at in range(0, len(asking), 1024):
                    compare(asking[at : at + 1024], rows[start : start + 4 * LEAF])
            return
        for side in (m[rows, cut[0]] <= cut[1], m[rows, cut[0]] > cut[1]):
            part = rows[side]
            low, high = m[part].min(0), m[part].max(0)  # the box of the words themselves
            lack = np.maximum(low - q[asking], 0).sum(1)
            excess = np.maximum(q[asking] - high, 0).sum(1)
            descend(part, asking[(lack <= 1) & (excess <= (0 if shorter else 1))])

    descend(np.arange(len(members)), np.arange(len(queries)))
    return np.concatenate([i for i, _ in found]), np.concatenate([j for _, j in found])


NEAR = "word string, near string, near_n bigint"


def _search(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """All near pairs of a cell's words and those that look into it, in both directions."""
    length, out = int(key[0]), []
    members = rows[rows["home"]]
    if len(members):
        points = codes(members["word"].tolist(), length)
        for size in (length, length - 1):
            asking = members if size == length else None
            others = rows[~rows["home"] & (rows["word"].str.len() == size)]
            for group, own in ((asking, True), (others, False)):
                if group is None or not len(group):
                    continue
                i, j = near_pairs(points, points if own else codes(group["word"].tolist(), size))
                if own:  # found from both sides
                    i, j = i[i < j], j[i < j]
                a, b = group.iloc[i], members.iloc[j]
                for x, y in ((a, b), (b, a)):
                    out.append(pd.DataFrame({"word": x["word"].to_numpy(), "near": y["word"].to_numpy(), "near_n": y["n"].to_numpy()}))
    return pd.concat(out) if out else pd.DataFrame({"word": [], "near": [], "near_n": []})


def plan(words: DataFrame, sample_words: int = SAMPLE_WORDS) -> dict[int, Node]:
    """Per length the cells of its words, cut along at most ``sample_words`` of them."""
    sizes = {r["length"]: r["count"] for r in words.groupBy(F.length("word").alias("length")).count().collect()}
    sample = words.orderBy(F.xxhash64("word"), "word").limit(sample_words)

    def counted(batches):
        for batch in batches:
            for length, part in batch.groupby(batch["word"].str.len()):
                x = vectors(codes(part["word"].tolist(), length))
                yield pd.DataFrame({"length": length, "x": list(x)})

    rows = sample.select("word").mapInPandas(counted, "length int, x array<int>").collect()
    by_length: dict[int, list] = {}
    for r in rows:
        by_length.setdefault(r["length"], []).append(r["x"])
    trees = {}
    for length, size in sizes.items():
        x = np.array(sorted(by_length.get(length, [])), np.int32).reshape(-1, DIMS)
        trees[length] = cells(x, size / len(x))[0] if len(x) else Node(cell=0)
    return trees


def routed(words: DataFrame, trees: dict[int, Node]) -> DataFrame:
    """``length, cell, home, word, n``: each word in its own cell and in all it looks into."""

    def send(batches):
        for batch in batches:
            for length, part in batch.groupby(batch["word"].str.len()):
                x = vectors(codes(part["word"].tolist(), length))
                own = np.zeros(len(x), np.int64)
                sent = []
                for cell, rows in reached(trees[length], x, 0, 0):  # its box holds the vector itself
                    own[rows] = cell
                    sent.append((length, cell, True, rows))
                for cell, rows in reached(trees[length], x, 1, 1):
                    sent.append((length, cell, False, rows[own[rows] < cell]))
                if length + 1 in trees:
                    sent += [(length + 1, cell, False, rows) for cell, rows in reached(trees[length + 1], x, 1, 0)]
                for size, cell, home, rows in sent:
                    if len(rows):
                        found = part.iloc[rows]
                        yield pd.DataFrame({"length": size, "cell": cell, "home": home, "word": found["word"], "n": found["n"]})

    return words.mapInPandas(send, "length int, cell int, home boolean, word string, n bigint")


def near_words(words: DataFrame, sample_words: int = SAMPLE_WORDS) -> DataFrame:
    """``word, near, near_n`` for each ordered pair of words one edit apart."""
    sent = routed(words, plan(words, sample_words))
    return sent.groupBy("length", "cell").applyInPandas(_search, NEAR)


# ---- forms


def variants(counts: DataFrame, ratio: int = RATIO, sample_words: int = SAMPLE_WORDS) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for each word of ``counts`` (``word, n``, words unique).

    Near words differ by exactly one inserted, deleted or replaced letter.  A word's form is the
    near word of largest ``n`` (of equal ones the first by code points) if that is at least ``ratio``
    times its own; ``root`` follows the forms to the last.  A word without one has itself as root.
    Words of any letters and length take part; null words are left out, an empty table has no rows.
    Other columns are dropped.  Runs jobs: words and forms are tables below the shared folder.
    """
    words = stored(counts.filter("word is not null").select("word", F.col("n").cast("bigint").alias("n")), "words")
    best = near_words(words, sample_words).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    )
    is_form = -F.col("best.less") >= ratio * F.col("n")
    forms = words.join(best, "word", "left").select(
        "word",
        "n",
        F.when(is_form, F.col("best.near")).alias("form"),
        F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(is_form, -F.col("best.less")).alias("form_n"),
    )
    forms = stored(forms, "forms")
    roots = _roots(forms, ratio)
    return forms.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def _roots(forms: DataFrame, ratio: int) -> DataFrame:
    """``word, root`` of the words that have a form; counts rise along a chain, so its length is bounded.

    Each step joins chains end to end, which doubles what they cover.
    """
    least, most = forms.agg(F.min("n"), F.max("n")).first()
    steps = int(math.log(max(most, 1) / max(least, 1), ratio)) + 1 if most else 1
    chains = forms.filter("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(max(0, math.ceil(math.log2(steps)))):
        onward = chains.select(F.col("word").alias("root"), F.col("root").alias("further"))
        chains = stored(chains.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "chains")
    return chains
