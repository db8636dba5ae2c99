"""Suffix-array dedup of bytes: common prefixes by backward extension on a Burrows-Wheeler transform.

The texts' segments that share an anchor (see ``repeats``) meet in one group.  A group's
segments are joined, their suffixes sorted and the transform taken from the order.  Starting
from the interval of the empty string, every interval is extended to the left by every byte
that its rows have there, breadth first; an interval that ends where no common prefix is known
yet sets it to the present depth.  So common prefixes come out by increasing value, and after
``LENGTH`` rounds what is still unknown is at least that long: these suffixes are the repeats.

Groups of one segment need no transform: all their windows are as often there as the segment.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from convq.llm import repeats
from convq.llm.tables import stored

LENGTH = 400
SEED = 64
#: Bytes that are sorted together; a group above it goes by numbers of its single windows.
GROUP_BYTES = 1 << 20
_BYTES = np.random.default_rng(400).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


def byte_numbers(data: bytes) -> np.ndarray:
    return _BYTES[np.frombuffer(data, np.uint8)]


def kept_bytes(data: bytes, gone: np.ndarray) -> bytes:
    return data if not gone.any() else np.frombuffer(data, np.uint8)[~gone].tobytes()


def sorted_suffixes(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Starts of the suffixes in order of their first ``depth`` symbols (below 512), or more.

    Prefix doubling; only suffixes that are not alone yet are sorted again.
    """
    n, width = len(symbols), 7
    padded = np.concatenate((symbols, np.zeros(width, symbols.dtype))).astype(np.uint64)
    keys = np.zeros(n, np.uint64)
    for j in range(width):
        keys = (keys << np.uint64(9)) | padded[j : j + n]
    order = np.argsort(keys, kind="stable")
    rank = np.zeros(n + 1, np.int64)  # a rank is the place of the first suffix of its group, plus one
    places = np.arange(n)
    new = np.concatenate(([True], keys[order][1:] != keys[order][:-1]))
    rank[order] = np.maximum.accumulate(np.where(new, places, 0)) + 1
    while width < depth:
        group = rank[order]
        alone = np.concatenate((group[1:] != group[:-1], [True])) & np.concatenate(([True], group[1:] != group[:-1]))
        at = np.flatnonzero(~alone)
        if not len(at):
            break
        suffixes = order[at]
        keys = rank[suffixes] * (n + 2) + rank[np.minimum(suffixes + width, n)]
        inner = np.argsort(keys, kind="stable")
        order[at], keys = suffixes[inner], keys[inner]
        new = np.concatenate(([True], keys[1:] != keys[:-1]))
        rank[order[at]] = np.maximum.accumulate(np.where(new, at, 0)) + 1
        width *= 2
    return order


def repeated_suffixes(symbols: np.ndarray, length: int) -> np.ndarray:
    """Starts whose first ``length`` symbols start elsewhere too; symbol 0 only ends segments.

    Right for starts without a 0 in these symbols; the others are not to be asked for.
    """
    n = len(symbols)
    order = sorted_suffixes(symbols, length)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    before = order - 1  # the last symbol is a 0, so going round is safe
    transform, step = symbols[before], place[before]
    known = np.full(n + 1, -1, np.int32)
    known[0] = known[n] = 0
    low, high = np.array([0]), np.array([n - 1])
    for depth in range(length):
        size = high - low + 1
        interval = np.repeat(np.arange(len(low)), size)
        rows = np.arange(len(interval)) - np.repeat(np.cumsum(size) - size, size) + low[interval]
        keys = interval * 512 + transform[rows]
        if depth:  # strings that go on after the end of a segment are of no use
            inside = transform[rows] > 0
            rows, keys = rows[inside], keys[inside]
        if not len(rows):
            break
        by_key = np.argsort(keys, kind="stable")
        keys, to = keys[by_key], step[rows[by_key]]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        low, high = np.minimum.reduceat(to, first), np.maximum.reduceat(to, first)
        fresh = known[high + 1] < 0
        low, high = low[fresh], high[fresh]
        known[high + 1] = depth
        if not len(low):
            break
    unknown = known < 0
    return order[unknown[:-1] | unknown[1:]]


def repeated_windows(pieces: list[bytes], length: int) -> list[np.ndarray]:
    """For each piece the starts of its windows of ``length`` bytes that also start elsewhere."""
    symbols = np.zeros(sum(map(len, pieces)) + len(pieces), np.int64)
    ends = np.cumsum([len(p) + 1 for p in pieces])
    starts = ends - [len(p) + 1 for p in pieces]
    for piece, start in zip(pieces, starts):
        symbols[start : start + len(piece)] = np.frombuffer(piece, np.uint8).astype(np.int64) + 1
    found = np.sort(repeated_suffixes(symbols, length))
    owner = np.searchsorted(ends, found, side="right")
    own = found - starts[owner]
    valid = own + length <= np.array([len(p) for p in pieces])[owner]
    owner, own = owner[valid], own[valid]
    bounds = np.searchsorted(owner, np.arange(len(pieces) + 1))
    return [own[a:b] for a, b in zip(bounds[:-1], bounds[1:])]


def _pieces(length: int):
    def pieces(data, tokens, anchors, firsts, lasts):
        for anchor, first, last in zip(anchors.tolist(), firsts.tolist(), lasts.tolist()):
            yield anchor, None, first, last, data[first : last + length]

    return pieces


def _search(length: int, group_bytes: int):
    def found(rows):
        out = []
        for (row, place, status), starts in zip([r[1:4] for r in rows], repeated_windows([r[4] for r in rows], length)):
            if status == repeats.PARTIAL and len(starts):
                first, _ = repeats.unpack(np.array([place], np.int64))
                runs = np.split(starts, np.flatnonzero(np.diff(starts) > 1) + 1)
                a, b = np.array([r[0] for r in runs]) + first[0], np.array([r[-1] for r in runs]) + first[0]
                out += [(row, p) for p in repeats.pack(a, b).view(np.int64).tolist()]
        numbers, places = zip(*out) if out else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(places, pa.int64())], ["row", "place"])

    def search(batches):
        rows, held = [], 0
        for batch in batches:
            for row in zip(*(batch.column(n).to_pylist() for n in ("a", "row", "place", "status", "piece"))):
                if held >= group_bytes and row[0] != rows[-1][0]:
                    yield found(rows)
                    rows, held = [], 0
                rows.append(row)
                held += len(row[4])
        if rows:
            yield found(rows)

    return search


def _single(length: int):
    """Two numbers for every window of the pieces of groups that are too large to be sorted."""

    def number(batches):
        for batch in batches:
            for row, place, status, piece in zip(*(batch.column(n).to_pylist() for n in ("row", "place", "status", "piece"))):
                tokens = byte_numbers(piece)
                a = repeats.Numbers(tokens).all_of(length).view(np.int64)
                b = repeats.Numbers(repeats._mixed(tokens)).all_of(length).view(np.int64)
                first, _ = repeats.unpack(np.array([place], np.int64))
                at = np.arange(len(a)) + first[0]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a), pa.array(b), pa.array(np.full(len(a), row, np.int64)), pa.array(repeats.pack(at, at).view(np.int64)), pa.array(np.full(len(a), status, np.int32))],
                    ["a", "b", "row", "place", "status"],
                )

    return number


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, seed: int = SEED, group_bytes: int = GROUP_BYTES, with_kept: bool = True) -> DataFrame:
    """``doc, n_tokens, n_removed, n_spans, kept_sha256, kept`` for every row of ``docs``.

    Texts are UTF-8 bytes (null: none).  A byte is removed if it is in a run of ``length`` bytes
    that starts anywhere else too, in the same text or another; runs never cross texts and are
    judged on the texts as they are.  ``n_spans`` is the number of maximal removed runs; ``kept``
    the other bytes, null without ``with_kept``.

    Every row is a text of its own, also one that repeats another's id, text or both.  A null
    id stays null.  Empty tables give empty ones; other columns are not read.
    """
    kind = repeats.Kind(byte_numbers, length, seed, False, kept_bytes)
    texts = repeats.documents_of(docs, id_col, text_col)
    found = stored(repeats.statuses(texts, kind), "segments")
    mixed = stored(repeats.look(texts, found, kind, _pieces(length), with_kept), "looked")
    pieces = mixed.filter(F.col("step") == repeats.PIECE).select("a", "row", "place", "status", "piece")
    large = pieces.groupBy("a").agg(F.sum(F.octet_length("piece")).alias("bytes")).filter(F.col("bytes") > group_bytes).select("a")
    groups = pieces.join(large, "a", "left_anti").repartition("a").sortWithinPartitions("a")
    by_transform = groups.mapInArrow(_search(length, group_bytes), "row bigint, place bigint")
    windows = pieces.join(large, "a", "left_semi").mapInArrow(_single(length), "a bigint, b bigint, row bigint, place bigint, status int")
    windows = stored(windows, "windows")
    several = windows.groupBy("a", "b").agg(F.count("*").alias("n")).filter("n > 1").select("a", "b")
    by_number = windows.filter(F.col("status") == repeats.PARTIAL).join(several, ["a", "b"], "left_semi").select("row", "place")
    return repeats.finish(mixed, by_transform.unionByName(by_number), kind, with_kept)
