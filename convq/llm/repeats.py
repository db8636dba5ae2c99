"""What the two dedup operators on repeated passages share: anchors, segments, statuses.

A window of ``length`` tokens (bytes or words) is represented by its anchor: the seed, a shorter
run of tokens, whose number is the smallest in the window (leftmost of equals).  Equal windows
have equal anchors at the same place.  The windows of one text that share an anchor lie side by
side; the tokens they cover are a segment.  Only anchors and a number for each segment's tokens
are compared over all texts:

* equal segments elsewhere: all windows of the segment are repeated (``FULL``);
* the same anchor with other segments: some windows may be repeated (``PARTIAL``);
* an anchor found once: none is.

A task first settles what it can see itself, so that at most one row per task and segment is
sent for a passage, however often it occurs.

Every row of the input is a text of its own and has a number of its own, ``row``, which the texts
are written with before the scan.  Places and statuses find their text by it; ``doc``, the id, may
be null or shared by any number of rows and serves for the rule of the smaller id and the output.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from convq.llm.tables import stored

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
FULL, PARTIAL, REFERENCE = 0, 1, 2
#: Anchors that a task holds before it settles and sends them.
HELD = 1_500_000
#: Rows of one anchor that are held before those that are settled are sent on.
OPEN = 1_000_000
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of ``BASE`` and of its inverse modulo 2**64, kept between calls."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(1 << 16, 1 << int(n - 1).bit_length())
        _POWERS[:] = [
            np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(size - 1, b, np.uint64)))) for b in (BASE, INVERSE)
        ]
    return _POWERS[0][:n], _POWERS[1][:n]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


class Numbers:
    """Numbers for any run of the tokens of one text: sums of token times power, shifted to 0."""

    def __init__(self, tokens: np.ndarray):
        up, self.down = _powers(len(tokens) + 1)
        self.sums = np.zeros(len(tokens) + 1, np.uint64)
        np.cumsum(tokens * up[:-1], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[ends] - self.sums[starts]) * self.down[starts])

    def all_of(self, length: int) -> np.ndarray:
        n = len(self.sums) - length
        return _mixed((self.sums[length:] - self.sums[:n]) * self.down[:n])


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` values the place of its smallest, the leftmost of equals.

    Values are compared by their upper 44 bits.
    """
    out: list[np.ndarray] = []
    mask = np.uint64((1 << 20) - 1)
    step = (1 << 20) - width
    for at in range(0, len(values) - width + 1, step):
        part = values[at : at + step + width - 1]
        keys = (part & ~mask) | np.arange(len(part), dtype=np.uint64)
        n = len(part) - width + 1
        if width <= 16:
            low = keys[:n].copy()
            for k in range(1, width):
                np.minimum(low, keys[k : k + n], out=low)
        else:  # running minima from both ends of blocks of ``width``
            blocks = np.pad(keys, (0, -len(keys) % width), constant_values=np.uint64(2**64 - 1)).reshape(-1, width)
            right = np.minimum.accumulate(blocks, axis=1).reshape(-1)
            left = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
            low = np.minimum(left[:n], right[width - 1 : width - 1 + n])
        out.append((low & mask).astype(np.int64) + at)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def segments(numbers: Numbers, n_tokens: int, length: int, seed: int):
    """``anchor number, segment number, first window, last window`` of each segment of a text."""
    if n_tokens < length:
        empty = np.zeros(0, np.int64)
        return empty.view(np.uint64), empty.view(np.uint64), empty, empty
    seeds = numbers.all_of(seed)
    anchor = sliding_argmin(seeds, length - seed + 1)
    change = np.flatnonzero(np.diff(anchor)) + 1
    first = np.concatenate(([0], change))
    last = np.concatenate((change, [len(anchor)])) - 1
    return seeds[anchor[first]], numbers.of(first, last + length), first, last


# A place in one text as one long: the first window, 9 bits of the number of windows less one, 2 of
# the weight.


def pack(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    return (first.astype(np.uint64) << np.uint64(11)) | ((last - first).astype(np.uint64) << np.uint64(2))


def unpack(place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``first window, last window``."""
    place = place.view(np.uint64)
    first = (place >> np.uint64(11)).astype(np.int64)
    return first, first + ((place >> np.uint64(2)) & np.uint64(0x1FF)).astype(np.int64)


@dataclass(frozen=True)
class Kind:
    """How texts become tokens, and whether the first document keeps its windows."""

    tokens: object  # bytes -> array of uint64
    length: int
    seed: int
    keep_first: bool
    kept: object  # bytes, what is removed -> bytes that stay


COLUMNS = "anchor bigint, segment bigint, place bigint, doc bigint, row bigint"
NAMES = ["anchor", "segment", "place", "doc", "row"]
ORDER = ["anchor", "segment", "doc", "row", "place"]


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal rows, and the number of rows at the end."""
    change = np.zeros(len(columns[0]), bool)
    change[:1] = True
    for c in columns:
        change[1:] |= c[1:] != c[:-1]
    return np.concatenate((np.flatnonzero(change), [len(change)]))


def _settle(rows: list[np.ndarray], kind: Kind) -> list[np.ndarray]:
    """Weight 0 for rows that are FULL already, by what this task has seen; they go anywhere.

    Of each segment the rows of the smallest document stay (``keep_first``), or one row of
    weight 2 that stands for all of them.
    """
    anchor, segment, place, doc, row = rows
    order = np.lexsort((place, row, doc, segment, anchor))
    anchor, segment, place, doc, row = (c[order] for c in rows)
    back = np.empty_like(order)
    back[order] = np.arange(len(order))  # rows of one text stay together, which packs better
    bounds = _runs(anchor, segment)
    size = np.diff(bounds)
    if kind.keep_first:
        settled = doc > np.repeat(doc[bounds[:-1]], size)
        place = place.view(np.uint64) | np.where(settled, 0, 1).astype(np.uint64)
    else:
        several = np.repeat(size > 1, size)
        settled = several.copy()
        settled[bounds[:-1]] = False
        place = place.view(np.uint64) | np.where(settled, 0, np.where(several, 2, 1)).astype(np.uint64)
    anchor = np.where(settled, _mixed(place ^ (row.view(np.uint64) * np.uint64(BASE))), anchor)
    return [c.view(np.int64)[back] for c in (anchor, segment, place, doc, row)]


def _anchors(kind: Kind):
    """Rows of ``COLUMNS`` for ``row, doc, text``; ids that are unique may stand for ``row``."""

    def scan(batches):
        held, n = [], 0
        for batch in batches:
            docs = batch.column("doc").to_pylist()
            numbers = batch.column("row").to_pylist() if "row" in batch.schema.names else docs
            for row, doc, text in zip(numbers, docs, batch.column("text")):
                tokens = kind.tokens(text.as_py())
                anchor, segment, first, last = segments(Numbers(tokens), len(tokens), kind.length, kind.seed)
                if len(anchor):
                    whose = (np.full(len(anchor), number, np.int64) for number in (doc, row))
                    held.append((anchor, segment, pack(first, last), *whose))
                    n += len(anchor)
            if n >= HELD:
                yield _batch(_settle([np.concatenate(c) for c in zip(*held)], kind))
                held, n = [], 0
        if held:
            yield _batch(_settle([np.concatenate(c) for c in zip(*held)], kind))

    return scan


def _batch(columns: list[np.ndarray], names: list[str] = NAMES) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)


def _decide(rows: list[np.ndarray], kind: Kind, many_anchor: int | None) -> pa.RecordBatch:
    """Statuses of whole segments; ``many_anchor`` has more segments than are here."""
    anchor, segment, place, doc, row = rows
    size = np.diff(bounds := _runs(anchor, segment))
    anchors = _runs(anchor)
    weight = (place & 3).astype(np.int64)
    different = np.repeat(np.add.reduceat(np.isin(np.arange(len(anchor)), bounds[:-1]), anchors[:-1]), np.diff(anchors)) > 1
    if many_anchor is not None:
        different |= anchor == many_anchor
    if kind.keep_first:
        # Passages within one document only need no look: none of it has a smaller id.
        low, high = (np.repeat(f.reduceat(doc, anchors[:-1]), np.diff(anchors)) for f in (np.minimum, np.maximum))
        spread = (low != high) | (anchor == many_anchor if many_anchor is not None else False)
        full = doc > np.repeat(doc[bounds[:-1]], size)
        partial, reference = ~full & different & spread, np.zeros(len(anchor), bool)
    else:
        total = np.repeat(np.add.reduceat(weight, bounds[:-1]), size)
        full = total > 1
        first = np.isin(np.arange(len(anchor)), bounds[:-1])
        partial, reference = ~full & different, full & different & first
    full |= weight == 0
    partial &= weight > 0
    reference &= weight > 0
    parts = [(full, FULL), (partial, PARTIAL), (reference, REFERENCE)]
    index = np.concatenate([np.flatnonzero(which) for which, _ in parts])
    status = np.concatenate([np.full(int(which.sum()), s, np.int32) for which, s in parts])
    return _batch([anchor[index], doc[index], row[index], place[index], status], ["anchor", "doc", "row", "place", "status"])


def _statuses(kind: Kind):
    def decide(batches):
        rest, many = None, None
        for batch in batches:
            rows = [batch.column(n).to_numpy(zero_copy_only=False) for n in NAMES]
            if rest is not None:
                rows = [np.concatenate(pair) for pair in zip(rest, rows)]
            if not len(rows[0]):
                continue
            cut = _runs(rows[0])[-2]
            if cut:
                yield _decide([r[:cut] for r in rows], kind, many)
                rows, many = [r[cut:] for r in rows], None if rows[0][0] != rows[0][-1] else many
            last = _runs(rows[0], rows[1])[-2]
            if len(rows[0]) > OPEN and last:
                many = int(rows[0][0])
                yield _decide([r[:last] for r in rows], kind, many)
                rows = [r[last:] for r in rows]
            rest = rows
        if rest is not None and len(rest[0]):
            yield _decide(rest, kind, many)

    return decide


def documents_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``row, doc, text``: a number of the row's own, the id, null as the largest number, and the
    UTF-8 bytes, null as empty.

    The numbers depend on how the rows are dealt, so the rows are written with them.
    """
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.coalesce(F.col(id_col).cast("bigint"), F.lit((1 << 63) - 1)).alias("doc"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"),
    )
    return stored(rows, "texts")


def statuses(texts: DataFrame, kind: Kind) -> DataFrame:
    """``anchor, row, place, status`` of the segments that are repeated or may be in part.

    ``texts`` has ``row, doc, text``.
    """
    rows = texts.mapInArrow(_anchors(kind), COLUMNS)
    dealt = rows.repartition("anchor").sortWithinPartitions(*ORDER)
    decided = dealt.mapInArrow(_statuses(kind), "anchor bigint, doc bigint, row bigint, place bigint, status int")
    return decided.drop("doc")


def covered(n_tokens: int, first: np.ndarray, last: np.ndarray, length: int) -> np.ndarray:
    """True for the tokens inside a window that starts between ``first`` and ``last``."""
    change = np.zeros(n_tokens + 1, np.int64)
    np.add.at(change, first, 1)
    np.add.at(change, np.minimum(last + length, n_tokens), -1)
    return np.cumsum(change[:-1]) > 0


RESULT = "doc bigint, n_tokens bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"
RESULT_NAMES = [c.split()[0] for c in RESULT.split(", ")]


def result(doc: int, data: bytes, kind: Kind, first: np.ndarray, last: np.ndarray, with_kept: bool) -> tuple:
    """The row of one text of which the windows from ``first`` to ``last`` are removed."""
    n = len(kind.tokens(data))
    gone = covered(n, first, last, kind.length)
    kept = kind.kept(data, gone)
    spans = int(np.count_nonzero(np.diff(np.concatenate(([False], gone)).astype(np.int8)) == 1))
    return doc, n, int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept if with_kept else None


#: A table with results, pieces to be compared (``a, b, place, piece``) and texts that wait for them.
MIXED = f"step int, row bigint, {RESULT}, a bigint, b bigint, place bigint, status int, piece binary, ready array<bigint>"
DONE, PIECE, WAITING = 0, 1, 2
BATCH_BYTES = 16 << 20


def packed(texts: DataFrame) -> DataFrame:
    """``row, doc, text`` with the text compressed, to be shuffled."""

    def pack_all(batches):
        import zstandard

        packer = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            texts = pa.array([packer.compress(t.as_py()) for t in batch.column("text")], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc"), texts], ["row", "doc", "text"])

    return texts.mapInArrow(pack_all, "row bigint, doc bigint, text binary")


def _unpacker():
    import zstandard

    return zstandard.ZstdDecompressor().decompress


def look(texts: DataFrame, found: DataFrame, kind: Kind, pieces, with_kept: bool) -> DataFrame:
    """One pass over the texts with the statuses of their segments; see ``MIXED``.

    ``pieces(data, tokens, anchors, firsts, lasts)`` yields ``a, b, first, last, piece`` of what
    has to be compared for the segments that may be repeated in part.
    """
    by_row = found.groupBy("row").agg(F.collect_list(F.struct("place", "status", "anchor")).alias("found"))
    names = [c.split()[0] for c in MIXED.replace("array<bigint>", "array").split(", ")]
    schema = pa.schema(
        [("step", pa.int32()), ("row", pa.int64()), ("doc", pa.int64()), ("n_tokens", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
         ("kept_sha256", pa.string()), ("kept", pa.binary()), ("a", pa.int64()), ("b", pa.int64()), ("place", pa.int64()),
         ("status", pa.int32()), ("piece", pa.binary()), ("ready", pa.list_(pa.int64()))]
    )

    def work(batches):
        unpacked, rows, held = _unpacker(), [], 0
        for batch in batches:
            whose = (batch.column(n).to_pylist() for n in ("row", "doc"))
            for row, doc, text, own in zip(*whose, batch.column("text"), batch.column("found")):
                data = unpacked(text.as_py())
                place, status, anchor, first, last = _own(own)
                full = status == FULL
                if full.all():
                    rows.append((DONE, row, *result(doc, data, kind, first, last, with_kept), None, None, None, None, None, None))
                    held += len(data) * with_kept + 100
                else:
                    for s in (PARTIAL, REFERENCE):
                        which = status == s
                        for a, b, f, l, piece in pieces(data, kind.tokens(data), anchor[which], first[which], last[which]):
                            at = int(pack(np.array([f]), np.array([l])).view(np.int64)[0])
                            rows.append((PIECE, row, doc, *[None] * 5, a, b, at, s, piece, None))
                            held += len(piece or b"") + 100
                    if (status == PARTIAL).any():
                        rows.append((WAITING, row, doc, *[None] * 9, text.as_py(), place[full].tolist()))
                        held += len(data)
                    else:
                        rows.append((DONE, row, *result(doc, data, kind, first[full], last[full], with_kept), None, None, None, None, None, None))
                        held += len(data) * with_kept + 100
                if held >= BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], names)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], names)

    return packed(texts).join(by_row, "row", "left").select("row", "doc", "text", "found").mapInArrow(work, MIXED)


def _own(found: pa.Scalar) -> tuple[np.ndarray, ...]:
    """``place, status, anchor, first, last`` of the segments found in a text."""
    values = found.values
    if values is None or not len(values):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, empty, empty
    place, status, anchor = (values.field(n).to_numpy(zero_copy_only=False) for n in ("place", "status", "anchor"))
    return place, status, anchor, *unpack(place)


def finish(mixed: DataFrame, removed: DataFrame, kind: Kind, with_kept: bool) -> DataFrame:
    """``RESULT`` for every text: those done, and those waiting with the places ``removed`` (``row, place``)."""
    waiting = mixed.filter(F.col("step") == WAITING).select("row", "doc", F.col("piece").alias("text"), "ready")
    by_row = removed.groupBy("row").agg(F.collect_set("place").alias("removed"))

    def work(batches):
        unpacked = _unpacker()
        for batch in batches:
            rows = []
            for doc, text, ready, own in zip(*(batch.column(n).to_pylist() for n in ("doc", "text", "ready", "removed"))):
                text = unpacked(text)
                place = np.array([*(ready or []), *(own or [])], np.int64)
                rows.append(result(doc, text, kind, *unpack(place), with_kept))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], RESULT_NAMES)

    late = waiting.join(by_row, "row", "left").select("doc", "text", "ready", "removed").mapInArrow(work, RESULT)
    done = mixed.filter(F.col("step") == DONE).select(*RESULT_NAMES)
    return done.unionByName(late).withColumn("doc", F.when(F.col("doc") < (1 << 63) - 1, F.col("doc")))
