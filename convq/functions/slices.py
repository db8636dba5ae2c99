"""Arrow batches in slices, so that Python holds the texts of one slice as objects and not those of a batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20


def bounds(texts: pa.Array, per_row: int = 0, slice_bytes: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Starts and ends of runs of ``texts`` of at most ``slice_bytes``, or of one text that is longer.

    Every text counts ``per_row`` bytes beside its own.
    """
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0).to_pylist(), np.int64) + per_row
    ends, start, before = np.cumsum(sizes), 0, 0
    while start < len(sizes):
        end = max(start + 1, int(np.searchsorted(ends, before + slice_bytes, side="right")))
        yield start, end
        start, before = end, int(ends[end - 1])
