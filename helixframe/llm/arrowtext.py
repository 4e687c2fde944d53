"""Arrow batches of texts, taken a bounded number of bytes at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one step of a vectorised operator takes (or one document, if longer).
STEP_BYTES = 1 << 20


def layout(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls count as empty texts."""
    if not pa.types.is_string(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, ends


def steps(ends: np.ndarray, limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``limit`` bytes, one row at least."""
    at, last = 0, len(ends) - 1
    while at < last:
        to = int(np.searchsorted(ends, ends[at] + limit, side="right")) - 1
        to = min(last, max(at + 1, to))
        yield at, to
        at = to
