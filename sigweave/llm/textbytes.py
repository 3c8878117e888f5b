"""Bytes of an Arrow string column without making Python strings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def text_bytes(column: pa.Array) -> Iterator[np.ndarray]:
    """UTF-8 bytes of each row as a read-only view; a null row is empty."""
    if isinstance(column, pa.ChunkedArray):
        for c in column.chunks:
            yield from text_bytes(c)
        return
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    flat = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    empty = np.empty(0, np.uint8)
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    for i in range(len(column)):
        yield flat[at[i] : at[i + 1]] if valid[i] else empty
