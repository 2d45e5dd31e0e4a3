"""Arrow batches in parts of bounded size, so that what a task holds in Python doesn't grow with its batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def ranges(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows that go from offset to offset, as many as have no more than ``most`` together; one row at least."""
    a = 0
    while a < len(offsets) - 1:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1)
        yield a, b
        a = b


def bounds(binary: pa.Array) -> np.ndarray:
    """The offsets in bytes of texts or binaries that lie one behind the other; a null has none."""
    return np.concatenate(([0], np.cumsum(pc.fill_null(pc.binary_length(binary), 0).to_numpy(zero_copy_only=False)))).astype(np.int64)
