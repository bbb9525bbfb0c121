"""Arrow batches cut by bytes, so that a worker's memory follows a limit and not the number of rows."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that a worker turns into Python objects at a time.
BLOCK_BYTES = 4 << 20


def value_bytes(column: pa.Array) -> np.ndarray:
    """Bytes of each string or binary value (0 for null), from the offsets alone."""
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def blocks(batches: Iterable[pa.RecordBatch], column: int | Callable[[pa.RecordBatch], pa.Array], limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most `limit` bytes in a column, or one row where that alone is larger."""
    for batch in batches:
        ends = np.cumsum(value_bytes(column(batch) if callable(column) else batch.column(column)))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, end - start)
            start = end
