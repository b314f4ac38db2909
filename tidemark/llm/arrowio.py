"""Rows of Arrow batches in small lists, so that copies in Python stay bounded."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

SLICE_ROWS, SLICE_BYTES = 256, 8 << 20


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[list[list]]:
    """Columns as Python lists, of at most SLICE_ROWS rows and, beyond one row, about SLICE_BYTES."""
    for batch in batches:
        i, n = 0, batch.num_rows
        per_row = max(1, batch.nbytes // max(1, n))
        step = max(1, min(SLICE_ROWS, SLICE_BYTES // per_row))
        while i < n:
            yield [c.to_pylist() for c in batch.slice(i, step).columns]
            i += step
