"""Small steps through Arrow batches, so that a worker's memory follows the step, not the batch."""

from __future__ import annotations

import pyarrow as pa

STEP_ROWS = 256
STEP_BYTES = 8 << 20


def steps(batch: pa.RecordBatch, rows: int = STEP_ROWS, most: int = STEP_BYTES):
    """Slices of ``batch`` of at most ``rows`` rows and about ``most`` bytes (one row at least)."""
    each = max(1, batch.nbytes // max(1, batch.num_rows))
    size = max(1, min(rows, most // each))
    for at in range(0, batch.num_rows, size):
        yield batch.slice(at, size)
