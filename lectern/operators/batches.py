"""Arrow batches cut small for work row by row: Spark's have up to 10,000 rows or 64 MB, whose Python objects
need several times their bytes in each task."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa

#: About how many bytes of a batch are Python objects at once.
PIECE_BYTES = 2 * 1024 * 1024


def pieces(batches: Iterable[pa.RecordBatch], size: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """All rows in order, in slices of about ``size`` bytes and at least a row; nothing is copied."""
    for batch in batches:
        step = max(1, batch.num_rows * size // max(1, batch.nbytes))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)
