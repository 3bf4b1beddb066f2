"""Arrow batches cut by the size of their texts, so that very long texts do not pile up in a worker."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MOST = 4 << 20  # bytes of text held at once; a single longer text is held alone


def sliced(batches: Iterator[pa.RecordBatch], most: int = MOST) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in order, in batches whose string columns hold about ``most`` bytes at most."""
    for batch in batches:
        sizes = np.zeros(batch.num_rows, dtype=np.int64)
        for column in batch.columns:
            if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
                sizes += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        if sizes.sum() <= most:  # also a batch without rows
            yield batch
            continue
        ends = np.cumsum(sizes)
        at = 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(at, stop - at)
            at = stop
