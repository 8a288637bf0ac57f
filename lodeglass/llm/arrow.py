"""Arrow batches in Python workers."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa


def frugal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """`batches`, giving back after each what Arrow's allocator holds of earlier ones: workers are used again by later stages, beside the executor's heap."""
    pool = pa.default_memory_pool()
    for part in batches:
        yield part
        del part
        pool.release_unused()
