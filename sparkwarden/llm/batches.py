"""Arrow batches of bounded size for functions that see whole texts."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import pyarrow as pa

MAX_ROWS = 2_000
MAX_BYTES = 16 << 20


def release() -> None:
    """Give freed memory back to the system: Spark keeps a worker for later stages."""
    pa.default_memory_pool().release_unused()
    library = ctypes.CDLL(None)
    if hasattr(library, "malloc_trim"):
        library.malloc_trim(0)


def bounded(batches: Iterator[pa.RecordBatch], rows: int = MAX_ROWS, size: int = MAX_BYTES):
    """The same rows in slices of at most ``rows`` rows and about ``size`` bytes
    (a longer row comes alone). Slices share memory with their batch. At the end of the
    partition freed memory is released."""
    for batch in batches:
        total = batch.num_rows
        if not total:
            continue
        step = max(1, min(rows, int(total * size / max(batch.nbytes, 1))))
        for start in range(0, total, step):
            yield batch.slice(start, step)
        del batch
    release()
