"""Arrow batches in workers: parts of bounded size, and memory given back."""

from __future__ import annotations

import contextlib
import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: List items, and characters of text, of a batch that a worker works on at once.
ITEMS, CHARS = 1_000_000, 1 << 20
#: Rows of a result that leave a worker together.
ROWS_OUT = 200_000


def lengths(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def cuts(size: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """(first, end) of runs of rows whose sizes come to ``most`` at most; one row at least."""
    upto, a = np.cumsum(size), 0
    while a < len(size):
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + most, side="right")))
        yield a, b
        a = b


def slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose lists in ``column`` hold about ITEMS items at most."""
    for a, b in cuts(lengths(batch.column(column)), ITEMS):
        yield batch.slice(a, b - a)


def frugal(run: Callable) -> Callable:
    """A function over batches that returns what it has freed to the system at its end: workers live on from stage to stage."""

    @functools.wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL(None).malloc_trim(0)

    return wrapped
