"""Texts in Arrow batches, in Python: slices of bounded size, tokens as bytes, memory given back."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are Python objects at once; a longer text is a slice of its own.
SLICE_BYTES = 1 << 20
Batches = Iterator[pa.RecordBatch]
#: ASCII letters in lower case and digits as they are, all else a space; no byte of another character is below 128.
_FOLD = bytes(ord(chr(i).lower()) if i < 128 and chr(i).isalnum() else 32 for i in range(256))


def tokens(value: str) -> list[bytes]:
    """Runs of ASCII letters and digits, in lower case, as functions.text.tokens has them."""
    return value.encode("utf-8", "replace").translate(_FOLD).split()


def slices(batch: pa.RecordBatch, column: int, step: int = 1, most: int = SLICE_BYTES, rows: int = 1024) -> Batches:
    """Parts of a batch with at most so many bytes in the text column and so many rows, in whole steps."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    end = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
    at = 0
    while at < batch.num_rows:
        n = min(int(np.searchsorted(end, end[at] + most, "right")) - 1 - at, rows)
        n = max(step, n // step * step)
        yield batch.slice(at, n)
        at += n


def trim() -> None:
    """Give memory that is free back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def tidy(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """run, after which the worker, that Spark keeps for the next task, gives its free memory back."""

    def tidied(batches: Batches) -> Batches:
        try:
            yield from run(batches)
        finally:
            trim()

    return tidied
