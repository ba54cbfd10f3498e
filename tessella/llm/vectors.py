"""What the embedding operators share: clean rows, vectors as float32 bytes, unit length."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import common


def clean(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, vec) with one row an id: rows with a null id, vector or element go, of equal ids the greatest vector stays.

    Only vectors of the commonest length count (of equally common lengths the greatest).
    """
    some = rows.select(common.column(id_col).cast("long").alias("vec_id"), common.column(vec_col).cast("array<float>").alias("vec"))
    some = some.filter("vec_id is not null and vec is not null and size(vec) > 0 and forall(vec, x -> x is not null)")
    size = some.groupBy(F.size("vec").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    some = some.filter(F.size("vec") == (size["dim"] if size else 0))
    return common.one_row_per_id(some, "vec_id", "vec", [F.col("vec").desc()])


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column without nulls as rows of float32."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float32)
    return flat.reshape(n, -1) if n else np.empty((0, 0), np.float32)


def unit(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows of length 1, which rows have a direction): zero, infinite and NaN vectors have none."""
    wide = v.astype(np.float64)
    with np.errstate(all="ignore"):
        norm = np.sqrt((wide * wide).sum(1))
        ok = np.isfinite(norm) & (norm > 0)
        out = wide / np.where(ok, norm, 1)[:, None]
    return np.ascontiguousarray(out, np.float32), ok


def as_binary(v: np.ndarray) -> pa.Array:
    """Each row's bytes."""
    width = v.shape[1] * v.itemsize
    raw = np.ascontiguousarray(v)
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(v), [None, pa.py_buffer(raw)]).cast(pa.binary()) if len(v) else pa.array([], pa.binary())


def from_binary(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The rows of as_binary()."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.empty((0, 0), np.float32)
    column = column.cast(pa.large_binary())
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64, len(column) + 1, column.offset * 8)
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]].view(np.float32).reshape(len(column), -1)


def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, unit) of (vec_id, vec), for mapInArrow: vectors of length 1 as bytes, those without a direction left out."""
    for batch in batches:
        if batch.num_rows:
            v, ok = unit(matrix(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(ok)), as_binary(v[ok])], ["vec_id", "unit"])
