"""Helpers shared by the operators: shared-folder tables, text as byte arrays, hashing, components.

Text operators look at a batch of strings as one UTF-8 buffer with offsets and work on it with numpy, so that
no Python object is made per word. A word here is a longest run of bytes other than ASCII white space.
"""

from __future__ import annotations

import atexit
import ctypes
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of text that a numpy pass looks at together; a longer document is a slice of its own.
SLICE_BYTES = 2 << 20


# -- shared folder


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir, or the context's checkpoint folder.

    Where neither is set a local master gets a folder that ends with the process; a cluster must name one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = known.get() if known.isDefined() else None
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tessella-")
        atexit.register(shutil.rmtree, base[7:], True)
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


#: Tables of materialise() that are still there.
_written: list[str] = []


def materialise(df: DataFrame, label: str) -> DataFrame:
    """The rows written once to a table in the shared folder and read back, which cuts the lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessella-{label}-{uuid.uuid4().hex[:12]}"
    _written.append(path)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tessella_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table of materialise() that no later result reads."""
    path = getattr(df, "_tessella_path", None)
    if path:
        _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    if path in _written:
        _written.remove(path)


def clear(spark: SparkSession) -> None:
    """Delete every table of materialise() that this process wrote: once the results that read them are written."""
    for path in list(_written):
        _delete(spark, path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(df: DataFrame, base: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    name = f"__{base}"
    while name.lower() in taken:
        name += "_"
    return name


def ids_and_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def by_id(df: DataFrame, id_col: str, text_col: str, order: list[Column] | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(one row an id, a row for each further text of the same id or None where no id is repeated); rows without an id go.

    The one is the first by order, else that with the longest, then greatest text. Only the ids are counted; the texts move
    only where ids do repeat.
    """
    key, value = column(id_col), column(text_col)
    df = df.filter(key.isNotNull())
    rid, rank, text = fresh(df, "rid"), fresh(df, "rank"), fresh(df, "text")
    repeated = df.groupBy(key.alias(rid)).count().filter("count > 1").select(rid)
    if repeated.isEmpty():
        return df, None
    order = Window.partitionBy(key).orderBy(*(order or [F.length(value).desc_nulls_last(), value.desc_nulls_last()]))
    # equal texts of an id stand together in the order: all but the first of them go
    some = df.join(repeated, key == F.col(rid), "left_semi").withColumn(rank, F.row_number().over(order)).withColumn(text, F.lag(value).over(order))
    first = some.filter(F.col(rank) == 1).drop(rank, text)
    rest = some.filter((F.col(rank) > 1) & ~value.eqNullSafe(F.col(text))).drop(rank, text)
    return df.join(repeated, key == F.col(rid), "left_anti").unionByName(first), rest


def one_row_per_id(df: DataFrame, id_col: str, text_col: str, order: list[Column] | None = None) -> DataFrame:
    """The first part of by_id()."""
    return by_id(df, id_col, text_col, order)[0]


# -- memory of the Python workers


def trim() -> None:
    """Give freed memory back to the system: Spark keeps its Python workers for later stages, which bring their own needs."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library than glibc
        pass


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The function for mapInArrow, with trim() when a task's batches are done."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        trim()

    return tidied


# -- text as bytes


def as_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(batch: pa.RecordBatch, text: str = "text", most: int = SLICE_BYTES, rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of at most so many bytes of text and rows, one row at least."""
    n = batch.num_rows
    if n == 0:
        return
    column = batch.column(batch.schema.get_field_index(text))
    width = 8 if pa.types.is_large_string(column.type) else 4
    off = np.frombuffer(column.buffers()[1], np.int64 if width == 8 else np.int32, n + 1, column.offset * width).astype(np.int64)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
        to = min(to, n, at + rows)
        yield batch.slice(at, to - at)
        at = to


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and for each text where its words begin (one more at the end)."""
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(off), np.int64)
    inside = ~_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begin = off[:-1][off[:-1] < off[1:]]
    first[begin] = inside[begin]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    end = off[1:][off[:-1] < off[1:]] - 1
    last[end] = inside[end]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, off)


# -- hashing

_B = np.uint64(0x9E3779B97F4A7C15)
_BI = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        have = np.empty(max(n, 1 << 20), np.uint64)
        have[0] = 1
        have[1:] = base
        np.cumprod(have, out=have)
        _powers[int(base)] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def span_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, step: int = 1 << 19) -> np.ndarray:
    """A 64-bit hash of values[start:end] for each span (starts and ends ascending), by prefix sums modulo 2**64.

    It depends on the values in the span alone, not on where the span lies. Values are 64-bit and odd or mixed.
    """
    out = np.empty(len(starts), np.uint64)
    at, n = 0, len(starts)
    while at < n:
        lo = int(starts[at])
        to = max(at + 1, int(np.searchsorted(ends, lo + step, "right")))
        hi = int(ends[to - 1])
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(values[lo:hi] * _power(_BI, hi - lo), out=sums[1:])
        s, e = starts[at:to] - lo, ends[at:to] - lo
        out[at:to] = (sums[e] - sums[s]) * _power(_B, hi - lo + 1)[s]
        at = to
    return out


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out = np.empty(len(starts), np.uint64)
    at, n = 0, len(starts)
    while at < n:  # the table of byte values is taken piece by piece: 8 bytes for each byte of text
        lo = int(starts[at])
        to = max(at + 1, int(np.searchsorted(ends, lo + (1 << 19), "right")))
        out[at:to] = span_hash(_BYTE[data[lo : int(ends[to - 1])]], starts[at:to] - lo, ends[at:to] - lo)
        at = to
    return mix(out ^ (ends - starts).astype(np.uint64))


# -- varints


def zigzag(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.int64)
    return ((x << 1) ^ (x >> 63)).astype(np.uint64)


def unzigzag(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(1)).astype(np.int64) ^ -(x & np.uint64(1)).astype(np.int64)


def pack(x: np.ndarray) -> bytes:
    """Unsigned integers as base-128 digits, lowest first."""
    x = np.asarray(x, np.uint64)
    size = np.ones(len(x), np.int64)
    for k in range(1, 10):
        more = x >= np.uint64(1) << np.uint64(7 * k)
        if not more.any():
            break
        size += more
    at = np.cumsum(size) - size
    out = np.empty(int(size.sum()), np.uint8)
    for k in range(int(size.max()) if len(x) else 0):
        some = size > k
        digit = (x[some] >> np.uint64(7 * k)) & np.uint64(127)
        out[at[some] + k] = digit | np.where(size[some] > k + 1, np.uint64(128), np.uint64(0))
    return out.tobytes()


def unpack(raw: np.ndarray) -> np.ndarray:
    ends = np.flatnonzero(raw < 128)
    starts = np.concatenate([[0], ends[:-1] + 1]).astype(np.int64) if len(ends) else ends
    out = np.zeros(len(ends), np.uint64)
    length = ends - starts + 1
    for k in range(int(length.max()) if len(ends) else 0):
        some = length > k
        out[some] |= (raw[starts[some] + k].astype(np.uint64) & np.uint64(127)) << np.uint64(7 * k)
    return out


# -- components


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (least of the component, other node) that keep the components of the given edges."""
    if not len(a):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while len(x):
        p, q = label[x], label[y]
        low = np.minimum(p, q)
        np.minimum.at(label, p, low)  # roots are hooked to lesser ones
        np.minimum.at(label, q, low)
        while (label[label] != label).any():
            label = label[label]
        more = label[x] != label[y]
        x, y = x[more], y[more]
    other = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[label[other]], nodes[other]


def _stars(rows: Iterator[pa.RecordBatch], most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """The edges of a task as stars of their own components, at most so many taken together."""
    a: list[np.ndarray] = []
    b: list[np.ndarray] = []

    def flush() -> pa.RecordBatch:
        x, y = spanning(np.concatenate(a or [np.empty(0, np.int64)]), np.concatenate(b or [np.empty(0, np.int64)]))
        a.clear()
        b.clear()
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["a", "b"])

    for batch in rows:
        a.append(batch.column(0).to_numpy())
        b.append(batch.column(1).to_numpy())
        if sum(map(len, a)) > most:
            yield flush()
    yield flush()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): for every node of the undirected edges (a, b), the least node of its component.

    Alternates large-star and small-star steps until nothing changes; the number of rounds grows with the logarithm of
    the longest path. Each task first replaces its edges by the stars of their own components, so dense groups shrink at
    once. The least neighbour of a node is a partial aggregate joined back, so no task gets all neighbours of a hub.
    """
    e = edges.filter("a is not null and b is not null and a <> b").select(F.least("a", "b").cast("long").alias("a"), F.greatest("a", "b").cast("long").alias("b"))
    now = materialise(e.mapInArrow(_stars, "a long, b long"), "edges")
    seen = None
    while True:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        # large star: each larger neighbour is joined to the least of the neighbourhood
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: each node and its smaller neighbours are joined to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u").alias("b"), F.col("m").alias("a")), F.struct(F.col("v").alias("b"), F.col("m").alias("a")))).alias("e")).select("e.a", "e.b").filter("a <> b").distinct()
        then = materialise(small, "edges")
        sign = then.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        discard(now)
        now = then
        if tuple(sign) == seen or not sign[0]:
            break
        seen = tuple(sign)
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def column(name: str) -> Column:
    return F.col(f"`{name}`")
