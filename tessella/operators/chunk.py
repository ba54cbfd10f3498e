"""Chunkers (T1-T3, T5, T7-T9): a row a chunk, (…, chunk_idx, chunk), in the order of the text.

Fixed-size chunks and the sentence packer are JVM expressions. The Markdown splitter and the semantic chunkers keep state
from chunk to chunk and run in Python on Arrow batches, a document at a time, without a shuffle. Null and empty
texts have no chunks.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import batches as parts_of
from tessella.functions import markdown, text
from tessella.schema import extended

Encode = Callable[[list[str]], np.ndarray]


def fixed_chunks(value: Column, size: int, overlap: int = 0) -> Column:
    """Chunks of size characters that each begin size - overlap after the one before, the last as long as the text lasts."""
    if size < 1:
        raise ValueError("chunk_size must be positive")
    if not 0 <= overlap < size:
        raise ValueError(f"overlap must be less than chunk_size, got {overlap} and {size}")
    step = size - overlap
    more = F.ceil(F.greatest(F.length(value) - size, F.lit(0)) / step).cast("int")
    return F.when(F.length(value) > 0, F.transform(F.sequence(F.lit(0), more), lambda i: F.substring(value, i * step + 1, size)))


def sentence_packs(value: Column, n_words: int) -> Column:
    """Sentences (ended by . or ;) gathered until they have n_words words; a shorter text stays as it is.

    Both limits count words. A sentence gets a full stop, whichever sign ended it.
    """
    if n_words < 1:
        raise ValueError("n_words must be positive")
    parts = F.split(F.regexp_replace(value, r"[.;]\z", ""), "[.;]")
    sentences = F.transform(parts, lambda s: text.words(F.concat(s, F.lit("."))))
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("done"), none.alias("open"))

    def add(acc: Column, words: Column) -> Column:
        both = F.concat(acc["open"], words)
        full = F.size(both) >= n_words
        return F.struct(F.when(full, F.concat(acc["done"], F.array(F.array_join(both, " ")))).otherwise(acc["done"]).alias("done"), F.when(full, none).otherwise(both).alias("open"))

    end = lambda acc: F.when(F.size(acc["open"]) > 0, F.concat(acc["done"], F.array(F.array_join(acc["open"], " ")))).otherwise(acc["done"])
    return F.when(F.length(value) > 0, F.when(F.size(text.words(value)) < n_words, F.array(value)).otherwise(F.aggregate(sentences, start, add, end)))


def explode(df: DataFrame, chunks: Column, keep: list[str]) -> DataFrame:
    """(keep …, chunk_idx, chunk)."""
    return df.select(*keep, F.posexplode(chunks).alias("chunk_idx", "chunk")).withColumn("chunk_idx", F.col("chunk_idx").cast("long"))


def _each(df: DataFrame, text_col: str, keep: list[str], split: Callable[[str], list[str]]) -> DataFrame:
    """Chunks of each text by a Python function."""
    light = df.select(*keep, F.col(text_col).cast("string").alias("__text"))
    schema = extended(df.select(*keep).schema, chunk_idx="bigint", chunk="string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in parts_of.slices(whole, whole.num_columns - 1, rows=256):
                lists = [split(t) if t else [] for t in b.column(b.num_columns - 1).to_pylist()]
                row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
                index = pa.array([k for x in lists for k in range(len(x))], pa.int64())
                own = [b.column(k).take(pa.array(row)) for k in range(b.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*own, index, pa.array([c for x in lists for c in x], pa.string())], schema.names)

    return light.mapInArrow(parts_of.tidy(run), schema)


def markdown_chunks(df: DataFrame, text_col: str = "text", keep: list[str] | None = None, size: int = 1000, overlap: int = 0) -> DataFrame:
    """T1, T2."""
    markdown.spans("", size, overlap)  # a bad size or overlap is an error here, not in a task
    return _each(df, text_col, keep if keep is not None else [c for c in df.columns if c != text_col], lambda t: markdown.split(t, size, overlap))


def html_chunks(df: DataFrame, html_col: str = "html", keep: list[str] | None = None, size: int = 1000, overlap: int = 0) -> DataFrame:
    """HTML as Markdown, links unwrapped, then T1."""
    markdown.spans("", size, overlap)
    return _each(df, html_col, keep if keep is not None else [c for c in df.columns if c != html_col], lambda t: markdown.split(markdown.unwrap_links(markdown.from_html(t)), size, overlap))


def html_to_markdown(df: DataFrame, html_col: str = "html", out_col: str = "markdown") -> DataFrame:
    """T3 without chunks: df with a column more."""
    schema = extended(df.schema, **{out_col: "string"})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [None if t is None else markdown.from_html(t) for t in b.column(b.schema.get_field_index(html_col)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.string())], schema.names)

    return df.mapInArrow(run, schema)


# Semantic chunkers


def pieces(value: str, n_words: int) -> list[str]:
    """What the semantic chunkers regroup: sentences, cut where they have more than n_words words."""
    out = []
    for sentence in re.split(r"(?<=[.!?;])\s+|\n+", value):
        w = sentence.split()
        out += [" ".join(w[k : k + n_words]) for k in range(0, len(w), n_words)]
    return out


def context_similarities(v: np.ndarray, window: int = 5) -> np.ndarray:
    """The cosine of each vector but the first with the mean of the up to window before it."""
    n = len(v) - 1
    if n < 1:
        return np.zeros(0)
    total = np.zeros((n, v.shape[1]))
    for k in range(min(window, n), 0, -1):  # from the first of a window to its last
        total[k - 1 :] += v[: n - k + 1]
    context = total / np.minimum(np.arange(1, n + 1), window)[:, None]
    dot = lambda a, b: np.matmul(a[:, None], b[:, :, None])[:, 0, 0]
    scale = np.sqrt(dot(context, context)) * np.sqrt(dot(v[1:], v[1:]))
    return np.divide(dot(v[1:], context), scale, out=np.zeros(n), where=scale > 0)


def split_indices(similarities: np.ndarray, threshold: float) -> list[int]:
    """A split before each piece that is less like its context than the threshold."""
    return [i + 1 for i, s in enumerate(similarities) if s < threshold]


def optimal_threshold(similarities: np.ndarray, counts: list[int], least: int = 100, most: int = 512, tolerance: int = 10, step: float = 0.01) -> float:
    """By bisection between the median less and plus a deviation, until the median split has least to most tokens."""
    if len(similarities) < 2:
        return float(similarities[0]) if len(similarities) else 0.5
    middle, spread = float(np.median(similarities)), float(np.std(similarities))
    low, high, found = max(0.0, middle - spread), min(1.0, middle + spread), 0.0
    total = np.concatenate([[0], np.cumsum(counts)])
    while low <= high:
        found = (low + high) / 2
        at = [0, *split_indices(similarities, found), len(counts)]
        size = float(np.median(np.diff(total[at])))
        if least - tolerance <= size <= most + tolerance:
            break
        if size < least:
            high = found - step
        else:
            low = found + step
    return found


def group_pieces(parts: list[str], counts: list[int], splits: list[int], least: int = 100, most: int = 512) -> list[str]:
    """T8d: pieces joined by line feeds, cut at splits once a chunk has least tokens and before it has more than most.

    No piece is lost: a run that is too short when the next piece would overflow it is a chunk of its own.
    """
    at, out, open_, n = set(splits), [], [], 0
    for i, (part, count) in enumerate(zip(parts, counts, strict=True)):
        if open_ and n + count > most:
            out.append("\n".join(open_))
            open_, n = [], 0
        open_.append(part)
        n += count
        if i + 1 in at and least <= n <= most:
            out.append("\n".join(open_))
            open_, n = [], 0
    return [*out, "\n".join(open_)] if open_ else out


def statistical_chunks(value: str, encode: Encode, n_words: int = 50, window: int = 5, least: int = 100, most: int = 512) -> list[str]:
    """The whole document at once, so that no context ends at a batch."""
    parts = pieces(value, n_words)
    if len(parts) < 2:
        return parts
    counts = [len(p.split()) for p in parts]
    similar = context_similarities(encode(parts), window)
    return group_pieces(parts, counts, split_indices(similar, optimal_threshold(similar, counts, least, most)), least, most)


def _near(a: np.ndarray, b: np.ndarray, threshold: float) -> bool:
    scale = np.linalg.norm(a) * np.linalg.norm(b)
    return bool(scale) and float(a @ b) / scale >= threshold


def _cumulative_sums(parts: list[str], v: np.ndarray, threshold: float) -> list[str]:
    """cumulative_chunks where a chunk's vector is the sum of its pieces', brought to length 1."""
    out, begin = [], 0
    square = np.einsum("ij,ij->i", v, v).tolist()
    for i in range(len(parts)):
        if i > begin:
            dot = float(whole @ v[i])
            scale = math.sqrt(size * square[i])
            apart = dot / scale - threshold if scale else -1.0
            if abs(apart) < 1e-9:  # as near as rounding: by the vectors of length 1, as encode gives them
                apart = 0.0 if _near(whole / np.sqrt((whole * whole).sum()), v[i] / np.sqrt((v[i] * v[i]).sum()), threshold) else -1.0
            if apart < 0:
                out.append("\n".join(parts[begin:i]))
                begin = i
            else:
                whole = whole + v[i]
                size += 2 * dot + square[i]
        if i == begin:
            whole, size = v[i], square[i]
    return [*out, "\n".join(parts[begin:])] if parts else out


def cumulative_chunks(value: str, encode: Encode, n_words: int = 50, threshold: float = 0.9, counts: Encode | None = None) -> list[str]:
    """A piece joins the chunk while its cosine with the whole chunk so far is at least the threshold.

    counts: vectors of whole numbers that encode brings to length 1 and that add up when texts are joined. With it each piece is
    encoded once; else the whole chunk is for each piece, which only a model has to.
    """
    if counts is not None:
        own = pieces(value, n_words)
        return _cumulative_sums(own, counts(own), threshold) if own else []
    out, open_ = [], []
    for part in pieces(value, n_words):
        if open_:
            a, b = encode(["\n".join(open_), part])
            if not _near(a, b, threshold):
                out.append("\n".join(open_))
                open_ = []
        open_.append(part)
    return [*out, "\n".join(open_)] if open_ else out


def semantic_chunks(df: DataFrame, encode: Encode, how: str = "statistical", text_col: str = "text", keep: list[str] | None = None, **options) -> DataFrame:
    """T8, T9 for each row of df."""
    split = {"statistical": statistical_chunks, "cumulative": cumulative_chunks}.get(how)
    if split is None:
        raise ValueError(f"unknown chunker {how!r}")
    return _each(df, text_col, keep if keep is not None else [c for c in df.columns if c != text_col], lambda t: split(t, encode, **options))
