"""Images, page images and frames to vectors (E18-E22, E28, E30, X3, V6): the same contract as for texts, over a column of bytes.

A model is a function from pixels to vectors; the histogram embedder needs none and makes the plans testable. PNG files of 8 bits a
channel are decoded with the standard library; other formats need a decoder. An image that can't be decoded gets a null vector
and says why in the error column, the others aren't touched by it.
"""

from __future__ import annotations

import struct
import zlib
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessella.operators.embed import normalize
from tessella.schema import extended
from tessella.sources.media import preprocess, tiles

Decode = Callable[[bytes], np.ndarray]
_CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}


def decode_png(content: bytes) -> np.ndarray:
    """(height, width, 3) of a PNG with 8 bits a channel, not interlaced; grey is repeated, alpha left out."""
    if content[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG file")
    at, data, head = 8, [], None
    while at + 8 <= len(content):
        size, kind = struct.unpack(">I4s", content[at : at + 8])
        part = content[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"IDAT":
            data.append(part)
        at += 12 + size
    if head is None or head[2] != 8 or head[3] not in _CHANNELS or head[6]:
        raise ValueError("only PNG files of 8 bits a channel without interlacing are decoded")
    width, height, n = head[0], head[1], _CHANNELS[head[3]]
    try:
        raw = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, 1 + width * n)
    except (zlib.error, ValueError) as e:
        raise ValueError(f"broken PNG file: {e}") from e
    out = np.zeros((height, width, n), np.uint8)
    above = np.zeros((width, n), np.int64)
    for y in range(height):
        kind, line = raw[y, 0], raw[y, 1:].reshape(width, n).astype(np.int64)
        if kind == 1:
            line = np.cumsum(line, axis=0) & 255
        elif kind == 2:
            line = (line + above) & 255
        elif kind in (3, 4):
            left = corner = np.zeros(n, np.int64)
            for x in range(width):
                if kind == 3:
                    guess = (left + above[x]) // 2
                else:
                    p = left + above[x] - corner
                    a, b, c = abs(p - left), abs(p - above[x]), abs(p - corner)
                    guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, above[x], corner))
                corner = above[x]
                line[x] = left = (line[x] + guess) & 255
        out[y] = above = line
    return np.repeat(out[..., :1], 3, axis=2) if n < 3 else out[..., :3]


def _run(df: DataFrame, col: str, schema, kind: pa.DataType, make: Callable[[bytes], list]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made, errors = [], []
            for raw in b.column(b.schema.get_field_index(col)).to_pylist():
                try:
                    made.append(None if raw is None else make(raw))
                    errors.append(None)
                except ValueError as e:
                    made.append(None)
                    errors.append(str(e))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, kind), pa.array(errors, pa.string())], schema.names)

    return df.mapInArrow(run, schema)


class ImageEmbedder(ABC):
    """One vector an image."""

    def __init__(self, decode: Decode = decode_png) -> None:
        self.decode = decode

    @abstractmethod
    def encode(self, pixels: np.ndarray) -> np.ndarray:
        """The vector of one image (height, width, 3)."""

    def embed(self, df: DataFrame, content_col: str = "content", out_col: str = "embedding") -> DataFrame:
        """df with the vector (array<double>, rounded to 6 places) and error."""
        schema = extended(df.schema, **{out_col: "array<double>", "error": "string"})
        return _run(df, content_col, schema, pa.list_(pa.float64()), lambda raw: (np.round(self.encode(self.decode(raw)), 6) + 0.0).tolist())


class HistogramEmbedder(ImageEmbedder):
    """The share of pixels in each of bins ** 3 colours, of length 1."""

    def __init__(self, bins: int = 4, decode: Decode = decode_png) -> None:
        super().__init__(decode)
        self.bins = bins

    def encode(self, pixels: np.ndarray) -> np.ndarray:
        b = pixels.reshape(-1, 3).astype(np.int64) * self.bins // 256
        return normalize(np.bincount((b[:, 0] * self.bins + b[:, 1]) * self.bins + b[:, 2], minlength=self.bins**3).astype(float))


class ModelEmbedder(ImageEmbedder):
    """A function of preprocessed pixels (3, size, size), its result brought to length 1."""

    def __init__(self, model: Callable[[np.ndarray], np.ndarray], size: int = 224, mean: tuple[float, ...] = (0.5, 0.5, 0.5), std: tuple[float, ...] = (0.5, 0.5, 0.5), decode: Decode = decode_png) -> None:
        super().__init__(decode)
        self.model, self.size, self.mean, self.std = model, size, mean, std

    def encode(self, pixels: np.ndarray) -> np.ndarray:
        return normalize(np.asarray(self.model(preprocess(pixels, self.size, self.mean, self.std)), float))


class PageEmbedder:
    """A vector for each tile of a page image and one for the whole, for late interaction with a query's token vectors."""

    def __init__(self, tile: ImageEmbedder, most: int = 364) -> None:
        self.tile, self.most = tile, most

    def embed(self, df: DataFrame, content_col: str = "page", out_col: str = "multi") -> DataFrame:
        schema = extended(df.schema, **{out_col: "array<array<double>>", "error": "string"})

        def make(raw: bytes) -> list:
            pixels = self.tile.decode(raw)
            return [(np.round(self.tile.encode(pixels[y : y + h, x : x + w]), 6) + 0.0).tolist() for y, x, h, w in tiles(pixels.shape[0], pixels.shape[1], self.most)]

        return _run(df, content_col, schema, pa.list_(pa.list_(pa.float64())), make)
