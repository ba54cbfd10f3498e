"""Audio and images as rows (S16, S18, E26, E30): decoding in Python on Arrow batches, a file at a time."""

from __future__ import annotations

import io
import wave
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions import text

RATE = 16_000
WINDOW_SECONDS = 30


def decode_wav(content: bytes) -> tuple[np.ndarray, int]:
    """(samples of the first channel in [-1, 1], rate)."""
    with wave.open(io.BytesIO(content)) as w:
        raw, width, channels, rate = w.readframes(w.getnframes()), w.getsampwidth(), w.getnchannels(), w.getframerate()
    if width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(float) - 128) / 128
    elif width == 2:
        x = np.frombuffer(raw, "<i2").astype(float) / 32768
    elif width == 4:
        x = np.frombuffer(raw, "<i4").astype(float) / 2147483648
    else:
        raise ValueError(f"samples of {width} bytes")
    return x[::channels].astype(np.float32), rate


def audio_windows(files: DataFrame, seconds: int = WINDOW_SECONDS) -> DataFrame:
    """(path, window, start, duration, samples, error): fixed windows of 16 kHz audio, the last one as long as it is."""
    schema = "path string, window long, start double, duration double, samples array<float>, error string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    x, rate = decode_wav(content)
                    if rate != RATE:
                        raise ValueError(f"audio must be sampled at {RATE} Hz, not {rate}")
                    step = seconds * RATE
                    rows = [(path, k, float(k * seconds), len(x[k * step : (k + 1) * step]) / RATE, x[k * step : (k + 1) * step].tolist(), None) for k in range(-(-len(x) // step))]
                except (ValueError, EOFError, wave.Error) as e:
                    rows = [(path, None, None, None, None, str(e) or type(e).__name__)]
                cols = list(zip(*rows, strict=True)) or [[]] * 6
                kinds = (pa.string(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.float32()), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["path", "window", "start", "duration", "samples", "error"])

    return files.select("path", "content").mapInArrow(run, schema)


def transcribe(windows: DataFrame, recognise: Callable[[np.ndarray], tuple[str, float, float]]) -> DataFrame:
    """(path, start, duration, text, avg_logprob, no_speech_prob): each window by a plug-in transcriber."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [recognise(np.asarray(x, np.float32)) for x in b.column(3).to_pylist()]
            cols = list(zip(*got, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(3)), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.float64())], ["path", "start", "duration", "text", "avg_logprob", "no_speech_prob"])

    whole = windows.filter("samples is not null").select("path", "start", "duration", "samples")
    return whole.mapInArrow(run, "path string, start double, duration double, text string, avg_logprob double, no_speech_prob double")


def base64_images(df: DataFrame, col: str) -> DataFrame:
    """Df with image (bytes) and image_kind where col holds an image in base64 or a data URL, else null."""
    payload = F.regexp_replace(F.regexp_replace(F.col(col), "^data:image/[^,]*,", ""), f"{text.SPACE}+", "")
    raw = F.when(text.is_base64_image(F.col(col)), F.try_to_binary(payload, F.lit("base64")))
    return df.withColumn("image", raw).withColumn("image_kind", text.image_kind(F.col("image")))


def preprocess(pixels: np.ndarray, size: int = 224, mean: tuple[float, ...] = (0.5, 0.5, 0.5), std: tuple[float, ...] = (0.5, 0.5, 0.5)) -> np.ndarray:
    """(height, width, 3) of bytes to (3, size, size): the centre of the image scaled to fill, then (x / 255 - mean) / std."""
    h, w, _ = pixels.shape
    side = min(h, w)
    top, left = (h - side) // 2, (w - side) // 2
    at = lambda n: ((np.arange(size) + 0.5) * n / size - 0.5).clip(0, n - 1)
    y, x = at(side) + top, at(side) + left
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = (y - y0)[:, None, None], (x - x0)[None, :, None]
    p = pixels.astype(float)
    out = (p[y0][:, x0] * (1 - fy) + p[y1][:, x0] * fy) * (1 - fx) + (p[y0][:, x1] * (1 - fy) + p[y1][:, x1] * fy) * fx
    return ((out / 255 - np.array(mean)) / np.array(std)).transpose(2, 0, 1)


def tiles(height: int, width: int, most: int = 364) -> list[tuple[int, int, int, int]]:
    """(top, left, height, width) of the tiles of at most so many pixels a side that cover an image, and the whole last."""
    rows, cols = -(-height // most), -(-width // most)
    cut = lambda n, k: [n * i // k for i in range(k + 1)]
    y, x = cut(height, rows), cut(width, cols)
    grid = [(y[i], x[j], y[i + 1] - y[i], x[j + 1] - x[j]) for i in range(rows) for j in range(cols)] if rows * cols > 1 else []
    return [*grid, (0, 0, height, width)]
