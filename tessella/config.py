"""Settings of embedding jobs, checked when they are made."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum


class Pooling(Enum):
    """How token vectors become one vector."""

    MEAN = "mean"
    CLS = "cls"
    LAST = "last"
    NONE = "none"


class Dtype(Enum):
    F32 = "f32"
    F16 = "f16"
    INT8 = "int8"
    UINT8 = "uint8"
    Q4 = "q4"


class SplittingStrategy(Enum):
    SENTENCE = "sentence"
    SEMANTIC = "semantic"


#: Default pooling by model family (A4); any other family is pooled by the mean.
FAMILY_POOLING = {
    "bge": Pooling.CLS,
    "mxbai": Pooling.CLS,
    "gte": Pooling.CLS,
    "qwen3": Pooling.LAST,
    "colbert": Pooling.NONE,
}


def default_pooling(model: str) -> Pooling:
    """A4: the pooling of the family whose name the model's id holds."""
    name = model.lower()
    return next((p for family, p in FAMILY_POOLING.items() if family in name), Pooling.MEAN)


def _positive(**values: int) -> None:
    for name, value in values.items():
        if value is not None and value < 1:
            raise ValueError(f"{name} must be positive, got {value}")


@dataclass(frozen=True)
class TextEmbedConfig:
    """Chunking and batching of texts.

    The overlap in characters is chunk_size * overlap_ratio, rounded down (T5). buffer_size is the number of chunks
    handed to an adapter at once, batch_size that of one call of the model.
    """

    chunk_size: int = 1000
    batch_size: int = 32
    buffer_size: int = 100
    overlap_ratio: float = 0.0
    splitting_strategy: SplittingStrategy = SplittingStrategy.SENTENCE
    late_chunking: bool = False
    use_ocr: bool = False
    tesseract_path: str | None = None
    pdf_backend: str = "lopdf"

    def __post_init__(self) -> None:
        _positive(chunk_size=self.chunk_size, batch_size=self.batch_size, buffer_size=self.buffer_size)
        if not 0 <= self.overlap_ratio < 1:
            raise ValueError(f"overlap_ratio must be in [0, 1), got {self.overlap_ratio}")

    @property
    def overlap(self) -> int:
        return int(self.chunk_size * self.overlap_ratio)


@dataclass(frozen=True)
class ImageEmbedConfig:
    buffer_size: int = 100
    batch_size: int = 32

    def __post_init__(self) -> None:
        _positive(buffer_size=self.buffer_size, batch_size=self.batch_size)


@dataclass(frozen=True)
class VideoEmbedConfig:
    """Every frame_step-th frame, at most max_frames of a video (None: all)."""

    frame_step: int = 30
    max_frames: int | None = 300
    batch_size: int = 32

    def __post_init__(self) -> None:
        _positive(frame_step=self.frame_step, max_frames=self.max_frames or None, batch_size=self.batch_size)
