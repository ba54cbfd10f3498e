"""The catalog of known models and a builder for embedders (S19, E3, E6, E27). Files are looked for locally; nothing is downloaded."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tessella.config import Pooling, default_pooling
from tessella.operators.embed import CloudEmbedder, Embedder, OnnxEmbedder

#: dimension, then the repositories of that dimension; a + behind a name says that it holds a quantised variant as well.
_TEXT = """
384 Qdrant/all-MiniLM-L6-v2-onnx Xenova/all-MiniLM-L6-v2 Xenova/all-MiniLM-L12-v2+ Xenova/bge-small-en-v1.5 Qdrant/bge-small-en-v1.5-onnx-Q
384 Qdrant/paraphrase-multilingual-MiniLM-L12-v2-onnx-Q Xenova/paraphrase-multilingual-MiniLM-L12-v2 intfloat/multilingual-e5-small onnx-models/jina-colbert-v1-en-onnx
512 Xenova/bge-small-zh-v1.5 jinaai/jina-embeddings-v2-small-en
768 nomic-ai/modernbert-embed-base Xenova/bge-base-en-v1.5 Qdrant/bge-base-en-v1.5-onnx-Q nomic-ai/nomic-embed-text-v1 nomic-ai/nomic-embed-text-v1.5
768 Qdrant/nomic-embed-text-v1.5-onnx-Q Xenova/paraphrase-multilingual-mpnet-base-v2 intfloat/multilingual-e5-base Alibaba-NLP/gte-base-en-v1.5+
768 jinaai/jina-embeddings-v2-base-en jinaai/jina-embeddings-v3 prithivida/Splade_PP_en_v1 prithivida/Splade_PP_en_v2 onnx-community/Qwen3-Embedding-0.6B-ONNX
1024 answerdotai/ModernBERT-large Xenova/bge-large-en-v1.5 Qdrant/bge-large-en-v1.5-onnx-Q Qdrant/multilingual-e5-large-onnx mixedbread-ai/mxbai-embed-large-v1+
1024 Alibaba-NLP/gte-large-en-v1.5+
"""
SPEECH = ("tiny", "base", "small", "medium", "large", "large-v2", "large-v3", "distil-large-v2", "distil-large-v3", "tiny-en", "base-en", "small-en", "medium-en", "distil-medium-en")


@dataclass(frozen=True)
class ModelInfo:
    repo: str
    dim: int
    quantized: bool

    @property
    def name(self) -> str:
        return self.repo.partition("/")[2]

    @property
    def pooling(self) -> Pooling:
        return default_pooling(self.name)


def _parse() -> list[ModelInfo]:
    out = []
    for line in _TEXT.split("\n"):
        dim, *repos = line.split() or [""]
        for r in repos:
            out.append(ModelInfo(r.rstrip("+"), int(dim), False))
            if r.endswith("+"):
                out.append(ModelInfo(r.rstrip("+"), int(dim), True))
    return out


MODELS = _parse()


def model_info(name: str, quantized: bool = False) -> ModelInfo:
    """By repository or by its last part; ValueError for one that isn't known."""
    found = [m for m in MODELS if name.lower() in (m.repo.lower(), m.name.lower())]
    if not found:
        raise ValueError(f"unknown model {name!r}")
    return next((m for m in found if m.quantized == quantized), found[0])


def list_models(spark: SparkSession) -> DataFrame:
    """(repo, name, dim, quantized, pooling)."""
    return spark.createDataFrame([(m.repo, m.name, m.dim, m.quantized, m.pooling.value) for m in MODELS], "repo string, name string, dim int, quantized boolean, pooling string")


def is_multilingual(speech_model: str) -> bool:
    """E27."""
    if speech_model not in SPEECH:
        raise ValueError(f"unknown speech model {speech_model!r}")
    return not speech_model.endswith("-en")


class EmbedderBuilder:
    """Options one by one, then build(). Exactly one of a model folder and a service's model has to be given."""

    def __init__(self) -> None:
        self._folder: str | None = None
        self._service: tuple[str, str] | None = None
        self._options: dict = {}

    def model_folder(self, path: str, file: str = "model.onnx") -> EmbedderBuilder:
        self._folder = path
        self._options["model_file"] = file
        return self

    def service(self, name: str, model: str) -> EmbedderBuilder:
        self._service = (name, model)
        return self

    def pooling(self, how: Pooling) -> EmbedderBuilder:
        self._options["pooling"] = how
        return self

    def max_length(self, tokens: int) -> EmbedderBuilder:
        self._options["max_length"] = tokens
        return self

    def key(self, value: str) -> EmbedderBuilder:
        self._options["key"] = value
        return self

    def build(self) -> Embedder:
        if (self._folder is None) == (self._service is None):
            raise ValueError("give a model folder or a service, one of the two")
        if self._service:
            return CloudEmbedder(*self._service, key=self._options.get("key"))
        if not os.path.isdir(self._folder):
            raise FileNotFoundError(self._folder)
        return OnnxEmbedder(self._folder, **{k: v for k, v in self._options.items() if k != "key"})
