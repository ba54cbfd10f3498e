"""Embedders: text columns to vector columns.

An embedder turns lists of strings into arrays. ``embed`` runs it over Arrow batches in mini-batches of batch_size
and adds the vectors as a column; rows keep their other columns, so nothing has to be zipped back. The hashing
embedders need no model: a text's tokens (runs of ASCII letters and digits, in lower case) are hashed to dim buckets, which SQL
can do as well. They stand in for the contract of a model, not for its quality.

Null text gives a null vector, a text without tokens the zero vector. Vectors have length 1 otherwise.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.config import Pooling, default_pooling
from tessella.functions import batches as parts
from tessella.functions import text as text_functions
from tessella.functions import vector
from tessella.schema import extended

_TOKEN = re.compile("[A-Za-z0-9]+")


def tokenize(value: str) -> list[str]:
    return [t.lower() for t in _TOKEN.findall(value)]


class _Hashes(dict):
    """The first 32 bits of a token's md5; what it keeps is bounded."""

    def __init__(self, most: int = 1 << 16) -> None:
        self.most = most

    def __missing__(self, token: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[token] = value = int.from_bytes(hashlib.md5(token).digest()[:4], "big")
        return value


_HASHES = _Hashes()


def _hash(token: str) -> int:
    return _HASHES[token.encode()]


def normalize(v: np.ndarray) -> np.ndarray:
    """A5, by rows: a zero vector stays one."""
    size = np.sqrt((v * v).sum(-1, keepdims=True))
    return np.divide(v, size, out=np.zeros_like(v), where=size > 0)


class Embedder(ABC):
    """One vector a text."""

    batch_size = 32

    @abstractmethod
    def encode(self, texts: list[str]) -> np.ndarray:
        """(texts, dim), in the order of the texts."""

    def embed(self, df: DataFrame, text_col: str = "text", out_col: str = "embedding", batch_size: int | None = None) -> DataFrame:
        """df with a column more; array<double>, rounded to 6 places."""
        size, schema = batch_size or self.batch_size, extended(df.schema, **{out_col: "array<double>"})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                at = whole.schema.get_field_index(text_col)
                for b in parts.slices(whole, at, size):
                    yield pa.RecordBatch.from_arrays([*b.columns, vectors_of(b.column(at).to_pylist(), self.encode, size)], schema.names)

        return df.mapInArrow(parts.tidy(run), schema)

    def embed_query(self, queries: list[str]) -> list[list[float]]:
        """On the driver, for a handful of strings."""
        return np.round(self.encode(list(queries)), 6).tolist() if queries else []

    def embed_chunks(self, df: DataFrame, chunks_col: str, out_col: str = "vectors", late: bool = False) -> DataFrame:
        """df with a vector for each of a document's chunks (array<string>); late: each chunk in the context of the document."""
        encode, schema = self.encode_late if late else self.encode, extended(df.schema, **{out_col: "array<array<double>>"})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                lists = b.column(b.schema.get_field_index(chunks_col)).to_pylist()
                made = [None if x is None else np.round(encode(x), 6).tolist() if x else [] for x in lists]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.list_(pa.list_(pa.float64())))], schema.names)

        return df.mapInArrow(run, schema)

    def encode_late(self, chunks: list[str]) -> np.ndarray:
        """The chunks of one document; without a context of its own an embedder encodes them one by one."""
        return self.encode(chunks)


def vectors_of(texts: list[str | None], encode: Callable[[list[str]], np.ndarray], size: int) -> pa.Array:
    """Vectors as an Arrow list column, null where the text is."""
    some = [i for i, t in enumerate(texts) if t is not None]
    parts = [np.round(encode([texts[i] for i in some[k : k + size]]), 6) + 0.0 for k in range(0, len(some), size)]
    flat = np.concatenate(parts).astype(float) if parts else np.empty((0, 0))
    length = np.zeros(len(texts), np.int64)
    length[some] = flat.shape[1]
    off = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
    null = np.ones(len(texts), bool)
    null[some] = False
    return pa.ListArray.from_arrays(pa.array(off), pa.array(flat.ravel()), mask=pa.array(null))


class HashingEmbedder(Embedder):
    """Counts of hashed tokens; with sparse the logarithm of 1 + the count (A6, E10), without normalising."""

    batch_size = 1024

    def __init__(self, dim: int = 64, sparse: bool = False, context: int = 2) -> None:
        if dim < 1:
            raise ValueError("dim must be positive")
        self.dim, self.sparse, self.context = dim, sparse, context

    def _counts(self, lists: list[list[bytes]]) -> np.ndarray:
        row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        bucket = np.fromiter(map(_HASHES.__getitem__, chain.from_iterable(lists)), np.int64, len(row)) % self.dim
        return np.bincount(row * self.dim + bucket, minlength=len(lists) * self.dim).reshape(len(lists), self.dim).astype(float)

    def counts(self, texts: list[str]) -> np.ndarray:
        """(texts, dim): tokens a bucket. Those of texts add up to that of the texts joined by white space."""
        out, at = np.zeros((len(texts), self.dim)), 0
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and size < parts.SLICE_BYTES:
                size += len(texts[to])
                to += 1
            out[at:to] = self._counts([parts.tokens(t) for t in texts[at:to]])
            at = to
        return out

    def encode(self, texts: list[str]) -> np.ndarray:
        counts = self.counts(texts)
        return np.log1p(counts) if self.sparse else normalize(counts)

    def encode_late(self, chunks: list[str]) -> np.ndarray:
        """A token's state is its own bucket and, with half the weight, those of the tokens around it in the document."""
        lists = [parts.tokens(c) for c in chunks]
        states = self._counts([[t] for x in lists for t in x])
        mixed = states.copy()
        for k in range(1, self.context + 1):
            mixed[k:] += 0.5 * states[:-k]
            mixed[:-k] += 0.5 * states[k:]
        ends = np.cumsum([len(x) for x in lists])
        return normalize(np.stack([mixed[e - len(x) : e].sum(0) if x else np.zeros(self.dim) for x, e in zip(lists, ends, strict=True)]))

    def as_column(self, value: Column) -> Column:
        """The same vector in the JVM alone, for plans that must not leave it; slower than the Arrow way for long texts."""
        bucket = F.transform(text_functions.tokens(value), lambda t: text_functions.hash_bucket(t, self.dim))
        counts = F.transform(F.sequence(F.lit(0), F.lit(self.dim - 1)), lambda d: F.size(F.filter(bucket, lambda b: b == d)).cast("double"))
        return F.when(value.isNotNull(), F.transform(counts, F.log1p) if self.sparse else vector.l2_normalize(counts))


class MultiVectorEmbedder:
    """A vector a token, each of length 1; queries are padded to query_tokens with a mask token's vector."""

    def __init__(self, dim: int = 64, query_tokens: int = 32) -> None:
        self.dim, self.query_tokens = dim, query_tokens

    def encode(self, value: str, is_doc: bool = True) -> np.ndarray:
        tokens = ["[d]" if is_doc else "[q]", *tokenize(value)]
        if not is_doc:
            tokens = (tokens + ["[mask]"] * self.query_tokens)[: max(self.query_tokens, len(tokens))]
        out = np.zeros((len(tokens), self.dim))
        out[np.arange(len(tokens)), [_hash(t) % self.dim for t in tokens]] = 1
        return out

    def embed(self, df: DataFrame, text_col: str = "text", out_col: str = "multi", is_doc: bool = True) -> DataFrame:
        schema = extended(df.schema, **{out_col: "array<array<double>>"})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                texts = b.column(b.schema.get_field_index(text_col)).to_pylist()
                made = [None if t is None else self.encode(t, is_doc).tolist() for t in texts]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.list_(pa.list_(pa.float64())))], schema.names)

        return df.mapInArrow(run, schema)


class StaticEmbedder(Embedder):
    """The mean of the rows of a token table, of length 1; tokens that the table lacks don't count."""

    def __init__(self, table: dict[str, list[float]]) -> None:
        if not table:
            raise ValueError("an empty token table")
        self.index = {t: i for i, t in enumerate(table)}
        self.vectors = np.array(list(table.values()), float)

    def encode(self, texts: list[str]) -> np.ndarray:
        rows = [[self.index[t] for t in tokenize(x) if t in self.index] for x in texts]
        return normalize(np.stack([self.vectors[r].mean(0) if r else np.zeros(self.vectors.shape[1]) for r in rows]))


def pool(hidden: np.ndarray, mask: np.ndarray, how: Pooling) -> np.ndarray:
    """A1-A3 over (texts, tokens, dim) and (texts, tokens): mean, first or last token whose mask isn't 0."""
    on = mask != 0
    if how is Pooling.MEAN:
        return (hidden * on[..., None]).sum(1) / np.maximum(on.sum(1), 1e-10)[:, None]
    if not on.any(1).all():
        raise ValueError("a text whose tokens are all padding can't be pooled")
    at = on.argmax(1) if how is Pooling.CLS else on.shape[1] - 1 - on[:, ::-1].argmax(1)
    return hidden[np.arange(len(hidden)), at]


class OnnxEmbedder(Embedder):
    """A local ONNX model with its tokenizer file, opened once in each Python worker.

    folder holds model_file and tokenizer.json. Texts are cut to max_length tokens and padded to the longest of a mini-batch.
    Vectors are pooled, unless the model gives one a text, and brought to length 1.
    """

    def __init__(self, folder: str, model_file: str = "model.onnx", pooling: Pooling | None = None, max_length: int = 512) -> None:
        for name in (model_file, "tokenizer.json"):
            if not os.path.exists(os.path.join(folder, name)):
                raise FileNotFoundError(os.path.join(folder, name))
        self.folder, self.model_file, self.max_length = folder, model_file, max_length
        self.pooling = pooling or default_pooling(os.path.basename(folder.rstrip("/")))

    def encode(self, texts: list[str]) -> np.ndarray:
        session, tokenizer = _onnx(self.folder, self.model_file, self.max_length)
        rows = tokenizer.encode_batch(list(texts))
        ids, mask = (np.array([getattr(r, f) for r in rows], np.int64) for f in ("ids", "attention_mask"))
        feed = {"input_ids": ids, "attention_mask": mask, "token_type_ids": np.zeros_like(ids)}
        wanted = {x.name for x in session.get_inputs()}
        out = session.run(None, {k: v for k, v in feed.items() if k in wanted})[0].astype(float)
        return normalize(out if out.ndim == 2 else pool(out, mask, self.pooling))


@lru_cache(maxsize=2)
def _onnx(folder: str, model_file: str, max_length: int):
    import onnxruntime
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(os.path.join(folder, "tokenizer.json"))
    tokenizer.enable_truncation(max_length)
    tokenizer.enable_padding()
    return onnxruntime.InferenceSession(os.path.join(folder, model_file)), tokenizer


class CloudEmbedder(Embedder):
    """An HTTP service. post(url, headers, body) gives the answer's JSON; by default with urllib.

    The key is read from the environment of the process that calls, unless given.
    """

    SERVICES = {
        "openai": ("https://api.openai.com/v1/embeddings", "OPENAI_API_KEY"),
        "cohere": ("https://api.cohere.com/v1/embed", "CO_API_KEY"),
        "gemini": ("https://generativelanguage.googleapis.com/v1beta/models/{model}:batchEmbedContents", "GEMINI_API_KEY"),
    }

    def __init__(self, service: str, model: str, key: str | None = None, post: Callable[[str, dict, dict], dict] | None = None) -> None:
        if service not in self.SERVICES:
            raise ValueError(f"unknown service {service!r}: {', '.join(sorted(self.SERVICES))}")
        self.service, self.model, self.post = service, model, post or _post
        self.key = key or os.environ.get(self.SERVICES[service][1])
        if not self.key:
            raise ValueError(f"no key: set {self.SERVICES[service][1]}")

    def encode(self, texts: list[str]) -> np.ndarray:
        url = self.SERVICES[self.service][0].format(model=self.model)
        if self.service == "openai":
            got = self.post(url, {"Authorization": f"Bearer {self.key}"}, {"model": self.model, "input": texts})
            vectors = [x["embedding"] for x in sorted(got["data"], key=lambda x: x["index"])]
        elif self.service == "cohere":
            got = self.post(url, {"Authorization": f"Bearer {self.key}"}, {"model": self.model, "texts": texts, "input_type": "search_document"})
            vectors = got["embeddings"]
        else:
            part = lambda t: {"model": f"models/{self.model}", "content": {"parts": [{"text": t}]}, "taskType": "SEMANTIC_SIMILARITY"}
            got = self.post(url, {"x-goog-api-key": self.key}, {"requests": [part(t) for t in texts]})
            vectors = [x["values"] for x in got["embeddings"]]
        if len(vectors) != len(texts):
            raise ValueError(f"{len(texts)} texts, but {len(vectors)} vectors")
        return np.array(vectors, float)


def _post(url: str, headers: dict, body: dict) -> dict:
    from urllib.request import Request, urlopen

    request = Request(url, json.dumps(body).encode(), headers | {"Content-Type": "application/json"})
    with urlopen(request, timeout=60) as answer:  # an error status raises
        return json.load(answer)


def from_name(name: str, **options) -> Embedder:
    """E1-E6: "hashing", "hashing-sparse", "openai:model", "cohere:model", "gemini:model" or a folder with an ONNX model."""
    service, _, model = name.partition(":")
    if name == "hashing":
        return HashingEmbedder(**options)
    if name == "hashing-sparse":
        return HashingEmbedder(sparse=True, **options)
    if service in CloudEmbedder.SERVICES and model:
        return CloudEmbedder(service, model, **options)
    if os.path.isdir(name):
        return OnnxEmbedder(name, **options)
    raise ValueError(f"no embedder {name!r}")
