"""Operators over DataFrames."""

from tessella.operators import adapters, chunk, embed, media, pooling, rerank, search, vision

__all__ = ["adapters", "chunk", "embed", "media", "pooling", "rerank", "search", "vision"]
