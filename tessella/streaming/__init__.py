"""Incremental indexing."""

from tessella.streaming.index import stream_directory, stream_table

__all__ = ["stream_directory", "stream_table"]
