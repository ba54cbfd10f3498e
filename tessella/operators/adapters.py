"""Sinks (K0-K9, P12): what each kind of vector store is given, and the interface to write one.

An adapter's convert is a projection, so it stays in the plan; upsert gets converted rows partition by partition, or batch by
batch from a stream. Ids are hashes of what a row holds, so a repeated write replaces rows in place of adding them.
Input rows have (embedding, text, file_name, modified, created).
"""

from __future__ import annotations

import json
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import text


def row_id(*columns: str) -> Column:
    return F.sha2(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)), 256)


class Adapter(ABC):
    """K0."""

    @abstractmethod
    def create_index(self, dimension: int, **options) -> None: ...

    @abstractmethod
    def delete_index(self) -> None: ...

    @abstractmethod
    def convert(self, rows: DataFrame) -> DataFrame: ...

    @abstractmethod
    def upsert(self, rows: DataFrame) -> None: ...


class CallbackAdapter(Adapter):
    """K1, K2: rows are handed to a function in lists of at most buffer_size, on the executors."""

    def __init__(self, write: Callable[[list[dict]], None], convert: Callable[[DataFrame], DataFrame] = lambda df: df, buffer_size: int = 100) -> None:
        self.write, self._convert, self.buffer_size = write, convert, buffer_size

    def create_index(self, dimension: int, **options) -> None:
        """The function's store is there already."""

    def delete_index(self) -> None:
        """As create_index."""

    def convert(self, rows: DataFrame) -> DataFrame:
        return self._convert(rows)

    def upsert(self, rows: DataFrame) -> None:
        write, size = self.write, self.buffer_size

        def run(part: Iterable) -> None:
            buffer: list[dict] = []
            for r in part:
                buffer.append(r.asDict(recursive=True))
                if len(buffer) == size:
                    write(buffer)
                    buffer = []
            if buffer:
                write(buffer)

        self.convert(rows).foreachPartition(run)


class TableAdapter(Adapter):
    """K6: a folder of Parquet files with the flat columns."""

    def __init__(self, path: str) -> None:
        self.path = path
        self.dimension: int | None = None

    def create_index(self, dimension: int, **options) -> None:
        self.dimension = dimension

    def delete_index(self) -> None:
        self.dimension = None

    def convert(self, rows: DataFrame) -> DataFrame:
        return flat5(rows)

    def upsert(self, rows: DataFrame) -> None:
        self.convert(rows).write.mode("append").parquet(self.path)


def flat5(rows: DataFrame) -> DataFrame:
    """K5, K6: five flat columns."""
    return rows.select(F.col("embedding").alias("embeddings"), "text", "file_name", "modified", "created")


def capped5(rows: DataFrame) -> DataFrame:
    """K5: the same with the widths of that store's VARCHAR columns."""
    return flat5(rows).select("embeddings", *(F.substring(c, 1, n).alias(c) for c, n in (("text", 4098), ("file_name", 255), ("modified", 50), ("created", 50))))


def id_values_metadata(rows: DataFrame) -> DataFrame:
    """K3: (id, values, metadata_text, metadata_file)."""
    return rows.select(row_id("file_name", "text").alias("id"), F.col("embedding").alias("values"), F.col("text").alias("metadata_text"), text.basename(F.col("file_name")).alias("metadata_file"))


def point_payload(rows: DataFrame) -> DataFrame:
    """K4: (id, vector, payload)."""
    return rows.select(row_id("file_name", "text").alias("id"), F.col("embedding").alias("vector"), F.struct("text", "file_name", "modified", "created").alias("payload"))


def columnar(rows: DataFrame, buffer: str) -> DataFrame:
    """K7: a row a buffer with a list for each column, in the order of the ids. A buffer's size bounds the lists."""
    one = F.struct(row_id("file_name", "text").alias("id"), "text", "file_name")
    every = rows.groupBy(buffer).agg(F.array_sort(F.collect_list(one)).alias("rows"))
    return every.select(buffer, *(F.col(f"rows.{c}").alias(name) for c, name in (("id", "ids"), ("text", "documents"), ("file_name", "file_names"))))


def nested_json(rows: DataFrame) -> DataFrame:
    """K8: one JSON document a row."""
    return rows.select(F.to_json(F.struct("text", F.col("embedding").alias("embeddings"), F.struct("file_name", "modified", "created").alias("metadata"))).alias("document"))


def properties(rows: DataFrame) -> DataFrame:
    """K9: (vector, properties): metadata and text in one map."""
    meta = F.create_map(*(x for c in ("file_name", "modified", "created") for x in (F.lit(c), F.col(c))))
    return rows.select(F.col("embedding").alias("vector"), F.map_concat(meta, F.create_map(F.lit("text"), F.col("text"))).alias("properties"))


def embedding_response(rows: list[dict], model: str, usage: int) -> str:
    """The answer to an embeddings request; dense and multi vectors both stay what they are."""
    data = [{"object": "embedding", "index": i, "embedding": r["embedding"]} for i, r in enumerate(rows)]
    return json.dumps({"object": "list", "data": data, "model": model, "usage": {"prompt_tokens": usage, "total_tokens": usage}})


def error_response(message: str, kind: str = "invalid_request_error") -> str:
    return json.dumps({"error": {"message": message, "type": kind, "param": None, "code": None}})
