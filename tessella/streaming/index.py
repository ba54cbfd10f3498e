"""Structured Streaming from a directory to an adapter.

Each micro-batch takes at most max_files new files, extracts, chunks and embeds them, and hands the rows to the adapter. The
checkpoint remembers the files that are done, so a restart goes on where it stopped; an adapter whose ids depend on
the rows alone makes the repeat of a batch harmless. Rows are the same as those of the batch job over the same files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.config import TextEmbedConfig
from tessella.functions import text
from tessella.operators import chunk
from tessella.operators.adapters import Adapter
from tessella.operators.embed import Embedder
from tessella.sources import files

FILE = "path string, modificationTime timestamp, length long, content binary"


def chunk_rows(extracted: DataFrame, embedder: Embedder, config: TextEmbedConfig) -> DataFrame:
    """(embedding, text, file_name, modified, created, chunk_idx) of extracted files; files with an error have none."""
    good = extracted.filter("text is not null").select(F.col("path").alias("file_name"), "modified", "text")
    if config.late_chunking:
        return _late(good, embedder, config)
    parts = chunk.markdown_chunks(good, keep=["file_name", "modified"], size=config.chunk_size, overlap=config.overlap)
    rows = embedder.embed(parts, "chunk", "embedding", config.batch_size)
    return rows.select("embedding", F.col("chunk").alias("text"), "file_name", "modified", F.lit(None).cast("string").alias("created"), "chunk_idx")


def _late(good: DataFrame, embedder: Embedder, config: TextEmbedConfig) -> DataFrame:
    """The chunks of a file together, whose context never crosses into another file."""
    parts = chunk.fixed_chunks(F.col("text"), config.chunk_size, config.overlap)
    rows = embedder.embed_chunks(good.withColumn("chunks", parts), "chunks", "vectors", late=True)
    rows = rows.select("file_name", "modified", F.posexplode(F.arrays_zip("chunks", "vectors")).alias("chunk_idx", "c"))
    return rows.select(F.col("c.vectors").alias("embedding"), F.col("c.chunks").alias("text"), "file_name", "modified", F.lit(None).cast("string").alias("created"), F.col("chunk_idx").cast("long"))


def stream_directory(
    spark: SparkSession, directory: str, embedder: Embedder, adapter: Adapter, checkpoint: str, extensions: list[str] | None = None, config: TextEmbedConfig | None = None,
    max_files: int = 100, once: bool = True, progress: Callable[[int, int], None] | None = None,
):
    """The running query; with once it ends when the files that are there are done.

    progress gets the number of the batch and of the files in it.
    """
    config = config or TextEmbedConfig()
    source = spark.readStream.format("binaryFile").schema(FILE).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", max_files).load(directory)

    def each(batch: DataFrame, number: int) -> None:
        found = batch.filter(F.col("path").rlike(files._pattern(extensions or files.TEXT)))
        stamp = F.date_format("modificationTime", "yyyy-MM-dd HH:mm:ss").alias("modified")
        rows = found.select("path", text.basename(F.col("path")).alias("file_name"), text.extension(F.col("path")).alias("extension"), stamp, F.col("length").alias("size"), "content")
        adapter.upsert(chunk_rows(files.extract(rows), embedder, config))
        if progress:
            progress(number, found.select("path").distinct().count())

    writer = source.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def stream_table(spark: SparkSession, path: str, schema, write: Callable[[DataFrame, int], None], checkpoint: str, transform: Callable[[DataFrame], DataFrame] = lambda df: df, max_files: int = 100):
    """A Parquet folder as a stream, transformed and handed on batch by batch until what is there is done."""
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)
    return transform(source).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
