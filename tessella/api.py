"""Entry points by the names a user of an embedding library looks for; each takes or gives DataFrames.

Rows of texts are (embedding, text, file_name, modified, created, chunk_idx). With an adapter the rows are written and None is
given, without one they are returned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.config import TextEmbedConfig, VideoEmbedConfig
from tessella.operators import chunk, media
from tessella.operators.adapters import Adapter
from tessella.operators.embed import Embedder, MultiVectorEmbedder
from tessella.operators.vision import ImageEmbedder, PageEmbedder
from tessella.sources import files
from tessella.streaming.index import chunk_rows


def _out(rows: DataFrame, adapter: Adapter | None) -> DataFrame | None:
    if adapter is None:
        return rows
    adapter.upsert(rows)
    return None


def embed_query(spark: SparkSession, queries: list[str], embedder: Embedder) -> DataFrame:
    """(query_id, text, embedding) in the order of the queries."""
    return embedder.embed(spark.createDataFrame(list(enumerate(queries)), "query_id long, text string"), "text")


def embed_text(df: DataFrame, text_col: str, embedder: Embedder, config: TextEmbedConfig | None = None) -> DataFrame:
    """Rows of df in chunks with their vectors."""
    config = config or TextEmbedConfig()
    keep = [c for c in df.columns if c != text_col]
    return embedder.embed(chunk.markdown_chunks(df, text_col, keep, config.chunk_size, config.overlap), "chunk", "embedding", config.batch_size)


def embed_files(spark: SparkSession, paths: list[str], embedder: Embedder, config: TextEmbedConfig | None = None, adapter: Adapter | None = None) -> DataFrame | None:
    """Given files; FileNotFoundError or ValueError for one that can't be read at all."""
    return _out(chunk_rows(files.extract(files.read_files(spark, paths)), embedder, config or TextEmbedConfig()), adapter)


def embed_file(spark: SparkSession, path: str, embedder: Embedder, config: TextEmbedConfig | None = None, adapter: Adapter | None = None) -> DataFrame | None:
    return embed_files(spark, [path], embedder, config, adapter)


def embed_directory(
    spark: SparkSession, directory: str, embedder: Embedder, extensions: list[str] | None = None, config: TextEmbedConfig | None = None, adapter: Adapter | None = None, indexed: DataFrame | None = None
) -> DataFrame | None:
    """X1 as one job; files whose path is in indexed (path) are left out. Unreadable files are skipped, see files.extract()."""
    found = files.scan(spark, directory, extensions)
    if indexed is not None:
        found = files.not_indexed(found, indexed)
    return _out(chunk_rows(files.extract(found), embedder, config or TextEmbedConfig()), adapter)


def embed_pages(pages: DataFrame, embedder: Embedder, config: TextEmbedConfig | None = None, adapter: Adapter | None = None) -> DataFrame | None:
    """Web pages (url, html), as fetched."""
    config = config or TextEmbedConfig()
    parts = chunk.html_chunks(pages, "html", ["url"], config.chunk_size, config.overlap)
    rows = embedder.embed(parts, "chunk", "embedding", config.batch_size)
    none = F.lit(None).cast("string")
    return _out(rows.select("embedding", F.col("chunk").alias("text"), F.col("url").alias("file_name"), none.alias("modified"), none.alias("created"), "chunk_idx"), adapter)


def embed_images(spark: SparkSession, directory: str, embedder: ImageEmbedder, adapter: Adapter | None = None) -> DataFrame | None:
    """(embedding, text, file_name, modified, created, error) of the images below a directory; text is null."""
    rows = embedder.embed(files.scan_images(spark, directory).select("path", "modified", "content"))
    none = F.lit(None).cast("string")
    return _out(rows.select("embedding", none.alias("text"), F.col("path").alias("file_name"), "modified", none.alias("created"), "error"), adapter)


def embed_pages_multi(pages: DataFrame, embedder: PageEmbedder) -> DataFrame:
    """Page images (…, page) with a vector for each tile."""
    return embedder.embed(pages)


def embed_segments(segments: DataFrame, embedder: Embedder) -> DataFrame:
    """Audio segments (start, duration, text, file_name)."""
    return embedder.embed(media.segment_rows(segments), "text")


def embed_frames(frames: DataFrame, embed, config: VideoEmbedConfig | None = None) -> DataFrame:
    """Sampled frames (video, frame, …) given to embed, a function of a DataFrame."""
    config = config or VideoEmbedConfig()
    return embed(media.sample_frames(frames, config.frame_step, config.max_frames))


def embed_multi(df: DataFrame, text_col: str, embedder: MultiVectorEmbedder, is_doc: bool = True) -> DataFrame:
    """A vector a token."""
    return embedder.embed(df, text_col, "multi", is_doc)
