"""Pages and objects from elsewhere (S8-S10, S20, K11). Nothing here is reached without being asked for by name."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HEADERS = {"User-Agent": "Mozilla/5.0 (compatible)", "Accept": "text/html,application/xhtml+xml;q=0.9,*/*;q=0.8", "Accept-Encoding": "gzip"}


def fetch_url(url: str, timeout: float = 30.0) -> str:
    """A page's HTML."""
    import gzip
    from urllib.request import Request, urlopen

    with urlopen(Request(url, headers=HEADERS), timeout=timeout) as answer:
        raw = answer.read()
        raw = gzip.decompress(raw) if answer.headers.get("Content-Encoding") == "gzip" else raw
    return raw.decode("utf-8", "replace")


def fetch_pages(urls: DataFrame, url_col: str = "url", fetch: Callable[[str], str] = fetch_url) -> DataFrame:
    """(url, html, error), a row a URL; fetched on the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pages, errors = [], []
            for url in b.column(0).to_pylist():
                try:
                    pages.append(fetch(url))
                    errors.append(None)
                except (OSError, ValueError) as e:
                    pages.append(None)
                    errors.append(str(e) or type(e).__name__)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pages, pa.string()), pa.array(errors, pa.string())], ["url", "html", "error"])

    return urls.select(F.col(url_col).cast("string").alias("url")).filter("url is not null").mapInArrow(run, "url string, html string, error string")


@dataclass(frozen=True)
class S3File:
    """An object's key and bytes."""

    key: str
    bytes: bytes

    def __len__(self) -> int:
        return len(self.bytes)

    @property
    def size(self) -> int:
        return len(self.bytes)

    def save_file(self, folder: str) -> str:
        """Written under its basename; gives the path."""
        path = os.path.join(folder, os.path.basename(self.key))
        with open(path, "wb") as f:
            f.write(self.bytes)
        return path


@dataclass(frozen=True)
class S3Client:
    """Objects of a store through Spark's s3a file system, which needs its jars on the cluster."""

    access_key: str
    secret_key: str
    region: str = "us-east-1"
    endpoint: str | None = None
    scheme: str = "s3a"

    @classmethod
    def from_env(cls) -> S3Client:
        missing = [k for k in ("AWS_ACCESS_KEY_ID", "AWS_SECRET_ACCESS_KEY") if not os.environ.get(k)]
        if missing:
            raise ValueError(f"not set: {', '.join(missing)}")
        return cls(os.environ["AWS_ACCESS_KEY_ID"], os.environ["AWS_SECRET_ACCESS_KEY"], os.environ.get("AWS_REGION", "us-east-1"), os.environ.get("AWS_ENDPOINT_URL"))

    def options(self) -> dict[str, str]:
        out = {"fs.s3a.access.key": self.access_key, "fs.s3a.secret.key": self.secret_key, "fs.s3a.endpoint.region": self.region}
        return out | ({"fs.s3a.endpoint": self.endpoint} if self.endpoint else {})

    def objects(self, spark: SparkSession, bucket: str, prefix: str = "") -> DataFrame:
        """(path, modificationTime, length, content) of the objects below a prefix."""
        reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        for k, v in self.options().items():
            reader = reader.option(k, v)
        return reader.load(f"{self.scheme}://{bucket}/{prefix}")

    def get_file(self, spark: SparkSession, bucket: str, key: str) -> S3File:
        rows = self.objects(spark, bucket, key).select("content").limit(1).collect()
        if not rows:
            raise FileNotFoundError(key)
        return S3File(key, bytes(rows[0]["content"]))
