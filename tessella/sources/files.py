"""Directories and files as tables.

A scan is Spark's own binary file source, recursive, with the wanted extensions as its filter; columns that a query
doesn't use, the content above all, aren't read. Extensions are matched without regard to case and given with or without a
dot. A missing directory or file is a FileNotFoundError where the scan is made. Files of no bytes are left out.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from zipfile import BadZipFile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import markdown, text
from tessella.schema import extended

TEXT = ("pdf", "md", "txt", "docx")
IMAGE = ("png", "jpg", "jpeg", "gif", "bmp", "tiff", "webp")
AUDIO = ("wav",)
VIDEO = ("mp4", "mov", "avi", "mkv", "webm", "m4v", "flv", "wmv")
#: What extract() can read; pdf needs an extractor.
READABLE = ("md", "txt", "html", "docx", "pdf")


def local_path(path: str) -> str | None:
    """The path on this machine, None for one on another file system."""
    if "://" not in path and not path.startswith("file:"):
        return path
    return re.sub("^file:(//)?", "", path) if path.startswith("file:") else None


def _must_exist(path: str) -> None:
    local = local_path(path)
    if local is not None and not os.path.exists(local):
        raise FileNotFoundError(path)


def _pattern(extensions: tuple[str, ...] | list[str]) -> str:
    names = sorted({e.lstrip(".").lower() for e in extensions})
    return r"(?i)\.(" + "|".join(re.escape(e) for e in names) + ")$"


def scan(spark: SparkSession, directory: str, extensions: tuple[str, ...] | list[str] | None = None) -> DataFrame:
    """(path, file_name, extension, modified, size, content) of the files below a directory; by default those of texts."""
    _must_exist(directory)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(directory)
    files = files.filter(F.col("path").rlike(_pattern(extensions or TEXT)))
    stamp = F.date_format("modificationTime", "yyyy-MM-dd HH:mm:ss")
    return files.select("path", text.basename(F.col("path")).alias("file_name"), text.extension(F.col("path")).alias("extension"), stamp.alias("modified"), F.col("length").alias("size"), "content")


def scan_images(spark: SparkSession, directory: str) -> DataFrame:
    """S2."""
    return scan(spark, directory, IMAGE)


def scan_audio(spark: SparkSession, directory: str) -> DataFrame:
    """S3."""
    return scan(spark, directory, AUDIO)


def scan_video(spark: SparkSession, directory: str) -> DataFrame:
    """S4."""
    return scan(spark, directory, VIDEO)


def is_video(path: str) -> bool:
    """P7."""
    return path.rpartition(".")[2].lower() in VIDEO


def not_indexed(files: DataFrame, indexed: DataFrame, key: str = "path") -> DataFrame:
    """The files whose key isn't among those indexed; a null key is never indexed."""
    return files.join(indexed.select(key).filter(F.col(key).isNotNull()).distinct(), key, "left_anti")


def read_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The rows of scan() for given files. FileNotFoundError or ValueError for one that is missing or unreadable."""
    for p in paths:
        _must_exist(p)
        if p.rpartition(".")[2] not in READABLE:
            raise ValueError(f"unsupported file type: {p} (readable: {', '.join(READABLE)})")
    files = spark.read.format("binaryFile").load(list(paths))
    stamp = F.date_format("modificationTime", "yyyy-MM-dd HH:mm:ss")
    return files.select("path", text.basename(F.col("path")).alias("file_name"), text.extension(F.col("path")).alias("extension"), stamp.alias("modified"), F.col("length").alias("size"), "content")


def docx_text(content: bytes) -> str:
    """A document's paragraphs as Markdown, headings by their style, list items with a dash."""
    import io
    import xml.etree.ElementTree as ET
    import zipfile

    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ET.fromstring(z.read("word/document.xml"))
    out = []
    for p in root.iter(f"{w}p"):
        line = "".join(t.text or "" if t.tag == f"{w}t" else "\t" if t.tag == f"{w}tab" else "\n" if t.tag == f"{w}br" else "" for t in p.iter())
        style = p.find(f"{w}pPr/{w}pStyle")
        name = style.get(f"{w}val", "") if style is not None else ""
        if (m := re.match(r"(?i)heading\s*(\d)", name)) and line:
            line = "#" * int(m.group(1)) + " " + line
        elif p.find(f"{w}pPr/{w}numPr") is not None and line:
            line = "- " + line
        out.append(line)
    return re.sub(r"\n{3,}", "\n\n", "\n\n".join(out)).strip()


def extract(files: DataFrame, pdf: Callable[[bytes], str] | None = None) -> DataFrame:
    """Files with text and error in place of content; one of the two is null.

    Plain texts and Markdown are decoded in the JVM, U+FFFD in place of what isn't UTF-8. HTML becomes Markdown with its links
    unwrapped. A PDF needs an extractor; without one, and for a broken document, error says what is wrong and the
    other files aren't touched by it.
    """
    keep = [c for c in files.columns if c != "content"]
    plain = files.filter(F.col("extension").isin("md", "txt")).select(*keep, text.lossy_decode(F.col("content")).alias("text"), F.lit(None).cast("string").alias("error"))
    other = files.filter(~F.col("extension").isin("md", "txt")).select(*keep, "content")
    schema = extended(files.select(*keep).schema, text="string", error="string")

    def read(kind: str, content: bytes) -> str:
        if kind == "html":
            return markdown.unwrap_links(markdown.from_html(content.decode("utf-8", "replace")))
        if kind == "docx":
            return docx_text(content)
        if kind == "pdf" and pdf is not None:
            return pdf(content)
        raise ValueError(f"no reader for .{kind} files")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, errors = [], []
            kinds = b.column(b.schema.get_field_index("extension")).to_pylist()
            for kind, content in zip(kinds, b.column(b.num_columns - 1).to_pylist(), strict=True):
                try:
                    texts.append(read(kind, content))
                    errors.append(None)
                except (ValueError, KeyError, SyntaxError, OSError, BadZipFile) as e:
                    texts.append(None)
                    errors.append(str(e) or type(e).__name__)
            own = [b.column(k) for k in range(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(texts, pa.string()), pa.array(errors, pa.string())], schema.names)

    return plain.unionByName(other.mapInArrow(run, schema))


def read_jsonl(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """S22."""
    _must_exist(path)
    return (spark.read.schema(schema) if schema else spark.read).json(path)


def ocr_pages(pages: DataFrame, recognise: Callable[[bytes], str], page_col: str = "page", key: str = "path") -> DataFrame:
    """(key, text) of page images: recognised page by page, joined by line feeds, without blank lines."""
    light = pages.select(key, "page_number", page_col)
    schema = extended(pages.select(key, "page_number").schema, text="string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [None if x is None else recognise(x) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.string())], schema.names)

    lines = light.mapInArrow(run, schema).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("page_number", "text"))).alias("p"))
    return lines.select(key, text.blank_line_clean(F.array_join(F.col("p.text"), "\n")).alias("text"))


def tesseract(image_path: str, binary: str = "tesseract", language: str = "eng", dpi: int = 150, psm: int = 3, oem: int = 3, output: str | None = None) -> str:
    """The command-line program on one image; output is tsv for data, makebox for boxes, None for text."""
    import shutil
    import subprocess

    if shutil.which(binary) is None:
        raise FileNotFoundError(f"the OCR program {binary} isn't installed")
    command = [binary, image_path, "stdout", "-l", language, "--dpi", str(dpi), "--psm", str(psm), "--oem", str(oem)] + ([output] if output else [])
    return subprocess.run(command, capture_output=True, check=True, text=True).stdout


def tesseract_data(tsv: str) -> list[dict]:
    """The rows of the program's data output, numbers as such."""
    lines = [x.split("\t") for x in tsv.splitlines() if x]
    if not lines:
        return []
    number = lambda x: float(x) if re.fullmatch(r"-?\d+\.\d+", x) else int(x) if re.fullmatch(r"-?\d+", x) else x
    return [{k: v if k == "text" else number(v) for k, v in zip(lines[0], row, strict=False)} for row in lines[1:]]


def tesseract_boxes(text_out: str) -> list[dict]:
    """Symbol, left, bottom, right, top and page of each line of the box output."""
    keys = ("left", "bottom", "right", "top", "page")
    return [{"symbol": r[0]} | dict(zip(keys, map(int, r[1:6]), strict=True)) for r in (x.split(" ") for x in text_out.splitlines()) if len(r) >= 6]
