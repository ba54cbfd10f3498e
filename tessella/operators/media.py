"""Audio segments, video frames, page images and requests as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def speech_only(segments: DataFrame, no_speech: Column, logprob: Column, most_no_speech: float, least_logprob: float) -> DataFrame:
    """Without the segments that are likely silence and poorly decoded."""
    silent = (no_speech > most_no_speech) & (logprob < least_logprob)
    return segments.filter(~F.coalesce(silent, F.lit(False)))


def segment_rows(segments: DataFrame) -> DataFrame:
    """With start and end as metadata."""
    end = F.col("start") + F.col("duration")
    return segments.withColumn("end", end).withColumn("metadata", F.create_map(F.lit("start"), F.col("start").cast("string"), F.lit("end"), end.cast("string"), F.lit("file_name"), F.col("file_name")))


def tumbling_windows(ts: Column, seconds: int = 30) -> Column:
    """The number of the fixed window that holds a time; the last one may be partial."""
    return F.floor(F.unix_micros(ts) / F.lit(seconds * 1_000_000)).cast("bigint")


def sample_frames(frames: DataFrame, step: int = 30, max_frames: int | None = 300, video: str = "video", frame: str = "frame") -> DataFrame:
    """Every step-th frame of each video, the first max_frames of them, with frame_index counted from 0 among those kept.

    The limit is that of each video and a window group limit keeps it before the shuffle.
    """
    if step < 1:
        raise ValueError("step must be positive")
    order = Window.partitionBy(video).orderBy(frame)
    out = frames.filter(F.col(frame) % step == 0).withColumn("__n", F.row_number().over(order))
    if max_frames:
        out = out.filter(F.col("__n") <= max_frames)
    return out.withColumn("frame_index", (F.col("__n") - 1).cast("bigint")).drop("__n")


def page_rows(docs: DataFrame, pages: str, keep: list[str]) -> DataFrame:
    """A row a page, numbered from 1."""
    return docs.select(*keep, F.posexplode(pages).alias("page_number", "page")).withColumn("page_number", (F.col("page_number") + 1).cast("bigint"))


def average_logprob(tokens: DataFrame, segment: str, probability: str) -> DataFrame:
    """The mean logarithm of the tokens' chances; tokens of chance 0 or less don't count."""
    return tokens.filter(F.col(probability) > 0).groupBy(segment).agg(F.round(F.sum(F.ln(probability)) / F.count("*"), 6).alias("avg_logprob"))


def positions(df: DataFrame, key: str, out_col: str = "position", span: int = 4096) -> DataFrame:
    """Df with a 0-based number in the order of an integer key that has no ties, without one task for all rows.

    Rows are counted by ranges of span keys; the counts, one row a range, give where each range begins, and a window
    within the range does the rest. Only the counts, a row for span keys, are ordered in one task.
    """
    part = df.withColumn("__range", F.floor(F.col(key) / span))
    counts = part.groupBy("__range").agg(F.count("*").alias("__n"))
    begin = counts.select("__range", (F.sum("__n").over(Window.orderBy("__range")) - F.col("__n")).alias("__begin"))
    inner = F.row_number().over(Window.partitionBy("__range").orderBy(key)) - 1
    return part.withColumn("__row", inner).join(begin, "__range").withColumn(out_col, (F.col("__begin") + F.col("__row")).cast("bigint")).drop("__range", "__row", "__begin")


def buffers(df: DataFrame, key: str, size: int = 100) -> DataFrame:
    """Df with the number of the buffer that each row falls into when size rows fill one, in the order of key."""
    if size < 1:
        raise ValueError("size must be positive")
    return positions(df, key, "__position").withColumn("buffer", F.floor(F.col("__position") / size).cast("bigint")).drop("__position")


def mixed_inputs(items: DataFrame, request: str, is_image: Column) -> DataFrame:
    """P10: (request, status): ok where a request holds images only or texts only, else 400."""
    some, every = F.bool_or(is_image), F.bool_and(is_image)
    return items.groupBy(request).agg(F.when(some & ~every, F.lit(400)).otherwise(F.lit(200)).cast("bigint").alias("status"))


def response_index(items: DataFrame, request: str, order: str) -> DataFrame:
    """Items with their index in the answer to their request, from 0."""
    return items.withColumn("index", (F.row_number().over(Window.partitionBy(request).orderBy(order)) - 1).cast("bigint"))
