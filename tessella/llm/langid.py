"""Language identification by compression with per-language dictionaries.

For each language a zstandard raw-content dictionary is cut from a bounded sample of labelled rows. A text is
lower-cased, its runs of other characters than letters become single spaces, and the whole of it is compressed
in blocks of ``block`` bytes with each dictionary. The language with the smallest total wins; where the
runner-up is less than ``least_margin`` larger the text is rejected.

Blocks keep the comparison fair for long texts: without them a text soon becomes its own dictionary and the
languages' totals meet.

Fitting is bounded: ``per_language`` rows for each language, those of the least hash of their id, of each the first
``sample_chars`` characters, together at most ``dictionary_bytes``; of the commonest ``languages`` labels. Labels may be wrong, so the sample is cleaned: each
half is judged with dictionaries of the other half, and rows judged otherwise than labelled leave it.

Defined results. A null, empty or letterless text has no language (null), margin 0, and is rejected; so is a tie. With
a single language in the sample every text with letters is of it, with margin 1; without any, all are rejected. Rows
are judged independently: repeated rows give repeated results, null ids are kept. In a tie the first language by name is
given, not accepted. Of rows with the same id the longest, then greatest text may enter the sample. Rows without id or label never
enter the sample. Further columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm import common

LEVEL = 6


def normalise(texts: pa.Array) -> pa.Array:
    return pc.utf8_trim(pc.replace_substring_regex(pc.utf8_lower(texts.cast(pa.large_string()).fill_null("")), r"[^\pL]+", " "), " ")


class Judge:
    """Sizes of texts under each language's dictionary."""

    def __init__(self, profiles: dict[str, bytes], block: int = 2000) -> None:
        import zstandard

        self.languages, self.block, self.compressors = sorted(profiles), block, []
        for name in self.languages:
            d = zstandard.ZstdCompressionDict(profiles[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.compressors.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False))

    def sizes(self, texts: pa.Array) -> np.ndarray:
        """Bytes of each (already normalised) text under each language."""
        out = np.zeros((len(texts), len(self.languages)), np.int64)
        for i, raw in enumerate(texts.cast(pa.large_binary()).to_pylist()):
            for at in range(0, len(raw), self.block):
                part = raw[at : at + self.block]
                for k, c in enumerate(self.compressors):
                    out[i, k] += len(c.compress(part))
        return out

    def judge(self, texts: pa.Array, least_margin: float) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """(language, margin, accepted) of raw texts."""
        plain = normalise(texts)
        some = pc.binary_length(plain).to_numpy(zero_copy_only=False) > 0
        if not self.languages:
            return pa.nulls(len(texts), pa.string()), np.zeros(len(texts)), np.zeros(len(texts), bool)
        sizes = self.sizes(plain)
        best = sizes.argmin(1)
        if len(self.languages) == 1:
            margin = some.astype(float)
        else:
            two = np.sort(sizes, 1)[:, :2]
            margin = np.where(some, (two[:, 1] - two[:, 0]) / np.maximum(two[:, 1], 1), 0.0)
        names = pa.array(self.languages).take(pa.array(best))
        return pc.if_else(pa.array(some), names, pa.scalar(None, pa.string())), margin, some & (margin > 0) & (margin >= least_margin)


def _dictionary(parts: list[bytes], size: int) -> bytes:
    return b"\n".join(parts)[:size]


def fit(docs: DataFrame, per_language: int = 96, sample_chars: int = 512, dictionary_bytes: int = 32768, languages: int = 256, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, bytes]:
    """A dictionary for each of the commonest ``languages`` of lang_col, from at most per_language rows of each."""
    light = docs.select(common.column(id_col).alias("doc_id"), common.column(lang_col).alias("lang")).filter("doc_id is not null and lang is not null")
    # the commonest languages, of equally common ones the first by name: labels are free text, so their number needs a bound
    known = light.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).select("lang")
    light = light.join(F.broadcast(known), "lang")
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = light.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= per_language).select("doc_id").distinct()
    rows = docs.select(common.column(id_col).alias("doc_id"), common.column(lang_col).alias("lang"), F.substring(common.column(text_col), 1, sample_chars).alias("text"))
    # at most per_language ids for each language: the sample's bound, whatever the size of the table
    rows = rows.filter("lang is not null and text is not null").join(F.broadcast(chosen), "doc_id")
    # of rows with the same id one counts, whichever order they come in
    rows = rows.groupBy("doc_id").agg(F.max(F.struct(F.length("text").alias("n"), "text", "lang")).alias("x")).select("doc_id", "x.lang", "x.text").collect()
    sample: dict[str, list[bytes]] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["doc_id"])):
        plain = normalise(pa.array([r["text"]], pa.string()))[0].as_py()
        if plain:
            sample.setdefault(r["lang"], []).append(plain.encode())
    kept: dict[str, list[bytes]] = {name: [] for name in sample}
    for half in (0, 1):
        other = {name: _dictionary(parts[1 - half :: 2], dictionary_bytes) for name, parts in sample.items()}
        judge = Judge({k: v for k, v in other.items() if v})
        for name, parts in sample.items():
            mine = parts[half::2]
            if mine and len(judge.languages) > 1:
                best = judge.sizes(pa.array(mine, pa.large_binary())).argmin(1)
                mine = [p for p, b in zip(mine, best, strict=True) if judge.languages[b] == name]
            kept[name] += mine
    return {name: _dictionary(kept[name] or parts, dictionary_bytes) for name, parts in sample.items()}


def identify(docs: DataFrame, profiles: dict[str, bytes], least_margin: float = 0.02, block: int = 2000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, language, margin, accepted) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(profiles, block)
        for whole in batches:
            for part in common.slices(whole):
                language, margin, accepted = judge.judge(part.column(1), least_margin)
                yield pa.RecordBatch.from_arrays([part.column(0), language, pa.array(margin), pa.array(accepted)], ["doc_id", "language", "margin", "accepted"])

    return common.ids_and_text(docs, id_col, text_col).mapInArrow(common.tidy(run), "doc_id long, language string, margin double, accepted boolean")


def keep_identified(docs: DataFrame, profiles: dict[str, bytes], least_margin: float = 0.02, block: int = 2000, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all columns, whose language is accepted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(profiles, block)
        for whole in batches:
            for part in common.slices(whole, text_col):
                text = part.column(part.schema.get_field_index(text_col))
                yield part.filter(pa.array(judge.judge(text, least_margin)[2]))

    return docs.mapInArrow(common.tidy(run), docs.schema)
