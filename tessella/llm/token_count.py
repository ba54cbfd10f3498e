"""Token counts, with overlap resynchronisation for huge documents.

A byte-level BPE splits a text with a regular expression that scans from left to right, then merges inside
each match. A document of more than ``chunk_chars`` is encoded in overlapping chunks, so that no call sees more
than a chunk at a time. Two neighbouring encodings are spliced at a *stable boundary* inside their overlap: a
place where both have a token border (by their offsets) and where every scan, wherever it began, has the border
of a match. Such a place is one where a letter, digit or mark is followed by white space: no alternative of the
pattern holds white space after another character, and none looks further right than one character past its
match. Before such a place the left encoding is that of the whole text; from there on the right one
is. Where an overlap has no such place (a run of 10,000 letters, say) it is widened to twice its length,
up to the start of the left chunk, and then the chunk itself grows: the count is always that of the whole text.

Defined results. Null text: null count. Empty text: 0. Special tokens' strings are ordinary text. Rows are
independent, so repeated rows, null ids and further columns don't matter.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tessella.llm import common

#: The pattern of the rank files' tokenizers.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_STABLE = regex.compile(r"(?<=[^\s])(?=\s)")


@lru_cache(maxsize=4)
def _encoding(path: str):
    """(tiktoken encoding, bytes in each token)."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        sizes[rank] = len(token)
    return tiktoken.Encoding("counts", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), sizes


def _borders(encoding, sizes: np.ndarray, text: str) -> np.ndarray:
    """Byte offsets of the token borders of a text, 0 and its end among them."""
    return np.concatenate([[0], np.cumsum(sizes[np.asarray(encoding.encode_ordinary(text), np.int64)])]).astype(np.int64)


def count_long(text: str, encoding, sizes: np.ndarray, chunk: int, overlap: int) -> int:
    """Tokens of a text, by chunks of so many characters that overlap by so many at first."""
    n, total = len(text), 0
    left, end = 0, min(chunk, n)
    # the left chunk counts from byte `since` of its own, which is a border of the whole text's encoding
    since, borders = 0, _borders(encoding, sizes, text[left:end])
    while end < n:
        back = min(overlap, end - left)
        while True:
            start, stop = end - back, min(end - back + chunk, n)
            stop = max(stop, min(n, end + 1))
            right = _borders(encoding, sizes, text[start:stop])
            shift = len(text[left:start].encode())
            cut = _splice(text, start, end, shift, borders, right, since)
            if cut is not None:
                break
            if back < end - left:
                back = min(back * 2, end - left)  # widen the overlap
            else:  # it is the whole left chunk: let that grow instead
                end = min(n, end + max(chunk, end - left))
                borders = _borders(encoding, sizes, text[left:end])
                if end == n:
                    return total + len(borders) - 1 - int(np.searchsorted(borders, since))
        at_left, at_right = cut
        total += int(np.searchsorted(borders, at_left) - np.searchsorted(borders, since))
        left, end, since, borders = start, stop, at_right, right
    return total + len(borders) - 1 - int(np.searchsorted(borders, since))


def _splice(text: str, start: int, end: int, shift: int, left: np.ndarray, right: np.ndarray, since: int) -> tuple[int, int] | None:
    """The last stable boundary in text[start:end] that both encodings have, in bytes of either chunk."""
    part = text[start:end]
    found = [m.start() for m in _STABLE.finditer(part)]
    for p in reversed(found):
        at = len(part[:p].encode())
        if shift + at <= since:  # a cut there would bring nothing: the overlap, then the left chunk has to grow
            return None
        if _has(right, at) and _has(left, shift + at):
            return shift + at, at
    return None


def _has(borders: np.ndarray, at: int) -> bool:
    i = int(np.searchsorted(borders, at))
    return i < len(borders) and borders[i] == at


def count_tokens(docs: DataFrame, ranks: str, chunk_chars: int = 1 << 15, overlap_chars: int = 256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, sizes = _encoding(ranks)
        for whole in batches:
            for part in common.slices(whole):
                counts = []
                for text in part.column(1).to_pylist():
                    if text is None:
                        counts.append(None)
                    elif len(text) <= chunk_chars:
                        counts.append(len(encoding.encode_ordinary(text)))
                    else:
                        counts.append(count_long(text, encoding, sizes, chunk_chars, overlap_chars))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64())], ["doc_id", "n_tokens"])

    return common.ids_and_text(docs, id_col, text_col).mapInArrow(common.tidy(run), "doc_id long, n_tokens long")
