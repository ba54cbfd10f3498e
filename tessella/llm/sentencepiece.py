"""SentencePiece encoding and decoding through a table of distinct chunks.

In a model whose pieces hold white space only as leading markers, no piece crosses the border between a
character and a marker after it. A text then falls into chunks (markers, then other characters) which are
segmented independently, and a chunk gives the same ids wherever it stands. So each task keeps a table of
distinct chunks, segments a chunk when it first meets it, and joins ids back by position: texts become
dictionary-encoded chunks, the ids of a text are the lists of its chunks end to end. The table lives in the
task, for a table of the whole corpus would need every position of it shuffled twice; it is cleared
when it holds more than ``table_bytes``, so memory stays flat however many distinct chunks there are.

Defined results. Null text: null ids. Empty text: no ids. A literal U+2581 in a text counts as a space, as
in the library itself. Rows are independent: repeated rows and null or repeated ids give a row each. Only
the id and text columns are read, so other columns of any name don't matter. Decoding gives U+FFFD for
byte pieces that aren't UTF-8, and null for null ids or ids outside the vocabulary.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tessella.llm import common

MARK = "▁".encode()
#: Appended to a serialised model: the normaliser adds no marker of its own.
_NO_PREFIX = b"\x1a\x02\x18\x00"


@lru_cache(maxsize=4)
def _model(path: str):
    """(processor for single chunks, whether texts get a marker in front, pieces as bytes, kinds of piece)."""
    import sentencepiece as spm

    raw = open(path, "rb").read()
    whole = spm.SentencePieceProcessor(model_proto=raw)
    chunk = spm.SentencePieceProcessor(model_proto=raw + _NO_PREFIX)
    pieces = [whole.id_to_piece(i) for i in range(whole.get_piece_size())]
    for p in pieces:
        if "▁" in p.lstrip("▁"):
            raise ValueError(f"piece {p!r} crosses a white space marker: chunks aren't independent in {path}")
    if whole.encode("a  b ") != whole.encode("a  b") + chunk.encode("▁"):
        raise ValueError("the model's normaliser drops white space: chunks aren't independent")
    prefix = whole.encode("a", out_type=str)[0].startswith("▁")
    surface = []
    for i, p in enumerate(pieces):
        if whole.is_control(i):
            surface.append(b"")
        elif whole.is_unknown(i):
            surface.append(" ⁇ ".encode())
        elif whole.is_byte(i):
            surface.append(bytes([int(p[3:5], 16)]))
        else:
            surface.append(p.replace("▁", " ").encode())
    return chunk, prefix, pa.array(surface, pa.large_binary())


def _chunk_starts(data: np.ndarray) -> np.ndarray:
    """First bytes of chunks: spaces that follow another byte than a space."""
    space = data == 0x20
    first = space.copy()
    first[1:] &= ~space[:-1]
    return np.flatnonzero(first)


class Encoder:
    """Encodes batches of texts with one table of distinct chunks."""

    def __init__(self, path: str, table_bytes: int = 32 << 20) -> None:
        self.model, self.prefix, _ = _model(path)
        self.table_bytes = table_bytes
        self._clear()

    def _clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.size, self.ids, self.more = 0, pa.array([], pa.large_list(pa.int32())), []

    def _rows(self, chunks: pa.Array) -> np.ndarray:
        """For each distinct chunk its row of the table, which grows by those not met before."""
        if self.size > self.table_bytes:
            self._clear()
        known, new = self.known, []
        rows = np.empty(len(chunks), np.int64)
        for i, c in enumerate(chunks.to_pylist()):
            row = known.get(c)
            if row is None:
                row = known[c] = len(known)
                new.append(c.decode())
                self.size += len(c) + 120
            rows[i] = row
        if new:
            more = self.model.encode(new, num_threads=1)
            sizes = np.fromiter(map(len, more), np.int64, len(more))
            flat = np.fromiter((x for ids in more for x in ids), np.int32, int(sizes.sum()))
            lists = pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int64()), pa.array(flat))
            self.more.append(lists)
            if sum(map(len, self.more)) > len(self.ids) or len(self.more) > 64:  # the table is copied when it has doubled
                self.ids, self.more = pa.concat_arrays([self.ids, *self.more]), []
        return rows

    def encode(self, texts: pa.Array) -> pa.Array:
        """int32 lists, null where the text is null."""
        valid = texts.is_valid()
        full = texts.fill_null("").cast(pa.large_string())
        if pc.any(pc.match_substring(full, "▁")).as_py():
            full = pc.replace_substring(full, "▁", " ")
        if self.prefix:
            none, space = (pa.scalar(x, pa.large_string()) for x in ("", " "))
            full = pc.if_else(pc.equal(pc.binary_length(full), 0), none, pc.binary_join_element_wise(none, full, space))
        data, off = common.as_bytes(full)
        cut = np.unique(np.concatenate([off[:-1], _chunk_starts(data)])) if len(data) else np.empty(0, np.int64)
        cut = cut[cut < len(data)]
        chunks = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cut), [None, pa.py_buffer(np.append(cut, len(data)).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
        coded = chunks.dictionary_encode()
        distinct = pc.replace_substring(coded.dictionary, b" ", MARK)
        rows = self._rows(distinct)
        table = pa.chunked_array([self.ids, *self.more]) if self.more else self.ids
        lists = table.take(pa.array(rows[coded.indices.to_numpy(zero_copy_only=False)]))
        if isinstance(lists, pa.ChunkedArray):
            lists = lists.combine_chunks() if lists.num_chunks else pa.array([], lists.type)
        flat_off = lists.offsets.to_numpy()
        where = np.searchsorted(cut, off)
        return pa.ListArray.from_arrays(pa.array(flat_off[where] - flat_off[0], pa.int32(), mask=None), lists.flatten(), mask=pc.invert(valid) if valid.false_count else None)


class Decoder:
    def __init__(self, path: str) -> None:
        _, self.prefix, self.surface = _model(path)

    def decode(self, ids: pa.Array) -> pa.Array:
        ids = ids.cast(pa.large_list(pa.int32()))
        flat = ids.flatten()
        sizes = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
        off = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        values = flat.fill_null(-1).to_numpy(zero_copy_only=False)
        bad = (values < 0) | (values >= len(self.surface))
        null = ids.is_null().to_numpy(zero_copy_only=False)
        if bad.any():
            null = null | (np.add.reduceat(np.append(bad, False), off[:-1]) > 0) & (sizes > 0) if len(off) > 1 else null
            values = np.where(bad, 0, values)
        taken = self.surface.take(pa.array(values))
        ends = np.frombuffer(taken.buffers()[1], np.int64, len(taken) + 1, taken.offset * 8)
        at = ends[off] if len(taken) else np.zeros(len(off), np.int64)
        raw = bytes(taken.buffers()[2] or b"") if len(taken) else b""
        try:
            raw.decode()
            if raw:  # the texts together may be UTF-8 where a character's bytes lie in two of them
                heads = np.frombuffer(raw, np.uint8)[at[:-1][at[:-1] < at[1:]]]
                if ((heads & 0xC0) == 0x80).any():
                    raise UnicodeDecodeError("utf-8", raw, 0, 1, "a text begins inside a character")
            begin = at.copy()
            if self.prefix and raw:
                head = np.frombuffer(raw, np.uint8)[np.minimum(at[:-1], len(raw) - 1)] == 0x20
                out = pa.LargeStringArray.from_buffers(len(ids), pa.py_buffer(begin), pa.py_buffer(raw))
                cut = pc.utf8_slice_codeunits(out, 1)
                out = pc.if_else(pa.array(head & (at[:-1] < at[1:])), cut, out)
            else:
                out = pa.LargeStringArray.from_buffers(len(ids), pa.py_buffer(begin), pa.py_buffer(raw))
        except UnicodeDecodeError:
            texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            out = pa.array([t[1:] if self.prefix and t[:1] == " " else t for t in texts], pa.large_string())
        return pc.if_else(pa.array(~null), out, pa.scalar(None, pa.large_string())).cast(pa.string())


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", check: bool = False) -> DataFrame:
    """(doc_id, ids, n_ids) for each row; with check also round_trip: whether decoding gives the text back."""
    schema = "doc_id long, ids array<int>, n_ids int" + ", round_trip boolean" * check

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = Encoder(model), Decoder(model)
        for whole in batches:
            for part in common.slices(whole):
                text = part.column(1)
                ids = encoder.encode(text)
                out = [part.column(0), ids, pc.list_value_length(ids)]
                if check:
                    out.append(pc.equal(decoder.decode(ids), text))
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "ids", "n_ids"] + ["round_trip"] * check)

    return common.ids_and_text(docs, id_col, text_col).mapInArrow(common.tidy(run), schema)


def decode(encoded: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) for each row of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(model)
        for part in batches:
            yield pa.RecordBatch.from_arrays([part.column(0), decoder.decode(part.column(1))], ["doc_id", "text"])

    from pyspark.sql import functions as F

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")
