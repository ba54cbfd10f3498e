"""Repeated passages by a depth-limited radix sort of suffixes.

The suffixes of all documents, one from each word with at least ``threshold`` words to come, are ordered only through
their first ``threshold`` words, by most-significant-digit passes; groups that are still equal then are exactly the
windows that occur more than once. A digit is the 64-bit hash of half the words of a window.

* Partition pass: suffixes go to buckets by their first digit. A task first orders its own slice of the corpus
  and settles there all occurrences after a slice's first one, so a passage found a billion times
  sends one suffix a slice to its bucket, not a billion.
* First pass, in a bucket: order by the first digit; suffixes that are alone in it leave.
* Second pass: order what is left by the second digit; groups of equals are repeated windows.

In a shuffle a suffix is about 12 bytes: document and position as variable-length differences, 32 bits of the first
digit (the bucket gives more of it) and 47 of the second. Two different windows count as equal
with a chance of about 2**-86 for a pair: over 10**13 suffixes about one false pair is to be expected.

Windows that repeat make up *spans*: maximal runs of words covered by repeated windows. A window's first occurrence, by
(doc_id, position), stays; words covered by a later occurrence of any window are to be removed.

Words are runs of other characters than ASCII white space, compared byte by byte. Defined results. Null, empty and
shorter texts have no spans. Repeats within a document count like those across documents. Rows without id have
no spans; of rows with the same id one counts, that with the longest, then greatest text. The empty table has no
spans. Further columns don't matter, and remove_repeats keeps them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import common

_PACKED = "bucket int, part int, docs binary, at binary, low binary, high binary, flag binary"
_FIELDS = [x.split()[0] for x in _PACKED.split(", ")]


# -- packed suffixes


def _binary(raw: bytes, ends: np.ndarray) -> pa.Array:
    """The byte string cut at the given ends."""
    off = np.concatenate([[0], ends]).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(off), pa.py_buffer(raw)]).cast(pa.binary())


def _sizes(x: np.ndarray) -> np.ndarray:
    size = np.ones(len(x), np.int64)
    for k in range(1, 10):
        more = x >= np.uint64(1) << np.uint64(7 * k)
        if not more.any():
            break
        size += more
    return size


def pack_rows(group: np.ndarray, doc: np.ndarray, at: np.ndarray, low=None, high=None, flag=None) -> tuple[np.ndarray, list[pa.Array]]:
    """Suffixes ordered by (group, doc, at) as one packed row a group: the groups, and columns docs .. flag."""
    n = len(group)
    head = np.ones(n, bool)
    head[1:] = group[1:] != group[:-1]
    lead = head.copy()
    lead[1:] |= doc[1:] != doc[:-1]
    step = np.where(lead, at, at - np.concatenate([[0], at[:-1]])).astype(np.uint64)
    first = np.flatnonzero(lead)
    ids = doc[first]
    delta = np.where(head[first], ids, ids - np.concatenate([[0], ids[:-1]]))
    pairs = np.empty(2 * len(first), np.uint64)
    pairs[0::2] = common.zigzag(delta)
    pairs[1::2] = np.diff(np.append(first, n))
    tops = np.flatnonzero(head)
    ends = np.append(tops[1:], n)
    pair_ends = 2 * np.searchsorted(first, ends)
    cols = [_binary(common.pack(pairs), np.cumsum(_sizes(pairs))[pair_ends - 1]), _binary(common.pack(step), np.cumsum(_sizes(step))[ends - 1])]
    for x, kind in ((low, np.uint32), (high, np.uint32), (flag, np.uint16)):
        cols.append(pa.nulls(len(tops), pa.binary()) if x is None else _binary(x.astype(kind).tobytes(), ends * np.dtype(kind).itemsize))
    return group[tops], cols


def unpack_row(docs: bytes, at: bytes) -> tuple[np.ndarray, np.ndarray]:
    pairs = common.unpack(np.frombuffer(docs, np.uint8))
    step = common.unpack(np.frombuffer(at, np.uint8)).astype(np.int64)
    counts = pairs[1::2].astype(np.int64)
    ids = np.cumsum(common.unzigzag(pairs[0::2]))
    total = np.cumsum(step)
    lead = np.cumsum(counts) - counts
    return np.repeat(ids, counts), total - np.repeat(total[lead] - step[lead], counts)


def _unpack_table(table: pa.Table, digits: bool) -> list[np.ndarray]:
    """doc, at and, with digits, low, high, flag; else flag alone."""
    parts: list[list[np.ndarray]] = [[], [], [], [], []]
    for docs, at, low, high, flag in zip(*(table[c].to_pylist() for c in _FIELDS[2:]), strict=True):
        d, a = unpack_row(docs, at)
        parts[0].append(d)
        parts[1].append(a)
        if digits:
            parts[2].append(np.frombuffer(low, np.uint32))
            parts[3].append(np.frombuffer(high, np.uint32))
        parts[4].append(np.frombuffer(flag, np.uint16))
    kinds = (np.int64, np.int64, np.uint32, np.uint32, np.uint16)
    return [np.concatenate(p) if p else np.empty(0, k) for p, k in zip(parts, kinds, strict=True)]


# -- partition pass


def suffixes(data: np.ndarray, off: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, position, first digit, second digit) of every suffix with threshold words to come."""
    starts, ends, first = common.words(data, off)
    half = threshold // 2
    empty = np.empty(0, np.int64)
    if not len(starts):
        return empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
    value = common.word_hashes(data, starts, ends)
    count = np.diff(first)
    own = np.maximum(0, count - threshold + 1)
    text = np.repeat(np.arange(len(count)), own)
    at = np.arange(int(own.sum())) - np.repeat(np.cumsum(own) - own, own)
    begin = at + np.repeat(first[:-1], own)
    one = common.mix(common.span_hash(value, begin, begin + half))
    two = common.mix(common.span_hash(value, begin + half, begin + threshold))
    return text, at, one, two


def _map(threshold: int, buckets: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for piece in common.slices(whole):
                ids = piece.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                text, at, one, two = suffixes(*common.as_bytes(piece.column(1)), threshold)
                if not len(at):
                    continue
                doc = ids[text]
                two &= np.uint64((1 << 47) - 1)
                multi = np.zeros(len(at), bool)
                later = np.zeros(len(at), bool)
                order = np.argsort(one)
                same = one[order[1:]] == one[order[:-1]]
                if same.any():  # settle repeats within the slice
                    again = np.zeros(len(at), bool)
                    again[1:] |= same
                    again[:-1] |= same
                    k = order[again]
                    k = k[np.lexsort((at[k], doc[k], two[k], one[k]))]
                    equal = (one[k[1:]] == one[k[:-1]]) & (two[k[1:]] == two[k[:-1]])
                    later[k[1:][equal]] = True
                    multi[k[:-1][equal]] = True
                    multi &= ~later
                bucket = (one % np.uint64(buckets)).astype(np.int64)
                s = np.flatnonzero(~later)
                s = s[np.lexsort((at[s], doc[s], bucket[s]))] if (np.diff(ids) < 0).any() else s[np.argsort(bucket[s].astype(np.uint16 if buckets < 65536 else np.uint32), kind="stable")]
                flag = (two[s] >> np.uint64(32)).astype(np.uint16) | (multi[s].astype(np.uint16) << np.uint16(15))
                group, cols = pack_rows(bucket[s], doc[s], at[s], (one[s] >> np.uint64(16)) & np.uint64(0xFFFFFFFF), two[s] & np.uint64(0xFFFFFFFF), flag)
                yield pa.RecordBatch.from_arrays([pa.array(group, pa.int32()), pa.nulls(len(group), pa.int32()), *cols], _FIELDS)
                if later.any():
                    k = np.flatnonzero(later)
                    group, cols = _by_part(doc[k], at[k], np.zeros(len(k), np.uint16), parts)
                    yield pa.RecordBatch.from_arrays([pa.array(group % buckets, pa.int32()), pa.array(group, pa.int32()), *cols], _FIELDS)

    return run


def _by_part(doc: np.ndarray, at: np.ndarray, flag: np.ndarray, parts: int) -> tuple[np.ndarray, list[pa.Array]]:
    part = (common.mix(doc.view(np.uint64)) % np.uint64(parts)).astype(np.int64)
    k = np.lexsort((at, doc, part))
    return pack_rows(part[k], doc[k], at[k], flag=flag[k])


# -- digit passes


def equal_groups(doc, at, low, high, flag) -> tuple[np.ndarray, np.ndarray]:
    """Positions of suffixes whose window occurs again, and whether each is the first of its group."""
    order = np.argsort(low)
    same = low[order[1:]] == low[order[:-1]]
    again = np.zeros(len(low), bool)
    again[1:] |= same
    again[:-1] |= same
    multi = flag >> np.uint16(15) != 0
    keep = multi.copy()
    keep[order[again]] = True
    k = np.flatnonzero(keep)
    two = high[k].astype(np.int64) | ((flag[k] & np.uint16(0x7FFF)).astype(np.int64) << 32)
    o = np.lexsort((at[k], doc[k], two, low[k]))
    k, two = k[o], two[o]
    same = (low[k[1:]] == low[k[:-1]]) & (two[1:] == two[:-1])
    after = np.zeros(len(k), bool)
    after[1:] = same
    more = multi[k].copy()
    more[1:] |= same
    more[:-1] |= same
    return k[more], ~after[more]


def _reduce(parts: int):
    def run(table: pa.Table) -> pa.Table:
        settled = pc.is_valid(table["part"])
        out = [table.filter(settled).select(_FIELDS[1:])]
        doc, at, low, high, flag = _unpack_table(table.filter(pc.invert(settled)), True)
        if len(doc):
            k, first = equal_groups(doc, at, low, high, flag)
            if len(k):
                group, cols = _by_part(doc[k], at[k], first.astype(np.uint16), parts)
                out.append(pa.table([pa.array(group, pa.int32()), *cols], names=_FIELDS[1:]))
            del doc, at, low, high, flag, k, first
            common.trim()
        return pa.concat_tables(out)

    return run


# -- spans


def spans_of(doc: np.ndarray, at: np.ndarray, first: np.ndarray, threshold: int) -> tuple[np.ndarray, ...]:
    """(doc, start, end, removed) of the maximal runs of words covered by repeated windows, cut where removed changes."""
    none = np.empty(0, np.int64)
    if not len(doc):
        return none, none, none, none.astype(bool)
    # events: a window opens or closes the layer of all repeated windows, and that of windows to remove
    d = np.concatenate([doc, doc])
    x = np.concatenate([at, at + threshold])
    all_ = np.concatenate([np.ones(len(doc), np.int64), -np.ones(len(doc), np.int64)])
    gone = all_ * np.concatenate([~first, ~first])
    order = np.lexsort((x, d))
    d, x, all_, gone = d[order], x[order], np.cumsum(all_[order]), np.cumsum(gone[order])
    last = np.ones(len(d), bool)
    last[:-1] = (d[1:] != d[:-1]) | (x[1:] != x[:-1])
    d, x, all_, gone = d[last], x[last], all_[last] > 0, gone[last] > 0
    # a layer's count is 0 at the end of a document, so each state holds up to the next event of the same one
    change = np.ones(len(d), bool)
    change[1:] = (d[1:] != d[:-1]) | (all_[1:] != all_[:-1]) | (gone[1:] != gone[:-1])
    d, x, all_, gone = d[change], x[change], all_[change], gone[change]
    k = np.flatnonzero(all_)
    return d[k], x[k], x[k + 1], gone[k]


def _spans(threshold: int):
    def run(table: pa.Table) -> pa.Table:
        doc, at, _, _, flag = _unpack_table(table, False)
        d, s, e, gone = spans_of(doc, at, flag != 0, threshold)
        return pa.table({"doc_id": pa.array(d, pa.int64()), "start_word": pa.array(s, pa.int32()), "end_word": pa.array(e, pa.int32()), "removed": pa.array(gone)})

    return run


def repeated_spans(docs: DataFrame, threshold: int = 50, id_col: str = "doc_id", text_col: str = "text", bucket_chars: int = 16 << 20) -> DataFrame:
    """(doc_id, start_word, end_word, removed): spans of words, counted from 0 and without the end, in repeated windows.

    A bucket gets the suffixes of about bucket_chars of text, so a task's share doesn't grow with the corpus.
    """
    if threshold < 2:
        raise ValueError("a window has two words at least")
    docs = common.one_row_per_id(common.ids_and_text(docs, id_col, text_col), "doc_id", "text").filter("text is not null")
    chars = docs.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    buckets = max(2 * common.partitions(docs.sparkSession), -(-chars // bucket_chars))
    parts = buckets // 2  # the number of tasks follows the corpus where that outgrows the session's setting
    sent = docs.mapInArrow(common.tidy(_map(threshold, buckets, parts)), _PACKED).repartition(parts, "bucket")
    found = sent.groupBy("bucket").applyInArrow(_reduce(parts), _PACKED.partition(", ")[2])
    return found.repartition(parts, "part").groupBy("part").applyInArrow(_spans(threshold), "doc_id long, start_word int, end_word int, removed boolean")


def cut_words(data: np.ndarray, off: np.ndarray, row: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts without the words [start, end) of the given rows: each goes with the white space after it."""
    starts, ends, first = common.words(data, off)
    begin = starts[first[row] + start]
    stop_word = first[row] + end
    inner = stop_word < first[row + 1]
    stop = np.where(inner, starts[np.minimum(stop_word, len(starts) - 1)], off[row + 1])
    # a cut at the end of a text takes the white space before it
    before = first[row] + start - 1
    begin = np.where(~inner & (start > 0), ends[np.maximum(before, 0)], begin)
    mark = np.zeros(len(data) + 1, np.int32)
    np.add.at(mark, begin, 1)
    np.add.at(mark, stop, -1)
    keep = np.cumsum(mark[:-1]) == 0
    gone = np.concatenate([[0], np.cumsum(~keep)])
    return data[keep], off - gone[off]


def remove_repeats(docs: DataFrame, threshold: int = 50, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """docs without the words that repeat an earlier window; a document of which nothing is left goes.

    Where docs has length_col, a shortened text's length in characters is written there. Rows without id stay as they are,
    and so do further texts of an id (those that don't count).
    """
    cuts = repeated_spans(docs, threshold, id_col, text_col).filter("removed").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start_word", "end_word"))).alias("cuts"))
    at, start, stop = (common.fresh(docs, x) for x in ("at", "start", "stop"))
    cuts = cuts.select(F.col("doc_id").alias(at), F.col("cuts.start_word").alias(start), F.col("cuts.end_word").alias(stop))
    one, rest = common.by_id(docs, id_col, text_col)
    joined = one.join(cuts, common.column(id_col).cast("long") == F.col(at), "left").drop(at)
    length_kind = dict(docs.dtypes).get(length_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in common.slices(whole, text_col):
                lists, tos = part.column(part.num_columns - 2), part.column(part.num_columns - 1)
                count = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
                out = part.select(list(range(part.num_columns - 2)))
                if count.any():
                    i = out.schema.get_field_index(text_col)
                    text = out.column(i)
                    row = np.repeat(np.arange(len(count)), count)
                    data, off = cut_words(*common.as_bytes(text), row, pc.list_flatten(lists).to_numpy(), pc.list_flatten(tos).to_numpy())
                    new = pa.LargeStringArray.from_buffers(len(text), pa.py_buffer(off.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))).cast(text.type)
                    touched = pa.array(count > 0)
                    new = pc.if_else(touched, new, text)
                    cols = list(out.columns)
                    cols[i] = new
                    if length_kind:
                        j = out.schema.get_field_index(length_col)
                        cols[j] = pc.if_else(touched, pc.utf8_length(new).cast(cols[j].type), cols[j])
                    out = pa.RecordBatch.from_arrays(cols, schema=out.schema)
                    blank = pc.and_(touched, pc.equal(pc.binary_length(pc.utf8_trim_whitespace(new)), 0))
                    out = out.filter(pc.invert(pc.fill_null(blank, False)))
                yield out

    kept = joined.mapInArrow(common.tidy(run), docs.schema).unionByName(docs.filter(common.column(id_col).isNull()))
    return kept if rest is None else kept.unionByName(rest)
