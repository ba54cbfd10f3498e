"""SimHash near-dedup by tiled exact comparison.

A document's features are its distinct words (a set, so that frequent words don't drown the rest); each feature's
hash votes on 256 bits and the majority gives the fingerprint. Two documents are near copies when their fingerprints
differ in at most ``radius`` bits, whatever their numbers of words.

Every pair of documents is held to this and none is missed: equal fingerprints are put together first, then
fingerprints are ordered by population count and cut into stripes by quantiles. Each pair of stripes whose population
counts come within the radius is a cell. Up to ``INDEX_FROM`` fingerprints a cell is a task that compares tiles of
``TILE`` fingerprints with numpy's exclusive-or and bit count. A tile pair is skipped when the population counts of its
halves differ by more than the radius: no pair in it can qualify.

Beyond that, the cells' pairs are found by the pigeonhole principle. A radius of 50 over 256 bits leaves some word of 64
with at most 12 (in the last 11), of that word some half with at most 6 or 5, and of that half some 16 bits with at most
3 or 2 that differ (``parts``). For each of the 16 parts fingerprints are sorted by its bits, and only the buckets within
that distance of each other are compared: a bucket's neighbours are gathered once and held to all its rows by the word,
and what is left by the half and all bits. Every pair within the radius has such a part, and counts in the first it has. Work is still quadratic in the distinct fingerprints, over a small
share of the pairs; memory and the size of each task are bounded.

A cell passes on the edges of a spanning forest, not all pairs, so a group of n copies costs n edges; besides it counts
each fingerprint's links, and as every pair counts in one task, the sums are whole. Groups are the connected components.
The population counts of texts lie within some 12 of each other's, so at a radius of 50 hardly any tile is skipped.

Defined results. Documents without words (null, empty or blank texts) are
in no group. Rows without an id are in no group. Of rows with the same id one counts, that with the longest, then
greatest text; dedupe keeps the others' further texts. Identical texts always fall together. The empty table has no groups. Further columns don't matter.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import common

TILE = 1024
WORDS = 4  # 64-bit words of a fingerprint
PARTS = 4 * WORDS  # of 16 bits
INDEX_FROM, INDEX_STRIPE = 1 << 16, 3 << 18  # fingerprints from which cells are searched by parts, and those of a stripe then
_LANES = np.array([sum(((b >> i) & 1) << (8 * i) for i in range(8)) for b in range(256)], np.uint64)
_STEPS = [np.uint64((k + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1) for k in range(WORDS)]
_SIGNATURE = "doc_id long, n_words int, " + ", ".join(f"s{k} long" for k in range(WORDS))


def fingerprints(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct words, fingerprint as 4 integers) of each text; all bits 0 where there is no word."""
    n = len(off) - 1
    starts, ends, first = common.words(data, off)
    out, sizes = np.zeros((n, WORDS), np.uint64), np.zeros(n, np.int64)
    if not len(starts):
        return sizes, out
    doc = np.repeat(np.arange(n, dtype=np.uint64), np.diff(first))
    key = np.unique((doc << np.uint64(44)) | (common.word_hashes(data, starts, ends) >> np.uint64(20)))
    owner = (key >> np.uint64(44)).astype(np.int64)
    feature = key & np.uint64((1 << 44) - 1)
    sizes = np.bincount(owner, minlength=n)
    some = np.flatnonzero(sizes)
    count = sizes[some]
    runs = -(-count // 255)  # a byte lane counts to 255
    begin = np.repeat(np.cumsum(count) - count, runs) + 255 * (np.arange(int(runs.sum())) - np.repeat(np.cumsum(runs) - runs, runs))
    lead = np.cumsum(runs) - runs
    for k in range(WORDS):
        octets = np.ascontiguousarray(common.mix(feature + _STEPS[k])).view(np.uint8).reshape(-1, 8)
        bits = np.empty((len(some), 64), bool)
        for j in range(8):
            lanes = np.add.reduceat(_LANES[octets[:, j]], begin).view(np.uint8).reshape(-1, 8)
            bits[:, 8 * j : 8 * j + 8] = 2 * np.add.reduceat(lanes.astype(np.int64), lead, axis=0) > count[:, None]
        out[some, k] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)[:, 0]
    return sizes, out


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, s0 .. s3) of each row that has words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in common.slices(whole):
                sizes, sig = fingerprints(*common.as_bytes(part.column(1)))
                keep = pa.array(sizes > 0)
                cols = [part.column(0), pa.array(sizes.astype(np.int32)), *(pa.array(sig[:, k].view(np.int64)) for k in range(WORDS))]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_words", *(f"s{k}" for k in range(WORDS))]).filter(keep)

    return common.ids_and_text(docs, id_col, text_col).filter("doc_id is not null and text is not null").mapInArrow(common.tidy(run), _SIGNATURE)


def tile_pairs(pops: np.ndarray, tile: int, radius: int, other: np.ndarray | None = None) -> Iterator[tuple[int, int]]:
    """Starts of tiles that may hold a pair: pops against themselves (a <= b), or against another block's."""

    def ranges(p: np.ndarray) -> list[np.ndarray]:
        at = np.arange(0, len(p), tile)
        return [np.minimum.reduceat(p, at), np.maximum.reduceat(p, at)]

    a = ranges(pops)
    b = a if other is None else ranges(other)
    for i in range(len(a[0])):
        least = np.zeros(len(b[0]), np.int64)
        for k in range(pops.shape[1]):
            least += np.maximum(0, np.maximum(b[0][:, k] - a[1][i, k], a[0][i, k] - b[1][:, k]))
        for j in np.flatnonzero(least <= radius).tolist():
            if other is not None or j >= i:
                yield i * tile, j * tile


def close_pairs(a_sig, b_sig=None, radius: int = 50, tile: int = TILE) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all near copies within one block of fingerprints (i < j) or between two."""
    found = list(_tiled(a_sig, b_sig, radius, tile))
    none = [np.empty(0, np.int64)]
    return np.concatenate([a for a, _ in found] or none), np.concatenate([b for _, b in found] or none)


def _tiled(a_sig, b_sig, radius: int, tile: int = TILE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of close_pairs(), tile by tile.

    A tile compares the first half of the bits, and the second where the first is within the radius.
    """
    same = b_sig is None
    pop = lambda s: np.bitwise_count(s[:, : WORDS // 2]).sum(1), lambda s: np.bitwise_count(s[:, WORDS // 2 :]).sum(1)
    pops = lambda s: np.stack([f(s) for f in pop], 1).astype(np.int64)
    a_pop = pops(a_sig)
    a_order = np.lexsort((a_pop[:, 1], a_pop[:, 0] // 8))
    a_cols = [np.ascontiguousarray(a_sig[a_order, k]) for k in range(WORDS)]
    if same:
        b_order, b_cols, other = a_order, a_cols, None
    else:
        b_pop = pops(b_sig)
        b_order = np.lexsort((b_pop[:, 1], b_pop[:, 0] // 8))
        b_cols, other = [np.ascontiguousarray(b_sig[b_order, k]) for k in range(WORDS)], b_pop[b_order]
    x, c, d = (np.empty((tile, tile), t) for t in (np.uint64, np.uint8, np.uint8))
    for i, j in tile_pairs(a_pop[a_order], tile, radius, other):
        p, q = min(tile, len(a_order) - i), min(tile, len(b_order) - j)
        xx, cc, dd = x[:p, :q], c[:p, :q], d[:p, :q]
        np.bitwise_xor(a_cols[0][i : i + p, None], b_cols[0][None, j : j + q], out=xx)
        np.bitwise_count(xx, out=cc)
        np.bitwise_xor(a_cols[1][i : i + p, None], b_cols[1][None, j : j + q], out=xx)
        np.bitwise_count(xx, out=dd)
        np.add(cc, dd, out=cc)
        hit = np.flatnonzero(cc <= radius)
        if not len(hit):
            continue
        u, v = np.divmod(hit, q)
        dist = cc[u, v].astype(np.int64)
        u, v = u + i, v + j
        for k in range(2, WORDS):
            dist += np.bitwise_count(a_cols[k][u] ^ b_cols[k][v])
        ok = dist <= radius
        if same:
            ok &= u < v
        yield a_order[u[ok]], b_order[v[ok]]


def parts(radius: int) -> list[tuple[int, int, int]]:
    """(most bits that differ in the word, in the half, in the part) of each of the 16 parts; -1: the part isn't needed.

    Limits plus one add up to those of the whole plus one, so not all parts of it can be beyond theirs.
    """

    def halves(most: int) -> tuple[int, int]:
        return -(-(most + 1) // 2) - 1, (most + 1) // 2 - 1

    words = [w for h in halves(radius) for w in halves(h)]
    return [(w, h, p) for w in words for h in halves(w) for p in halves(h)]


def _first_part(diff: np.ndarray, limits: list[tuple[int, int, int]], part: int) -> np.ndarray:
    """Which differences (4 words each) have no earlier part within its limits."""
    first = np.ones(len(diff), bool)
    for w in range(part // 4 + 1):
        word = np.ascontiguousarray(diff[:, w])
        near = [np.bitwise_count(word), np.bitwise_count(word.view(np.uint32).reshape(-1, 2)), np.bitwise_count(word.view(np.uint16).reshape(-1, 4))]
        for k in range(min(4, part - 4 * w)):
            most = limits[4 * w + k]
            first &= ~((near[0] <= most[0]) & (near[1][:, k // 2] <= most[1]) & (near[2][:, k] <= most[2]))
    return first


def _by_parts(a_sig: np.ndarray, b_sig: np.ndarray | None, radius: int, which: range, most: int = 1 << 17) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of close_pairs() whose first part within its limits is one of those, some at a time.

    A bucket's neighbours are gathered once and compared with all its rows; only the rows that pass by word are looked at singly.
    """
    limits, same = parts(radius), b_sig is None
    x, c, near_by = np.empty(most, np.uint64), np.empty(most, np.uint8), np.empty(most, bool)
    weight = np.bitwise_count(np.arange(1 << 16, dtype=np.uint16))

    def column(sig: np.ndarray, part: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(order by the part's bits, where each value begins, the words in that order)."""
        value = np.ascontiguousarray(sig.view(np.uint16).reshape(len(sig), PARTS)[:, part])
        order = np.argsort(value, kind="stable").astype(np.int32)
        begin = np.concatenate([[0], np.cumsum(np.bincount(value, minlength=1 << 16))])
        return order, begin, sig[order, part // 4]

    u: list[np.ndarray] = []
    v: list[np.ndarray] = []
    held = 0

    def settle(part: int) -> tuple[np.ndarray, np.ndarray]:
        i, j = np.concatenate(u), np.concatenate(v)
        u.clear()
        v.clear()
        if same:
            i, j = i[i < j], j[i < j]
        i, j = a_order[i], b_order[j]
        diff = a_sig[i] ^ (a_sig if same else b_sig)[j]
        half = np.bitwise_count(diff.view(np.uint32).reshape(-1, PARTS // 2)[:, part // 2])
        ok = np.flatnonzero((np.bitwise_count(diff).sum(1) <= radius) & (half <= limits[part][1]))
        ok = ok[_first_part(diff[ok], limits, part)]
        i, j = i[ok].astype(np.int64), j[ok].astype(np.int64)
        return (np.minimum(i, j), np.maximum(i, j)) if same else (i, j)

    for part in which:
        if limits[part][2] < 0:
            continue
        masks = np.flatnonzero(weight <= limits[part][2])
        a_order, a_begin, a_word = column(a_sig, part)
        b_order, b_begin, b_word = (a_order, a_begin, a_word) if same else column(b_sig, part)
        b_size, filled = np.diff(b_begin), np.flatnonzero(np.diff(a_begin))
        for k in range(0, len(filled), 64):
            bucket = filled[k : k + 64]
            near = bucket[:, None] ^ masks
            begin, size = b_begin[near], b_size[near]
            if same:
                size[near < bucket[:, None]] = 0
            lo, hi, length = a_begin[bucket], a_begin[bucket + 1], size.sum(1)
            work = np.cumsum((hi - lo) * length)
            s = 0
            while s < len(bucket):  # buckets that make at most so many comparisons, one at least
                e = max(s + 1, int(np.searchsorted(work, (work[s - 1] if s else 0) + most, "right")))
                n = size[s:e].ravel()
                ends = np.cumsum(n)
                at = np.repeat((begin[s:e].ravel() - ends + n).astype(np.int32), n)
                at += np.arange(ends[-1], dtype=np.int32)
                other = b_word[at]
                off = np.cumsum(length[s:e]) - length[s:e]
                for blocks in _blocks(lo[s:e], hi[s:e], off, length[s:e], most):
                    full = 0
                    for g, f, t, w in blocks:
                        to = full + (f - g) * w
                        np.bitwise_xor(a_word[g:f, None], other[t : t + w], out=x[full:to].reshape(f - g, w))
                        full = to
                    np.bitwise_count(x[:full], out=c[:full])
                    hit = np.flatnonzero(np.less_equal(c[:full], limits[part][0], out=near_by[:full]))
                    if len(hit):
                        first, last, left, wide = np.array(blocks).T
                        ends = np.cumsum((last - first) * wide)
                        of = np.searchsorted(ends, hit, "right")
                        row, col = np.divmod(hit - (ends - (last - first) * wide)[of], wide[of])
                        u.append(row + first[of])
                        v.append(at[col + left[of]])
                        held += len(hit)
                        if held > 1 << 18:
                            held = 0
                            yield settle(part)
                s = e
        if u:
            held = 0
            yield settle(part)


def _blocks(lo: np.ndarray, hi: np.ndarray, off: np.ndarray, length: np.ndarray, most: int) -> Iterator[list[tuple[int, int, int, int]]]:
    """(first row, last row + 1, first neighbour, neighbours) that cover each bucket's rows and neighbours, in lists of at most so many comparisons."""
    quads = [q for q in zip(lo.tolist(), hi.tolist(), off.tolist(), length.tolist(), strict=True) if q[3]]
    if len(quads) != 1 or (quads[0][1] - quads[0][0]) * quads[0][3] <= most:
        if quads:
            yield quads
        return
    g, f, t, w = quads[0]
    for m in range(t, t + w, most):
        wide = min(most, t + w - m)
        for r in range(g, f, max(1, most // wide)):
            yield [(r, min(r + max(1, most // wide), f), m, wide)]


def _cell(radius: int):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Edges (a, b), and (a, null, n): so many links of a in this cell."""
        of, rows, first, last = ([], []), ([], []), 0, 0
        for batch in batches:  # side: 0 and 1 of two blocks, 2 of one alone
            side = batch.column("side").to_numpy()
            first, last = (batch.column(k)[0].as_py() for k in ("first", "last")) if len(side) else (first, last)
            for k in (0, 1):
                some = np.flatnonzero((side == 1) == k)
                if len(some):
                    of[k].append(batch.column("doc_id").to_numpy()[some])
                    rows[k].append(np.stack([batch.column(f"s{w}").to_numpy()[some].view(np.uint64) for w in range(WORDS)], 1))
        alone = not of[1]
        if alone and of[0] and side[0] != 2:  # the other block is empty
            of[0].clear()
            rows[0].clear()
        ids = np.concatenate(of[0] + of[1] or [np.empty(0, np.int64)])
        blocks = []
        for k in (0, 1):
            blocks.append(np.concatenate(rows[k]) if rows[k] else np.empty((0, WORDS), np.uint64))
            rows[k].clear()
        of[0].clear()
        of[1].clear()
        common.trim()
        own = len(blocks[0])
        if alone:
            blocks[1] = None
        links, label = np.zeros(len(ids), np.int64), np.arange(len(ids), dtype=np.int32)
        edges, held = [(label[:0], label[:0])], 0

        def forest() -> tuple[np.ndarray, np.ndarray]:
            return common.spanning(np.concatenate([a for a, _ in edges]), np.concatenate([b for _, b in edges]))

        for a, b in (_by_parts(*blocks, radius, range(first, last)) if last else _tiled(*blocks, radius)) if own else ():
            if not alone:
                b = b + own
            for x in (a, b):
                node, times = np.unique(x, return_counts=True)
                links[node] += times
            apart = label[a] != label[b]
            edges.append((a[apart], b[apart]))
            held += len(edges[-1][0])
            if held > 1 << 20:  # many pairs of few fingerprints: their forest is as good
                roots, nodes = forest()
                label[nodes] = roots
                edges, held = [(roots, nodes)], 0
        roots, nodes = forest()
        some = np.flatnonzero(links)
        yield pa.RecordBatch.from_arrays([
            pa.array(np.concatenate([ids[roots], ids[some]]), pa.int64()),
            pa.concat_arrays([pa.array(ids[nodes], pa.int64()), pa.nulls(len(some), pa.int64())]),
            pa.array(np.concatenate([np.zeros(len(roots), np.int64), links[some]]), pa.int64()),
        ], ["a", "b", "n"])
        del ids, blocks, links, label, edges
        common.trim()

    return compare


def near_edges(sig: DataFrame, radius: int, stripe_rows: int) -> DataFrame:
    """(a, b, n) of fingerprints (doc_id, s0 ..): edges whose components are those of all near copies, and counts of links."""
    pop = sum((F.bit_count(f"s{k}") for k in range(1, WORDS)), F.bit_count("s0"))
    key = sig.withColumn("key", pop.cast("long") * (1 << 10) + F.pmod(F.xxhash64("doc_id"), F.lit(1 << 10))).withColumn("pop", pop)
    total = key.count()
    indexed = total >= INDEX_FROM
    stripes = max(1, min(2048, -(-total // (max(stripe_rows, INDEX_STRIPE) if indexed else stripe_rows))))
    cuts = sorted({int(x) for x in key.approxQuantile("key", [i / stripes for i in range(1, stripes)], 0.25 / stripes)}) if stripes > 1 else []
    bounds = F.array(*[F.lit(c).cast("long") for c in cuts]) if cuts else F.array().cast("array<long>")
    key = key.withColumn("stripe", F.size(F.filter(bounds, lambda c: c < F.col("key"))) if cuts else F.lit(0))
    reach = {r["stripe"]: (r["lo"], r["hi"]) for r in key.groupBy("stripe").agg(F.min("pop").alias("lo"), F.max("pop").alias("hi")).collect()}
    pairs = [(i, j) for i, j in itertools.combinations_with_replacement(sorted(reach), 2) if reach[j][0] - reach[i][1] <= radius]
    # parts of a cell that a task of its own searches: one where cells are few, so that there are tasks enough, all where rows would be copied too often
    step = PARTS if stripes > 8 else 4 if stripes > 2 else 1
    tasks = [(p, p + step) for p in range(0, PARTS, step)] if indexed else [(0, 0)]
    cells = []
    for c, ((i, j), (first, last)) in enumerate(itertools.product(pairs, tasks)):
        cells.append((i, c, 0 if i != j else 2, first, last))
        if i != j:
            cells.append((j, c, 1, first, last))
    spark = sig.sparkSession
    plan = spark.createDataFrame(cells or [(-1, 0, 0, 0, 0)], "stripe int, cell int, side int, first int, last int")
    # the plan has one row for each stripe and cell: at most 2048 x 2048, and a few hundred for most inputs
    placed = key.drop("key", "pop").join(F.broadcast(plan) if len(cells) <= 200_000 else plan, "stripe").drop("stripe")
    return placed.groupBy("cell").applyInArrow(_cell(radius), "a long, b long, n long")


def near_copies(docs: DataFrame, radius: int = 50, stripe_rows: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, group_id, n_links) of every document that has a near copy.

    group_id is the least id of its group; n_links how many other fingerprints are within the radius of its own.
    """
    docs = common.one_row_per_id(docs.select(common.column(id_col).cast("long").alias("doc_id"), common.column(text_col).alias("text")), "doc_id", "text")
    sig = common.materialise(signatures(docs), "simhash")
    parts = [f"s{k}" for k in range(WORDS)]
    heads = common.materialise(sig.groupBy(*parts).agg(F.min("doc_id").alias("doc_id")), "heads")
    rows = stripe_rows or max(4096, min(1 << 16, heads.count() // 8))
    found = common.materialise(near_edges(heads.select("doc_id", *parts), radius, rows), "near")
    heads_of = sig.select("doc_id", *parts).join(heads.select(*parts, F.col("doc_id").alias("head")), parts).select("doc_id", "head")
    heads_of = common.materialise(heads_of, "heads")
    equal = heads_of.filter("doc_id <> head").select(F.col("head").alias("a"), F.col("doc_id").alias("b"))
    roots = common.components(found.filter("b is not null").select("a", "b").unionByName(equal)).select(F.col("node").alias("doc_id"), F.col("root").alias("group_id"))
    links = found.filter("b is null").groupBy(F.col("a").alias("head")).agg(F.sum("n").alias("n_links"))
    return roots.join(heads_of, "doc_id").join(links, "head", "left").select("doc_id", "group_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))


def dedupe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs without the near copies, except that with the least id of each group; rows without an id stay.

    Rows that share their id with the one that counts stay too where their text is another.
    """
    found = near_copies(docs, id_col=id_col, text_col=text_col, **options)
    gone = common.fresh(docs, "gone")
    drop = found.filter("doc_id <> group_id").select(F.col("doc_id").alias(gone))
    one, rest = common.by_id(docs, id_col, text_col)
    kept = one.join(drop, common.column(id_col).cast("long") == F.col(gone), "left_anti").unionByName(docs.filter(common.column(id_col).isNull()))
    return kept if rest is None else kept.unionByName(rest)
