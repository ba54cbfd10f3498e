"""Approximate nearest neighbours by a permutation index.

A vector is represented by its ``prefix`` nearest pivots in order of nearness. Rows are indexed in blocks; each block has
an inverted file with, for every pivot, the rows that have it in their prefix and at which place. A query walks the
lists of its own pivots and so adds up the footrule distance of every row to it: with places counted from 0 and
``prefix`` for pivots that are missing, two prefixes are prefix * (prefix + 1) apart less 2 * (prefix - max(place, place))
for each pivot they share. The nearest ``fraction`` of each block by footrule (all rows tied at the end included) is
reranked by cosine.

Every row is indexed and every query meets every block, as cells of (stripe of blocks, block of queries), so neither
side is broadcast or gathered whole; a cell passes on k rows a query. Pivots are chosen from a sample of at most
``sample`` rows, those with the least hashed ids, near copies of a chosen pivot left out, so a group of copies that holds
a third of the rows gives one pivot. fraction = 1 reranks every row, which is the exact search.

Defined results. Scores are cosines rounded to 6 places, ties go to the lesser id. A row isn't its own neighbour. Null
ids, null, empty, zero or infinite vectors, vectors with null elements and vectors of another than the commonest
length are neither indexed nor asked; of rows with the same id the greatest vector counts. Fewer than k other rows: all
of them. The empty table gives no rows. Further columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm import common, vectors

#: Rows of an index block, and of a block of queries.
BLOCK, ASKED = 8192, 8192
_BLOCKS = "ids binary, units binary, start binary, row binary, place binary"


def choose_pivots(rows: DataFrame, pivots: int, sample: int, seed: int = 7) -> np.ndarray:
    """At most so many pivots as unit rows, from (vec_id, vec)."""
    if rows.isEmpty():
        return np.empty((0, 0), np.float32)
    drawn = rows.orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id").limit(sample).select("vec").toArrow()
    v, ok = vectors.unit(vectors.matrix(drawn["vec"]))
    v = v[ok]
    kept = np.empty((0, v.shape[1]), np.float32)
    for x in v:
        if not len(kept) or float((kept @ x).max()) < 0.9:
            kept = np.concatenate([kept, x[None]])
            if len(kept) == pivots:
                break
    return kept


def prefixes(v: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The nearest pivots of each row, nearest first."""
    near = -(v @ pivots.T)
    if prefix < near.shape[1]:
        some = np.sort(np.argpartition(near, prefix - 1, axis=1)[:, :prefix], axis=1)
        return np.take_along_axis(some, np.argsort(np.take_along_axis(near, some, 1), axis=1, kind="stable"), 1)
    return np.argsort(near, axis=1, kind="stable")


def _indexer(pivots: np.ndarray, prefix: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                part = whole.slice(at, BLOCK)
                v, ok = vectors.unit(vectors.matrix(part.column(1)))
                ids, v = part.column(0).to_numpy()[ok], v[ok]
                if not len(ids):
                    continue
                flat = prefixes(v, pivots, prefix).ravel()
                order = np.argsort(flat, kind="stable")
                start = np.searchsorted(flat[order], np.arange(len(pivots) + 1)).astype(np.int32)
                row, place = (order // prefix).astype(np.uint16), (order % prefix).astype(np.uint16)
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (ids.astype(np.int64), v, start, row, place)], [x.split()[0] for x in _BLOCKS.split(", ")])

    return run


def footrule_gain(query: np.ndarray, start: np.ndarray, row: np.ndarray, place: np.ndarray, n: int) -> np.ndarray:
    """For each row of a block half of what its footrule distance to the query's prefix falls short of the greatest."""
    prefix = len(query)
    gain = np.zeros(n, np.uint32)
    for at, p in enumerate(query.tolist()):
        own = slice(start[p], start[p + 1])
        gain[row[own]] += prefix - np.maximum(place[own], at)  # a row is in a pivot's list once
    return gain


def best(ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k greatest scores, ties to the lesser id."""
    if len(score) > k:
        some = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
    else:
        some = np.arange(len(score))
    return some[np.lexsort((ids[some], -score[some]))][:k]


def _searcher(pivots: np.ndarray, prefix: int, k: int, fraction: float):
    dim = pivots.shape[1]
    types = ((np.int64, 1), (np.float32, dim), (np.int32, 1), (np.uint16, 1), (np.uint16, 1))

    def run(index: pa.Table, asked: pa.Table) -> pa.Table:
        qids, qv = asked["query_id"].to_numpy(), vectors.from_binary(asked["unit"])
        top: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0))] * len(qids)
        if len(qids):
            order = prefixes(qv, pivots, prefix)
            for block in zip(*(index[x.split()[0]].to_pylist() for x in _BLOCKS.split(", ")), strict=True):
                ids, v, start, row, place = (np.frombuffer(x, t) for x, (t, _) in zip(block, types, strict=True))
                v = v.reshape(-1, dim)
                least = min(len(ids), max(k + 1, int(np.ceil(fraction * len(ids)))))
                for i, q in enumerate(order):
                    gain = footrule_gain(q, start, row, place, len(ids))
                    near = np.flatnonzero(gain >= np.partition(gain, len(ids) - least)[len(ids) - least])
                    near = near[ids[near] != qids[i]]
                    score = np.round(v[near].astype(np.float64) @ qv[i].astype(np.float64), 6)
                    own = near[(b := best(ids[near], score, k))]
                    both = np.concatenate([top[i][0], ids[own]]), np.concatenate([top[i][1], score[b]])
                    b = best(*both, k)
                    top[i] = both[0][b], both[1][b]
        count = [len(x) for x, _ in top]
        return pa.table({
            "query_id": pa.array(np.repeat(qids, count), pa.int64()),
            "vec_id": pa.array(np.concatenate([x for x, _ in top]) if top else [], pa.int64()),
            "score": pa.array(np.concatenate([s for _, s in top]) if top else [], pa.float64()),
        })

    return run


def search(
    rows: DataFrame, asks: Column, k: int = 10, pivots: int = 512, prefix: int = 64, fraction: float = 0.15, sample: int = 4096, id_col: str = "vec_id", vec_col: str = "embedding"
) -> DataFrame:
    """(query_id, vec_id, score, rank): the k nearest rows of every row for which asks (over vec_id) is true."""
    spark = rows.sparkSession
    own = vectors.clean(rows, id_col, vec_col)
    chosen = choose_pivots(own, pivots, sample)
    if not len(chosen):
        return spark.createDataFrame([], "query_id long, vec_id long, score double, rank int")
    prefix = min(prefix, len(chosen))
    index = common.materialise(own.mapInArrow(_indexer(chosen, prefix), _BLOCKS), "permutations")
    units = common.materialise(own.filter(asks).mapInArrow(vectors.units, "vec_id long, unit binary").withColumnRenamed("vec_id", "query_id"), "queries")
    blocks, queries = index.count(), units.count()
    stripes = max(1, min(blocks, common.partitions(spark)), -(-blocks // 16))
    sets = max(1, -(-queries // ASKED))
    left = index.withColumn("stripe", F.pmod(F.xxhash64("ids"), F.lit(stripes))).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(sets - 1))))
    right = units.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(sets)).cast("int")).withColumn("stripe", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(stripes - 1).cast("long"))))
    cells = left.groupBy("stripe", "part").cogroup(right.groupBy("stripe", "part"))
    found = cells.applyInArrow(_searcher(chosen, prefix, k, fraction), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
