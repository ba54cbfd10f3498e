"""Sequence packing as a cutting-stock problem solved by column generation.

Documents of n tokens (their end marker included) are to fill sequences of ``capacity`` tokens. A longer document is cut
into pieces of a whole capacity and a rest. The pieces' lengths, rounded up to ``unit`` tokens, make a histogram
of at most capacity / unit classes, whatever the number of documents. On the driver:

* the master linear program covers the histogram with patterns (how many pieces of each class share a sequence),
  by the revised simplex method;
* knapsack dynamic programming prices columns with the master's duals, until no pattern is worth more than a sequence;
* pattern counts are rounded down, and what is left over (less than a sequence for each pattern) is packed
  first-fit decreasing.

Pieces are ranked within their class by (hash of the id, id, piece), and ranks are dealt to the patterns' places by
arithmetic, so no list of bins is ever made. Ranks come from counts by (class, hash bucket) and a row number
within each, so a class that holds a tenth of the corpus is still spread over the cluster.

Defined results. A document without id or without tokens (null or empty) is in no sequence. Repeated rows are packed
as often as they occur. The empty table gives no sequences. Further columns don't matter.
"""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm import common, token_count


def knapsack(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Best value of items (each as often as wanted, sizes ascending) within capacity, and how many of each."""
    best = np.zeros(capacity + 1)
    choice = np.full(capacity + 1, -1, np.int64)
    fits = np.searchsorted(sizes, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if k := fits[c]:
            v = values[:k] + best[c - sizes[:k]]
            i = int(v.argmax())
            if v[i] > best[c] + 1e-12:
                best[c], choice[c] = v[i], i
    count, c = np.zeros(len(sizes), np.int64), capacity
    while c > 0:
        if choice[c] < 0:
            c -= 1
        else:
            count[choice[c]] += 1
            c -= int(sizes[choice[c]])
    return float(best[capacity]), count


def inverted(a: np.ndarray) -> np.ndarray:
    """The inverse by Gauss-Jordan steps with row pivots: LAPACK's threads can stall in a process that runs a Spark driver."""
    n = len(a)
    m = np.concatenate([a, np.eye(n)], axis=1)
    for k in range(n):
        p = k + int(np.abs(m[k:, k]).argmax())
        if p != k:
            m[[k, p]] = m[[p, k]]
        m[k] /= m[k, k]
        way = m[:, k].copy()
        way[k] = 0
        m -= way[:, None] * m[k]
    return m[:, n:]


def master(demand: np.ndarray, sizes: np.ndarray, capacity: int, tolerance: float = 1e-7, rounds: int = 20000) -> tuple[np.ndarray, np.ndarray]:
    """(patterns as rows, how often each) of an optimal solution of the linear program."""
    m = len(sizes)
    patterns = np.diag(capacity // sizes)
    inverse = np.diag(1.0 / np.diag(patterns))  # of the basis with patterns as columns
    amount = np.einsum("ij,j->i", inverse, demand)
    for turn in range(rounds):
        if turn % 200 == 199:
            inverse = inverted(patterns.T.astype(float))
            amount = np.einsum("ij,j->i", inverse, demand)
        duals = inverse.sum(0)
        value, column = knapsack(duals, sizes, capacity)
        if value <= 1 + tolerance:
            break
        way = np.einsum("ij,j->i", inverse, column)  # not by BLAS, whose threads wait for each other on a busy driver
        ok = way > 1e-9
        ratio = np.full(m, np.inf)
        ratio[ok] = np.maximum(amount[ok], 0) / way[ok]
        out = int(ratio.argmin())
        amount = amount - ratio[out] * way
        amount[out] = ratio[out]
        row = inverse[out] / way[out]
        inverse = inverse - np.outer(way, row)
        inverse[out] = row
        patterns[out] = column
    else:
        warnings.warn(f"the linear program wasn't optimal after {rounds} rounds: the plan holds, its bound doesn't", stacklevel=2)
    return patterns, np.maximum(amount, 0)


def plan(demand: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int, float]:
    """(slots, bins, bound): slots as (size, first rank, end rank, first bin, pieces of that size in each of its bins)."""
    sizes = np.array(sorted(demand), np.int64)
    if not len(sizes):
        return [], 0, 0.0
    need = np.array([demand[int(s)] for s in sizes], np.int64)
    patterns, amount = master(need.astype(float), sizes, capacity)
    used = [(patterns[k], int(np.floor(amount[k] + 1e-6))) for k in range(len(amount))]
    left, whole = need.copy(), []
    for pattern, n in used:
        has = pattern > 0
        if n > 0 and has.any():
            n = int(min(n, (left[has] // pattern[has]).min()))
        if n > 0:
            whole.append((pattern, n))
            left -= pattern * n
    room: list[int] = []
    rest: list[np.ndarray] = []
    for k in range(len(sizes) - 1, -1, -1):  # first-fit decreasing
        for _ in range(int(left[k])):
            for b, free in enumerate(room):
                if free >= sizes[k]:
                    break
            else:
                b = len(room)
                room.append(capacity)
                rest.append(np.zeros(len(sizes), np.int64))
            room[b] -= int(sizes[k])
            rest[b][k] += 1
    whole += [(p, 1) for p in rest]
    slots, rank, bins = [], np.zeros(len(sizes), np.int64), 0
    for pattern, n in whole:
        for k in np.flatnonzero(pattern).tolist():
            take = int(pattern[k]) * n
            slots.append((int(sizes[k]), int(rank[k]), int(rank[k]) + take, bins, int(pattern[k])))
            rank[k] += take
        bins += n
    assert (rank == need).all()
    return slots, bins, float(amount.sum())


def token_lengths(docs: DataFrame, ranks: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens) of docs, an end mark included for each that has tokens; a small table in the shared folder."""
    counted = token_count.count_tokens(docs, ranks, id_col=id_col, text_col=text_col)
    return common.materialise(counted.filter("n_tokens > 0").withColumn("n_tokens", F.col("n_tokens") + 1), "lengths")


def pieces(lengths: DataFrame, capacity: int, unit: int) -> DataFrame:
    """(doc_id, piece, start, length, size) from (doc_id, n_tokens)."""
    cap = F.lit(capacity).cast("long")
    cut = lengths.filter("doc_id is not null and n_tokens > 0").withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_tokens") - 1) / cap))))
    cut = cut.withColumn("start", F.col("piece") * cap).withColumn("length", F.least(cap, F.col("n_tokens") - F.col("start")))
    return cut.select("doc_id", "piece", "start", "length", F.ceil(F.col("length") / unit).cast("int").alias("size"))


def pack(lengths: DataFrame, capacity: int = 2048, unit: int = 8) -> DataFrame:
    """(bin_id, doc_id, piece, start, length): every piece of every document of (doc_id, n_tokens) in a sequence.

    The tokens in a bin are at most capacity.
    """
    if capacity % unit:
        raise ValueError("capacity must be a multiple of unit")
    spark = lengths.sparkSession
    spread = max(8, common.partitions(spark))
    cut = pieces(lengths, capacity, unit).withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(spread)).cast("int"))
    counts = cut.groupBy("size", "part").agg(F.count("*").alias("n"))
    # capacity / unit rows, whatever the size of the corpus
    demand = {r["size"]: r["n"] for r in counts.groupBy("size").agg(F.sum("n").alias("n")).collect()}
    slots, _, _ = plan(demand, capacity // unit)
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("size").orderBy("part")) - F.col("n")).drop("n")
    order = Window.partitionBy("size", "part").orderBy("doc_id", "piece", "length", "start")
    ranked = cut.withColumn("row", F.row_number().over(order).cast("long") - 1).join(before, ["size", "part"]).withColumn("rank", F.col("row") + F.col("before"))
    schema = "size int, first long, stop long, bin long, each long"
    # a few rows for each class: bounded by (capacity / unit) squared, a few thousand in practice
    places = F.broadcast(spark.createDataFrame(slots, schema).withColumnRenamed("size", "slot_size"))
    at = (F.col("size") == F.col("slot_size")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("stop"))
    bin_id = F.col("bin") + F.floor((F.col("rank") - F.col("first")) / F.col("each"))
    return ranked.join(places, at).select(bin_id.cast("long").alias("bin_id"), "doc_id", "piece", "start", "length")
