"""op3 against brute force, and its defined cases."""

import numpy as np
from pyspark.sql import functions as F

from tessella.llm import permutation

SCHEMA = "vec_id long, embedding array<float>"


def table(spark, ids, v):
    return spark.createDataFrame([(int(i), [float(t) for t in x]) for i, x in zip(ids, v, strict=True)], SCHEMA)


def brute(ids, v, query, k):
    w = v.astype(float)
    u = (w / np.linalg.norm(w, axis=1)[:, None]).astype(np.float32).astype(float)
    s = np.round(u @ u[ids.tolist().index(query)], 6)
    rows = sorted((-s[j], int(i)) for j, i in enumerate(ids) if i != query)
    return [(i, -x) for x, i in rows[:k]]


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


def test_recall_against_brute_force_with_a_hot_group(spark):
    rng = np.random.default_rng(3)
    v = rng.standard_normal((3000, 64)).astype(np.float32)
    v[:1000] = v[0] + 0.02 * rng.standard_normal((1000, 64))  # a third of the rows are near copies
    ids = np.arange(3000) * 7
    got = found(permutation.search(table(spark, ids, v).repartition(4), F.pmod("vec_id", F.lit(100)) == 0))
    hit = 0
    for query, rows in got.items():
        want = brute(ids, v, query, 10)
        hit += sum(score >= want[-1][1] - 1e-6 for _, score in rows)
    assert len(got) == 30 and hit / (10 * len(got)) >= 0.9


def test_fraction_one_is_the_exact_search_in_several_cells(spark, monkeypatch):
    rng = np.random.default_rng(4)
    v = rng.standard_normal((400, 16)).astype(np.float32)
    v[50] = v[51] = v[52]  # ties
    ids = np.arange(400)
    monkeypatch.setattr(permutation, "ASKED", 8)
    got = found(permutation.search(table(spark, ids, v).repartition(5), F.pmod("vec_id", F.lit(10)) == 0, k=7, fraction=1.0))
    assert sorted(got) == list(range(0, 400, 10))
    for query, rows in got.items():
        assert rows == [(i, s) for i, s in brute(ids, v, query, 7)]


def test_footrule_gain_is_the_footrule_distance():
    rng = np.random.default_rng(5)
    pivots, prefix, n = 20, 6, 50
    order = np.stack([rng.permutation(pivots)[:prefix] for _ in range(n + 1)])
    rows, query = order[:n], order[n]
    flat = rows.ravel()
    by = np.argsort(flat, kind="stable")
    start = np.searchsorted(flat[by], np.arange(pivots + 1))
    gain = permutation.footrule_gain(query, start, (by // prefix).astype(np.uint16), (by % prefix).astype(np.uint16), n)
    place = lambda o: np.array([list(o).index(p) if p in o else prefix for p in range(pivots)])
    far = np.array([np.abs(place(r) - place(query)).sum() for r in rows])
    assert (far == prefix * (prefix + 1) - 2 * gain.astype(int)).all()


def test_defined_cases(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (None, [1.0, 0.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [1.0, 2.0, 3.0]), (7, []), (8, [0.0, 1.0]), (8, [0.0, -1.0]), (9, [2.0, 0.0])]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("vec", F.lit("x")).withColumn("rank", F.lit(1))
    got = found(permutation.search(df, F.lit(True), k=3))
    assert got == {0: [(1, 1.0), (9, 1.0), (8, 0.0)], 1: [(0, 1.0), (9, 1.0), (8, 0.0)], 8: [(0, 0.0), (1, 0.0), (9, 0.0)], 9: [(0, 1.0), (1, 1.0), (8, 0.0)]}
    assert permutation.search(df.limit(0), F.lit(True)).count() == 0
    assert permutation.search(df.filter("vec_id = 0"), F.lit(True)).count() == 0
