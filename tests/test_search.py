"""Vector functions and search in both of its ways, with nulls, zero vectors, ties and clashing columns."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessella.functions import vector
from tessella.operators import pooling, search

V = "doc_id long, vec array<double>"


def test_vector_functions(spark):
    rows = [([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 2.0]), (None, [1.0]), ([1.0, None], [1.0, 1.0])]
    a, b = F.col("a"), F.col("b")
    cols = [vector.dot(a, b), vector.cosine(a, b), vector.l2_distance(a, b), vector.neg_distance(a, b), vector.norm(a), vector.l2_normalize(a)]
    got = [tuple(r) for r in spark.createDataFrame(rows, "a array<double>, b array<double>").select(*cols).collect()]
    assert got[0] == (24.0, 0.96, 2**0.5, -(2**0.5), 5.0, [0.6, 0.8])
    assert got[1][1] == 0.0 and got[1][5] == [0.0, 0.0]
    assert got[2][0] is None and got[2][2] is None and got[3][0] is None and got[4][0] is None
    one = spark.range(1).select(vector.sigmoid(F.lit(0.0)), vector.softmax2(F.lit(1000.0), F.lit(1000.0)), vector.sigmoid(F.lit(-2000.0)), vector.scaled_logits(F.array(F.lit(2.0)), F.array(F.lit(3.0)), 0.0)).first()
    assert tuple(one) == (0.5, 0.5, 0.0, 6.0)


def brute(v, q, k, metric, ids, skip=None):
    if metric == "l2":
        s = -np.sqrt(((v - q) ** 2).sum(1))
    else:
        s = v @ q
        if metric == "cosine":
            n = np.sqrt((v * v).sum(1)) * np.sqrt(q @ q)
            s = np.divide(s, n, out=np.zeros_like(s), where=n > 0)
    s = np.round(s, 6) + 0.0
    order = [j for j in np.lexsort((ids, -s)) if ids[j] != skip][:k]
    return [(int(ids[j]), float(s[j])) for j in order]


@pytest.mark.parametrize("metric", ["cosine", "dot", "l2"])
@pytest.mark.parametrize("small", [1 << 20, 1])
def test_knn_both_ways(spark, metric, small):
    rng = np.random.default_rng(1)
    v = rng.standard_normal((300, 8))
    v[5] = 0
    v[10:14] = v[10]  # ties
    ids = np.arange(300)
    rows = [(int(i), x.tolist(), "x") for i, x in zip(ids, v, strict=True)]
    rows += [(None, [1.0] * 8, "x"), (900, None, "x"), (901, [1.0, None] + [0.0] * 6, "x"), (902, [1.0], "x")]
    df = spark.createDataFrame(rows, V + ", score string").repartition(3)
    asked = df.filter("doc_id % 50 = 0 or doc_id = 10").filter("doc_id < 900").withColumnRenamed("doc_id", "query_id")
    got = {}
    for r in search.knn(asked, df, 6, metric, skip_self=True, small_bytes=small).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.doc_id, r.score))
    assert set(got) == {0, 10, 50, 100, 150, 200, 250}
    for q, hits in got.items():
        assert hits == brute(v, v[q], 6, metric, ids, q)
    assert search.knn(asked.limit(0), df, 3).count() == 0 and search.knn(asked, df.limit(0), 3).count() == 0
    with pytest.raises(ValueError, match="metric"):
        search.knn(asked, df, 3, "cubic")


def test_pairs_in_tiles(spark):
    rng = np.random.default_rng(2)
    v = rng.standard_normal((120, 6))
    v[1] = v[0]
    v[2] = v[0]
    u = v / np.linalg.norm(v, axis=1)[:, None]
    want = sorted((-round(float(u[i] @ u[j]), 6), i, j) for i in range(120) for j in range(i + 1, 120))[:9]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], V)
    for tile in (4096, 30):
        assert [(-r.score, r.a, r.b) for r in search.pairs_topk(df, 9, tile=tile).collect()] == want
    assert search.pairs_topk(df.limit(0), 3).count() == 0 and search.pairs_topk(df.limit(1), 3).count() == 0


def test_maxsim(spark):
    rng = np.random.default_rng(3)
    docs = {i: rng.standard_normal((rng.integers(1, 6), 4)) for i in range(40)}
    frame = spark.createDataFrame([(i, m.tolist()) for i, m in docs.items()] + [(99, None), (98, []), (97, [[1.0]])], "doc_id long, multi array<array<double>>")
    asked = frame.filter("doc_id % 10 = 0").withColumnRenamed("doc_id", "query_id")
    for small in (1 << 20, 64):
        got = {}
        for r in search.maxsim(asked, frame, 5, small).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.doc_id, r.score))
        for q in (0, 10, 20, 30):
            score = sorted((-round(float((docs[q] @ m.T).max(1).sum()), 6), i) for i, m in docs.items())[:5]
            assert got[q] == [(i, -s) for s, i in score]
    assert search.maxsim(asked.limit(0), frame, 5).count() == 0


def test_fusion_and_best(spark):
    a = spark.createDataFrame([(1, 10, 0.9, 1), (1, 11, 0.8, 2)], "query_id long, doc_id long, score double, rank long")
    b = spark.createDataFrame([(1, 11, 5.0, 1), (1, 12, 4.0, 2)], "query_id long, doc_id long, score double, rank long")
    got = [tuple(r) for r in search.rrf([a, b], 3).orderBy("rank").collect()]
    assert [g[1] for g in got] == [11, 10, 12] and got[0][2] == round(1 / 62 + 1 / 61, 6)
    assert tuple(search.best_hit(a).first()) == (1, 10, 0.9)


HIDDEN = [[[1.0, 2.0], [3.0, 4.0], [5.0, 6.0]], [[10.0, 20.0], [30.0, 40.0], [50.0, 60.0]]]


@pytest.mark.parametrize(("masks", "how", "want"), [
    ([[1, 1, 0], [1, 1, 1]], "mean", [[2.0, 3.0], [30.0, 40.0]]),
    ([[1, 1, 0], [1, 1, 1]], "cls", [[1.0, 2.0], [10.0, 20.0]]),
    ([[0, 1, 1], [1, 1, 1]], "cls", [[3.0, 4.0], [10.0, 20.0]]),
    ([[1, 1, 0], [1, 1, 1]], "last", [[3.0, 4.0], [50.0, 60.0]]),
    ([[0, 1, 1], [1, 1, 1]], "last", [[5.0, 6.0], [50.0, 60.0]]),
])
def test_pooling_three_ways(spark, masks, how, want):
    from tessella.config import Pooling
    from tessella.operators import embed

    assert embed.pool(np.array(HIDDEN), np.array(masks), Pooling(how)).tolist() == want
    rows = spark.createDataFrame(list(zip(HIDDEN, masks, strict=True)), "h array<array<double>>, m array<int>")
    assert [r[0] for r in rows.select(pooling.pool_row(F.col("h"), F.col("m"), how, 2)).collect()] == want
    tokens = [(d, p, HIDDEN[d][p], masks[d][p]) for d in range(2) for p in range(3)] + [(7, 0, [1.0, 1.0], 0), (8, 0, None, 1)]
    table = spark.createDataFrame(tokens, "doc long, pos int, vec array<double>, mask int")
    f = {"mean": lambda t: pooling.mean_pool(t, 2), "cls": pooling.cls_pool, "last": pooling.last_pool}[how]
    assert [r.vec for r in f(table).orderBy("doc").collect()] == want
    with pytest.raises(ValueError, match="padding"):
        embed.pool(np.array(HIDDEN), np.array([[0, 0, 0], [1, 1, 1]]), Pooling.CLS)


def test_inverted_lists(spark):
    rng = np.random.default_rng(6)
    v = rng.standard_normal((90, 5))
    label = np.arange(90) % 6
    rows = [(int(i), x.tolist(), int(g)) for i, (x, g) in enumerate(zip(v, label, strict=True))] + [(500, None, 1), (501, [1.0], 1), (502, [1.0] * 5, None)]
    df = spark.createDataFrame(rows, V + ", label long")
    asked = df.filter("doc_id % 30 = 0").select(F.col("doc_id").alias("query_id"), "vec")
    lists = search.centroids(df.filter("doc_id < 500"), "label", 5)
    center = {g: v[label == g].mean(0) for g in range(6)}
    cos = lambda a, b: round(float(a @ b / np.sqrt((a @ a) * (b @ b))), 6)
    for probes in (2, 6):
        got = {}
        for r in search.ivf_topk(asked, df, lists, 4, probes).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.doc_id)
        for q in (0, 30, 60):
            near = sorted(range(6), key=lambda g: (-cos(v[q], center[g]), g))[:probes]
            want = sorted((i for i in range(90) if label[i] in near and i != q), key=lambda i: (-cos(v[q], v[i]), i))[:4]
            assert got[q] == want
    assert search.ivf_topk(asked.limit(0), df, lists, 4, 2).count() == 0


def test_sparse_search(spark):
    docs = {1: "a b b c", 2: "b c", 3: "d", 4: "a a a"}
    tokens = spark.createDataFrame([(i, t) for i, x in docs.items() for t in x.split()], "doc_id long, token string")
    asked = spark.createDataFrame([(9, "a"), (9, "b"), (8, "zzz")], "doc_id long, token string")
    idf = {t: np.log(1 + (4 - n + 0.5) / (n + 0.5)) for t, n in (("a", 2), ("b", 2))}
    want = {1: np.log(2) ** 2 * idf["a"] + np.log(3) * np.log(2) * idf["b"], 2: np.log(2) ** 2 * idf["b"], 4: np.log(4) * np.log(2) * idf["a"]}
    got = {r.doc_id: r.score for r in search.sparse_topk(asked, tokens, 4, 5).collect()}
    assert got == {i: round(s, 6) for i, s in want.items()}


@pytest.mark.parametrize("small", [1 << 20, 1])
def test_sparse_search_of_texts_writes_no_pairs(spark, small):
    docs = [(1, "a b, B c"), (2, "b\nc é"), (3, "d"), (4, "A a"), (4, "a"), (5, None), (6, "a"), (7, "a"), (None, "b"), (None, "b zzz")]
    asked = [(9, "a B"), (8, "zzz"), (7, None), (6, "none of them"), (9, "c")]
    rows = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    found = search.sparse_search(spark.createDataFrame(asked, "query_id long, text string"), rows, 3, small)
    idf = {t: np.log(1 + (len(docs) - n + 0.5) / (n + 0.5)) for t, n in (("a", 4), ("b", 2), ("c", 2), ("zzz", 0))}
    one = np.log(2) ** 2
    every = {1: one * idf["a"] + np.log(3) * np.log(2) * idf["b"] + one * idf["c"], 2: one * (idf["b"] + idf["c"]), 4: np.log(4) * np.log(2) * idf["a"], None: np.log(3) * np.log(2) * idf["b"]}
    want = sorted(((round(s, 6), i) for i, s in every.items()), key=lambda x: -x[0])[:3]
    got = [tuple(r) for r in found.orderBy("query_id", "rank").collect()]
    assert got == [(8, None, round(one * idf["zzz"], 6), 1), *((9, i, s, r) for r, (s, i) in enumerate(want, 1))]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "Generate" not in plan
    assert search.sparse_search(spark.createDataFrame([(7, "-")], "query_id long, text string"), rows, 3).count() == 0


def test_maxsim_in_blocks_of_bounded_size():
    rng = np.random.default_rng(4)
    kind = pa.list_(pa.list_(pa.float64()))
    own, asked = ([rng.standard_normal((rng.integers(1, 6), 4)) for _ in range(n)] for n in (50, 30))
    table = lambda name, m: pa.table({name: pa.array(range(len(m)), pa.int64()), "multi": pa.array([x.tolist() for x in m], kind)})
    docs, want = table("doc_id", own).to_batches()[0], {}
    for i, q in enumerate(asked):
        want[i] = sorted((-round(float((q @ d.T).max(1).sum()), 6), j) for j, d in enumerate(own))[:3]
    for block in (1, 200, 1 << 20):
        found = list(search._maxsim(table("query_id", asked), 4, 3, block)(iter([docs])))[0].to_pylist()
        got = {i: sorted((-r["score"], r["doc_id"]) for r in found if r["query_id"] == i) for i in want}
        assert got == want


def test_idf_counts_before_anything_moves(spark):
    docs = [(1, "a b, B"), (2, "b\nA é"), (3, None), (4, "A a"), (4, "a d"), (None, "b zzz"), (None, "zzz")]
    rows = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    found = search.idf_of_texts(rows)
    got = {r.token: (r.df, round(r.idf, 6)) for r in found.collect()}
    assert got == {t: (n, round(np.log(1 + (7 - n + 0.5) / (n + 0.5)), 6)) for t, n in (("a", 3), ("b", 2), ("d", 1), ("zzz", 0))}
    assert search.idf_of_texts(rows.limit(0)).count() == 0
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()
    one = pa.RecordBatch.from_arrays([pa.array([True] * 40), pa.array([f"x y{i}" for i in range(40)])], ["real", "text"])
    parts = pa.Table.from_batches(list(search._document_counts(iter([one] * 3), most=10))).to_pydict()
    assert sum(n for t, n in zip(parts["token"], parts["n"], strict=True) if t == "x") == 120 and parts["token"].count("x") == 3


def test_rrf_hybrid_joins_no_tokens(spark):
    from tessella.plans import catalog

    plan = catalog.queries()["rrf_hybrid"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan
