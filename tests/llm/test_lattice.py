"""op5 against all pairs, and its defined cases."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import lattice

SCHEMA = "vec_id long, embedding array<float>"


def table(spark, ids, v):
    return spark.createDataFrame([(int(i), [float(t) for t in x]) for i, x in zip(ids, v, strict=True)], SCHEMA)


def brute(ids, v, threshold=0.95):
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1)[:, None]
    close = u @ u.T >= threshold
    same = (v[:, None, :] == v[None, :, :]).all(2)
    rep = [int(ids[np.flatnonzero(s)].min()) for s in same]
    group = np.array(ids)
    for _ in range(len(ids)):
        then = np.array([group[c | s].min() for c, s in zip(close, same, strict=True)])
        if (then == group).all():
            break
        group = then
    out = set()
    for i, own in enumerate(ids):
        links = len({rep[j] for j in np.flatnonzero(close[i])} - {rep[i]})
        if links or same[i].sum() > 1:
            out.add((int(own), int(group[i]), int(same[i].sum()), links))
    return out


def found(df):
    return {(r["vec_id"], r["group_id"], r["n_copies"], r["n_links"]) for r in df.collect()}


def corpus(n=600, dim=64, seed=1):
    rng = np.random.default_rng(seed)
    v = rng.standard_normal((n, dim)).astype(np.float32)
    v[: n // 3] = v[0] + 0.05 * rng.standard_normal((n // 3, dim))  # a third are near copies of one
    v[n // 3 : n // 3 + 40] = v[n // 3]  # equal vectors
    v[-30:] = v[-60:-30] + 0.08 * rng.standard_normal((30, dim))
    return np.arange(n) * 3 + 5, v.astype(np.float32)


@pytest.mark.parametrize("small", [False, True])
def test_against_all_pairs(spark, monkeypatch, small):
    ids, v = corpus()
    if small:  # crowded cells, several rounds and tiles
        monkeypatch.setattr(lattice, "CROWD", 12)
        monkeypatch.setattr(lattice, "TILE", 32)
    assert found(lattice.near_copies(table(spark, ids, v).repartition(3))) == brute(ids, v)


def test_two_groups_in_one_crowded_cell(spark, monkeypatch):
    monkeypatch.setattr(lattice, "CROWD", 4)
    monkeypatch.setattr(lattice, "ROUNDS", 1)
    rng = np.random.default_rng(9)
    v = np.concatenate([c + 0.02 * rng.standard_normal((20, 64)) for c in rng.standard_normal((3, 64))]).astype(np.float32)
    ids = np.arange(len(v))
    assert found(lattice.near_copies(table(spark, ids, v), scale=3.0)) == brute(ids, v)  # a scale that puts all in a few cells


def test_decode_gives_the_nearest_point():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((40, 8)) * 2
    near = lattice.decode(x)
    assert (np.abs(near.sum(1) % 2) < 1e-9).all() and ((near * 2) % 1 == 0).all()
    assert len(lattice.STEPS) == 240 and np.allclose((lattice.STEPS**2).sum(1), 2) and len({tuple(s) for s in lattice.STEPS}) == 240
    for p, q in zip(x, near, strict=True):  # no lattice neighbour is nearer, and E8's relevant vectors are those of length 2 and 4
        two = np.array([a + b for a, b in itertools.combinations(lattice.STEPS[:112], 2)])
        for step in (lattice.STEPS, two):
            assert (((p - q - step) ** 2).sum(1) >= ((p - q) ** 2).sum() - 1e-9).all()


def test_recall_at_the_threshold():
    rng = np.random.default_rng(6)
    a = rng.standard_normal((4000, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    w = rng.standard_normal(a.shape)
    w -= (w * a).sum(1)[:, None] * a
    b = 0.95 * a + np.sqrt(1 - 0.95**2) * w / np.linalg.norm(w, axis=1)[:, None]
    hasher = lattice.Hasher(64, 12, 0.34, 3, 11)
    met = np.zeros(len(a), bool)
    for t in range(12):
        x, y = hasher.cells(a, t), hasher.cells(b, t)
        met |= (x == y[:, :1]).any(1) | (y == x[:, :1]).any(1)
    signs = np.bitwise_count((hasher.signs(a) ^ hasher.signs(b)).view(np.uint64)) <= lattice.SIGNS
    assert met.mean() > 0.995 and signs.mean() > 0.999


def test_links_that_share_no_cell_are_found(spark, monkeypatch):
    monkeypatch.setattr(lattice, "STRIPE", 2048)
    rng = np.random.default_rng(12)
    a = rng.standard_normal((1500, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    w = rng.standard_normal(a.shape)
    w -= (w * a).sum(1)[:, None] * a
    b = 0.951 * a + np.sqrt(1 - 0.951**2) * w / np.linalg.norm(w, axis=1)[:, None]
    v = np.concatenate([a, b]).astype(np.float32)
    want = {(i, i % 1500, 1, 1) for i in range(3000)}
    rows = table(spark, np.arange(3000), v)
    assert found(lattice.near_copies(rows, tables=1, probes=0)) == want  # more than one stripe
    assert 0 < len(found(lattice.near_copies(rows, tables=1, probes=0, exact=False))) < 3000


def test_lattice_against_all_pairs(spark):
    ids, v = corpus()
    assert found(lattice.near_copies(table(spark, ids, v), exact=False)) == brute(ids, v)


def test_defined_cases(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (None, [1.0, 0.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [1.0, 2.0, 3.0]), (8, [0.0, 1.0]), (8, [0.0, -1.0]), (9, [2.0, 0.01])]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("id", F.lit("x")).withColumn("unit", F.lit(1))
    assert found(lattice.near_copies(df)) == {(0, 0, 2, 1), (1, 0, 2, 1), (9, 0, 1, 1)}
    assert found(lattice.near_copies(df.limit(0))) == set()
