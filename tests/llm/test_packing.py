"""Every token of every document in one sequence, and no more sequences than first-fit decreasing."""

import random

from tessella.llm import packing


def test_pack_places_every_piece_once(spark):
    rng = random.Random(6)
    rows = [(i, rng.randrange(1, 200)) for i in range(300)] + [(5, 30), (5, 30), (None, 9), (900, 0), (901, None)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, n_tokens long"), capacity=64, unit=8).collect()
    want = sorted((i, at, min(64, n - at)) for i, n in rows if i is not None and n for at in range(0, n, 64))
    assert sorted((r.doc_id, r.start, r.length) for r in got) == want
    room: dict[int, int] = {}
    for r in got:
        room[r.bin_id] = room.get(r.bin_id, 0) + r.length
    assert max(room.values()) <= 64
    free: list[int] = []
    for size in sorted((-(-n // 8) for _, _, n in want), reverse=True):
        k = next((k for k, f in enumerate(free) if f >= size), None)
        if k is None:
            free.append(8 - size)
        else:
            free[k] -= size
    assert len(room) <= len(free)


def test_empty_table_has_no_sequences(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, n_tokens long")).collect() == []


def test_inverse():
    import numpy as np

    rng = np.random.default_rng(1)
    a = rng.integers(0, 4, (40, 40)).astype(float) + 3 * np.eye(40)[rng.permutation(40)]
    assert np.abs(np.einsum("ij,jk->ik", packing.inverted(a), a) - np.eye(40)).max() < 1e-6
