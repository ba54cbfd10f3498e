"""Groups of near copies against every pair compared."""

import random

import numpy as np
import pyarrow as pa

from tessella.llm import common, simhash


def _documents() -> list[tuple]:
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrst", k=6))
    rows = []
    for i in range(60):
        base = [word() for _ in range(rng.choice([2, 30, 33, 200]))]
        rows += [(10 * i, base), (10 * i + 1, base + [word() for _ in range(rng.choice([1, 8, 10, 13]))])]
    texts = [(i, " ".join(w)) for i, w in rows]
    return [*texts, (5000, texts[0][1]), (5001, None), (5002, "  "), (None, texts[0][1]), (5003, "one"), (5003, texts[2][1])]


def _brute(rows: list[tuple]) -> tuple[dict[int, tuple[int, int]], int]:
    """Least document of the group and number of links of each near copy, and how many pairs with fewer than 0.8 as many words on one side are in them."""
    best: dict[int, str] = {}
    for i, t in rows:
        if i is not None and t and t.split() and (len(t), t) > (len(best.get(i, "")), best.get(i, "")):
            best[i] = t
    ids = sorted(best)
    sizes, sig = simhash.fingerprints(*common.as_bytes(pa.array([best[i] for i in ids])))
    pairs, uneven = [], 0
    for k, a in enumerate(ids):
        for j in range(k + 1, len(ids)):
            bits = np.bitwise_count(sig[k] ^ sig[j]).astype(int)
            if bits.sum() <= 50:
                pairs.append((k, j))
                uneven += min(sizes[k], sizes[j]) < 0.8 * max(sizes[k], sizes[j])
    root = list(range(len(ids)))
    for _ in ids:
        for k, j in pairs:
            root[k] = root[j] = min(root[k], root[j])
    links = lambda k: len({tuple(sig[i + j - k]) for i, j in pairs if k in (i, j)} - {tuple(sig[k])})
    return {ids[k]: (ids[root[k]], links(k)) for k in range(len(ids)) if any(k in p for p in pairs)}, uneven


def test_groups_equal_brute_force_whatever_the_word_numbers(spark):
    rows = _documents()
    want, uneven = _brute(rows)
    assert uneven > 3
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for stripe_rows in (0, 16):  # one stripe, and several
        got = {r.doc_id: (r.group_id, r.n_links) for r in simhash.near_copies(docs, stripe_rows=stripe_rows).collect()}
        assert got == want


def test_tiles_hold_every_close_pair():
    rng = np.random.default_rng(1)
    sig = rng.integers(0, 1 << 63, (300, 4), dtype=np.uint64)
    sig[200:] = sig[:100]
    sig[200:, 3] ^= rng.integers(0, 1 << 40, 100, dtype=np.uint64)
    bits = np.bitwise_count(sig[:, None] ^ sig[None]).astype(int)
    close = bits.sum(2) <= 50
    a, b = simhash.close_pairs(sig, tile=32)
    assert {tuple(sorted(p)) for p in zip(a.tolist(), b.tolist(), strict=True)} == {(i, j) for i, j in zip(*np.nonzero(close), strict=True) if i < j}
    a, b = simhash.close_pairs(sig[:150], sig[150:], tile=32)
    assert set(zip(a.tolist(), (b + 150).tolist(), strict=True)) == {(i, j) for i, j in zip(*np.nonzero(close), strict=True) if i < 150 <= j}


def test_limits_of_the_parts_leave_no_pair_out():
    for radius in (0, 1, 7, 50, 51, 100):
        limits = simhash.parts(radius)
        assert sum(p + 1 for _, _, p in limits) == radius + 1
        for k in range(0, 16, 4):
            word = limits[k][0]
            assert {w for w, _, _ in limits[k : k + 4]} == {word} and limits[k][1] + limits[k + 2][1] + 2 == word + 1
            assert all(limits[k + h][2] + limits[k + h + 1][2] + 2 == limits[k + h][1] + 1 for h in (0, 2))


def test_parts_hold_every_close_pair_once_at_a_share_of_the_comparisons(monkeypatch):
    rng = np.random.default_rng(4)
    sig = rng.integers(0, 1 << 63, (6000, 4), dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, (6000, 4), dtype=np.uint64)
    near = sig[rng.integers(0, 3000, 3000)]
    flips = np.argsort(rng.random((3000, 256)), axis=1).argsort(axis=1) < rng.integers(1, 60, 3000)[:, None]  # some beyond the radius
    sig[3000:] = near ^ np.packbits(flips, axis=1, bitorder="little").view(np.uint64)
    sig[:400, 0] = sig[0, 0]  # a bucket with many
    compared, count = [0], np.bitwise_count

    def counted(x, **options):
        compared[0] += x.size * (x.dtype == np.uint32)
        return count(x, **options)

    for blocks in ((sig, None), (sig[:3500], sig[3500:])):
        a, b = simhash.close_pairs(*blocks)
        want = {tuple(sorted(p)) if blocks[1] is None else p for p in zip(a.tolist(), b.tolist(), strict=True)}
        compared[0] = 0
        with monkeypatch.context() as m:
            m.setattr(np, "bitwise_count", counted)
            got = [p for first in range(0, 16, 4) for a, b in simhash._by_parts(*blocks, 50, range(first, first + 4)) for p in zip(a.tolist(), b.tolist(), strict=True)]
        assert len(want) > 1000 and len(got) == len(set(got)) and set(got) == want
        pairs = 6000 * 5999 // 2 if blocks[1] is None else 3500 * 2500
        assert 0 < compared[0] < pairs / 5


def test_groups_and_links_by_parts_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(simhash, "INDEX_FROM", 1)
    rows = _documents()
    want, _ = _brute(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for stripe in (1 << 19, 40):
        monkeypatch.setattr(simhash, "INDEX_STRIPE", stripe)
        assert {r.doc_id: (r.group_id, r.n_links) for r in simhash.near_copies(docs, stripe_rows=1).collect()} == want


def test_dedupe_keeps_one_of_each_group_and_further_texts_of_an_id(spark):
    rows = _documents() + [(7777, None), (7777, "x y z"), (7777, "x y z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as __gone", "2 as __rid", "3 as count", "4 as cell", "5 as s0")
    want, _ = _brute(rows)
    kept = [(r.doc_id, r.text) for r in simhash.dedupe(docs).collect()]
    gone = {i for i, (g, _) in want.items() if i != g}
    assert len(kept) == len(set(kept)) and {i for i, _ in kept} >= {i for i, _ in rows if i not in gone}
    assert (None, rows[0][1]) in kept and (7777, "x y z") in kept and (7777, None) in kept
    assert ((5003, "one") in kept) and ((5003, rows[2][1]) not in kept)
    assert simhash.dedupe(docs.limit(0)).count() == 0 and simhash.near_copies(docs.limit(0)).count() == 0


def test_very_many_short_and_one_very_long_text():
    texts = pa.array(["w%d" % (i % 7) for i in range(70000)] + ["long " * 500000])
    batch = pa.RecordBatch.from_arrays([texts], ["text"])
    parts = list(common.slices(batch))
    assert sum(p.num_rows for p in parts) == 70001 and max(p.num_rows for p in parts) <= 1 << 16
    sizes, _ = simhash.fingerprints(*common.as_bytes(texts))
    assert (sizes == 1).all()


def test_parts_gather_neighbours_once_for_a_bucket_not_once_a_comparison(monkeypatch):
    rng = np.random.default_rng(6)
    sig = rng.integers(0, 1 << 63, (40000, 4), dtype=np.uint64)
    sig[:, 0] &= np.uint64(0x3F3F3F3F3F3F3F3F)  # fuller buckets, as in a large table
    sig[20000:] = sig[:20000]
    sig[20000:, 2] ^= rng.integers(0, 1 << 50, 20000, dtype=np.uint64)
    a, b = simhash.close_pairs(sig)
    want = {(i, j) for i, j in zip(np.minimum(a, b).tolist(), np.maximum(a, b).tolist(), strict=True)}
    made, compared, repeat, count = [0], [0], np.repeat, np.bitwise_count

    def repeated(*args, **options):
        out = repeat(*args, **options)
        made[0] += len(out)
        return out

    def counted(x, *args, **options):
        compared[0] += x.size
        return count(x, *args, **options)

    monkeypatch.setattr(np, "repeat", repeated)
    monkeypatch.setattr(np, "bitwise_count", counted)
    got = [p for a, b in simhash._by_parts(sig, None, 50, range(4)) for p in zip(a.tolist(), b.tolist(), strict=True)]
    assert len(want) > 15000 and len(got) == len(set(got)) and set(got) <= want and len(got) > 0.9 * len(want)
    assert made[0] < compared[0] / 4 < 40000 * 39999 / 40
