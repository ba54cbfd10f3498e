"""Defined cases of op7, op9 and op10 and of the helpers they share."""

import random
import time

import numpy as np
import pytest

from tessella.llm import common, packing, pii, suffix_dedup


def test_pii_foreign_digits_and_long_local_parts():
    assert all(s.kind != "NATIONAL_ID" for s in pii.propose("call 5 ١٢٣-٤٥-٦٧٨٩ now"))
    pii.propose("x1 ١٢٣٤٥٦٧٨٩٠١٢٣٤ y")
    mail = "a" * 100 + "@example.com"
    assert (4, 4 + len(mail)) in {(s.start, s.end) for s in pii.propose("hey " + mail + " ok") if s.kind == "EMAIL"}
    assert {(s.start, s.end) for s in pii.propose("a@b.com,c@d.org") if s.kind == "EMAIL"} == {(0, 7), (8, 15)}
    assert pii.propose("@@ a@ @b") == []


def test_pii_takes_linear_time():
    took = []
    for n in (4000, 16000):
        text = " ".join(f"10.{i % 250}.{i % 99}.7 and" for i in range(n)) + " " + "ab1" * 50 * n
        began = time.process_time()
        pii.Model().find(text)
        pii.foremost(pii.propose(text))
        took.append(time.process_time() - began)
    assert took[1] < 10 * took[0] + 1


def test_pii_apart_equals_the_plain_test():
    rng = random.Random(4)
    for _ in range(100):
        spans = [pii.Span(a, a + rng.randrange(1, 9), "IP") for a in (rng.randrange(40) for _ in range(30))]
        best = []
        for s in spans:
            if all(s.end <= b.start or b.end <= s.start for b in best):
                best.append(s)
        assert pii.apart(spans) == sorted(best, key=lambda s: s.start)


def test_pii_defined_cases(spark):
    rows = [(1, "mail jane.roe@gmail.com now", 27), (None, "ip 10.1.2.3 here", 16), (2, None, None), (3, "", 0), (1, "mail jane.roe@gmail.com now", 27)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long").selectExpr("*", "1 as kind", "2 as span")
    model = pii.fit(df)
    found = [(r.doc_id, r.span) for r in pii.find(df, model).collect()]
    assert found.count((1, "jane.roe@gmail.com")) == 2
    out = pii.redact(df, model)
    assert out.columns == df.columns
    assert sorted(out.collect(), key=str)[0].n_chars is not None and {(r.text, r.n_chars) for r in out.collect()} >= {("mail [EMAIL] now", 16), (None, None), ("", 0)}
    empty = df.limit(0)
    assert pii.find(empty, pii.fit(empty)).count() == 0


def _windows(texts, n):
    seen, later = {}, set()
    for i in sorted(texts):
        w = texts[i].split()
        for at in range(len(w) - n + 1):
            seen.setdefault(tuple(w[at : at + n]), []).append((i, at))
    cover, gone = set(), set()
    for places in seen.values():
        if len(places) > 1:
            for k, (i, at) in enumerate(sorted(places)):
                cover |= {(i, x) for x in range(at, at + n)}
                if k:
                    gone |= {(i, x) for x in range(at, at + n)}
    return cover, gone


def test_suffix_dedup_words_and_clashing_columns(spark):
    rng = random.Random(8)
    texts = {i: " ".join(rng.choice("abc") for _ in range(rng.randrange(0, 60))) for i in range(40)}
    rows = [(i, t, len(t)) for i, t in texts.items()] + [(None, "a b c a b c a b", 15), (50, None, None), (51, "", 0), (0, texts[0], len(texts[0])), (3, "q w", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long").selectExpr("*", "1 as __at", "2 as __start", "3 as __stop", "4 as __rid", "5 as cuts")
    for chars in (1 << 24, 64):
        cover, gone = set(), set()
        for r in suffix_dedup.repeated_spans(df, 8, bucket_chars=chars).collect():
            own = {(r.doc_id, x) for x in range(r.start_word, r.end_word)}
            assert not own & cover
            cover |= own
            gone |= own if r.removed else set()
        assert (cover, gone) == _windows(texts, 8)
    out = suffix_dedup.remove_repeats(df, 8)
    assert out.columns == df.columns
    kept = {}
    for r in out.collect():
        kept.setdefault(r.doc_id, []).append((r.text, r.n_chars))
    assert kept[None] == [("a b c a b c a b", 15)] and kept[50] == [(None, None)] and ("q w", 3) in kept[3]
    for i, t in texts.items():
        left = " ".join(w for x, w in enumerate(t.split()) if (i, x) not in gone)
        assert i not in kept if t and not left else (left, len(left)) in [(x.strip(), len(x.strip())) for x, _ in kept[i]]
    assert suffix_dedup.repeated_spans(df.limit(0)).count() == 0 and suffix_dedup.remove_repeats(df.limit(0)).count() == 0


def test_packing_ties_repeats_and_the_bound(spark):
    rng = random.Random(3)
    rows = [(i, rng.randrange(1, 700)) for i in range(400)] + [(7, 33), (7, 33), (7, 40), (None, 5), (8000, 0), (8001, None), (9000, 1000)]
    df = spark.createDataFrame(rows, "doc_id long, n_tokens long").selectExpr("*", "1 as size", "2 as part")
    one = sorted(map(tuple, packing.pack(df, 256, 8).collect()))
    assert one == sorted(map(tuple, packing.pack(df.repartition(7), 256, 8).collect()))
    room, seen = {}, {}
    for b, d, _, _, n in one:
        room[b] = room.get(b, 0) + n
        seen[d] = seen.get(d, 0) + n
    assert max(room.values()) <= 256 and set(room) == set(range(len(room)))
    want = {}
    for d, n in rows:
        if d is not None and n:
            want[d] = want.get(d, 0) + n
    assert seen == want
    assert len(room) <= 1.03 * sum(want.values()) / 256 + 12
    assert packing.pack(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="multiple"):
        packing.pack(df, 250, 8)


def test_packing_bound_is_that_of_the_linear_program():
    rng = random.Random(9)
    demand = {s: rng.randrange(1, 5000) for s in range(1, 33)}
    slots, bins, bound = packing.plan(demand, 32)
    assert bound - 1e-6 <= bins <= bound + 33 and bound >= sum(s * n for s, n in demand.items()) / 32 - 1e-6
    assert packing.plan({}, 32) == ([], 0, 0.0)


def test_components_of_paths_hubs_and_cliques(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, 500 + i) for i in range(1, 400)] + [(1000 + i, 1000 + j) for i in range(20) for j in range(i)]
    edges += [(3000 + rng.randrange(300), 3000 + rng.randrange(300)) for _ in range(150)] + [(5, 5), (None, 3)]
    up = {}

    def root(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((root(a), root(b)))
            up[y], up[x] = x, up.get(x, x)
    want = {x: root(x) for x in up}
    got = common.components(spark.createDataFrame(edges, "a long, b long").repartition(6)).collect()
    assert {r.node: r.root for r in got} == want and len(got) == len(want)
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0
    x, y = common.spanning(np.array([a for a, b in edges if a is not None]), np.array([b for a, b in edges if a is not None]))
    assert {int(j): int(i) for i, j in zip(x, y, strict=True)} == {k: v for k, v in want.items() if k != v}


def test_a_cluster_must_name_its_shared_folder(spark):
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"
        _jsc = spark.sparkContext._jsc

    class Session:
        conf, sparkContext = Conf(), Context()

    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        with pytest.raises(RuntimeError, match="checkpoint"):
            common.shared_dir(Session())
