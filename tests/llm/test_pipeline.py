"""The pipeline against the same five steps done one by one, and without any shortcut, in plain Python."""

import random

import numpy as np
import pyarrow as pa

import __spark_entry__
import corpus_pipeline
from tessella.llm import catalog, common, langid, pii, simhash, token_count

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _documents() -> list[tuple]:
    rng = random.Random(7)
    sounds = {"en": ("th", "ing", "wo", "ly", "er"), "de": ("sch", "ung", "ei", "ch", "ö"), "fr": ("eau", "ç", "oi", "tion", "é")}
    words = {k: ["".join(rng.choices(v, k=5)) for _ in range(2000)] for k, v in sounds.items()}
    prose = lambda lang, n: " ".join(rng.choice(words[lang]) for _ in range(n))
    rows = [(i, prose(lang, 120), lang) for i, lang in enumerate(["en", "de", "fr"] * 14)]
    passage = prose("en", 70)
    rows += [(100, prose("en", 150) + " " + passage, "en"), (101, passage + " " + prose("en", 150), "en")]
    rows += [(102, rows[0][1], "en"), (103, rows[3][1] + " extra", "en"), (104, "12 34 !", "en"), (105, None, "en"), (106, "", "de")]
    rows += [(107, prose("en", 100) + " mail john.smith@gmail.com now", "en"), (108, prose("de", 3000), "de"), (None, prose("fr", 80), "fr"), (109, rows[1][1], "de"), (109, prose("de", 90), "de")]
    return [(i, t, lang, "s", None if t is None else len(t)) for i, t, lang in rows]


def _repeats_cut(texts: dict[int, str], threshold: int) -> dict[int, str]:
    """Every window against every earlier one; words covered by a later occurrence go with the white space after them."""
    seen, out = set(), {}
    for i in sorted(texts):
        w, gone = texts[i].split(), set()
        for at in range(len(w) - threshold + 1):
            window = tuple(w[at : at + threshold])
            if window in seen:
                gone.update(range(at, at + threshold))
            seen.add(window)
        if len(gone) < len(w):
            out[i] = " ".join(x for k, x in enumerate(w) if k not in gone)
    return out


def _brute(spark, path: str) -> dict[int, int]:
    """doc_id -> tokens, end mark included, of every document that is packed."""
    docs = spark.read.parquet(f"{path}/documents.parquet")
    judge = langid.Judge(langid.fit(docs))
    rows = [r for r in docs.collect() if bool(judge.judge(pa.array([r.text], pa.string()), 0.02)[2][0])]
    best: dict[int, str] = {}
    for r in rows:
        if r.doc_id is not None and (len(r.text), r.text) > (len(best.get(r.doc_id, "")), best.get(r.doc_id, "")):
            best[r.doc_id] = r.text
    sign = {i: (int(n[0]), s[0]) for i, t in best.items() for n, s in [simhash.fingerprints(*common.as_bytes(pa.array([t])))]}
    ids = sorted(best)
    root = {i: i for i in ids}
    pairs = []
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            bits = np.bitwise_count(sign[a][1] ^ sign[b][1])
            if bits.sum() <= 50:
                pairs.append((a, b))
    for _ in ids:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    texts = {i: best[i] for i in ids if root[i] == i}
    for r in rows:  # a further text of an id stays, here in place of a near copy that went
        if r.doc_id is not None and r.text != best[r.doc_id]:
            assert r.doc_id not in texts
            texts[r.doc_id] = r.text
    kept = _repeats_cut(texts, 50)
    left = spark.createDataFrame([(i, t) for i, t in kept.items()] + [(None, r.text) for r in rows if r.doc_id is None], "doc_id long, text string")
    model = pii.fit(left)
    clean = []
    for i, t in kept.items():
        for s in reversed(model.find(t)):
            t = t[: s.start] + f"[{s.kind}]" + t[s.end :]
        clean.append((i, t))
    counted = token_count.count_tokens(spark.createDataFrame(clean, "doc_id long, text string"), catalog.tokenizer_file("byte_bpe_50k.tiktoken"))
    return {r.doc_id: r.n_tokens + 1 for r in counted.collect() if r.n_tokens}


def test_pipeline_equals_brute_force(spark, tmp_path):
    spark.createDataFrame(_documents(), SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    rows = __spark_entry__.queries()["pipeline"](spark, str(tmp_path)).collect()
    want = _brute(spark, str(tmp_path))
    got: dict[int, int] = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        assert r.start == got.get(r.doc_id, 0)
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == want
    assert 107 in got and 108 in got and not {102, 103, 104, 105, 106} & set(got)
    room: dict[int, int] = {}
    for r in rows:
        room[r.bin_id] = room.get(r.bin_id, 0) + r.length
    assert max(room.values()) <= 2048


def test_near_dedup_by_parts_keeps_the_same_documents(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    kept = lambda: sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").select("doc_id").collect())
    tiled = kept()
    monkeypatch.setattr(simhash, "INDEX_FROM", 1)
    monkeypatch.setattr(simhash, "INDEX_STRIPE", 90)
    assert kept() == tiled and 0 < len(tiled) < docs.count()
