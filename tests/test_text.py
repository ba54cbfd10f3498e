"""Text functions, chunkers, the Markdown splitter and embedders."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.config import ImageEmbedConfig, Pooling, TextEmbedConfig, VideoEmbedConfig, default_pooling
from tessella.functions import batches, markdown, text
from tessella.operators import chunk, embed, rerank

EDGES = [None, "", "   ", "x" * 5000, "日本語のテキスト。" * 300, "one. two; three.", "short", "a" * 999, "b" * 1000, "c" * 1001]


def frame(spark, texts=EDGES):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_fixed_chunks(spark):
    with pytest.raises(ValueError, match="overlap"):
        chunk.fixed_chunks(F.col("text"), 10, 10)
    for size, overlap in ((1000, 0), (1000, 100), (10, 9)):
        got = {}
        for r in chunk.explode(frame(spark), chunk.fixed_chunks(F.col("text"), size, overlap), ["doc_id"]).orderBy("doc_id", "chunk_idx").collect():
            got.setdefault(r.doc_id, []).append(r.chunk)
        assert 0 not in got and 1 not in got
        for i, t in enumerate(EDGES[2:], 2):
            step, want, at = size - overlap, [], 0
            while True:
                want.append(t[at : at + size])
                if at + size >= len(t):
                    break
                at += step
            assert got[i] == want


def test_sentence_packs(spark):
    def packs(t, n):
        if not t:
            return []
        if len(t.split()) < n:
            return [t]
        parts = __import__("re").split("[.;]", t[:-1] if t[-1] in ".;" else t)
        out, open_ = [], []
        for p in parts:
            open_ += (p + ".").split()
            if len(open_) >= n:
                out.append(" ".join(open_))
                open_ = []
        return out + ([" ".join(open_)] if open_ else [])

    texts = [None, "", "a b.", "a b c. d e; f g h i j k. l", "..a.. b; c d e", "one two three four five.\n", "x. y. z."]
    rows = frame(spark, texts).select("doc_id", chunk.sentence_packs(F.col("text"), 3).alias("p")).collect()
    for r in rows:
        assert (r.p or []) == packs(texts[r.doc_id], 3)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab#-*.`>1 \n\t日!")), max_size=400), st.integers(1, 60), st.integers(0, 30))
def test_markdown_spans(value, size, overlap):
    plain = markdown.split(value, size)
    assert all(c and len(c) <= size and c == c.strip() for c in plain)
    assert "".join("".join(plain).split()) == "".join(value.split())
    if overlap < size:
        found = markdown.spans(value, size, overlap)
        assert all(0 < b - a <= size for a, b in found)
        assert all(p[0] < q[0] and p[1] < q[1] and p[1] - q[0] <= overlap for p, q in zip(found, found[1:], strict=False))
        covered = set().union(*(range(a, b) for a, b in found))
        assert all(i in covered or c.isspace() for i, c in enumerate(value))


def test_markdown_prefers_headings(spark):
    value = "# One\n\nfirst text here\n\n# Two\n\nsecond text here"
    assert markdown.split(value, 30) == ["# One\n\nfirst text here", "# Two\n\nsecond text here"]
    got = chunk.markdown_chunks(frame(spark, [value, None, ""]), "text", size=30).collect()
    assert [(r.doc_id, r.chunk_idx) for r in got] == [(0, 0), (0, 1)]
    with pytest.raises(ValueError, match="overlap"):
        chunk.markdown_chunks(frame(spark), "text", size=5, overlap=5)


def test_html(spark):
    html = "<html><head><title>T</title><style>x</style></head><body><h1>Head</h1><p>Some <b>bold</b> &amp; <a href='u'>link</a><br>next</p><ul><li>a<li>b</ul><ol><li>c</li></ol><pre>x  y</pre><script>var a='</p>';</script></body></html>"
    md = markdown.from_html(html)
    for part in ("# Head", "Some **bold** & [link](u)", "- a\n- b", "1. c", "```\nx  y\n```"):
        assert part in md
    assert "var a" not in md and markdown.unwrap_links("see [a](b) ![c](d)") == "see a !c"
    row = spark.createDataFrame([(html,), (None,), ("",)], "html string").select(text.html_strip(F.col("html")), text.html_title(F.col("html"))).collect()
    assert tuple(row[0]) == ("T Head Some bold & link next a b c x y".replace("&", "&amp;"), "T") and tuple(row[1]) == (None, None) and tuple(row[2]) == ("", "")


def test_text_functions(spark):
    rows = [("a/b\\c.TXT", "<s>1</s> <s>2\n3</s>", "t\nb\n", " \n x \n\n"), (None, None, None, None), ("plain", "none", "one", "")]
    c = spark.createDataFrame(rows, "p string, t string, b string, l string")
    got = c.select(text.basename(F.col("p")), text.extension(F.col("p")), text.last_tag(F.col("t"), "s"), text.title_of(F.col("b")), text.body_of(F.col("b")), text.blank_line_clean(F.col("l")), text.word_count(F.col("l"))).collect()
    assert tuple(got[0]) == ("c.TXT", "txt", "2\n3", "t", "b\n", " x ", 1)
    assert tuple(got[1])[:6] == (None,) * 6 and tuple(got[2]) == ("plain", "", None, "one", "", "", 0)
    raw = spark.createDataFrame([(bytearray(b"ok\xff"),), (None,)], "c binary").select(text.lossy_decode(F.col("c"))).collect()
    assert [r[0] for r in raw] == ["ok�", None]


def test_semantic_chunkers_lose_no_text(spark):
    encode = embed.HashingEmbedder(64).encode
    value = " ".join(f"cats like milk and sun {i}." for i in range(60)) + " " + " ".join(f"stocks fell on monday {i}." for i in range(60))
    for split in (chunk.statistical_chunks, chunk.cumulative_chunks):
        out = split(value, encode)
        assert " ".join(out).split() == value.split() and split("", encode) == [] and split("one", encode) == ["one"]
    assert len(chunk.statistical_chunks(value, encode, least=20, most=120)) > 1
    assert chunk.optimal_threshold(np.array([]), [1]) == 0.5 and chunk.optimal_threshold(np.array([0.3]), [1, 1]) == 0.3
    assert chunk.split_indices(np.array([0.1, 0.9, 0.2]), 0.5) == [1, 3]
    got = chunk.semantic_chunks(frame(spark, [value, None, ""]), encode, keep=["doc_id"]).collect()
    assert {r.doc_id for r in got} == {0}
    with pytest.raises(ValueError, match="chunker"):
        chunk.semantic_chunks(frame(spark), encode, "other")


def test_hashing_embedder_in_python_and_in_the_jvm(spark):
    e = embed.HashingEmbedder(16)
    df = frame(spark).withColumn("other", F.lit(1))
    got = e.embed(df, "text").withColumn("jvm", F.transform(e.as_column(F.col("text")), lambda x: F.round(x, 6))).orderBy("doc_id").collect()
    assert got[0].embedding is None and got[1].embedding == [0.0] * 16
    for r in got:
        assert r.embedding == r.jvm or np.allclose(r.embedding, r.jvm, atol=1e-6)
        assert r.embedding is None or round(sum(x * x for x in r.embedding), 4) in (0.0, 1.0)
    assert e.embed(df, "text", batch_size=1).drop("other").orderBy("doc_id").collect() == e.embed(df, "text", batch_size=500).drop("other").orderBy("doc_id").collect()
    assert df.columns == ["doc_id", "text", "other"] and e.embed_query([]) == [] and len(e.embed_query(["a"])[0]) == 16
    with pytest.raises(ValueError, match="dim"):
        embed.HashingEmbedder(0)


def test_late_chunking_sees_its_neighbours(spark):
    e = embed.HashingEmbedder(64)
    a, b = e.encode_late(["alpha beta", "gamma"])
    assert not np.allclose(a, e.encode(["alpha beta"])[0]) and np.isclose(a @ a, 1) and np.isclose(b @ b, 1)
    one = spark.createDataFrame([(1, ["alpha beta", "gamma"]), (2, None), (3, [])], "i long, chunks array<string>")
    got = {r.i: r.vectors for r in e.embed_chunks(one, "chunks", late=True).collect()}
    assert np.allclose(got[1], [a, b], atol=1e-6) and got[2] is None and got[3] == []


def test_other_embedders(spark):
    m = embed.MultiVectorEmbedder(32, 8)
    doc, query = m.encode("one two three"), m.encode("one", is_doc=False)
    assert doc.shape == (4, 32) and query.shape == (8, 32) and (np.linalg.norm(query, axis=1) == 1).all()
    assert [None if r.multi is None else len(r.multi) for r in m.embed(frame(spark, ["a b", None, ""]), "text").orderBy("doc_id").collect()] == [3, None, 1]
    s = embed.StaticEmbedder({"a": [1.0, 0.0], "b": [0.0, 1.0]})
    assert np.allclose(s.encode(["a b", "z"]), [[0.5**0.5, 0.5**0.5], [0, 0]])
    seen = []

    def post(url, headers, body):
        seen.append((url, body))
        n = len(body.get("input") or body.get("texts") or body.get("requests"))
        v = [[float(i), 1.0] for i in range(n)]
        return {"data": [{"index": i, "embedding": x} for i, x in reversed(list(enumerate(v)))], "embeddings": v if "texts" in body else [{"values": x} for x in v]}

    for name in ("openai", "cohere", "gemini"):
        assert embed.CloudEmbedder(name, "m", "k", post).encode(["x", "y"]).tolist() == [[0.0, 1.0], [1.0, 1.0]]
    assert seen[1][1]["input_type"] == "search_document" and seen[2][1]["requests"][0]["taskType"] == "SEMANTIC_SIMILARITY"
    with pytest.raises(ValueError, match="unknown service"):
        embed.CloudEmbedder("other", "m", "k")
    with pytest.raises(ValueError, match="no embedder"):
        embed.from_name("nothing")
    with pytest.raises(FileNotFoundError):
        embed.OnnxEmbedder("/nowhere")
    assert isinstance(embed.from_name("hashing-sparse", dim=8), embed.HashingEmbedder)


def test_reranker(spark):
    docs = ["a man eats pasta", "the girl carries a baby", "a man eats food", "a monkey plays", "", "a man eats food"]
    d = spark.createDataFrame(list(enumerate(docs)), "doc_idx int, document string")
    q = spark.createDataFrame([("a man eats food",), ("monkey",)], "query string")
    every = rerank.Reranker().rerank(q, d)
    assert every.count() == 12
    top = rerank.Reranker().rerank(q, d, top_k=2).filter("query = 'a man eats food'").orderBy("rank").collect()
    assert [r.doc_idx for r in top] == [2, 5] and top[0].relevance_score == round(1 / (1 + np.exp(-1.0)), 6)
    sizes = []
    own = rerank.Reranker(lambda a, b: [float(len(x) - len(y)) for x, y in zip(a, b, strict=True)], batch_size=5)
    got = own.rerank(q, d)
    assert got.count() == 12 and sizes == [] and "__logit" not in got.columns
    assert rerank.Reranker().rerank(q.limit(0), d).count() == 0
    with pytest.raises(ValueError, match="10,000"):
        rerank.Reranker().rerank(spark.range(10001).selectExpr("string(id) as query"), d)


def test_configs():
    assert TextEmbedConfig(chunk_size=1000, overlap_ratio=0.155).overlap == 155 and VideoEmbedConfig().max_frames == 300 and ImageEmbedConfig().buffer_size == 100
    for bad in ({"chunk_size": 0}, {"overlap_ratio": 1.0}, {"batch_size": -1}):
        with pytest.raises(ValueError, match="must be"):
            TextEmbedConfig(**bad)
    assert default_pooling("BAAI/bge-small") is Pooling.CLS and default_pooling("Qwen3-Embedding") is Pooling.LAST and default_pooling("x") is Pooling.MEAN


def test_cumulative_chunks_encode_a_piece_once():
    e, seen = embed.HashingEmbedder(16), []

    def counts(texts):
        seen.extend(texts)
        return e.counts(texts)

    rng = np.random.default_rng(5)
    texts = ["", "one", ". ; .", "a b. a c. a d. b c. x. x.", "İK 日本. k i."] + [" ".join(rng.choice(["a", "b", "c", "d.", "e."], 60)) for _ in range(40)]
    for value in texts:
        for threshold in (0.0, 0.5, 0.8):  # of whole numbers, so many a cosine is just at 0.5
            seen.clear()
            assert chunk.cumulative_chunks(value, e.encode, 3, threshold, counts) == chunk.cumulative_chunks(value, e.encode, 3, threshold)
            assert seen == chunk.pieces(value, 3)


def test_texts_are_taken_in_slices_of_bounded_size(spark, monkeypatch):
    texts = ["A b1-C", None, "", "é" * 900, "x" * 5000, "İK_z"] * 20
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    for step in (1, 4):
        got = list(batches.slices(batch, 0, step, most=4000, rows=8))
        assert [t for b in got for t in b.column(0).to_pylist()] == texts and all(b.num_rows <= 8 for b in got)
        assert all(b.num_rows <= step or sum(len((t or "").encode()) for t in b.column(0).to_pylist()) <= 4000 for b in got)
    assert [t.decode() for t in batches.tokens("A b1-C é2 İK_z")] == embed.tokenize("A b1-C é2 İK_z")
    kept = embed._Hashes(10)
    assert [kept[str(i).encode()] for i in range(100)] == [int(hashlib.md5(str(i).encode()).hexdigest()[:8], 16) for i in range(100)] and len(kept) <= 10
    e, sizes = embed.HashingEmbedder(16), []
    monkeypatch.setattr(batches, "SLICE_BYTES", 2000)
    monkeypatch.setattr(e, "_counts", lambda lists, f=e._counts: sizes.append(len(lists)) or f(lists))
    some = [t for t in texts if t]
    assert (e.counts(some) == np.concatenate([e.counts([t]) for t in some])).all() and max(sizes) < len(some)


def test_context_similarities_are_those_of_each_window():
    rng = np.random.default_rng(7)
    for n, window in ((0, 5), (1, 5), (2, 5), (30, 5), (30, 1)):
        v, want = rng.integers(0, 2, (n, 4)).astype(float), []
        for i in range(1, n):
            c = v[max(0, i - window) : i].mean(0)
            size = np.linalg.norm(c) * np.linalg.norm(v[i])
            want.append(float(v[i] @ c) / size if size else 0.0)
        assert chunk.context_similarities(v, window).tolist() == want
