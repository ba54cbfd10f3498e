"""op1, op2 and op4 against the libraries and plain loops, and their defined cases."""

import random

import pyarrow as pa
import pytest

from tessella.llm import catalog, langid, sentencepiece, token_count

PIECES, RANKS = catalog.tokenizer_file("piece_bpe_32k.model"), catalog.tokenizer_file("byte_bpe_50k.tiktoken")
AWKWARD = ["", " ", "  two  spaces ", "naïve café", "日本語のテキスト", "a\tb\nc", "emoji 😀 x", "▁mark ▁▁ x", "a" * 5000, " nbsp", "x\r\ny", "0x1F " * 300]


@pytest.fixture(scope="module")
def texts(spark):
    rows = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()] if _data() else []
    rng = random.Random(1)
    return rows + AWKWARD + [" ".join(rng.choice(["alpha", "béta", "γάμμα", "x1", "--"]) for _ in range(400))]


def _data() -> bool:
    import os

    return os.path.isdir("/root/testdata/sf0.001")


def _frame(spark, texts):
    rows = [(i, t, "extra") for i, t in enumerate(texts)] + [(None, "no id", "x"), (0, "again", "x"), (0, "again", "x"), (9999, None, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string")


def test_sentencepiece_equals_the_library_and_decodes_back(spark, texts):
    import sentencepiece as spm

    library = spm.SentencePieceProcessor(model_file=PIECES)
    df = _frame(spark, texts)
    got = sentencepiece.encode(df, PIECES, check=True).collect()
    assert len(got) == len(texts) + 4
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    for i, t in enumerate(texts):
        assert any(r.ids == library.encode(t) and r.n_ids == len(r.ids) for r in by[i])
    assert by[9999][0].ids is None and by[9999][0].n_ids is None
    assert sum(r.ids == library.encode("again") for r in by[0]) == 2
    back = {(r.doc_id, r.text) for r in sentencepiece.decode(sentencepiece.encode(df, PIECES), PIECES).collect()}
    for i, t in enumerate(texts):
        if "▁" not in t:
            assert (i, t) in back
    assert sentencepiece.encode(df.limit(0), PIECES).count() == 0


def test_sentencepiece_tables_that_are_cleared_give_the_same(texts):
    small, large = sentencepiece.Encoder(PIECES, 2000), sentencepiece.Encoder(PIECES)
    for at in range(0, len(texts), 5):
        part = pa.array(texts[at : at + 5])
        assert small.encode(part).to_pylist() == large.encode(part).to_pylist()


def test_sentencepiece_decodes_bytes_split_over_rows_and_bad_ids():
    d = sentencepiece.Decoder(PIECES)
    import sentencepiece as spm

    byte = lambda x: spm.SentencePieceProcessor(model_file=PIECES).piece_to_id(f"<0x{x:02X}>")
    assert d.decode(pa.array([[byte(0xC3)], [byte(0xA9)]], pa.list_(pa.int32()))).to_pylist() == ["�", "�"]
    assert d.decode(pa.array([[byte(0xC3), byte(0xA9)], None, [], [-1], [10**6, 5]], pa.list_(pa.int32()))).to_pylist() == ["é", None, "", None, None]


@pytest.mark.parametrize(("chunk", "overlap"), [(64, 4), (300, 40), (1 << 15, 256)])
def test_token_counts_equal_the_whole_text_encoding(spark, texts, chunk, overlap):
    encoding, _ = token_count._encoding(RANKS)
    more = [*texts, "a" * 700 + " b " + "c" * 900, "word " * 200 + "x" * 3000 + " tail" * 100, "!?" * 800, "\n \n" * 300, "日本語" * 400, " " * 2000]
    got = {}
    for r in token_count.count_tokens(_frame(spark, more), RANKS, chunk, overlap).collect():
        got.setdefault(r.doc_id, []).append(r.n_tokens)
    for i, t in enumerate(more):
        assert len(encoding.encode_ordinary(t)) in got[i]
    assert got[9999] == [None] and len(got[None]) == 1 and len(got[0]) == 3


def test_token_counts_of_unbroken_runs_take_few_encodings(monkeypatch):
    encoding, sizes = token_count._encoding(RANKS)
    calls = []
    real = token_count._borders
    monkeypatch.setattr(token_count, "_borders", lambda e, s, t: calls.append(len(t)) or real(e, s, t))
    text = "some words first " + "ab" * 4000 + " and after"
    assert token_count.count_long(text, encoding, sizes, 256, 8) == len(encoding.encode_ordinary(text))
    assert len(calls) < 150 and sum(calls) < 60 * len(text)


def test_language_id_equals_a_plain_loop(spark):
    import zstandard

    rng = random.Random(5)
    sounds = {"en": ["the", "ing", "wor", "ly"], "de": ["sch", "ung", "ein", "ich"], "fr": ["eau", "oui", "tion", "que"]}
    prose = lambda k: " ".join("".join(rng.choices(sounds[k], k=2)) for _ in range(80))
    rows = [(i, prose(k), k) for i, k in enumerate(list(sounds) * 20)]
    rows += [(900, None, "en"), (901, "", "en"), (902, "123 !!", "de"), (None, prose("en"), "en"), (903, prose("de"), None), (904, prose("fr") * 200, "fr"), (5, prose("en"), "de"), (5, prose("en"), "fr")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 as language", "2 as count")
    profiles = langid.fit(df)
    assert profiles == langid.fit(df.repartition(5)) and sorted(profiles) == sorted(sounds)
    got = langid.identify(df, profiles).collect()
    assert len(got) == len(rows)
    dicts = {k: zstandard.ZstdCompressionDict(v, dict_type=zstandard.DICT_TYPE_RAWCONTENT) for k, v in profiles.items()}
    for i, text, _ in rows:
        plain = langid.normalise(pa.array([text], pa.string()))[0].as_py().encode()
        if not plain:
            want = (None, 0.0, False)
        else:
            size = {}
            for k, d in sorted(dicts.items()):
                c = zstandard.ZstdCompressor(level=langid.LEVEL, dict_data=d, write_content_size=False, write_checksum=False)
                size[k] = sum(len(c.compress(plain[a : a + 2000])) for a in range(0, len(plain), 2000))
            best = min(size, key=lambda k: (size[k], k))
            two = sorted(size.values())[:2]
            margin = (two[1] - two[0]) / two[1]
            want = (best, margin, margin > 0 and margin >= 0.02)
        assert want in [(r.language, r.margin, r.accepted) for r in got if r.doc_id == i]
    right = [r.language == dict((i, k) for i, _, k in rows[:60])[r.doc_id] for r in got if r.doc_id is not None and r.doc_id < 60 and r.doc_id != 5]
    assert sum(right) >= 0.95 * len(right)
    assert langid.identify(df.limit(0), profiles).count() == 0
    assert langid.fit(df.limit(0)) == {} and {r.language for r in langid.identify(df, {}).collect()} == {None}
    kept = langid.keep_identified(df, profiles)
    assert kept.columns == df.columns and kept.count() == sum(r.accepted for r in got)


def test_language_id_on_held_out_documents(spark):
    if not _data():
        pytest.skip("no tables")
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    profiles = langid.fit(docs)
    got = langid.identify(docs, profiles).withColumnRenamed("doc_id", "d").join(docs, docs.doc_id == __import__("pyspark").sql.functions.col("d"))
    acc = got.selectExpr("avg(int(language = lang)) as a", "avg(int(accepted)) as kept").first()
    assert acc.a > 0.9 and acc.kept > 0.9
