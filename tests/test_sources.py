"""Scans, extraction, the streaming index, adapters and media."""

import base64
import io
import wave
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella import api
from tessella.config import TextEmbedConfig
from tessella.operators import adapters, media
from tessella.operators.embed import HashingEmbedder
from tessella.sources import files, remote
from tessella.sources import media as sound
from tessella.streaming import stream_directory, stream_table


def docx(paragraphs):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join(f'<w:p><w:pPr><w:pStyle w:val="{s}"/></w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>' for s, t in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


@pytest.fixture
def folder(tmp_path):
    sub = tmp_path / "a" / "b"
    sub.mkdir(parents=True)
    (tmp_path / "one.txt").write_text("Some text. " * 30)
    (tmp_path / "a" / "two.md").write_bytes(b"# Title\n\nbody \xff end")
    (sub / "three.HTML").write_text("<h1>Hi</h1><p>see <a href='x'>there</a></p>")
    (sub / "four.docx").write_bytes(docx([("Heading1", "Head"), ("Normal", "This is a docx file test")]))
    (sub / "broken.docx").write_bytes(b"no zip")
    (sub / "paper.pdf").write_bytes(b"%PDF")
    (sub / "photo.JPG").write_bytes(b"\xff\xd8\xff")
    (sub / "x.apdf").write_bytes(b"")
    (sub / "clip.mp4").write_bytes(b"x")
    return tmp_path


def test_scans(spark, folder):
    names = lambda df: sorted(r.file_name for r in df.select("file_name").collect())
    assert names(files.scan(spark, str(folder))) == ["broken.docx", "four.docx", "one.txt", "paper.pdf", "two.md"]
    assert names(files.scan(spark, str(folder), [".html", "txt"])) == ["one.txt", "three.HTML"]
    assert names(files.scan(spark, str(folder), [".pdf"])) == ["paper.pdf"]
    assert names(files.scan_images(spark, str(folder))) == ["photo.JPG"] and names(files.scan_video(spark, str(folder))) == ["clip.mp4"] and names(files.scan_audio(spark, str(folder))) == []
    assert files.is_video("x.MP4") and not files.is_video("mp4.txt")
    with pytest.raises(FileNotFoundError):
        files.scan(spark, "/nowhere/at/all")
    with pytest.raises(FileNotFoundError):
        files.read_files(spark, [str(folder / "gone.txt")])
    with pytest.raises(ValueError, match="unsupported"):
        files.read_files(spark, [str(folder / "a" / "b" / "photo.JPG")])
    plan = files.scan(spark, str(folder)).select("path")._jdf.queryExecution().optimizedPlan().toString()
    assert "content" not in plan.split("Relation")[0]


def test_incremental(spark):
    found = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "path string")
    done = spark.createDataFrame([("a", 1), ("a", 2), (None, 3)], "path string, n int")
    assert sorted(str(r.path) for r in files.not_indexed(found, done).collect()) == ["None", "b", "b"]
    assert files.not_indexed(found, done.limit(0)).count() == 4


def test_extract(spark, folder):
    got = {r.file_name: r for r in files.extract(files.scan(spark, str(folder), ["txt", "md", "html", "docx", "pdf"])).collect()}
    assert got["two.md"].text == "# Title\n\nbody � end" and got["three.HTML"].text == "# Hi\n\nsee there"
    assert got["four.docx"].text == "# Head\n\nThis is a docx file test"
    assert got["broken.docx"].text is None and got["broken.docx"].error and "pdf" in got["paper.pdf"].error
    pdf = {r.file_name: r.text for r in files.extract(files.scan(spark, str(folder), ["pdf"]), lambda b: b.decode()).collect()}
    assert pdf == {"paper.pdf": "%PDF"}


def test_directory_stream_and_batch_agree(spark, folder, tmp_path_factory):
    e, config = HashingEmbedder(16), TextEmbedConfig(chunk_size=60, overlap_ratio=0.1)
    key = lambda df: sorted((r.file_name, r.chunk_idx, r.text, tuple(r.embedding)) for r in df.collect())
    batch = key(api.embed_directory(spark, str(folder), e, config=config))
    assert len(batch) > 6
    rows, seen = [], []

    class Keep(adapters.CallbackAdapter):
        def upsert(self, df):
            rows.extend(key(df))

    check = str(tmp_path_factory.mktemp("check"))
    run = lambda: stream_directory(spark, str(folder), e, Keep(print), check, config=config, max_files=2, progress=lambda *x: seen.append(x)).awaitTermination(120)
    run()
    assert sorted(rows) == batch and len(seen) >= 3
    run()
    assert sorted(rows) == batch  # a second run finds nothing new
    some = spark.createDataFrame([(batch[0][0],)], "path string")
    assert {r[0] for r in key(api.embed_directory(spark, str(folder), e, config=config, indexed=some))} == {r[0] for r in batch} - {batch[0][0]}
    one = api.embed_file(spark, str(folder / "one.txt"), e, config)
    assert key(one) == [r for r in batch if r[0].endswith("one.txt")]
    late = api.embed_file(spark, str(folder / "one.txt"), e, TextEmbedConfig(chunk_size=60, late_chunking=True)).collect()
    assert len(late) == 6 and len(late[0].embedding) == 16
    assert [r.text for r in api.embed_query(spark, ["", "long " * 1000, "日本語"], e).orderBy("query_id").collect()][2] == "日本語"
    pages = spark.createDataFrame([("http://h/x", "<p>hello</p>"), ("http://h/y", None)], "url string, html string")
    assert [(r.text, r.file_name) for r in api.embed_pages(pages, e).collect()] == [("hello", "http://h/x")]


def test_table_stream(spark, tmp_path):
    df = spark.range(50).selectExpr("id", "id % 7 as k")
    df.repartition(5).write.parquet(f"{tmp_path}/in")
    got = []
    stream_table(spark, f"{tmp_path}/in", df.schema, lambda b, n: got.append([r.id for r in b.collect()]), f"{tmp_path}/check", lambda x: x.filter("k = 0"), 2).awaitTermination(60)
    assert len(got) == 3 and sorted(sum(got, [])) == list(range(0, 50, 7))


ROWS = [([0.5, 0.5], "some text", "d/a.txt", "2024", None), ([1.0, 0.0], "x" * 5000, "d\\b.txt", "2024", "2023"), (None, None, None, None, None)]
ROW = "embedding array<double>, text string, file_name string, modified string, created string"


def test_adapters(spark, tmp_path):
    df = spark.createDataFrame(ROWS, ROW)
    assert adapters.flat5(df).columns == ["embeddings", "text", "file_name", "modified", "created"]
    assert adapters.capped5(df).agg(F.max(F.length("text"))).first()[0] == 4098
    meta = adapters.id_values_metadata(df).collect()
    assert meta[0].metadata_file == "a.txt" and meta[1].metadata_file == "b.txt" and len({r.id for r in meta}) == 3
    assert adapters.point_payload(df).first().payload.file_name == "d/a.txt"
    assert adapters.properties(df).first().properties["text"] == "some text"
    assert '"metadata":{"file_name":"d/a.txt"' in adapters.nested_json(df).first().document
    cols = adapters.columnar(df.withColumn("buffer", F.lit(1)), "buffer").first()
    assert len(cols.ids) == len(cols.documents) == 3
    table = adapters.TableAdapter(f"{tmp_path}/t")
    table.create_index(2)
    table.upsert(df)
    assert spark.read.parquet(f"{tmp_path}/t").count() == 3
    out = f"{tmp_path}/calls"

    def write(rows):
        with open(out, "a") as f:
            f.write(f"{len(rows)}\n")

    adapters.CallbackAdapter(write, buffer_size=2).upsert(spark.range(5).selectExpr("id").coalesce(1))
    assert open(out).read().split() == ["2", "2", "1"]
    assert '"prompt_tokens": 3' in adapters.embedding_response([{"embedding": [[0.1]]}], "m", 3) and "message" in adapters.error_response("bad")


def test_media_tables(spark):
    frames = spark.createDataFrame([(v, f) for v in (1, 2) for f in range(100)], "video long, frame long")
    got = media.sample_frames(frames, 30, 2).orderBy("video", "frame").collect()
    assert [(r.video, r.frame, r.frame_index) for r in got] == [(1, 0, 0), (1, 30, 1), (2, 0, 0), (2, 30, 1)]
    assert media.sample_frames(frames, 30, None).count() == 8
    keys = spark.createDataFrame([(k,) for k in (5, 90000, 7, -3, 4096)], "k long")
    assert [(r.k, r.position) for r in media.positions(keys, "k").orderBy("k").collect()] == [(-3, 0), (5, 1), (7, 2), (4096, 3), (90000, 4)]
    assert [r.buffer for r in media.buffers(keys, "k", 2).orderBy("k").collect()] == [0, 0, 1, 1, 2]
    seg = spark.createDataFrame([(0.9, -2.0), (0.9, 0.0), (0.1, -2.0), (None, -2.0)], "n double, l double")
    assert media.speech_only(seg, F.col("n"), F.col("l"), 0.6, -1.0).count() == 3
    rows = media.segment_rows(spark.createDataFrame([(1.5, 2.0, "hi", "f.wav")], "start double, duration double, text string, file_name string")).first()
    assert rows.end == 3.5 and rows.metadata == {"start": "1.5", "end": "3.5", "file_name": "f.wav"}


def test_audio_and_images(spark):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(2)
        w.setframerate(16000)
        w.writeframes(np.repeat(np.arange(35 * 16000) % 100, 2).astype("<i2").tobytes())
    slow = io.BytesIO()
    with wave.open(slow, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(8000)
        w.writeframes(b"\x80" * 10)
    df = spark.createDataFrame([("a", bytearray(out.getvalue())), ("b", bytearray(slow.getvalue())), ("c", bytearray(b"junk"))], "path string, content binary")
    got = {(r.path, r.window): r for r in sound.audio_windows(df).collect()}
    assert got["a", 0].duration == 30.0 and got["a", 1].duration == 5.0 and "8000" in got["b", None].error and got["c", None].error
    assert abs(got["a", 0].samples[5] - 5 / 32768) < 1e-9
    said = sound.transcribe(sound.audio_windows(df), lambda x: (f"{len(x)}", -0.5, 0.1)).collect()
    assert [r.text for r in said] == ["480000", "80000"]
    png = base64.b64encode(b"\x89PNG\r\n" + b"x" * 100).decode()
    rows = spark.createDataFrame([(png,), ("data:image/gif;base64," + base64.b64encode(b"GIF89a").decode(),), ("plain words",), (None,), ("A" * 101,)], "t string")
    assert [r.image_kind for r in sound.base64_images(rows, "t").collect()] == ["png", "gif", None, None, None]
    x = sound.preprocess(np.full((10, 20, 3), 255, np.uint8), 4)
    assert x.shape == (3, 4, 4) and np.allclose(x, 1)
    t = sound.tiles(800, 364)
    assert len(t) == 4 and t[-1] == (0, 0, 800, 364) and sum(h * w for _, _, h, w in t[:-1]) == 800 * 364 and sound.tiles(10, 10) == [(0, 0, 10, 10)]


def test_remote(spark, tmp_path, monkeypatch):
    urls = spark.createDataFrame([("u1",), ("bad",), (None,)], "url string")

    def fetch(u):
        if u == "bad":
            raise ValueError("no such page")
        return f"<p>{u}</p>"

    got = {r.url: (r.html, r.error) for r in remote.fetch_pages(urls, fetch=fetch).collect()}
    assert got == {"u1": ("<p>u1</p>", None), "bad": (None, "no such page")}
    assert remote.S3File("a/b.bin", b"abc").save_file(str(tmp_path)).endswith("b.bin") and len(remote.S3File("k", b"abc")) == 3
    monkeypatch.delenv("AWS_ACCESS_KEY_ID", raising=False)
    with pytest.raises(ValueError, match="AWS_ACCESS_KEY_ID"):
        remote.S3Client.from_env()
    assert remote.S3Client("a", "b").options()["fs.s3a.endpoint.region"] == "us-east-1"
    assert files.tesseract_data("level\tconf\ttext\n5\t96.5\thello\n") == [{"level": 5, "conf": 96.5, "text": "hello"}]
    assert files.tesseract_boxes("H 1 2 3 4 0\n")[0] == {"symbol": "H", "left": 1, "bottom": 2, "right": 3, "top": 4, "page": 0}
    pages = spark.createDataFrame([("f", 2, bytearray(b"two\n\n")), ("f", 1, bytearray(b"one"))], "path string, page_number int, page binary")
    assert files.ocr_pages(pages, lambda b: b.decode()).first().text == "one\ntwo"
