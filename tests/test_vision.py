"""Image embedders, the PNG decoder and the request handler."""

import base64
import json
import struct
import zlib

import numpy as np
import pytest

from tessella import api, server
from tessella.operators import search
from tessella.operators.embed import HashingEmbedder
from tessella.operators.vision import HistogramEmbedder, ModelEmbedder, PageEmbedder, decode_png


def png(pixels: np.ndarray, filters=None, kind=2) -> bytes:
    h, w, n = pixels.shape
    lines, above = [], np.zeros((w, n), int)
    for y in range(h):
        f = (filters or [0])[y % len(filters or [0])]
        x = pixels[y].astype(int)
        left = np.vstack([np.zeros((1, n), int), x[:-1]])
        corner = np.vstack([np.zeros((1, n), int), above[:-1]])
        p = left + above - corner
        a, b, c = abs(p - left), abs(p - above), abs(p - corner)
        guess = [0, left, above, (left + above) // 2, np.where((a <= b) & (a <= c), left, np.where(b <= c, above, corner))][f]
        lines.append(bytes([f]) + ((x - guess) & 255).astype(np.uint8).tobytes())
        above = x
    part = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + part(b"IDAT", zlib.compress(b"".join(lines))) + part(b"IEND", b"")


RED, BLUE = np.full((20, 30, 3), (250, 5, 5), np.uint8), np.full((20, 30, 3), (5, 5, 250), np.uint8)


def test_png_filters():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 256, (11, 7, 3), dtype=np.uint8)
    assert (decode_png(png(x, [0, 1, 2, 3, 4])) == x).all()
    grey = rng.integers(0, 256, (4, 5, 1), dtype=np.uint8)
    assert (decode_png(png(grey, [4], 0)) == np.repeat(grey, 3, 2)).all()
    for bad in (b"", b"GIF89a", png(x)[:40], png(x)[:60]):
        with pytest.raises(ValueError, match="PNG"):
            decode_png(bad)


def test_embed_images_and_search(spark, tmp_path):
    for name, x in (("red", RED), ("blue", BLUE)):
        (tmp_path / f"{name}.png").write_bytes(png(x))
    (tmp_path / "broken.png").write_bytes(b"nothing")
    e = HistogramEmbedder()
    rows = {r.file_name.rpartition("/")[2]: r for r in api.embed_images(spark, str(tmp_path), e).collect()}
    assert rows["broken.png"].embedding is None and "PNG" in rows["broken.png"].error
    assert rows["red.png"].error is None and len(rows["red.png"].embedding) == 64
    corpus = spark.createDataFrame([(1, rows["red.png"].embedding), (2, rows["blue.png"].embedding), (3, None)], "doc_id long, vec array<double>")
    asked = spark.createDataFrame([(0, e.encode(np.full((4, 4, 3), (240, 9, 9), np.uint8)).tolist())], "query_id long, vec array<double>")
    assert [(r.doc_id, r.score) for r in search.knn(asked, corpus, 2).orderBy("rank").collect()] == [(1, 1.0), (2, 0.0)]
    m = ModelEmbedder(lambda x: x.mean((1, 2)), 8)
    assert np.isclose(np.linalg.norm(m.encode(RED)), 1)


def test_pages(spark):
    wide = np.concatenate([RED, BLUE], axis=1)
    df = spark.createDataFrame([(1, bytearray(png(wide))), (2, None), (3, bytearray(b"x"))], "page_number int, page binary")
    got = {r.page_number: r for r in api.embed_pages_multi(df, PageEmbedder(HistogramEmbedder(), 30)).collect()}
    assert len(got[1].multi) == 3 and got[2].multi is None and got[2].error is None and got[3].error


def test_requests():
    e, images = HashingEmbedder(8), HistogramEmbedder()
    picture = base64.b64encode(png(np.random.default_rng(2).integers(0, 256, (9, 9, 3), dtype=np.uint8))).decode()
    assert server.handle("/health_check", "", e)[0] == 200 and server.handle("/nowhere", "{}", e)[0] == 404
    status, answer = server.handle("/v1/embeddings", json.dumps({"input": ["one two", "three"], "model": "m"}), e)
    data = json.loads(answer)
    assert status == 200 and [x["index"] for x in data["data"]] == [0, 1] and data["usage"]["total_tokens"] == 3 and data["model"] == "m"
    status, answer = server.handle("/v1/image_embeddings", json.dumps({"input": [picture, "data:image/png;base64," + picture]}), e, images)
    assert status == 200 and json.loads(answer)["usage"]["total_tokens"] == 2
    for path, body, given in (
        ("/v1/embeddings", {"input": ["text", picture]}, images), ("/v1/image_embeddings", {"input": ["text"]}, images), ("/v1/embeddings", {"input": picture}, None),
        ("/v1/embeddings", {"input": []}, images), ("/v1/embeddings", {}, images), ("/v1/embeddings", {"input": [1]}, images), ("/v1/embeddings", {"input": "data:image/png;base64,AAAA"}, images),
    ):
        status, answer = server.handle(path, json.dumps(body), e, given)
        assert status == 400 and json.loads(answer)["error"]["message"]
    assert server.handle("/v1/embeddings", "no json", e)[0] == 400
