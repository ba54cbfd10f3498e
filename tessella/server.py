"""Embedding requests as functions (K10, P10, P11, T11): from a path and a JSON body to a status and a JSON answer.

Any web server can call handle(); no socket is opened here. Inputs are all texts or all images in base64.
"""

from __future__ import annotations

import base64
import json
import re

from tessella.operators.adapters import embedding_response, error_response
from tessella.operators.embed import Embedder
from tessella.operators.vision import ImageEmbedder


def image_bytes(value: str) -> bytes | None:
    """The bytes of a data URL or of at least 100 characters of base64, else None."""
    if value.startswith("data:image/"):
        value = value.partition(",")[2]
    elif len(value) < 100:
        return None
    value = re.sub(r"\s+", "", value)
    try:
        return base64.b64decode(value, validate=True)
    except ValueError:
        return None


def handle(path: str, body: str, embedder: Embedder, images: ImageEmbedder | None = None, model: str = "hashing") -> tuple[int, str]:
    """The answer to /health_check, /v1/embeddings and /v1/image_embeddings."""
    if path == "/health_check":
        return 200, json.dumps({"status": "ok"})
    if path not in ("/v1/embeddings", "/v1/image_embeddings"):
        return 404, error_response(f"no such path: {path}", "not_found_error")
    try:
        given = json.loads(body)
        items = given["input"]
        items = [items] if isinstance(items, str) else items
        if not items or not all(isinstance(x, str) for x in items):
            raise ValueError("input must be a string or a list of strings, and not empty")
    except (KeyError, TypeError, ValueError) as e:
        return 400, error_response(f"bad request: {e}")
    found = [image_bytes(x) for x in items]
    some, every = any(x is not None for x in found), all(x is not None for x in found)
    if some and not every:
        return 400, error_response("input must be all texts or all images")
    if path == "/v1/image_embeddings" and not every:
        return 400, error_response("input must be images in base64")
    if every:
        if images is None:
            return 400, error_response("this model embeds texts only")
        try:
            vectors = [images.encode(images.decode(x)).tolist() for x in found]
        except ValueError as e:
            return 400, error_response(str(e))
        usage = len(items)
    else:
        vectors, usage = embedder.encode(items).tolist(), sum(len(x.split()) for x in items)
    return 200, embedding_response([{"embedding": v} for v in vectors], given.get("model", model), usage)
