"""The model catalog, the builder and the driver contract."""

import pytest

import __spark_entry__
from tessella import models
from tessella.config import Pooling


def test_catalog(spark):
    assert len(models.MODELS) == 35 and models.list_models(spark).count() == 35
    assert models.model_info("Xenova/bge-base-en-v1.5").dim == 768 and models.model_info("BGE-base-en-v1.5").pooling is Pooling.CLS
    assert models.model_info("gte-large-en-v1.5", True).quantized
    with pytest.raises(ValueError, match="unknown model"):
        models.model_info("nothing")
    assert models.is_multilingual("large-v3") and not models.is_multilingual("tiny-en") and len(models.SPEECH) == 14
    with pytest.raises(ValueError, match="speech"):
        models.is_multilingual("huge")


def test_builder(tmp_path):
    with pytest.raises(ValueError, match="one of the two"):
        models.EmbedderBuilder().build()
    with pytest.raises(ValueError, match="one of the two"):
        models.EmbedderBuilder().model_folder("x").service("openai", "m").build()
    with pytest.raises(FileNotFoundError):
        models.EmbedderBuilder().model_folder(str(tmp_path / "gone")).build()
    assert models.EmbedderBuilder().service("openai", "m").key("k").build().model == "m"


def test_contract():
    q, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert "semantic_search_docs" in q and len(q) >= 60 and set(sql) <= set(q)
