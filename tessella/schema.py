"""Row types that the operators exchange."""

from __future__ import annotations

from pyspark.sql import types as T

_F, _S, _L, _D = T.FloatType(), T.StringType(), T.LongType(), T.DoubleType()


def _row(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


#: A vector is dense (one) or multi (one a token): two nullable columns, so that Parquet can prune either.
EMBED_ROW = _row(("doc_id", _S), ("chunk_idx", T.IntegerType()), ("text", _S), ("dense", T.ArrayType(_F)), ("multi", T.ArrayType(T.ArrayType(_F))), ("metadata", T.MapType(_S, _S)))
FLAT_STORE = _row(("embeddings", T.ArrayType(_F)), ("text", _S), ("file_name", _S), ("modified", _S), ("created", _S))
RERANK_ROW = _row(("query", _S), ("document", _S), ("doc_idx", T.IntegerType()), ("relevance_score", _D), ("rank", T.IntegerType()))
SEGMENT = _row(("start", _D), ("duration", _D), ("text", _S), ("avg_logprob", _D), ("no_speech_prob", _D))
SEARCH_HIT = _row(("query_id", _L), ("doc_id", _L), ("score", _D), ("rank", _L))


def extended(schema: T.StructType, **kinds: str) -> T.StructType:
    """A schema with further fields of the given SQL types; the schema itself stays as it is."""
    return T.StructType([*schema.fields, *T.StructType.fromDDL(", ".join(f"`{n}` {k}" for n, k in kinds.items())).fields])
