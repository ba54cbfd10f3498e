"""Token vectors to one vector (A1-A6): over a table with a row a token, or within a row that holds them all.

The table has (doc, pos, vec, mask); tokens with mask 0 don't count. A document whose tokens are all masked has no row,
where the row form raises an error only on request and otherwise gives null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import vector


def _counted(tokens: DataFrame) -> DataFrame:
    return tokens.filter("mask <> 0 and vec is not null")


def mean_pool(tokens: DataFrame, dim: int, doc: str = "doc") -> DataFrame:
    """A1: (doc, vec)."""
    mean = F.array(*[F.avg(F.get("vec", F.lit(k)).cast("double")) for k in range(dim)])
    return _counted(tokens).groupBy(doc).agg(mean.alias("vec"))


def cls_pool(tokens: DataFrame, doc: str = "doc") -> DataFrame:
    """A2: the first counted token's vector."""
    return _counted(tokens).groupBy(doc).agg(F.min_by("vec", "pos").alias("vec"))


def last_pool(tokens: DataFrame, doc: str = "doc") -> DataFrame:
    """A3: the last counted token's vector, on whichever side the padding is."""
    return _counted(tokens).groupBy(doc).agg(F.max_by("vec", "pos").alias("vec"))


def sparse_max_pool(tokens: DataFrame, dim: int, doc: str = "doc") -> DataFrame:
    """The greatest ln(1 + relu) of each dimension."""
    best = F.array(*[F.max(F.log1p(F.greatest(F.get("vec", F.lit(k)).cast("double"), F.lit(0.0)))) for k in range(dim)])
    return _counted(tokens).groupBy(doc).agg(best.alias("vec"))


def pool_row(hidden: Column, mask: Column, how: str, dim: int) -> Column:
    """A1-A3 of an array of token vectors and its mask, within a row; null where every token is masked."""
    kept = F.transform(F.filter(F.arrays_zip(hidden.alias("h"), mask.alias("m")), lambda x: x["m"] != 0), lambda x: x["h"])
    if how == "mean":
        return vector.mean_of(kept, dim)
    if how == "cls":
        return F.try_element_at(kept, F.lit(1))
    if how == "last":
        return F.try_element_at(kept, F.lit(-1))
    raise ValueError(f"unknown pooling {how!r}")
