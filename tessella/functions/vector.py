"""Vector arithmetic as column expressions, in double precision.

A null vector or element gives null. Vectors of different lengths give null. A zero vector has cosine 0 to any
other and is its own normal form, never NaN.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _same(a: Column, b: Column, value: Column) -> Column:
    return F.when(F.size(a) == F.size(b), value)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def dot(a: Column, b: Column) -> Column:
    return _same(a, b, _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    scale = norm(a) * norm(b)
    return F.when(scale == 0, F.lit(0.0)).otherwise(F.try_divide(dot(a, b), scale))


def l2_distance(a: Column, b: Column) -> Column:
    return _same(a, b, F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))))


def neg_distance(a: Column, b: Column) -> Column:
    """V4: greater is nearer."""
    return -l2_distance(a, b)


def l2_normalize(a: Column) -> Column:
    n = norm(a)
    return F.when(n.isNull() | (n == 0), F.transform(a, lambda x: x.cast("double"))).otherwise(F.transform(a, lambda x: x.cast("double") / n))


def scaled_logits(a: Column, b: Column, logit_scale: float) -> Column:
    """exp(logit_scale) times the dot product."""
    return F.exp(F.lit(float(logit_scale))) * dot(a, b)


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x.cast("double")))


def softmax2(no: Column, yes: Column) -> Column:
    """R2: the chance of yes of two logits, from the greater one so that nothing overflows."""
    top = F.greatest(no, yes).cast("double")
    return F.exp(yes - top) / (F.exp(no - top) + F.exp(yes - top))


def mean_of(vectors: Column, dim: int) -> Column:
    """The mean of an array of vectors, element by element; null for none."""
    add = lambda k: F.aggregate(vectors, F.lit(0.0), lambda s, v: s + F.element_at(v, k + 1).cast("double"))
    return F.when(F.size(vectors) > 0, F.array(*[add(k) / F.size(vectors) for k in range(dim)]))


def any_null(*columns: Column) -> Column:
    return reduce(lambda p, q: p | q, (c.isNull() for c in columns))
