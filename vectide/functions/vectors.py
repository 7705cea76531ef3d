"""Vector algebra on array columns, evaluated in the JVM.

Null vectors give null. Vectors of different length give null for distances (zip_with pads with null).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1.1920929e-07  # below this product of norms two vectors have no angle
Vec = Column | str | Sequence[float]


def vec(v: Vec) -> Column:
    """A vector column from a column, its name, or a Python sequence."""
    if isinstance(v, Column):
        return v
    return F.col(v) if isinstance(v, str) else F.array(*[F.lit(float(x)) for x in v])


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Vec, b: Vec) -> Column:
    return total(F.zip_with(vec(a), vec(b), lambda x, y: x.cast("double") * y))


def l2_squared(a: Vec, b: Vec) -> Column:
    return F.greatest(total(F.zip_with(vec(a), vec(b), lambda x, y: (x.cast("double") - y) * (x.cast("double") - y))), F.lit(0.0))


def l2(a: Vec, b: Vec) -> Column:
    return F.sqrt(l2_squared(a, b))


def norm(a: Vec) -> Column:
    return F.sqrt(total(F.transform(vec(a), lambda x: x.cast("double") * x)))


def cosine_distance(a: Vec, b: Vec) -> Column:
    """1 - cosine, between 0 and 2; 1 where a norm is (nearly) zero."""
    scale = norm(a) * norm(b)
    return F.when(scale < TINY, 1.0).otherwise(1 - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / F.nullif(scale, F.lit(0.0)))))


def dot_distance(a: Vec, b: Vec) -> Column:
    return -dot(a, b)


METRICS = {"l2": l2_squared, "cosine": cosine_distance, "dot": dot_distance}


def add(a: Vec, b: Vec) -> Column:
    return F.zip_with(vec(a), vec(b), lambda x, y: x + y)


def subtract(a: Vec, b: Vec) -> Column:
    return F.zip_with(vec(a), vec(b), lambda x, y: x - y)


def scale(a: Vec, by: Column | float) -> Column:
    return F.transform(vec(a), lambda x: x * by)


def zeros(dim: int) -> Column:
    return F.array_repeat(F.lit(0.0), dim)


def normalise(a: Vec) -> Column:
    return F.when(norm(a) > 0, scale(a, 1 / F.nullif(norm(a), F.lit(0.0)))).otherwise(vec(a))


def top_dims(change: Column, n: int) -> Column:
    """The n dimensions of largest absolute change, as structs (dim, change); ties go to the lower dimension."""
    keyed = F.transform(change, lambda x, i: F.struct((-F.abs(x)).alias("key"), i.alias("dim"), x.alias("change")))
    return F.transform(F.slice(F.array_sort(keyed), 1, n), lambda s: F.struct(s["dim"].alias("dim"), s["change"].alias("change")))


def softmax(a: Vec) -> Column:
    shifted = F.transform(vec(a), lambda x: F.exp(x - F.array_max(vec(a))))
    return F.transform(shifted, lambda x: x / total(shifted))


def scalar_quantise(a: Vec, low: float, high: float) -> Column:
    """Codes 0 to 255 of each component over [low, high], cut off below and above, fractions dropped."""
    by = 255.0 / (high - low)
    return F.transform(vec(a), lambda x: F.least(F.greatest((x.cast("double") - low) * by, F.lit(0.0)), F.lit(255.0)).cast("int"))


def quantised_distance(a: Vec, b: Vec, low: float, high: float) -> Column:
    return F.sqrt(total(F.zip_with(vec(a), vec(b), lambda x, y: ((x - y) * (x - y)).cast("double")))) / F.lit(255.0 / (high - low))
