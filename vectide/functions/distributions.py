"""Distances between discrete distributions held as arrays of equal length."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vectide.functions.vectors import Vec, total, vec


def bhattacharyya(p: Vec, q: Vec) -> Column:
    return total(F.zip_with(vec(p), vec(q), lambda a, b: F.sqrt(F.greatest(a, F.lit(0.0)) * F.greatest(b, F.lit(0.0)))))


def fisher_rao(p: Vec, q: Vec) -> Column:
    """Angle between the square roots, from 0 to pi."""
    return 2 * F.acos(F.least(F.greatest(bhattacharyya(p, q), F.lit(0.0)), F.lit(1.0)))


def hellinger(p: Vec, q: Vec) -> Column:
    """Square root of half the missing overlap, at most 0.7071."""
    return F.sqrt(F.greatest(1 - bhattacharyya(p, q), F.lit(0.0)) / 2)


def wasserstein_1d(p: Vec, q: Vec) -> Column:
    """Earth mover's distance over bins one unit apart."""
    diff = F.zip_with(vec(p), vec(q), lambda a, b: a.cast("double") - b)
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("cost"))
    return F.aggregate(diff, start, lambda s, x: F.struct((s["sum"] + x).alias("sum"), (s["cost"] + F.abs(s["sum"] + x)).alias("cost")), lambda s: s["cost"])
