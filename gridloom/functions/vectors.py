"""Vectors as ``array<double>`` columns of a known length, spelled out by component so that they stay in generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = list[Column]


def parts(v: Column, d: int) -> Vector:
    """The first ``d`` components; null where the array is shorter."""
    return [F.get(v, i) for i in range(d)]


def vector(*x: Column) -> Column:
    return F.array(*x)


def total(x: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, x)


def dot(a: Vector, b: Vector) -> Column:
    return total([x * y for x, y in zip(a, b, strict=True)])


def norm(a: Vector) -> Column:
    return F.sqrt(dot(a, a))


def plus(a: Vector, b: Vector) -> Vector:
    return [x + y for x, y in zip(a, b, strict=True)]


def minus(a: Vector, b: Vector) -> Vector:
    return [x - y for x, y in zip(a, b, strict=True)]


def times(s: Column | float, a: Vector) -> Vector:
    return [s * x for x in a]


def cross(a: Vector, b: Vector) -> Vector:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def unit(a: Vector) -> Vector:
    """Null for a zero vector."""
    n = norm(a)
    return [F.when(n > 0, x / n) for x in a]


def clamp(x: Column, low: float = -1.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))
