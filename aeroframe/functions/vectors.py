"""Small vector and matrix expressions over columns; 3x3 matrices are arrays of 9, row by row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return c if isinstance(c, Column) else F.lit(c) if isinstance(c, (int, float)) else F.col(c)


def norm(*xs) -> Column:
    total = None
    for x in map(col, xs):
        total = x * x if total is None else total + x * x
    return F.sqrt(total)


def dot(a, b) -> Column:
    total = None
    for x, y in zip(map(col, a), map(col, b)):
        total = x * y if total is None else total + x * y
    return total


def cross(a, b) -> tuple[Column, Column, Column]:
    (a1, a2, a3), (b1, b2, b3) = map(col, a), map(col, b)
    return a2 * b3 - a3 * b2, a3 * b1 - a1 * b3, a1 * b2 - a2 * b1


def mat_vec(m: Column, v) -> tuple[Column, Column, Column]:
    v = [col(x) for x in v]
    return tuple(m[3 * i] * v[0] + m[3 * i + 1] * v[1] + m[3 * i + 2] * v[2] for i in range(3))


def mat_mul(a: Column, b: Column) -> Column:
    return F.array(*[a[3 * i] * b[j] + a[3 * i + 1] * b[3 + j] + a[3 * i + 2] * b[6 + j] for i in range(3) for j in range(3)])


def transpose(m: Column) -> Column:
    return F.array(*[m[3 * j + i] for i in range(3) for j in range(3)])


def clip(x, lo, hi) -> Column:
    return F.greatest(col(lo), F.least(col(hi), col(x)))


def let(value: Column, f) -> Column:
    """f of a value that is computed once, whatever number of times f uses it."""
    return F.transform(F.array(value), f)[0]


def repeat(times: int, start: Column, f) -> Column:
    """f applied over and over to a value."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(times)), start, lambda acc, _: f(acc))
