"""Scalar functions whose edge cases differ from Spark's: NaN, signs of zero, division by zero, remainders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def number(c) -> Column:
    return c.cast("double") if isinstance(c, Column) else F.lit(float(c))


def negative(c: Column) -> Column:
    """The sign bit, also of a zero: only its text tells it in Spark."""
    return F.startswith(c.cast("string"), F.lit("-"))


def divide(a: Column, b: Column) -> Column:
    """Infinities and NaN instead of an error."""
    a, b = number(a), number(b)
    plain = a / F.when(b != 0, b)
    return F.when(b != 0, plain).when(F.isnan(a) | (a == 0), F.lit(float("nan"))).when((a > 0) != negative(b), F.lit(INF)).otherwise(F.lit(-INF))


def minimum(a: Column, b: Column) -> Column:
    """The lesser; a NaN loses."""
    return F.when(F.isnan(a), b).when(F.isnan(b), a).otherwise(F.least(a, b))


def maximum(a: Column, b: Column) -> Column:
    return F.when(F.isnan(a), b).when(F.isnan(b), a).otherwise(F.greatest(a, b))


def clamp(a: Column, lo: Column, hi: Column) -> Column:
    return F.when(F.isnan(a), a).when(a < lo, lo).when(a > hi, hi).otherwise(a)


def signum(a: Column) -> Column:
    """1 or -1 by the sign bit, also of a zero; NaN stays."""
    return F.when(F.isnan(a), a).when(negative(a), -1.0).otherwise(1.0)


def copysign(a: Column, b: Column) -> Column:
    return F.abs(a) * signum(b)


def rem_euclid(a: Column, b: Column) -> Column:
    """The remainder that is never negative, for divisors of either sign."""
    r = a % b
    return F.when(r < 0, r + F.abs(b)).otherwise(r)


def div_euclid(a: Column, b: Column) -> Column:
    q = a / b
    q = F.when(q < 0, F.ceil(q)).otherwise(F.floor(q)).cast("double")
    return F.when(a % b < 0, F.when(b > 0, q - 1).otherwise(q + 1)).otherwise(q)


def round_half_away(a: Column) -> Column:
    return F.round(a)


def round_ties_even(a: Column) -> Column:
    return F.bround(a)


def trunc(a: Column) -> Column:
    return F.when(a < 0, F.ceil(a)).otherwise(F.floor(a)).cast("double")


def fract(a: Column) -> Column:
    return a - trunc(a)


def ln(a: Column) -> Column:
    """Minus infinity at 0 and NaN below, where Spark gives null."""
    return F.when(a == 0, F.lit(-INF)).when(a < 0, F.lit(float("nan"))).otherwise(F.log(a))


def mul_add(a: Column, b: Column, c: Column) -> Column:
    return a * b + c


def lerp(a: Column, b: Column, t: Column) -> Column:
    return a + (b - a) * t


def midpoint(a: Column, b: Column) -> Column:
    return a / 2 + b / 2
