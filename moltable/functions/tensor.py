"""Vectors and 3 x 3 matrices as tuples of Columns; a matrix is nine, column by column."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.geometry import Vector, angle_between, cross, dot, norm, scale, sub
from . import scalar

Matrix = tuple[Column, ...]
__all__ = ["angle_between", "cross", "dot", "norm", "scale", "sub"]


def add(u: Vector, v: Vector) -> Vector:
    return u[0] + v[0], u[1] + v[1], u[2] + v[2]


def neg(u: Vector) -> Vector:
    return -u[0], -u[1], -u[2]


def normalized(u: Vector) -> Vector:
    """Null components where there is no direction."""
    n = norm(u)
    return scale(u, 1 / F.when(n > 0, n))


def normalized_or_zero(u: Vector) -> Vector:
    x, y, z = (F.coalesce(c, F.lit(0.0)) for c in normalized(u))
    return x, y, z


def project_onto(u: Vector, v: Vector) -> Vector:
    return scale(v, dot(u, v) / F.when(dot(v, v) > 0, dot(v, v)))


def reject_from(u: Vector, v: Vector) -> Vector:
    return sub(u, project_onto(u, v))


def reflect(u: Vector, normal: Vector) -> Vector:
    """u mirrored in the plane through the origin with a unit normal."""
    return sub(u, scale(normal, 2 * dot(u, normal)))


def lerp(u: Vector, v: Vector, t: Column) -> Vector:
    x, y, z = (scalar.lerp(a, b, t) for a, b in zip(u, v, strict=True))
    return x, y, z


def each(f, *vectors: Vector) -> Vector:
    """A scalar function by component: abs, minimum, clamp, floor, signum, ..."""
    x, y, z = (f(*parts) for parts in zip(*vectors, strict=True))
    return x, y, z


def element_sum(u: Vector) -> Column:
    return u[0] + u[1] + u[2]


def element_product(u: Vector) -> Column:
    return u[0] * u[1] * u[2]


def min_element(u: Vector) -> Column:
    return scalar.minimum(scalar.minimum(u[0], u[1]), u[2])


def max_element(u: Vector) -> Column:
    return scalar.maximum(scalar.maximum(u[0], u[1]), u[2])


def col(m: Matrix, i: int) -> Vector:
    return m[3 * i], m[3 * i + 1], m[3 * i + 2]


def row(m: Matrix, i: int) -> Vector:
    return m[i], m[i + 3], m[i + 6]


def from_cols(a: Vector, b: Vector, c: Vector) -> Matrix:
    return (*a, *b, *c)


def transpose(m: Matrix) -> Matrix:
    return from_cols(row(m, 0), row(m, 1), row(m, 2))


def diagonal(m: Matrix) -> Vector:
    return m[0], m[4], m[8]


def from_diagonal(d: Vector) -> Matrix:
    z = F.lit(0.0)
    return d[0], z, z, z, d[1], z, z, z, d[2]


def trace(m: Matrix) -> Column:
    return m[0] + m[4] + m[8]


def determinant(m: Matrix) -> Column:
    return dot(col(m, 0), cross(col(m, 1), col(m, 2)))


def apply(m: Matrix, v: Vector) -> Vector:
    return dot(row(m, 0), v), dot(row(m, 1), v), dot(row(m, 2), v)


def multiply(m: Matrix, n: Matrix) -> Matrix:
    return from_cols(*(apply(m, col(n, i)) for i in range(3)))


def is_invertible(m: Matrix) -> Column:
    """Whether the determinant is a finite number other than 0."""
    det = determinant(m)
    return (det != 0) & ~F.isnan(det) & (F.abs(det) != float("inf"))


def inverse(m: Matrix) -> Matrix:
    """Null entries where the matrix is not invertible."""
    a, b, c = (col(m, i) for i in range(3))
    k = 1 / F.when(is_invertible(m), determinant(m))
    return transpose(from_cols(scale(cross(b, c), k), scale(cross(c, a), k), scale(cross(a, b), k)))


def _jacobi(m: np.ndarray, sweeps: int) -> np.ndarray:
    """Singular values of matrices by columns (place in the matrix, matrix), falling, of entries of at most 1."""
    col = [m[3 * k : 3 * k + 3].copy() for k in range(3)]
    along = lambda u, v: u[0] * v[0] + u[1] * v[1] + u[2] * v[2]
    for _ in range(sweeps):
        for p, q in ((0, 1), (0, 2), (1, 2)):
            u, v = col[p], col[q]
            down = 2 * along(u, v)
            z = np.divide(along(v, v) - along(u, u), down, out=np.zeros_like(down), where=down != 0)
            # already orthogonal columns give no quotient and stay
            t = np.where(down != 0, np.where(z >= 0, 1.0, -1.0) / (np.abs(z) + np.sqrt(1 + z * z)), 0.0)
            cos = 1 / np.sqrt(1 + t * t)
            col[p], col[q] = cos * (u - t * v), cos * (t * u + v)
    return np.sort(np.sqrt([along(c, c) for c in col]), axis=0)[::-1]


def singular_values(m: Matrix, sweeps: int = 8) -> Vector:
    """Singular values, falling; 0.0 for each rank that is missing, null beside a null or non-finite entry.

    The columns, scaled by the largest entry, are made orthogonal pair by pair (one-sided Jacobi); their lengths are the
    values, small ones as accurate as large ones.  All matrices of an Arrow batch are turned at once, so the Columns can't
    stand inside a lambda.
    """

    @F.arrow_udf("struct<a: double, b: double, c: double>")
    def values(*entries: pa.Array) -> pa.Array:
        e = np.stack([c.to_numpy(zero_copy_only=False) for c in entries]).astype(float)
        finite = np.isfinite(e).all(axis=0)
        e = np.where(finite, e, 0.0)
        largest = np.abs(e).max(axis=0)
        with np.errstate(over="ignore", under="ignore"):
            s = _jacobi(np.divide(e, largest, out=np.zeros_like(e), where=largest > 0), sweeps) * largest
        return pa.StructArray.from_arrays([pa.array(v, mask=~finite) for v in s], ["a", "b", "c"])

    got = values(*(c.cast("double") for c in m))
    return got["a"], got["b"], got["c"]


def outer_product(u: Vector, v: Vector) -> Matrix:
    return from_cols(*(scale(u, c) for c in v))


def rotation(axis: Vector, angle: Column) -> Matrix:
    """About a unit axis, by the right hand."""
    c, s = F.cos(angle), F.sin(angle)
    x, y, z = axis
    k = 1 - c
    return (c + x * x * k, y * x * k + z * s, z * x * k - y * s, x * y * k - z * s, c + y * y * k, z * y * k + x * s, x * z * k + y * s, y * z * k - x * s, c + z * z * k)


def rotation_x(angle: Column) -> Matrix:
    return rotation((F.lit(1.0), F.lit(0.0), F.lit(0.0)), angle)


def rotation_y(angle: Column) -> Matrix:
    return rotation((F.lit(0.0), F.lit(1.0), F.lit(0.0)), angle)


def rotation_z(angle: Column) -> Matrix:
    return rotation((F.lit(0.0), F.lit(0.0), F.lit(1.0)), angle)
