"""Lattices as arrays of nine doubles, column by column, and their operators as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import stored
from .geometry import Vector, angle_between, cross, dot, meetings, norm, scale, vector


def let(value: Column, then) -> Column:
    """then(value) with the value computed once, however often it is used."""
    return F.transform(F.array(value), then)[0]


def column(basis: Column, i: int) -> Vector:
    return basis[3 * i], basis[3 * i + 1], basis[3 * i + 2]


def from_vectors(a: Vector, b: Vector, c: Vector) -> Column:
    """Null where the vectors are not finite or span no volume."""
    det = dot(a, cross(b, c))
    return F.when((det != 0) & (F.abs(det) < float("inf")), F.array(*a, *b, *c))


def orthorhombic(a: Column, b: Column, c: Column) -> Column:
    zero = F.lit(0.0)
    ok = (a > 0) & (b > 0) & (c > 0) & (F.greatest(a, b, c) < float("inf"))
    return F.when(ok, F.array(a, zero, zero, zero, b, zero, zero, zero, c))


def cubic(a: Column) -> Column:
    return orthorhombic(a, a, a)


def from_parameters(a: Column, b: Column, c: Column, alpha: Column, beta: Column, gamma: Column) -> Column:
    """a along x, b in the xy plane; null where the six numbers are no cell."""
    cx, sg = F.cos(beta), F.sin(gamma)
    ok = (a > 0) & (b > 0) & (c > 0) & (sg > 0)
    cy = (F.cos(alpha) - cx * F.cos(gamma)) / F.when(sg > 0, sg)
    rest = 1 - cx * cx - cy * cy
    zero = F.lit(0.0)
    basis = F.array(a, zero, zero, b * F.cos(gamma), b * sg, zero, c * cx, c * cy, c * F.sqrt(F.when(rest > 0, rest)))
    return F.when(ok & (rest > 0), basis)


def edge_lengths(basis: Column) -> Vector:
    return norm(column(basis, 0)), norm(column(basis, 1)), norm(column(basis, 2))


def angles(basis: Column) -> Vector:
    a, b, c = (column(basis, i) for i in range(3))
    return angle_between(b, c), angle_between(a, c), angle_between(a, b)


def determinant(basis: Column) -> Column:
    return dot(column(basis, 0), cross(column(basis, 1), column(basis, 2)))


def volume(basis: Column) -> Column:
    return F.abs(determinant(basis))


def reciprocal(basis: Column) -> Column:
    """The dual basis, without 2 pi: its columns are the rows of the inverse."""
    a, b, c = (column(basis, i) for i in range(3))
    k = 1 / determinant(basis)
    return F.array(*scale(cross(b, c), k), *scale(cross(c, a), k), *scale(cross(a, b), k))


def to_cartesian(basis: Column, f: Vector) -> Vector:
    a, b, c = (column(basis, i) for i in range(3))
    x, y, z = (a[k] * f[0] + b[k] * f[1] + c[k] * f[2] for k in range(3))
    return x, y, z


def to_fractional(basis: Column, r: Vector) -> Vector:
    dual = reciprocal(basis)
    return dot(column(dual, 0), r), dot(column(dual, 1), r), dot(column(dual, 2), r)


def wrapped_fraction(f: Column) -> Column:
    """f modulo 1 in [0, 1); what rounds to 1 is 0."""
    g = f - F.floor(f)
    return F.when(g >= 1, 0.0).otherwise(g)


def wrap(basis: Column, r: Vector) -> Vector:
    x, y, z = (wrapped_fraction(f) for f in to_fractional(basis, r))
    return to_cartesian(basis, (x, y, z))


def minimum_image(reduced: Column, d: Vector) -> Column:
    """The shortest d plus a lattice vector, as a struct of square, x, y, z.

    Over a reduced basis the shortest image lies within one step of the rounded one on each axis.
    """
    f = to_fractional(reduced, d)
    start = F.struct(*(F.coalesce(v - F.round(v), v).alias(n) for v, n in zip(f, "xyz", strict=True)), reduced.alias("m"))
    images = F.array(*(F.struct(F.lit(float(i)).alias("i"), F.lit(float(j)).alias("j"), F.lit(float(k)).alias("k")) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)))

    def image(base: Column, s: Column) -> Column:
        r = F.array(*to_cartesian(base["m"], (base["x"] + s["i"], base["y"] + s["j"], base["z"] + s["k"])))
        return let(r, lambda v: F.struct((v[0] * v[0] + v[1] * v[1] + v[2] * v[2]).alias("d2"), v[0].alias("x"), v[1].alias("y"), v[2].alias("z")))

    return let(start, lambda base: F.array_min(F.transform(images, lambda s: image(base, s))))


def neighbors(sites: DataFrame, cells: DataFrame, cutoff: float) -> DataFrame:
    """(mol_id, a, b, d2): pairs a < b whose shortest image in any cell is within a cutoff, each once.

    cells(mol_id, cell) holds a basis a molecule, which is reduced once.  An axis of the reduced cell is divided into
    floor(height / cutoff) layers if these are three at least, and neighbouring layers wrap around; otherwise it is one
    layer.  Sites without a cell, and those at null places, have no neighbours.
    """
    basis = cells.select("mol_id", reduced(F.col("cell")).alias("m")).where("m is not null")
    own = stored(basis.select("mol_id", "m", reciprocal(F.col("m")).alias("dual")), "cells")
    many = [F.floor(1 / norm(column(F.col("dual"), i)) / cutoff).cast("long") if cutoff > 0 else F.lit(1).cast("long") for i in range(3)]
    own = own.select("mol_id", "m", "dual", *(F.when(n >= 3, n).otherwise(1).alias(f"n{i}") for i, n in enumerate(many)))
    at = sites.select("mol_id", "site_id", "x", "y", "z").join(own, "mol_id")
    part = [wrapped_fraction(dot(column(F.col("dual"), i), (F.col("x"), F.col("y"), F.col("z")))) for i in range(3)]
    grid = at.select("*", *(F.least(F.floor(f * F.col(f"n{i}")).cast("long"), F.col(f"n{i}") - 1).alias(f"i{i}") for i, f in enumerate(part)))
    # where the cutoff is less than half of every height, no other image than the rounded one can be within it
    sure = reduce(lambda u, v: u & v, (cutoff * norm(column(F.col("dual"), i)) < 0.49 for i in range(3)))
    cell, layers = ["i0", "i1", "i2"], ["n0", "n1", "n2"]
    # its square by the products of the basis: short enough for the compiler wherever Spark repeats it
    share = [dot(column(F.col("dual"), i), vector()).alias(k) for i, k in enumerate("xyz")]
    basis = [column(F.col("m"), i) for i in range(3)]
    products = [((1 if i == j else 2) * dot(basis[i], basis[j])).alias(f"g{i}{j}") for i in range(3) for j in range(i, 3)]
    quick = meetings(grid.where(sure).select("mol_id", "site_id", *share, *cell, *layers, *products), cell, "g00", "g01", "g02", "g11", "g12", "g22", layers=layers)
    x, y, z = (F.col(f"d{k}") - F.rint(f"d{k}") for k in "xyz")
    square = x * (F.col("g00") * x + F.col("g01") * y + F.col("g02") * z) + y * (F.col("g11") * y + F.col("g12") * z) + z * F.col("g22") * z
    quick = quick.select("mol_id", "a", "b", square.alias("d2"))
    d = vector("d")
    rest = meetings(grid.where(~F.coalesce(sure, F.lit(False))), cell, "m", layers=layers)
    both = quick.unionByName(rest.select("mol_id", "a", "b", minimum_image(F.col("m"), d)["d2"].alias("d2")))
    return both.where((F.col("d2") <= cutoff * cutoff) & F.lit(cutoff >= 0))


def translations(basis: Column, radius: Column) -> Column:
    """All lattice vectors up to a radius, as structs of i, j, k, x, y, z; none for a radius without end.

    A vector within the radius has coefficients of at most the radius times the length of the dual vector, which bounds each axis.
    """
    endless = radius == float("inf")
    radius = F.when(~endless, radius)

    def within(c: Column) -> Column:
        basis, square = c["m"], c["r"] * c["r"]
        axis = [F.sequence(-c[f"n{i}"], c[f"n{i}"]) for i in range(3)]

        def point(i: Column, j: Column, k: Column) -> Column:
            r = to_cartesian(basis, (i.cast("double"), j.cast("double"), k.cast("double")))
            return F.struct(i.alias("i"), j.alias("j"), k.alias("k"), r[0].alias("x"), r[1].alias("y"), r[2].alias("z"))

        grid = F.flatten(F.transform(axis[0], lambda i: F.flatten(F.transform(axis[1], lambda j: F.transform(axis[2], lambda k: point(i, j, k))))))
        return F.filter(grid, lambda s: s["x"] * s["x"] + s["y"] * s["y"] + s["z"] * s["z"] <= square)

    # basis, dual and reach are worked out once a row: in the lambdas they would be worked out again for every point
    reach = lambda d, i: F.floor(radius * F.sqrt(dot(column(d, i), column(d, i))) + 1e-9).cast("int")
    known = let(basis, lambda m: let(reciprocal(m), lambda d: F.struct(m.alias("m"), radius.alias("r"), *(reach(d, i).alias(f"n{i}") for i in range(3)))))
    return F.when(endless, F.array().cast("array<struct<i:int,j:int,k:int,x:double,y:double,z:double>>")).otherwise(let(known, within))


def reduced(basis: Column, rounds: int = 64) -> Column:
    """A Minkowski-reduced basis, lengths ascending.

    A round takes from the second vector its rounded multiple of the first, and from the longest the lattice vector of
    the two others nearest to it: rounded coefficients within their plane, and their neighbours.  Each round that changes
    something shortens a vector by whole multiples at once, so the rounds needed grow with the logarithm of the skew;
    a basis that still changes after `rounds` of them is an error, not a wrong result.  A null basis gives null.
    """

    def ordered(s: Column) -> Column:
        rows = F.array(*(F.struct(dot(column(s, i), column(s, i)).alias("q"), F.lit(i).alias("i"), F.slice(s, 3 * i + 1, 3).alias("v")) for i in range(3)))
        return let(F.array_sort(rows), lambda r: F.concat(r[0]["v"], r[1]["v"], r[2]["v"]))

    def square(v: Column) -> Column:
        return v[0] * v[0] + v[1] * v[1] + v[2] * v[2]

    def product(s: Column, i: int, j: int) -> Column:
        return dot(column(s, i), column(s, j))

    # every intermediate value is bound once, as expressions are trees and would double with each use
    around = F.array(*(F.struct(F.lit(float(i)).alias("i"), F.lit(float(j)).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))

    def nearest(s: Column, k: Column) -> Column:
        def away(o: Column) -> Column:
            v = F.array(*(z - (k["i"] + o["i"]) * x - (k["j"] + o["j"]) * y for x, y, z in zip(*(column(s, n) for n in range(3)), strict=True)))
            return let(v, lambda w: F.struct(square(w).alias("q"), w.alias("v")))

        return let(F.array_min(F.transform(around, away)), lambda m: F.when(m["q"] < product(s, 2, 2) * (1 - 1e-14), F.concat(F.slice(s, 1, 6), m["v"])).otherwise(s))

    def third(s: Column) -> Column:
        gram = F.struct(*(product(s, i, j).alias(f"g{i}{j}") for i, j in ((0, 0), (0, 1), (1, 1), (0, 2), (1, 2))))
        plane = lambda g: g["g00"] * g["g11"] - g["g01"] * g["g01"]
        start = lambda g: F.struct(F.round((g["g02"] * g["g11"] - g["g12"] * g["g01"]) / plane(g)).alias("i"), F.round((g["g12"] * g["g00"] - g["g02"] * g["g01"]) / plane(g)).alias("j"))
        return let(let(gram, start), lambda k: nearest(s, k))

    def step(s: Column) -> Column:
        second = let(F.round(product(s, 1, 0) / product(s, 0, 0)), lambda k: F.array(*(y - k * x for x, y in zip(column(s, 0), column(s, 1), strict=True))))
        return let(second, lambda v: F.when(square(v) < product(s, 1, 1) * (1 - 1e-14), F.concat(F.slice(s, 1, 3), v, F.slice(s, 7, 3))).otherwise(third(s)))

    def turn(state: Column, _: Column) -> Column:
        following = lambda s: let(let(s, step), lambda n: let(ordered(n), lambda m: F.struct(m.alias("s"), (m == s).alias("done"))))
        return F.when(state["done"], state).otherwise(let(state["s"], following))

    start = F.struct(let(basis, ordered).alias("s"), F.lit(False).alias("done"))
    end = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, turn)
    return let(end, lambda e: F.when(basis.isNull() | e["done"], e["s"]).otherwise(F.raise_error(F.lit("lattice reduction does not end")).cast("array<double>")))
