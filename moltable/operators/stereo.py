"""Stereochemistry that joins and Columns can express: handedness of four-neighbour sites, sides of double bonds,
comparison of declared with detected loci, and relations of canonical stereo forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import incidence, require
from .geometry import Vector, cross, dot, signed_volume, sub

#: A sign is not determined below this size.
TINY = 1e-9


def _positions(sites: DataFrame, key: str, prefix: str) -> DataFrame:
    return sites.select("mol_id", F.col("site_id").alias(key), *(F.col(k).alias(f"{prefix}{k}") for k in "xyz"))


def _sign(value: Column) -> Column:
    return F.when(F.abs(value) >= TINY, F.signum(value).cast("int"))


def tetrahedral(sites: DataFrame, bonds: DataFrame) -> DataFrame:
    """(mol_id, site_id, parity) of sites with four neighbours: 1 if these, ascending, span a right-handed volume,
    -1 if a left-handed one, null if they are flat."""
    require(sites, "mol_id", "site_id", "x", "y", "z")
    far = incidence(bonds).join(_positions(sites, "nbr", ""), ["mol_id", "nbr"])
    four = far.groupBy("mol_id", "site_id").agg(F.array_sort(F.collect_list(F.struct("nbr", "x", "y", "z"))).alias("v")).where("size(v) = 4")

    def corner(i: int) -> Vector:
        p = F.col("v")[i]
        return p["x"], p["y"], p["z"]

    return four.select("mol_id", "site_id", _sign(signed_volume(*(corner(i) for i in range(4)))).alias("parity"))


def double_bonds(sites: DataFrame, bonds: DataFrame) -> DataFrame:
    """(mol_id, bond_id, side) of double bonds with further neighbours at both ends: 1 if the least further neighbours
    lie on one side, -1 if on opposite sides, null where that is not fixed."""
    double = bonds.where("bond_order = 2").select("mol_id", "bond_id", "a", "b")
    inc = incidence(bonds).select("mol_id", "site_id", "nbr")
    least = lambda end, other, name: double.join(inc.withColumnRenamed("site_id", end), ["mol_id", end]).where(F.col("nbr") != F.col(other)).groupBy("mol_id", "bond_id").agg(F.min("nbr").alias(name))
    both = double.join(least("a", "b", "s"), ["mol_id", "bond_id"]).join(least("b", "a", "t"), ["mol_id", "bond_id"])
    for key in "abst":
        both = both.join(_positions(sites, key, key), ["mol_id", key])
    a, b, s, t = ((F.col(f"{p}x"), F.col(f"{p}y"), F.col(f"{p}z")) for p in "abst")
    axis = sub(b, a)
    side = dot(cross(sub(s, a), axis), cross(sub(t, b), axis))
    return both.select("mol_id", "bond_id", _sign(side).alias("side"))


def consistency(declared: DataFrame, detected: DataFrame) -> DataFrame:
    """(mol_id, locus_kind, locus_id, finding): unspecified where a stereogenic locus has no declared configuration,
    overspecified where a declared one is not stereogenic."""
    key = ["mol_id", "locus_kind", "locus_id"]
    missing = detected.select(*key).distinct().join(declared, key, "left_anti").withColumn("finding", F.lit("unspecified"))
    return missing.unionByName(declared.select(*key).distinct().join(detected, key, "left_anti").withColumn("finding", F.lit("overspecified")))


def relate(pairs: DataFrame, forms: DataFrame) -> DataFrame:
    """(a, b, relation) of pairs (a, b) by forms (mol_id, constitution, configured, mirror): Identical, Enantiomers,
    Diastereomers, or Unrelated where the constitutions differ."""
    side = lambda k: forms.select(F.col("mol_id").alias(k), F.col("constitution").alias(f"c{k}"), F.col("configured").alias(f"f{k}"), F.col("mirror").alias(f"m{k}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    name = F.when(F.col("ca") != F.col("cb"), "Unrelated").when(F.col("fa") == F.col("fb"), "Identical").when(F.col("fa") == F.col("mb"), "Enantiomers").otherwise("Diastereomers")
    return both.select("a", "b", name.alias("relation"))


def is_chiral(forms: DataFrame) -> DataFrame:
    """(mol_id, is_chiral): whether a form differs from its mirror image's."""
    return forms.select("mol_id", (F.col("configured") != F.col("mirror")).alias("is_chiral"))
