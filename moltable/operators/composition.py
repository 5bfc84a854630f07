"""Composition: counts of elements or nuclides with a net charge, their pooling and reduction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import require


def elemental(sites: DataFrame) -> DataFrame:
    """(mol_id, element, n, charge): charge is the share of that element's sites; sum it for the molecule's."""
    require(sites, "mol_id", "element", "formal_charge")
    return sites.groupBy("mol_id", "element").agg(F.count("*").alias("n"), F.sum("formal_charge").alias("charge"))


def isotopic(sites: DataFrame) -> DataFrame:
    """(mol_id, element, mass_number, n, charge), keyed by nuclide; a null mass number is the natural element."""
    require(sites, "mol_id", "element", "mass_number", "formal_charge")
    return sites.groupBy("mol_id", "element", "mass_number").agg(F.count("*").alias("n"), F.sum("formal_charge").alias("charge"))


def from_counts(counts: DataFrame, *keys: str) -> DataFrame:
    """Sum repeated constituents and drop those of no atoms; keys default to (mol_id, element, mass_number)."""
    keys = keys or ("mol_id", "element", "mass_number")
    return counts.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("charge").alias("charge")).where("n <> 0")


def totals(comp: DataFrame) -> DataFrame:
    """(mol_id, atom_count, species, charge, element_counts): element_counts pools nuclides, ascending by element."""
    by_element = comp.groupBy("mol_id", "element").agg(F.sum("n").alias("n"), F.count("*").alias("species"), F.sum("charge").alias("charge"))
    return by_element.groupBy("mol_id").agg(
        F.sum("n").alias("atom_count"), F.sum("species").alias("species"), F.sum("charge").alias("charge"), F.array_sort(F.collect_list(F.struct("element", "n"))).alias("element_counts")
    )


def pooled(comp: DataFrame, groups: DataFrame, group: str) -> DataFrame:
    """Compositions added up over a grouping (mol_id, group): associative, commutative, empty as identity."""
    keys = [c for c in ("element", "mass_number") if c in comp.columns]
    return comp.join(groups, "mol_id").groupBy(group, *keys).agg(F.sum("n").alias("n"), F.sum("charge").alias("charge"))


def gcd(values: Column) -> Column:
    """Greatest common divisor of an array of non-negative longs, 0 for none: Euclid's steps folded over a bounded range."""
    zero = F.lit(0).cast("long")

    def pair(a: Column, b: Column) -> Column:
        start = F.struct(F.greatest(a, b).alias("x"), F.least(a, b).alias("y"))
        step = lambda s, _: F.when(s["y"] == 0, s).otherwise(F.struct(s["y"].alias("x"), (s["x"] % F.when(s["y"] == 0, 1).otherwise(s["y"])).alias("y")))
        return F.aggregate(F.sequence(F.lit(1), F.lit(92)), start, step)["x"]

    return F.aggregate(values, zero, lambda acc, v: pair(acc, v.cast("long")))


def empirical(comp: DataFrame) -> DataFrame:
    """Counts and the molecule's charge divided by their greatest common divisor; unchanged where that is at most 1.

    (mol_id, element[, mass_number], n, mol_charge)
    """
    keys = [c for c in ("element", "mass_number") if c in comp.columns]
    mol = comp.groupBy("mol_id").agg(F.collect_list(F.struct(*keys, "n")).alias("parts"), F.sum("charge").alias("mol_charge"))
    g = gcd(F.concat(F.transform("parts", lambda p: p["n"]), F.array(F.abs("mol_charge"))))
    mol = mol.withColumn("g", F.greatest(g, F.lit(1)))
    part = mol.select("mol_id", F.expr("mol_charge div g").alias("mol_charge"), "g", F.explode("parts").alias("p"))
    return part.select("mol_id", *(F.col(f"p.{k}").alias(k) for k in keys), F.expr("p.n div g").alias("n"), "mol_charge")
