"""Valence bookkeeping of sites: explicit valence, lone pairs, oxidation states, steric numbers.

A value that the model doesn't determine is null, never a default.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dims
from ..model import AROMATIC, incidence, require


def order_number(order: Column) -> Column:
    """A bond order as a number; aromatic is 1.5."""
    return F.when(order == AROMATIC, 1.5).otherwise(order.cast("double"))


def _element_dim(df: DataFrame, *names: str) -> DataFrame:
    return F.broadcast(dims.elements(df.sparkSession).select(F.col("element").cast("int").alias("element"), *names))


def explicit_valence(sites: DataFrame, bonds: DataFrame, degree: str | None = None) -> DataFrame:
    """sites with `valence`: the sum of incident orders, 0 without bonds, null beside an aromatic bond.

    degree: the name of a further column that counts the bonds.
    """
    count = [] if degree is None else [F.count("*").alias(degree)]
    inc = incidence(bonds, "bond_order").groupBy("mol_id", "site_id").agg(F.sum("bond_order").alias("total"), F.bool_or(F.col("bond_order") == AROMATIC).alias("open"), *count)
    out = sites.join(inc, ["mol_id", "site_id"], "left")
    value = F.when(F.coalesce("open", F.lit(False)), None).otherwise(F.coalesce("total", F.lit(0)))
    out = out.withColumn("valence", value.cast("long")).drop("total", "open")
    return out if degree is None else out.withColumn(degree, F.coalesce(degree, F.lit(0)))


def lone_pairs(sites: DataFrame, bonds: DataFrame, degree: str | None = None) -> DataFrame:
    """sites with `valence` and `lone_pairs`: half the electrons that charge, bonds and radicals leave; with the number of
    bonds too if `degree` names its column."""
    require(sites, "mol_id", "site_id", "element", "formal_charge", "radical_electrons")
    out = explicit_valence(sites, bonds, degree).join(_element_dim(sites, "valence_electrons"), "element", "left")
    free = F.col("valence_electrons") - F.col("formal_charge") - F.col("valence") - F.col("radical_electrons")
    return out.withColumn("lone_pairs", F.when(free >= 0, F.floor(free / 2)).cast("long")).drop("valence_electrons")


def oxidation_states(sites: DataFrame, bonds: DataFrame) -> DataFrame:
    """(mol_id, site_id, oxidation_state): bond electrons go to the end of higher rank, ties to neither."""
    require(sites, "mol_id", "site_id", "element", "formal_charge")
    rank = sites.join(_element_dim(sites, "en_rank"), "element", "left").select("mol_id", "site_id", "formal_charge", "en_rank")
    far = rank.select("mol_id", F.col("site_id").alias("nbr"), F.col("en_rank").alias("far_rank"))
    near = rank.select("mol_id", "site_id", "en_rank")
    inc = incidence(bonds, "bond_order").join(near, ["mol_id", "site_id"]).join(far, ["mol_id", "nbr"])
    gain = F.col("bond_order") * F.signum(F.col("far_rank") - F.col("en_rank"))
    unknown = (F.col("bond_order") == AROMATIC) | F.col("far_rank").isNull() | F.col("en_rank").isNull()
    got = inc.groupBy("mol_id", "site_id").agg(F.sum(gain).alias("gain"), F.bool_or(unknown).alias("open"))
    out = rank.join(got, ["mol_id", "site_id"], "left")
    state = F.col("formal_charge") + F.coalesce("gain", F.lit(0.0))
    state = F.when(~F.coalesce("open", F.lit(False)) & state.between(-128, 127), state.cast("int"))
    return out.select("mol_id", "site_id", state.alias("oxidation_state"))


def steric_numbers(sites: DataFrame, bonds: DataFrame, donated: DataFrame | None = None) -> DataFrame:
    """(mol_id, site_id, degree, steric_number): neighbours and the lone pairs kept; absent where lone pairs are undetermined.

    donated: (mol_id, site_id, pairs) given away to conjugated systems.
    """
    out = lone_pairs(sites.select("mol_id", "site_id", "element", "formal_charge", "radical_electrons"), bonds, "degree")
    out = out.join(donated, ["mol_id", "site_id"], "left") if donated is not None else out.withColumn("pairs", F.lit(0))
    out = out.where(F.col("lone_pairs").isNotNull())
    return out.select("mol_id", "site_id", "degree", (F.col("degree") + F.col("lone_pairs") - F.coalesce("pairs", F.lit(0))).alias("steric_number"))


def isotope(sites: DataFrame) -> DataFrame:
    """sites with neutron_count and isotope text; null where the mass number is below the atomic number or above 65535."""
    dim = _element_dim(sites, "symbol")
    ok = F.col("mass_number").between(F.col("element"), 65535)
    out = sites.join(dim, "element", "left")
    return out.withColumn("neutron_count", F.when(ok, F.col("mass_number") - F.col("element"))).withColumn("isotope", F.when(ok, F.concat("symbol", F.lit("-"), F.col("mass_number").cast("string")))).drop("symbol")
