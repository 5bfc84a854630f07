"""Tables of molecules: required columns, incidence, degree.

sites(mol_id, site_id, element, formal_charge, ...) and bonds(mol_id, bond_id, a, b,
bond_order, ...) hold any number of molecules; bond_order is 1-6, or 7 for aromatic.
A molecule is a simple graph.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

AROMATIC = 7


def require(df: DataFrame, *names: str) -> DataFrame:
    """The counterpart of a trait bound: the columns that an operator reads."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"columns missing: {', '.join(missing)}")
    return df


def incidence(bonds: DataFrame, *more: str) -> DataFrame:
    """(mol_id, bond_id, site_id, nbr, ...): each bond from both of its ends, in one pass."""
    require(bonds, "mol_id", "bond_id", "a", "b", *more)
    ends = F.array(F.struct(F.col("a").alias("s"), F.col("b").alias("n")), F.struct(F.col("b").alias("s"), F.col("a").alias("n")))
    return bonds.select("mol_id", "bond_id", *more, F.explode(ends).alias("e")).select("mol_id", "bond_id", F.col("e.s").alias("site_id"), F.col("e.n").alias("nbr"), *more)


def degrees(sites: DataFrame, bonds: DataFrame) -> DataFrame:
    """(mol_id, site_id, degree), 0 for a site without bonds."""
    count = incidence(bonds).groupBy("mol_id", "site_id").agg(F.count("*").alias("degree"))
    return sites.select("mol_id", "site_id").join(count, ["mol_id", "site_id"], "left").select("mol_id", "site_id", F.coalesce("degree", F.lit(0)).alias("degree"))


def bound(rows: DataFrame, overlay: DataFrame, key: list[str], *columns: str) -> DataFrame:
    """rows with these columns as a computed relation has them, and as before where it says nothing (no row, or null).

    overlay has one row a key at most.  Rows that operators make (Kekule orders, geometries, configurations) are laid over
    sites or bonds like this, and any operator reads the result.
    """
    new = {c: f"{c}_over" for c in columns}
    far = overlay.select(*key, *(F.col(c).alias(n) for c, n in new.items()))
    out = rows.join(far, key, "left")
    return out.select(*(F.coalesce(F.col(new[c]), F.col(c)).alias(c) if c in new else F.col(c) for c in rows.columns), *(F.col(n).alias(c) for c, n in new.items() if c not in rows.columns))
