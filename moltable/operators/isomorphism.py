"""Substructure search: a fixed pattern is compiled to a chain of equi-joins over incidence."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import incidence


@dataclass(frozen=True)
class Pattern:
    """sites: conditions on target sites by pattern site; bonds: (a, b, condition).  A condition is SQL over the
    target's columns (element, formal_charge, ...; bond_order), true where empty."""

    sites: dict[int, str]
    bonds: list[tuple[int, int, str]] = field(default_factory=list)

    def order(self) -> list[tuple[int, tuple[int, str] | None, list[tuple[int, str]]]]:
        """Placement: (site, the bond to a placed site or None, closures to further placed sites), connected where possible."""
        placed: list[int] = []
        out = []
        rest = sorted(self.sites)
        while rest:
            links = {s: [(a if b == s else b, c) for a, b, c in self.bonds if s in (a, b) and (a if b == s else b) in placed] for s in rest}
            s = max(rest, key=lambda v: (len(links[v]) > 0, len(links[v]), -v))
            out.append((s, links[s][0] if links[s] else None, links[s][1:]))
            placed.append(s)
            rest.remove(s)
        return out


def _site_condition(prefix: str, condition: str, columns: list[str]) -> Column:
    """The condition over columns renamed with a prefix."""
    if not condition:
        return F.lit(True)
    import re

    return F.expr(re.sub(r"\b(" + "|".join(map(re.escape, columns)) + r")\b", lambda m: f"`{prefix}{m[1]}`", condition))


def matches(sites: DataFrame, bonds: DataFrame, pattern: Pattern) -> DataFrame:
    """(mol_id, p<site>, ...): all injective placements of the pattern, every automorphic image included.

    One join along incidence for each bond of the pattern's spanning tree, a semi-join for each bond that
    closes a ring; conditions are pushed into the scans by the optimiser.  An empty pattern has one empty match.
    """
    if not pattern.sites:
        return sites.select("mol_id").distinct()
    columns = [c for c in sites.columns if c not in ("mol_id",)]
    inc = incidence(bonds, "bond_order").select("mol_id", "site_id", "nbr", "bond_order")
    out, names = None, []
    for s, link, closures in pattern.order():
        name = f"p{s}"
        own = sites.select("mol_id", *(F.col(c).alias(f"{name}_{c}") for c in columns)).where(_site_condition(f"{name}_", pattern.sites[s], columns)).select("mol_id", F.col(f"{name}_site_id").alias(name))
        if out is None:
            out = own
        elif link is None:
            out = out.join(own, "mol_id")
        else:
            step = inc.where(F.expr(link[1]) if link[1] else F.lit(True)).select("mol_id", F.col("site_id").alias(f"p{link[0]}"), F.col("nbr").alias(name))
            out = out.join(step, ["mol_id", f"p{link[0]}"]).join(own, ["mol_id", name], "left_semi")
        for other in names:
            if link is None or other != f"p{link[0]}":
                out = out.where(F.col(name) != F.col(other))
        for far, condition in closures:
            edge = inc.where(F.expr(condition) if condition else F.lit(True)).select("mol_id", F.col("site_id").alias(name), F.col("nbr").alias(f"p{far}"))
            out = out.join(edge, ["mol_id", name, f"p{far}"], "left_semi")
        names.append(name)
    return out.select("mol_id", *sorted(names))


def counts(found: DataFrame) -> DataFrame:
    return found.groupBy("mol_id").agg(F.count("*").alias("n"))


def first(found: DataFrame) -> DataFrame:
    """The least match of each molecule, by the places of the pattern's sites in order."""
    names = [c for c in found.columns if c != "mol_id"]
    if not names:
        return found.distinct()
    return found.groupBy("mol_id").agg(F.min(F.struct(*names)).alias("m")).select("mol_id", "m.*")


def containing(sites: DataFrame, found: DataFrame) -> DataFrame:
    """Molecules with a match."""
    return sites.select("mol_id").distinct().join(found.select("mol_id"), "mol_id", "left_semi")
