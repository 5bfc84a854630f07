"""Conjugated systems by joins: octet arithmetic in Columns, planes and systems as connected components.

Pi bonds that share a site lie in perpendicular planes.  Which of them share a plane is read off
a graph with two nodes for each pi bond, one for each plane, where neighbours link opposite planes:
a part of it is a plane, and a cycle that admits no alternation joins both into one.  A second
graph links planes across single bonds, aromatic bonds, and p orbitals beyond the bonds (vacant,
radical or lone pair) with the planes beside them; its parts of two contributions or more are the
systems.  Molecules of ordinary size go through the same steps as one row each, in Arrow batches; larger ones through joins,
so that a molecule may be of any size.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import AROMATIC, incidence, require
from ..storage import stored
from . import kernels, smallgraphs
from .topology import components
from .valence import lone_pairs


def orbitals(sites: DataFrame, bonds: DataFrame) -> DataFrame:
    """(mol_id, site_id, slots) of sites that keep to the octet: slots lists the electrons of up to two p orbitals that
    bonds leave free, vacant ones before radicals before lone pairs.  Others, and sites of aromatic bonds, are absent."""
    out = lone_pairs(sites, bonds, "sigma")
    vacant = F.when(F.col("element") <= 2, 1).otherwise(4) - F.col("valence") - F.col("lone_pairs") - F.col("radical_electrons")
    out = out.withColumn("vacant", vacant.cast("int")).where("vacant >= 0").withColumn("pi", F.col("valence") - F.col("sigma"))
    across = F.when((F.col("sigma") == 1) | ((F.col("sigma") == 2) & (F.col("pi") >= 2)), 2).when(F.col("sigma").isin(2, 3), 1).otherwise(0)
    free = F.greatest(across - F.col("pi"), F.lit(0)).cast("int")
    filled = [F.array_repeat(F.lit(e), F.col(c).cast("int")) for e, c in enumerate(("vacant", "radical_electrons", "lone_pairs"))]
    return out.select("mol_id", "site_id", F.slice(F.concat(*filled), F.lit(1), free).alias("slots"))


def _pi_bonds(bonds: DataFrame, octet: DataFrame) -> DataFrame:
    """(mol_id, bond_id, a, b, unit): a row for each pi bond, two for a triple bond, numbered by ends."""
    own = octet.select("mol_id", "site_id")
    many = bonds.where(F.col("bond_order").between(2, 6)).select("mol_id", "bond_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "bond_order")
    for end in "ab":
        many = many.join(own.withColumnRenamed("site_id", end), ["mol_id", end], "left_semi")
    number = F.row_number().over(Window.partitionBy("mol_id").orderBy("a", "b", "bond_id")).cast("long")
    return many.withColumn("k", number).select("mol_id", "bond_id", "a", "b", F.explode(F.sequence(2 * F.col("k"), 2 * F.col("k") + F.when(F.col("bond_order") > 2, 1).otherwise(0))).alias("unit"))


def _planes(units: DataFrame) -> DataFrame:
    """(mol_id, unit, plane)."""
    at = units.select("mol_id", "unit", F.explode(F.array("a", "b")).alias("site_id")).groupBy("mol_id", "site_id").agg(F.min("unit").alias("u"), F.max("unit").alias("v"))
    pair = at.where("u < v").select("mol_id", "u", "v").distinct()
    both = lambda x, y: F.struct((2 * F.col("u") + x).alias("a"), (2 * F.col("v") + y).alias("b"))
    edge = pair.select("mol_id", F.explode(F.array(both(0, 1), both(1, 0))).alias("e")).select("mol_id", "e.*", F.lit(0).alias("bond_id"))
    node = units.select("mol_id", F.explode(F.array(2 * F.col("unit"), 2 * F.col("unit") + 1)).alias("site_id"))
    return components(node, edge).where("site_id % 2 = 0").select("mol_id", F.expr("site_id div 2").alias("unit"), F.col("component").alias("plane"))


def _own(site: Column | str, k: Column | int) -> Column:
    """Nodes of a site: 0 its aromatic bonds, 1 and 2 its free orbitals; below zero, where planes are not."""
    return -4 * F.col(site) - 1 - k if isinstance(site, str) else -4 * site - 1 - k


def perceive(sites: DataFrame, bonds: DataFrame) -> DataFrame:
    """(mol_id, system, site_id, contributions, electrons, pairs, aromatic): what each site brings into its systems.

    The electrons and the contribution of a pi bond stand at its smaller site.  A site can be in two systems,
    of perpendicular planes.  Needs element, formal_charge and radical_electrons.
    """
    require(bonds, "mol_id", "bond_id", "a", "b", "bond_order")
    octet = stored(orbitals(sites, bonds), "octet")
    # without a bond of two or more, or an aromatic one, there is no system
    bonds = stored(bonds.select("mol_id", "bond_id", "a", "b", "bond_order").join(bonds.where("bond_order >= 2").select("mol_id").distinct(), "mol_id", "left_semi"), "pi-molecules")
    rows, large = _rows(octet, bonds)
    small = None if rows is None else kernels.per_molecule(rows, _brought, "system long, site_id long, contributions int, electrons int, pairs int, aromatic boolean")
    if large is None:
        return stored(small, "conjugated")
    far = _by_joins(smallgraphs.within(octet, large), smallgraphs.within(bonds, large))
    return stored(far if small is None else far.unionByName(small), "conjugated")


def _rows(octet: DataFrame, bonds: DataFrame) -> tuple[DataFrame | None, DataFrame | None]:
    """(rows, large): rows (mol_id, sites, bonds) of orbitals and bonds, and mol_id of the molecules too large for a row."""
    if not all(isinstance(df.schema[c].dataType, T.IntegralType) for df, c in ((octet, "mol_id"), (octet, "site_id"), (bonds, "bond_id"), (bonds, "a"), (bonds, "b"))):
        return None, bonds.select("mol_id").distinct()
    many = lambda df, most: df.groupBy("mol_id").agg(F.count("*").alias("n")).where(F.col("n") > most).select("mol_id")
    large = stored(many(octet, smallgraphs.PACKED).unionByName(many(bonds, 2 * smallgraphs.PACKED)).distinct(), "large")
    large = None if large.isEmpty() else large
    one, two = (octet, bonds) if large is None else (smallgraphs.without(octet, large), smallgraphs.without(bonds, large))
    s = one.groupBy("mol_id").agg(F.collect_list(F.struct("site_id", "slots")).alias("sites"))
    b = two.groupBy("mol_id").agg(F.collect_list(F.struct("bond_id", "a", "b", "bond_order")).alias("bonds"))
    rows = b.join(s, "mol_id", "left").withColumn("sites", F.coalesce("sites", F.array().cast(s.schema["sites"].dataType)))
    return rows.select("mol_id", "sites", "bonds"), large


def _parts(nodes: Iterable[int], edges: Iterable[tuple[int, int]]) -> dict[int, int]:
    """The least node that each is connected with."""
    top = {n: n for n in nodes}

    def root(n: int) -> int:
        while top[n] != n:
            top[n] = n = top[top[n]]
        return n

    for x, y in edges:
        x, y = root(x), root(y)
        top[max(x, y)] = min(x, y)
    return {n: root(n) for n in top}


def _brought(sites: list[dict], bonds: list[dict]) -> Iterator[tuple]:
    """The rows of perceive() of one molecule; the steps and numbers are those of _by_joins."""
    slots = {s["site_id"]: s["slots"] for s in sites}
    soft = [(b["a"], b["b"]) for b in bonds if b["bond_order"] == AROMATIC]
    rings = sorted({s for b in soft for s in b})
    many = sorted((min(b["a"], b["b"]), max(b["a"], b["b"]), b["bond_id"], b["bond_order"]) for b in bonds if 2 <= b["bond_order"] <= 6 and b["a"] in slots and b["b"] in slots)
    if not many and not rings:
        return
    units = [(u, a, b) for k, (a, b, _, order) in enumerate(many, 1) for u in range(2 * k, 2 * k + 1 + (order > 2))]
    at: dict[int, list[int]] = {}
    for u, a, b in units:
        at.setdefault(a, []).append(u)
        at.setdefault(b, []).append(u)
    ends = {(min(us), max(us)) for us in at.values()}
    plane = _parts((n for u, _, _ in units for n in (2 * u, 2 * u + 1)), ((2 * u + x, 2 * v + 1 - x) for u, v in ends if u < v for x in (0, 1)))
    plane = {u: plane[2 * u] for u, _, _ in units}
    own = lambda site, k: -4 * site - 1 - k
    present: dict[int, list[tuple]] = {s: sorted((plane[u], u) for u in us) for s, us in at.items()}
    for s in rings:
        present.setdefault(s, [(own(s, 0), None)])
    pi = {bond for _, _, bond, _ in many}
    edges = {(own(a, 0), own(b, 0)) for a, b in soft}
    for bond in bonds:
        if bond["bond_order"] == AROMATIC:
            continue
        for site, nbr in ((bond["a"], bond["b"]), (bond["b"], bond["a"])):
            far, here, free = present.get(nbr), present.get(site), slots.get(site)
            if far is None:
                continue
            if here is not None and bond["bond_id"] not in pi:
                edges.update((x[0], y[0]) for x, y in zip(here, far, strict=False))
            if free and here is None:
                edges.update((own(site, 1 + i), f[0]) for i, f in enumerate(far[: len(free)]))
            elif free:
                known = {u for _, u in here}
                edges.update((own(site, 1), f[0]) for f in far if f[1] is None or f[1] not in known)
    linked = {x for x, y in edges if x != y}
    out = [row for u, a, b in units for row in ((plane[u], a, 1, 2, 0, False), (plane[u], b, 0, 0, 0, False))]
    out += [(own(s, 0), s, 2, 0, 0, True) for s in rings]
    out += [(own(s, 1 + k), s, 1, e, int(e == 2), False) for s, free in slots.items() for k, e in enumerate(free or ()) if own(s, 1 + k) in linked]
    system = _parts({r[0] for r in out}, edges)
    total: dict[int, int] = {}
    for node, _, n, *_ in out:
        total[system[node]] = total.get(system[node], 0) + n
    for node, *rest in out:
        if total[system[node]] >= 2:
            yield system[node], *rest


def _by_joins(octet: DataFrame, bonds: DataFrame) -> DataFrame:
    """perceive() for molecules of any size."""
    octet, bonds = stored(octet, "octet"), stored(bonds, "pi-molecules")
    units = stored(_pi_bonds(bonds, octet), "pi-bonds")
    units = stored(units.join(_planes(units), ["mol_id", "unit"]), "pi-planes")
    soft = bonds.where(F.col("bond_order") == AROMATIC)
    rings = incidence(soft).select("mol_id", "site_id").distinct()
    hosted = units.select("mol_id", F.explode(F.array("a", "b")).alias("site_id"), F.struct(F.col("plane").alias("node"), "unit").alias("p"))
    present = hosted.groupBy("mol_id", "site_id").agg(F.array_sort(F.collect_list("p")).alias("at"))  # two at most
    block = rings.join(present, ["mol_id", "site_id"], "left_anti").select("mol_id", "site_id", F.array(F.struct(_own("site_id", 0).alias("node"), F.lit(None).cast("long").alias("unit"))).alias("at"))
    present = present.unionByName(block)

    inc = incidence(bonds.where(F.col("bond_order") != AROMATIC)).join(units.select("mol_id", "bond_id", F.lit(True).alias("pi")).distinct(), ["mol_id", "bond_id"], "left")
    step = inc.join(present.select("mol_id", F.col("site_id").alias("nbr"), F.col("at").alias("far")), ["mol_id", "nbr"])
    step = step.join(present, ["mol_id", "site_id"], "left").join(octet, ["mol_id", "site_id"], "left")
    link = lambda x, y: F.struct(x.alias("a"), y.alias("b"))
    none = F.array().cast("array<struct<a: bigint, b: bigint>>")
    level = F.filter(F.transform("far", lambda f, i: link(F.get("at", i)["node"], f["node"])), lambda e: e["a"].isNotNull())
    donor = F.transform(F.slice("far", F.lit(1), F.size("slots")), lambda f, i: link(_own(F.col("site_id"), 1 + i), f["node"]))
    beside = F.transform(F.filter("far", lambda f: f["unit"].isNull() | ~F.array_contains(F.col("at")["unit"], f["unit"])), lambda f: link(_own(F.col("site_id"), F.lit(1)), f["node"]))
    across = F.when(F.col("pi").isNull() & F.col("at").isNotNull(), level).otherwise(none)
    offered = F.when(F.coalesce(F.size("slots"), F.lit(0)) <= 0, none).when(F.col("at").isNull(), donor).otherwise(beside)
    step = step.select("mol_id", F.explode(F.concat(across, offered)).alias("e")).select("mol_id", "e.a", "e.b")
    edge = stored(step.unionByName(soft.select("mol_id", _own("a", 0).alias("a"), _own("b", 0).alias("b"))).where("a <> b").distinct().withColumn("bond_id", F.lit(0)), "pi-links")

    zero, one = F.lit(0), F.lit(1)
    ends = F.explode(F.array(F.struct(F.col("a").alias("site_id"), one.alias("contributions"), F.lit(2).alias("electrons")), F.struct(F.col("b").alias("site_id"), zero.alias("contributions"), zero.alias("electrons"))))
    bonded = units.select("mol_id", F.col("plane").alias("node"), ends.alias("e")).select("mol_id", "node", "e.*", zero.alias("pairs"), F.lit(False).alias("aromatic"))
    ringed = rings.select("mol_id", _own("site_id", 0).alias("node"), "site_id", F.lit(2).alias("contributions"), zero.alias("electrons"), zero.alias("pairs"), F.lit(True).alias("aromatic"))
    slot = octet.select("mol_id", "site_id", F.posexplode("slots").alias("k", "electrons")).withColumn("node", _own("site_id", 1 + F.col("k")))
    slot = slot.join(edge.select("mol_id", F.col("a").alias("node")).distinct(), ["mol_id", "node"], "left_semi")
    slot = slot.select("mol_id", "node", "site_id", one.alias("contributions"), "electrons", F.when(F.col("electrons") == 2, 1).otherwise(0).alias("pairs"), F.lit(False).alias("aromatic"))
    brought = stored(bonded.unionByName(ringed).unionByName(slot), "pi-brought")
    part = components(brought.select("mol_id", F.col("node").alias("site_id")).distinct(), edge).select("mol_id", F.col("site_id").alias("node"), F.col("component").alias("system"))
    out = brought.join(part, ["mol_id", "node"]).drop("node")
    kept = out.groupBy("mol_id", "system").agg(F.sum("contributions").alias("n")).where("n >= 2").drop("n")
    return out.join(kept, ["mol_id", "system"]).select("mol_id", "system", "site_id", "contributions", "electrons", "pairs", "aromatic")


def members(got: DataFrame) -> DataFrame:
    """(mol_id, system, site_id, donated_pairs) of what perceive() gives."""
    return got.groupBy("mol_id", "system", "site_id").agg(F.sum("pairs").alias("donated_pairs"))


def systems(got: DataFrame) -> DataFrame:
    """(mol_id, system, site_count, pi_electrons): electrons are null beside aromatic orders, until these are localised."""
    total = F.when(~F.bool_or("aromatic"), F.sum("electrons"))
    return got.groupBy("mol_id", "system").agg(F.count_distinct("site_id").alias("site_count"), total.alias("pi_electrons"))


def system_bonds(got: DataFrame, bonds: DataFrame) -> DataFrame:
    """(mol_id, system, bond_id): every bond between two sites of a system."""
    at = members(got).drop("donated_pairs")
    one = bonds.select("mol_id", "bond_id", "a", "b").join(at.withColumnRenamed("site_id", "a"), ["mol_id", "a"])
    return one.join(at.withColumnRenamed("site_id", "b"), ["mol_id", "system", "b"]).select("mol_id", "system", "bond_id")


def donated(got: DataFrame) -> DataFrame:
    """(mol_id, site_id, pairs) given to systems, as steric numbers take them."""
    return got.groupBy("mol_id", "site_id").agg(F.sum("pairs").alias("pairs")).where("pairs > 0")
