"""Graph topology of many molecules at once: frontiers expand by joins until none is left.

Every step is an equi-join by molecule over a table written to the shared folder, so
plans stay short and any task can be run again.  Results do not depend on row order.
Molecules of ordinary size are one row of arrays each instead (`smallgraphs`).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import degrees, incidence
from ..storage import stored
from . import smallgraphs, spanning


def _expand(start: DataFrame, step: Callable[[DataFrame], DataFrame], keys: list[str], name: str, levels: bool = False, depth: int | None = None) -> DataFrame:
    """All rows reached from start: step gives the next rows of the last ones; known keys are dropped.

    levels: every step goes over one bond and bonds go both ways, so that only the last two levels can come again.
    depth: how many steps to take at most.
    """
    seen = last = stored(start, name)
    before = None
    while depth is None or depth > 0:
        known = seen if not levels else last if before is None else last.unionByName(before)
        new = stored(step(last).dropDuplicates(keys).join(known.select(*keys), keys, "left_anti").select(*start.columns), name)
        if new.isEmpty():
            break
        seen, last, before = seen.unionByName(new), new, last
        depth = None if depth is None else depth - 1
    return seen


def distances(sites: DataFrame, bonds: DataFrame, depth: int | None = None) -> DataFrame:
    """(mol_id, a, b, d): hops between all pairs of sites that are connected, itself at 0; up to `depth` hops if it is given."""
    rows, large = smallgraphs.split(sites, bonds)
    small = None if rows is None else smallgraphs.distances(rows, depth)
    if large is None:
        return small
    sites, bonds = smallgraphs.within(sites, large), smallgraphs.within(bonds, large)
    inc = stored(incidence(bonds).select("mol_id", F.col("site_id").alias("b"), "nbr"), "inc")
    start = sites.select("mol_id", F.col("site_id").alias("a"), F.col("site_id").alias("b"), F.lit(0).alias("d"))
    step = lambda last: last.join(inc, ["mol_id", "b"]).select("mol_id", "a", F.col("nbr").alias("b"), (F.col("d") + 1).alias("d"))
    far = _expand(start, step, ["mol_id", "a", "b"], "dist", levels=True, depth=depth)
    return far if small is None else far.unionByName(small)


def bfs(sites: DataFrame, bonds: DataFrame, starts: DataFrame) -> DataFrame:
    """(mol_id, start, site_id, depth) of the sites reached from starts (mol_id, start); ties have one depth."""
    inc = stored(incidence(bonds).select("mol_id", "site_id", "nbr"), "inc")
    first = sites.select("mol_id", "site_id").join(starts.select("mol_id", F.col("start").alias("site_id")), ["mol_id", "site_id"])
    first = first.select("mol_id", F.col("site_id").alias("start"), "site_id", F.lit(0).alias("depth"))
    step = lambda last: last.join(inc, ["mol_id", "site_id"]).select("mol_id", "start", F.col("nbr").alias("site_id"), (F.col("depth") + 1).alias("depth"))
    return _expand(first, step, ["mol_id", "start", "site_id"], "bfs", levels=True)


def components(sites: DataFrame, bonds: DataFrame) -> DataFrame:
    """(mol_id, site_id, component): the smallest site of the connected part; an isolated site is its own.

    Minimum labels with pointer jumping: the rounds grow with the logarithm of a part's diameter, so
    a molecule of any size, such as a whole network, can be one of the rows.
    """
    rows, large = smallgraphs.split(sites, bonds)
    small = None if rows is None else smallgraphs.components(rows)
    if large is None:
        return small
    sites, bonds = smallgraphs.within(sites, large), smallgraphs.within(bonds, large)
    inc = stored(incidence(bonds).select("mol_id", "site_id", "nbr"), "inc")
    label = stored(sites.select("mol_id", "site_id", F.col("site_id").alias("component")), "cc")
    while True:
        far = label.select("mol_id", F.col("site_id").alias("nbr"), F.col("component").alias("c"))
        best = inc.join(far, ["mol_id", "nbr"]).groupBy("mol_id", "site_id").agg(F.min("c").alias("c"))
        hook = label.join(best, ["mol_id", "site_id"], "left").select("mol_id", "site_id", F.col("component").alias("old"), F.least("component", "c").alias("new"))
        # a root takes the smallest label that any of its members has seen
        root = hook.groupBy("mol_id", F.col("old").alias("site_id")).agg(F.min("new").alias("r"))
        joined = stored(hook.join(root, ["mol_id", "site_id"], "left").select("mol_id", "site_id", "old", F.least("new", "r").alias("component")), "cc")
        up = joined.select("mol_id", F.col("site_id").alias("component"), F.col("component").alias("jump"))
        nxt = stored(joined.join(up, ["mol_id", "component"], "left").select("mol_id", "site_id", F.least("component", "jump").alias("component"), F.col("old")), "cc")
        if nxt.where("component <> old").isEmpty():
            return nxt.drop("old") if small is None else nxt.drop("old").unionByName(small)
        label = nxt.drop("old")


def eccentricities(sites: DataFrame, dist: DataFrame) -> DataFrame:
    """(mol_id, site_id, eccentricity): null where some site is out of reach."""
    size = sites.groupBy("mol_id").agg(F.count("*").alias("n"))
    far = dist.groupBy("mol_id", F.col("a").alias("site_id")).agg(F.max("d").alias("e"), F.count("*").alias("k"))
    return far.join(size, "mol_id").select("mol_id", "site_id", F.when(F.col("k") == F.col("n"), F.col("e")).alias("eccentricity"))


def metrics(sites: DataFrame, dist: DataFrame) -> DataFrame:
    """(mol_id, diameter, radius, wiener): the first two null if disconnected; wiener sums reachable pairs."""
    size = sites.groupBy("mol_id").agg(F.count("*").alias("n"))
    far = dist.groupBy("mol_id", "a").agg(F.max("d").alias("e"), F.count("*").alias("k"), F.sum(F.when(F.col("a") < F.col("b"), F.col("d"))).alias("w"))
    ecc = F.when(F.col("k") == F.col("n"), F.col("e"))
    return far.join(size, "mol_id").groupBy("mol_id").agg(F.max(ecc).alias("diameter"), F.min(ecc).alias("radius"), F.coalesce(F.sum("w"), F.lit(0)).alias("wiener"))


def center(sites: DataFrame, dist: DataFrame) -> DataFrame:
    """(mol_id, site_id, is_center, is_peripheral) of connected molecules."""
    w = Window.partitionBy("mol_id")
    ecc = eccentricities(sites, dist).where("eccentricity is not null")
    ecc = ecc.withColumn("lo", F.min("eccentricity").over(w)).withColumn("hi", F.max("eccentricity").over(w))
    return ecc.select("mol_id", "site_id", (F.col("eccentricity") == F.col("lo")).alias("is_center"), (F.col("eccentricity") == F.col("hi")).alias("is_peripheral"))


def shortest_paths(dist: DataFrame, bonds: DataFrame, ends: DataFrame) -> DataFrame:
    """(mol_id, a, b, path): all shortest paths of the pairs (mol_id, a, b); none if out of reach, [a] for a itself.

    Walks back from b along sites one hop nearer to a.
    """
    inc = stored(incidence(bonds).select("mol_id", F.col("site_id").alias("at"), "nbr"), "inc")
    own = stored(dist.join(ends, ["mol_id", "a", "b"], "left_semi").select("mol_id", "a", "b", F.col("b").alias("at"), "d", F.array("b").alias("path")), "paths")
    near = dist.select("mol_id", "a", F.col("b").alias("nbr"), F.col("d").alias("dn"))
    done = []
    while True:
        done.append(own.where("d = 0").select("mol_id", "a", "b", "path"))
        more = own.where("d > 0")
        if more.isEmpty():
            break
        step = more.join(inc, ["mol_id", "at"]).join(near, ["mol_id", "a", "nbr"]).where("dn = d - 1")
        own = stored(step.select("mol_id", "a", "b", F.col("nbr").alias("at"), F.col("dn").alias("d"), F.concat(F.array("nbr"), "path").alias("path")), "paths")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def paths_between(sites: DataFrame, bonds: DataFrame, ends: DataFrame) -> DataFrame:
    """The rows of shortest_paths for the pairs (mol_id, a, b), found from their first sites alone and not from all distances."""
    want = ends.select("mol_id", F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).distinct()
    rows, large = smallgraphs.split(sites, bonds, want.groupBy("mol_id").agg(F.collect_list(F.struct("a", "b")).alias("ends")))
    small = None if rows is None else smallgraphs.paths(rows)
    if large is None:
        return small
    sites, bonds, want = (smallgraphs.within(df, large) for df in (sites, bonds, want))
    dist = bfs(sites, bonds, want.select("mol_id", F.col("a").alias("start")).distinct()).select("mol_id", F.col("start").alias("a"), F.col("site_id").alias("b"), F.col("depth").alias("d"))
    far = shortest_paths(dist, bonds, want)
    return far if small is None else far.unionByName(small)


def shortest_path(paths: DataFrame) -> DataFrame:
    """One path of each pair, the least by its sites."""
    return paths.groupBy("mol_id", "a", "b").agg(F.min("path").alias("path"))


def cycle_rank(sites: DataFrame, bonds: DataFrame, comp: DataFrame) -> DataFrame:
    """(mol_id, cycle_rank): bonds - sites + components."""
    part = comp.groupBy("mol_id").agg((F.count(F.when(F.col("site_id") == F.col("component"), 1)) - F.count("*")).alias("k"))
    edge = bonds.groupBy("mol_id").agg(F.count("*").alias("e"))
    return part.join(edge, "mol_id", "left").select("mol_id", (F.coalesce("e", F.lit(0)) + F.col("k")).alias("cycle_rank"))


def ring_membership(bonds: DataFrame, block: DataFrame | None = None) -> DataFrame:
    """(mol_id, bond_id, a, b, in_ring): a bond is in a ring if its biconnected block has several bonds."""
    block = spanning.blocks(bonds) if block is None else block
    many = block.groupBy("mol_id", "block").agg((F.count("*") > 1).alias("in_ring"))
    own = block.join(many, ["mol_id", "block"]).select("mol_id", "bond_id", "in_ring")
    return bonds.select("mol_id", "bond_id", "a", "b").join(own, ["mol_id", "bond_id"], "left").select("mol_id", "bond_id", "a", "b", F.coalesce("in_ring", F.lit(False)).alias("in_ring"))


def ring_sites(sites: DataFrame, membership: DataFrame) -> DataFrame:
    """(mol_id, site_id, in_ring): a site is in a ring if one of its bonds is."""
    ends = membership.where("in_ring").select("mol_id", F.explode(F.array("a", "b")).alias("site_id")).distinct().withColumn("in_ring", F.lit(True))
    return sites.select("mol_id", "site_id").join(ends, ["mol_id", "site_id"], "left").select("mol_id", "site_id", F.coalesce("in_ring", F.lit(False)).alias("in_ring"))


def _core(sites: DataFrame, bonds: DataFrame) -> DataFrame:
    """(mol_id, site_id) left when sites of fewer than two bonds are peeled off."""
    rows, large = smallgraphs.split(sites, bonds)
    small = None if rows is None else smallgraphs.core(rows)
    if large is None:
        return small
    bonds = smallgraphs.within(bonds, large)
    left = stored(bonds.select("mol_id", "bond_id", "a", "b"), "peel")
    while True:
        inc = incidence(left)
        leaf = inc.groupBy("mol_id", "site_id").agg(F.count("*").alias("k")).where("k < 2").select("mol_id", "site_id")
        drop = inc.join(leaf, ["mol_id", "site_id"]).select("mol_id", "bond_id").distinct()
        nxt = stored(left.join(drop, ["mol_id", "bond_id"], "left_anti"), "peel")
        if nxt.count() == left.count():
            break
        left = nxt
    far = incidence(left).select("mol_id", "site_id")
    return far if small is None else far.unionByName(small)


def framework(sites: DataFrame, bonds: DataFrame, membership: DataFrame) -> DataFrame:
    """(mol_id, site_id, role): Ring, Linker or SideChain, by peeling off sites of fewer than two bonds."""
    core = _core(sites, bonds).distinct().withColumn("core", F.lit(True))
    out = ring_sites(sites, membership).join(core, ["mol_id", "site_id"], "left")
    return out.select("mol_id", "site_id", F.when(F.col("in_ring"), "Ring").when(F.col("core"), "Linker").otherwise("SideChain").alias("role"))


def blocks(bonds: DataFrame) -> DataFrame:
    """(mol_id, bond_id, block): biconnected blocks, named by their least bond; a bridge is its own block."""
    return spanning.blocks(bonds)


def cut_sites(bonds: DataFrame, block: DataFrame) -> DataFrame:
    """(mol_id, site_id): sites in at least two blocks."""
    at = incidence(bonds).join(block, ["mol_id", "bond_id"]).select("mol_id", "site_id", "block").distinct()
    return at.groupBy("mol_id", "site_id").agg(F.count("*").alias("k")).where("k > 1").select("mol_id", "site_id")


def refine(sites: DataFrame, bonds: DataFrame, key: str, rounds: int) -> DataFrame:
    """(mol_id, site_id, colour): colour refinement from the site column `key`, colours dense by rank in the molecule."""
    w = lambda *order: Window.partitionBy("mol_id").orderBy(*order)
    inc = stored(incidence(bonds, "bond_order").select("mol_id", "site_id", "nbr", "bond_order"), "inc")
    colour = stored(sites.select("mol_id", "site_id", (F.dense_rank().over(w(key)) - 1).alias("colour")), "wl")
    for _ in range(rounds):
        far = colour.select("mol_id", F.col("site_id").alias("nbr"), F.col("colour").alias("c"))
        seen = inc.join(far, ["mol_id", "nbr"]).groupBy("mol_id", "site_id").agg(F.array_sort(F.collect_list(F.struct("bond_order", "c"))).alias("env"))
        both = colour.join(seen, ["mol_id", "site_id"], "left").withColumn("env", F.coalesce("env", F.array().cast("array<struct<bond_order:int,c:int>>")))
        colour = stored(both.select("mol_id", "site_id", (F.dense_rank().over(w("colour", "env")) - 1).alias("colour")), "wl")
    return colour


__all__ = ["bfs", "blocks", "center", "components", "cut_sites", "cycle_rank", "degrees", "distances", "eccentricities", "framework", "metrics", "refine", "ring_membership", "ring_sites", "shortest_path", "shortest_paths"]
