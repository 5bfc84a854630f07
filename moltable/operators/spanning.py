"""Biconnected blocks in work that is linear but for logarithms: spanning forest, Euler tour, ranges of subtrees.

All steps are joins and grouped minima over rows of sites and bonds, so one network may be as large as the
table.  Trees join along their least bonds; the tour around every tree is ranked by pointer doubling; what the
subtree of a site reaches by bonds outside the tree is a range minimum over the tour, looked up in blocks of doubling
size.  Two tree bonds that such a bond ties together are linked, and the connected parts are the blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import discard, stored
from .kernels import per_molecule

#: Molecules of up to so many bonds are one row each.
PACKED = 40


def _jumped(up: DataFrame) -> DataFrame:
    """up (mol_id, c, p) followed to the end: p is a root."""
    while True:
        hop = up.select("mol_id", F.col("c").alias("p"), F.col("p").alias("q"))
        far = hop.select("mol_id", F.col("p").alias("q"), F.col("q").alias("r"))
        new = stored(up.join(hop, ["mol_id", "p"]).join(far, ["mol_id", "q"]).select("mol_id", "c", F.col("r").alias("p"), (F.col("r") != F.col("p")).alias("moved")), "jump")
        still = not new.where("moved").isEmpty()
        discard(up)
        up = new.drop("moved")
        if not still:
            return up


def forest(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """edges (mol_id, bond_id, a, b) -> (mol_id, bond_id) of a spanning forest, and (mol_id, v, root) of every site with a bond.

    In each round every tree takes its least bond to another one, and the trees that these bonds tie become one; parallel
    bonds between two trees shrink to the least.
    """
    cross = stored(edges.where("a <> b").select("mol_id", "bond_id", "a", "b"), "cross")
    label = stored(cross.select("mol_id", F.explode(F.array("a", "b")).alias("v")).distinct().withColumn("root", F.col("v")), "roots")
    taken = []
    while not cross.isEmpty():
        both = cross.select("mol_id", F.explode(F.array(F.struct(F.col("a").alias("c"), F.col("bond_id").alias("e"), F.col("b").alias("p")), F.struct(F.col("b").alias("c"), F.col("bond_id").alias("e"), F.col("a").alias("p")))).alias("x"))
        best = stored(both.groupBy("mol_id", "x.c").agg(F.min(F.struct("x.e", "x.p")).alias("m")).select("mol_id", "c", F.col("m.e").alias("bond_id"), F.col("m.p").alias("p")), "least")
        taken.append(best.select("mol_id", "bond_id"))
        # two trees that take the same bond would point at each other: the smaller is the root
        back = best.select("mol_id", F.col("c").alias("p"), F.col("bond_id").alias("e2"))
        up = best.join(back, ["mol_id", "p"], "left").select("mol_id", "c", F.when((F.col("e2") == F.col("bond_id")) & (F.col("c") < F.col("p")), F.col("c")).otherwise(F.col("p")).alias("p"))
        up = _jumped(stored(up, "up"))
        new = label.join(up.select("mol_id", F.col("c").alias("root"), F.col("p").alias("top")), ["mol_id", "root"], "left")
        old, label = label, stored(new.select("mol_id", "v", F.coalesce("top", "root").alias("root")), "roots")
        side = lambda k: up.select("mol_id", F.col("c").alias(k), F.col("p").alias(f"{k}2"))  # noqa: B023, E731
        far = cross.join(side("a"), ["mol_id", "a"]).join(side("b"), ["mol_id", "b"]).where("a2 <> b2")
        less = far.groupBy("mol_id", F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).agg(F.min("bond_id").alias("bond_id"))
        gone, cross = cross, stored(less.select("mol_id", "bond_id", "a", "b"), "cross")
        discard(old, gone, up)
    tree = edges.select("mol_id", "bond_id").limit(0) if not taken else taken[0]
    for more in taken[1:]:
        tree = tree.unionByName(more)
    return stored(tree.distinct(), "tree"), label


def tour(edges: DataFrame, tree: DataFrame, label: DataFrame) -> DataFrame:
    """(mol_id, v, parent, bond_id, tin, tout) of every site but the roots: first and last step of the walk around its tree
    that stands at the site or below.  A root stands at 0 and is not among the rows."""
    bond = edges.join(tree, ["mol_id", "bond_id"], "left_semi")
    arc = bond.select("mol_id", "bond_id", F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("x")).select("mol_id", "bond_id", "x.u", "x.v")
    w = Window.partitionBy("mol_id", "u").orderBy("v")
    first = arc.groupBy("mol_id", "u").agg(F.min("v").alias("f"))
    # behind u -> v comes v's next bond after the one to u, or its first; at a root the walk ends instead
    turn = arc.withColumn("next", F.lead("v").over(w)).join(first, ["mol_id", "u"]).join(label.select("mol_id", F.col("v").alias("u"), "root"), ["mol_id", "u"])
    turn = turn.select("mol_id", F.col("u").alias("v"), F.col("v").alias("u"), F.coalesce("next", F.when(F.col("u") != F.col("root"), F.col("f"))).alias("to"), "bond_id")
    # an arc u -> v steps on to v -> to; d counts the steps to the end, this one included
    at = stored(turn.select("mol_id", "bond_id", "u", "v", F.when(F.col("to").isNotNull(), F.col("v")).alias("nu"), F.col("to").alias("nv"), F.lit(1).cast("long").alias("d")), "tour")
    while not at.where("nv is not null").isEmpty():
        far = at.select("mol_id", F.col("u").alias("nu"), F.col("v").alias("nv"), F.col("nu").alias("nu2"), F.col("nv").alias("nv2"), F.col("d").alias("d2"))
        new = stored(at.join(far, ["mol_id", "nu", "nv"], "left").select("mol_id", "bond_id", "u", "v", F.col("nu2").alias("nu"), F.col("nv2").alias("nv"), (F.col("d") + F.coalesce("d2", F.lit(0))).alias("d")), "tour")
        discard(at)
        at = new
    root = label.select("mol_id", F.col("v").alias("u"), "root")
    at = at.join(root, ["mol_id", "u"])
    size = label.groupBy("mol_id", "root").agg((2 * (F.count("*") - 1)).alias("n"))
    at = at.join(size, ["mol_id", "root"]).select("mol_id", "bond_id", "root", "u", "v", (F.col("n") - F.col("d")).alias("pos"))
    # of the two arcs of a bond the earlier goes down
    pair = at.groupBy("mol_id", "root", "bond_id").agg(F.min(F.struct("pos", "u", "v")).alias("down"), F.max("pos").alias("tout"))
    return stored(pair.select("mol_id", "root", F.col("down.v").alias("v"), F.col("down.u").alias("parent"), "bond_id", (F.col("down.pos") + 1).alias("tin"), "tout"), "walk")


def _nodes(lo: Column, hi: Column, levels: int) -> Column:
    """Blocks (level, place) that together hold the places lo up to, not with, hi."""

    def step(s: Column, k: Column) -> Column:
        on = s["l"] < s["r"]
        left, right = on & (s["l"] % 2 == 1), on & (s["r"] % 2 == 1)
        l2 = s["l"] + F.when(left, 1).otherwise(0)
        r2 = s["r"] - F.when(right, 1).otherwise(0)
        none = F.array().cast("array<struct<k:int,at:bigint>>")
        take = lambda c, v: F.when(c, F.array(F.struct(k.alias("k"), v.alias("at")))).otherwise(none)
        return F.struct(F.floor(l2 / 2).cast("long").alias("l"), F.floor(r2 / 2).cast("long").alias("r"), F.concat(s["n"], take(left, s["l"]), take(right, r2)).alias("n"))

    start = F.struct(lo.cast("long").alias("l"), hi.cast("long").alias("r"), F.array().cast("array<struct<k:int,at:bigint>>").alias("n"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(levels)), start, step)["n"]


def _blocks(_: list[dict], bonds: list[dict]) -> Iterator[tuple]:
    """Blocks of one molecule: every bond beside a spanning tree ties the bonds of the circle that it closes in the tree."""
    bonds = sorted(bonds, key=lambda e: e["bond_id"])
    top, near = list(range(len(bonds))), {}
    for i, e in enumerate(bonds):
        near.setdefault(e["a"], []).append((e["b"], i))
        near.setdefault(e["b"], []).append((e["a"], i))

    def root(i: int) -> int:
        while top[i] != i:
            top[i] = i = top[top[i]]
        return i

    depth, up, tree = {}, {}, set()
    for start in near:
        if start in depth:
            continue
        depth[start], left = 0, [start]
        while left:
            v = left.pop()
            for w, i in near[v]:
                if w not in depth:
                    depth[w], up[w] = depth[v] + 1, (v, i)
                    tree.add(i)
                    left.append(w)
    for i, e in enumerate(bonds):
        x, y = e["a"], e["b"]
        while i not in tree and x != y:
            if depth[x] < depth[y]:
                x, y = y, x
            x, k = up[x]
            k, own = root(k), root(i)
            top[max(k, own)] = min(k, own)
    for i, e in enumerate(bonds):
        yield e["bond_id"], bonds[root(i)]["bond_id"]


def _packed(bonds: DataFrame) -> DataFrame:
    """Blocks of molecules of few bonds, each one row of arrays."""
    row = bonds.groupBy("mol_id").agg(F.collect_list(F.struct("bond_id", "a", "b")).alias("bonds")).select("mol_id", F.array().alias("sites"), "bonds")
    kind = bonds.schema["bond_id"].dataType
    out = per_molecule(row, _blocks, "bond_id long, block long")
    return out.select(F.col("mol_id").cast(bonds.schema["mol_id"].dataType).alias("mol_id"), F.col("bond_id").cast(kind).alias("bond_id"), F.col("block").cast(kind).alias("block"))


def blocks(bonds: DataFrame, packed: int = PACKED) -> DataFrame:
    """(mol_id, bond_id, block): biconnected blocks, named by their least bond; a bridge is its own block.

    Molecules of up to `packed` bonds are done as one row each, larger ones by the forest and tour; results are the same.
    """
    bonds = stored(bonds.select("mol_id", "bond_id", "a", "b"), "edges")
    if not all(isinstance(f.dataType, T.IntegralType) for f in bonds.schema):
        packed = -1
    size = stored(bonds.groupBy("mol_id").agg(F.count("*").alias("n")), "sizes")
    large = size.where(F.col("n") > packed).select("mol_id")
    if large.isEmpty():
        return stored(_packed(bonds), "blocks")
    if packed < 0:
        return by_tours(bonds)
    few = _packed(bonds.join(size.where(F.col("n") <= packed).select("mol_id"), "mol_id"))
    return stored(few.unionByName(by_tours(bonds.join(large, "mol_id"))), "blocks")


def by_tours(bonds: DataFrame) -> DataFrame:
    """The same by joins over sites and bonds, for networks of any size."""
    edges = stored(bonds.select("mol_id", "bond_id", "a", "b"), "edges")
    tree, label = forest(edges)
    walk = tour(edges, tree, label)
    rest = edges.join(tree, ["mol_id", "bond_id"], "left_anti")
    place = stored(label.join(walk.select("mol_id", "v", "tin", "tout"), ["mol_id", "v"], "left").select("mol_id", "v", "root", F.coalesce("tin", F.lit(0)).alias("tin"), "tout"), "places")
    end = lambda k: place.select("mol_id", F.col("v").alias(k), F.col("tin").alias(f"{k}in"), F.col("tout").alias(f"{k}out"))
    rest = rest.join(end("a"), ["mol_id", "a"]).join(end("b"), ["mol_id", "b"])
    low = F.col("ain") < F.col("bin")
    pick = lambda x, y: F.when(low, F.col(x)).otherwise(F.col(y))
    rest = stored(rest.select("mol_id", "bond_id", pick("a", "b").alias("u"), pick("b", "a").alias("w"), pick("ain", "bin").alias("uin"), pick("bin", "ain").alias("win"), pick("aout", "bout").alias("uout")), "rest")
    # what each place reaches outside the tree, then the least and greatest of every subtree
    reach = rest.select("mol_id", F.explode(F.array(F.struct(F.col("u").alias("v"), F.col("win").alias("t")), F.struct(F.col("w").alias("v"), F.col("uin").alias("t")))).alias("x")).select("mol_id", "x.v", "x.t")
    own = reach.join(place.select("mol_id", "v", "root", "tin"), ["mol_id", "v"]).groupBy("mol_id", "root", "tin").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    most = walk.agg(F.max("tout")).first()[0] or 0
    levels = int(most + 1).bit_length()
    node = own.select("mol_id", "root", "lo", "hi", F.explode(F.transform(F.sequence(F.lit(0), F.lit(levels)), lambda k: F.struct(k.alias("k"), F.floor(F.col("tin") / F.pow(F.lit(2.0), k)).cast("long").alias("at")))).alias("x"))
    node = stored(node.groupBy("mol_id", "root", "x.k", "x.at").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")), "ranges")
    ask = walk.select("mol_id", "root", "v", F.explode(_nodes(F.col("tin"), F.col("tout") + 1, levels)).alias("x")).select("mol_id", "root", "v", "x.k", "x.at")
    span = ask.join(node, ["mol_id", "root", "k", "at"]).groupBy("mol_id", "v").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    up = walk.select("mol_id", F.col("v").alias("parent"), F.col("tin").alias("pin"), F.col("tout").alias("pout"))
    tied = walk.join(span, ["mol_id", "v"]).join(up, ["mol_id", "parent"]).where("lo < pin or hi > pout").select("mol_id", F.col("v").alias("a"), F.col("parent").alias("b"))
    across = rest.where("uin > 0 and win > uout").select("mol_id", F.col("u").alias("a"), F.col("w").alias("b"))
    link = stored(tied.unionByName(across).distinct().select("mol_id", F.xxhash64("a", "b").alias("bond_id"), "a", "b"), "links")
    _, part = forest(link)
    kin = walk.select("mol_id", "v", "bond_id").join(part.withColumnRenamed("root", "part"), ["mol_id", "v"], "left").select("mol_id", "v", "bond_id", F.coalesce("part", "v").alias("part"))
    kin = stored(kin, "kin")
    every = kin.select("mol_id", "bond_id", "part").unionByName(rest.join(kin.select("mol_id", F.col("v").alias("w"), "part"), ["mol_id", "w"]).select("mol_id", "bond_id", "part"))
    every = stored(every, "members")
    name = every.groupBy("mol_id", "part").agg(F.min("bond_id").alias("block"))
    out = stored(every.join(name, ["mol_id", "part"]).select("mol_id", "bond_id", "block"), "blocks")
    discard(edges, tree, label, walk, place, rest, node, link, part, kin, every)
    return out
