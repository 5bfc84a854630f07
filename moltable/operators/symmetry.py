"""Symmetry classes and identity of coloured molecules by joins: colours are refined together, sites made individual as rows.

Colours are rows (mol_id, tag, site_id, colour): a tag names one colouring of a molecule, so that many are refined at
once over the same bonds.  A colour is a 64-bit hash of what a site has seen, never of its number, so equal
colours of two molecules mean the same, and their order is fixed.  Each colouring stops by itself when a
round splits no class of it; its colours do not depend on what else is in the table.  Molecules of ordinary
size go through all rounds as rows of arrays, many at a time in a batch; a molecule of any size goes through the
same rounds as joins of its sites and bonds.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import incidence
from ..storage import discard, settled, stored
from . import smallcolours

KEY = ["mol_id", "tag"]
LOW = (1 << 31) - 1


def _sums(h: Column) -> tuple[Column, Column]:
    """Two sums that stand for a multiset of hashes, added up before any shuffle."""
    return F.sum(h.bitwiseAND(F.lit(LOW))).alias("lo"), F.sum(F.shiftrightunsigned(h, 31)).alias("hi")


#: Molecules of up to so many sites are refined as one row each, larger ones by joins; colours are the same.
PACKED = 1000


@dataclass(frozen=True)
class Ties:
    """Bonds from both ends with a hash of their key: as rows, packed by molecule, and rows of the molecules too large for that."""

    rows: DataFrame  # (mol_id, site_id, nbr, tie)
    packed: DataFrame | None  # (mol_id, a, b, e, t): ends, ids and hashes of a molecule's bonds
    large: DataFrame | None


def ties(sites: DataFrame, bonds: DataFrame, bond_key: str = "bond_order", packed: int = PACKED) -> Ties:
    rows = incidence(bonds, bond_key).select("mol_id", "site_id", "nbr", F.xxhash64(bond_key).alias("tie"))
    whole = all(isinstance(df.schema[c].dataType, T.IntegralType) for df, c in ((sites, "site_id"), (bonds, "a"), (bonds, "b"), (bonds, "bond_id")))
    size = sites.groupBy("mol_id").agg(F.count_distinct("site_id").alias("n"))
    big = stored(size.where(F.col("n") > (packed if whole else 0)).select("mol_id"), "large")
    if not whole:
        return Ties(stored(rows, "ties"), None, big)
    edge = F.struct(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), F.col("bond_id").cast("long").alias("e"), F.xxhash64(bond_key).alias("t"))
    one = bonds.groupBy("mol_id").agg(F.collect_list(edge).alias("v")).select("mol_id", *(F.col(f"v.{c}").alias(c) for c in "abet"))
    if big.isEmpty():
        return Ties(rows, one, None)
    return Ties(stored(rows, "ties"), one, big)


def colours(sites: DataFrame, site_key: str = "element") -> DataFrame:
    """(mol_id, tag, site_id, colour) by the caller's site key; tag 0 unless sites have one."""
    tag = F.col("tag") if "tag" in sites.columns else F.lit(0)
    return sites.select("mol_id", tag.cast("long").alias("tag"), "site_id", F.xxhash64(site_key).alias("colour"))


def _halves(h: Column) -> tuple[Column, Column]:
    return h.bitwiseAND(F.lit(LOW)), F.shiftrightunsigned(h, 31)


def _round(live: DataFrame, tie: DataFrame) -> DataFrame:
    """One hop: every site takes the hash of its colour and of what its neighbours send; a colouring that splits nothing more keeps its old colours."""
    zero = F.lit(0).cast("long")
    lo, hi = _halves(F.xxhash64("tie", "colour"))
    own = live.select(*KEY, "site_id", "colour", "n", zero.alias("lo"), zero.alias("hi"))
    far = live.join(tie, ["mol_id", "site_id"]).select(*KEY, F.col("nbr").alias("site_id"), F.lit(None).cast("long").alias("colour"), F.lit(None).cast("long").alias("n"), lo.alias("lo"), hi.alias("hi"))
    new = own.unionByName(far).groupBy(*KEY, "site_id").agg(F.max("colour").alias("colour"), F.max("n").alias("n"), F.sum("lo").alias("lo"), F.sum("hi").alias("hi"))
    new = stored(new.select(*KEY, "site_id", "colour", "n", F.xxhash64("colour", "lo", "hi").alias("next")), "hop")
    split = F.col("m") > F.col("n")
    now = new.join(new.groupBy(*KEY).agg(F.count_distinct("next").alias("m")), KEY)
    step = stored(now.select(*KEY, "site_id", F.when(split, F.col("next")).otherwise(F.col("colour")).alias("colour"), F.col("m").alias("n"), split.alias("live")), "colours")
    discard(new)
    return step


def _joined(colour: DataFrame, tie: DataFrame) -> list[DataFrame]:
    """Rounds by joins: rows that came to rest in each."""
    first = colour.groupBy(*KEY).agg(F.count_distinct("colour").alias("n"))
    live, done = stored(colour.join(first, KEY).select(*KEY, "site_id", "colour", "n"), "colours"), []
    while True:
        step = _round(live, tie)
        discard(live)
        done.append(step.where("not live").select(*KEY, "site_id", "colour"))
        live = stored(step.where("live").drop("live"), "colours")
        if live.isEmpty():
            return done


def parts(colour: DataFrame, tie: Ties) -> tuple[DataFrame | None, DataFrame | None]:
    """(rows of arrays of the molecules that fit one, colours of the larger ones)."""
    if tie.packed is None:
        return None, colour
    row = colour if tie.large is None else colour.join(tie.large, "mol_id", "left_anti")
    row = row.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct(F.col("site_id").cast("long").alias("site_id"), "colour"))).alias("v"))
    row = row.select(*KEY, F.col("v.site_id").alias("s"), F.col("v.colour").alias("c")).join(tie.packed, "mol_id", "left")
    return row, None if tie.large is None else colour.join(tie.large, "mol_id", "left_semi")


def _gathered(parts: list[DataFrame], name: str) -> DataFrame:
    return stored(reduce(DataFrame.unionByName, parts), name)


def stable(colour: DataFrame, tie: Ties) -> DataFrame:
    """The coarsest finer colouring in which sites of one colour see the same colours over the same bonds."""
    row, more = parts(colour, tie)
    out = [] if row is None else [smallcolours.stable(row)]
    return _gathered(out if more is None else [*out, *_joined(more, tie.rows)], "stable")


def _marked(colour: DataFrame, chosen: DataFrame) -> DataFrame:
    """colour under new tags: for each row of chosen (mol_id, tag, site_id, to) the colouring `tag` with that site made individual."""
    pick = chosen.select(*KEY, F.col("site_id").alias("own"), "to")
    return colour.join(pick, KEY).select("mol_id", F.col("to").alias("tag"), "site_id", F.when(F.col("site_id") == F.col("own"), F.xxhash64("colour", F.lit(1))).otherwise(F.col("colour")).alias("colour"))


def _cells(colour: DataFrame, tie: Ties) -> DataFrame:
    """(mol_id, tag, colour, size) of classes of several sites that bear two bonds or more, in molecules with a ring.

    Sites of one stable colour of a forest are always images of each other, and a site of one bond follows its neighbour.
    """
    degree = tie.rows.groupBy("mol_id", "site_id").agg(F.count("*").alias("d"))
    ringed = degree.groupBy("mol_id").agg(F.sum("d").alias("ends"), F.count("*").alias("k")).where("ends >= 2 * k").select("mol_id")
    inner = degree.where("d > 1").select("mol_id", "site_id").join(ringed, "mol_id", "left_semi")
    return colour.join(inner, ["mol_id", "site_id"], "left_semi").groupBy(*KEY, "colour").agg(F.count("*").alias("size"), F.min("site_id").alias("least")).where("size > 1")


def classes(colour: DataFrame, tie: Ties) -> DataFrame:
    """Symmetry classes: the stable colouring, split while making single sites individual tells members of a class apart.

    Every member of an undecided class gets a colouring of its own, refined together with all others; the hash of
    the outcome joins its colour.  In a forest, and wherever nothing splits any more in the graphs tested, classes are
    the orbits of the automorphisms.
    """
    row, more = parts(colour, tie)
    out = [] if row is None else [smallcolours.classes(row)]
    if more is None:
        return out[0]
    return _gathered([*out, _joined_classes(more, Ties(tie.rows, None, None))], "classes")


def _joined_classes(colour: DataFrame, tie: Ties) -> DataFrame:
    live, done = stable(colour, tie), []
    while True:
        cell = _cells(live, tie)
        pivot = stored(live.join(cell, [*KEY, "colour"]).select(*KEY, "site_id", F.xxhash64("tag", "site_id").alias("to")), "pivots")
        if pivot.isEmpty():
            done.append(live)
            break
        each = stable(_marked(live, pivot), tie)
        seen = each.groupBy("mol_id", F.col("tag").alias("to")).agg(*_sums(F.xxhash64("colour")))
        mark = pivot.join(seen, ["mol_id", "to"]).select(*KEY, "site_id", F.xxhash64("lo", "hi").alias("mark"))
        finer = live.join(mark, [*KEY, "site_id"], "left").withColumn("next", F.when(F.col("mark").isNull(), F.col("colour")).otherwise(F.xxhash64("colour", "mark")))
        split = finer.groupBy(*KEY).agg(F.count_distinct("colour").alias("n"), F.count_distinct("next").alias("m")).where("m > n").select(*KEY)
        finer = stored(finer.join(split.withColumn("on", F.lit(True)), KEY, "left").select(*KEY, "site_id", "colour", "next", F.coalesce("on", F.lit(False)).alias("on")), "finer")
        discard(each, pivot)
        done.append(finer.where("not on").select(*KEY, "site_id", "colour"))
        more = finer.where("on").select(*KEY, "site_id", F.col("next").alias("colour"))
        if more.isEmpty():
            break
        live = stable(more, tie)
    return done[0] if len(done) == 1 else settled(done, "classes")


def orbits(sites: DataFrame, bonds: DataFrame, site_key: str = "element", bond_key: str = "bond_order") -> DataFrame:
    """(mol_id, site_id, orbit): the least site of each symmetry class."""
    tie = ties(sites, bonds, bond_key)
    row, more = parts(colours(sites, site_key), tie)
    out = [] if row is None else [smallcolours.orbits(row).select("mol_id", F.col("site_id").cast(sites.schema["site_id"].dataType).alias("site_id"), F.col("orbit").cast(sites.schema["site_id"].dataType).alias("orbit"))]
    if more is not None:
        got = classes(more, Ties(tie.rows, None, None))
        out.append(got.join(got.groupBy("mol_id", "colour").agg(F.min("site_id").alias("orbit")), ["mol_id", "colour"]).select("mol_id", "site_id", "orbit"))
    return reduce(DataFrame.unionByName, out)


def certificates(colour: DataFrame, tie: Ties) -> DataFrame:
    """(mol_id, tag, certificate): equal for two colourings exactly if a map of sites and bonds takes one to the other.

    A site of the smallest undecided class (of equal sizes that of the least colour) is made individual and classes are
    found anew, until only sites of one bond and trees are left to exchange; members of a class are images of each
    other, so any of them does.  The certificate adds up the coloured sites and bonds, up to hash collisions.
    """
    row, more = parts(colour, tie)
    out = [] if row is None else [smallcolours.certificates(row)]
    if more is not None:
        out.append(_joined_certificates(more, Ties(tie.rows, None, None)))
    return reduce(DataFrame.unionByName, out).select(*KEY, certificate("lo", "hi", "k").alias("certificate"))


def certificate(lo: str, hi: str, k: str) -> Column:
    return F.concat_ws("-", F.col(k).cast("string"), F.hex(lo), F.hex(hi))


def _joined_certificates(colour: DataFrame, tie: Ties) -> DataFrame:
    """(mol_id, tag, lo, hi, k) of molecules of any size."""
    live, done = classes(colour, tie), []
    while True:
        cell = _cells(live, tie).groupBy(*KEY).agg(F.min(F.struct("size", "colour", "least")).alias("c")).select(*KEY, F.col("c.least").alias("site_id"), F.col("tag").alias("to"))
        cell = stored(cell, "targets")
        done.append(live.join(cell.select(*KEY), KEY, "left_anti"))
        if cell.isEmpty():
            break
        live = classes(_marked(live, cell), tie)
    last = done[0]
    for more in done[1:]:
        last = last.unionByName(more)
    last = stored(last.join(colour.select(*KEY, "site_id", F.col("colour").alias("key")), [*KEY, "site_id"]), "final")
    own = last.select(*KEY, F.xxhash64("colour", "key").alias("h"))
    ends = last.select(*KEY, "site_id", "colour").join(tie.rows, ["mol_id", "site_id"])
    far = ends.join(last.select(*KEY, F.col("site_id").alias("nbr"), F.col("colour").alias("c2")), [*KEY, "nbr"])
    return own.unionByName(far.select(*KEY, F.xxhash64("colour", "c2", "tie").alias("h"))).groupBy(*KEY).agg(*_sums(F.col("h")), F.count("*").alias("k"))
