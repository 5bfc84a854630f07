"""Stereo frames in the graph, and the configurations that coordinates give them.

A site's frame is the site and its neighbours.  A bond's or an axis's frame is a chain of cumulated double
bonds of which it is the middle: the chain's two ends, and the two further neighbours of each.  Chains are
followed by pointer doubling over directed double bonds, so the rounds grow with the logarithm of a
chain's length.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import incidence, require
from ..storage import stored
from . import rotations, smallgraphs, smallstereo
from .smallstereo import AXIS_LOCUS, BOND_LOCUS, SITE_LOCUS
from .stereo import TINY

DOUBLE = 2
MOST = 6
#: Molecules of up to so many sites have their frames found as one row each, larger ones by joins; frames are the same.
PACKED = 1000


def chains(bonds: DataFrame) -> DataFrame:
    """(mol_id, bond_id, start, head, last, hops): of every double bond, both ways, the site where the chain ends that is
    entered from start by head, and the further double bonds up to it; none where it branches or closes to a ring."""
    arc = incidence(require(bonds, "bond_order").where(F.col("bond_order") == DOUBLE)).select("mol_id", "bond_id", F.col("site_id").alias("start"), F.col("nbr").alias("head"))
    arc = stored(arc, "arcs")
    degree = arc.groupBy("mol_id", F.col("start").alias("head")).agg(F.count("*").alias("d"))
    on = arc.select("mol_id", F.col("start").alias("head"), F.col("bond_id").alias("next"), F.col("head").alias("to"))
    here = arc.join(degree, ["mol_id", "head"]).where("d <= 2")
    step = here.join(on, ["mol_id", "head"]).where("next <> bond_id").select("mol_id", "bond_id", "start", "head", F.col("next").alias("at"), F.col("to").alias("last"), F.lit(1).alias("hops"), F.lit(False).alias("ended"))
    ends = here.where("d = 1").select("mol_id", "bond_id", "start", "head", F.col("bond_id").alias("at"), F.col("head").alias("last"), F.lit(0).alias("hops"), F.lit(True).alias("ended"))
    way = stored(ends.unionByName(step), "chains")
    left = way.where("not ended").count()
    while left:
        far = way.select("mol_id", F.col("bond_id").alias("at"), F.col("head").alias("last"), F.col("at").alias("at2"), F.col("last").alias("last2"), F.col("hops").alias("hops2"), F.col("ended").alias("ended2"))
        jump = way.where("not ended").join(far, ["mol_id", "at", "last"]).select("mol_id", "bond_id", "start", "head", F.col("at2").alias("at"), F.col("last2").alias("last"), (F.col("hops") + F.col("hops2")).alias("hops"), F.col("ended2").alias("ended"))
        way = stored(way.where("ended").unionByName(jump), "chains")
        before, left = left, way.where("not ended").count()
        if left == before:  # what is left closes to rings
            break
    return way.where("ended").select("mol_id", "bond_id", "start", "head", "last", "hops")


def centres(sites: DataFrame, bonds: DataFrame, geometry: DataFrame | None = None) -> DataFrame:
    """The frames of sites alone, as frames() gives them; with geometry (mol_id, site_id, geometry) just those of sites
    whose geometry admits more than one configuration, which are all that perceive() reads."""
    inc = incidence(bonds)
    if geometry is not None:
        sites = stored(geometry.join(F.broadcast(_many(sites.sparkSession)), F.col("geometry").cast("int") == F.col("kind"), "left_semi").select("mol_id", "site_id"), "configurable")
        inc = inc.join(sites, ["mol_id", "site_id"], "left_semi")
    degree = inc.groupBy("mol_id", "site_id").agg(F.count("*").alias("d")).where(f"d between 2 and {MOST}")
    near = inc.join(degree, ["mol_id", "site_id"]).groupBy("mol_id", "site_id").agg(F.array_sort(F.collect_list("nbr")).alias("neighbors"))
    centre = near.join(sites.select("mol_id", "site_id"), ["mol_id", "site_id"], "left_semi")
    return centre.select("mol_id", F.lit(SITE_LOCUS).alias("locus_kind"), F.col("site_id").alias("locus_id"), F.array("site_id").alias("anchors"), "neighbors")


def frames(sites: DataFrame, bonds: DataFrame, packed: int = PACKED) -> DataFrame:
    """(mol_id, locus_kind, locus_id, anchors, neighbors): of sites with two to six neighbours, bonds and axes.

    neighbors ascend, for bonds and axes within each end.  A bond is the middle of its chain, an axis's site too;
    each end bears exactly two neighbours that are not bound double, and all four differ.
    """
    ids = [sites.schema["site_id"].dataType, *(require(bonds, "bond_order").schema[c].dataType for c in ("a", "b", "bond_id"))]
    if len(set(ids)) > 1 or not isinstance(ids[0], T.IntegralType):
        return _joined(sites, bonds)
    size = sites.groupBy("mol_id").agg(F.count("*").alias("n"))
    large = stored(size.where(F.col("n") > packed).select("mol_id"), "large")
    large = None if large.isEmpty() else large
    one, two = (sites, bonds) if large is None else (smallgraphs.without(sites, large), smallgraphs.without(bonds, large))
    order = F.when(F.col("bond_order") == DOUBLE, 2).when(F.col("bond_order") != DOUBLE, 1).otherwise(0)
    edge = two.groupBy("mol_id").agg(F.collect_list(F.struct(*(F.col(c).cast("long").alias(n) for c, n in (("a", "a"), ("b", "b"), ("bond_id", "e"))), order.alias("o"))).alias("v"))
    row = one.groupBy("mol_id").agg(F.array_sort(F.collect_list(F.col("site_id").cast("long"))).alias("s"))
    row = edge.select("mol_id", *(F.col(f"v.{c}").alias(c) for c in "abeo")).join(row, "mol_id", "left").withColumn("s", F.coalesce("s", F.array().cast("array<long>")))
    small = smallstereo.frames(row, MOST)
    lists = T.ArrayType(ids[0])
    small = small.select("mol_id", "locus_kind", F.col("locus_id").cast(ids[0]).alias("locus_id"), F.col("anchors").cast(lists).alias("anchors"), F.col("neighbors").cast(lists).alias("neighbors"))
    return small if large is None else small.unionByName(_joined(smallgraphs.within(sites, large), smallgraphs.within(bonds, large)))


def _joined(sites: DataFrame, bonds: DataFrame) -> DataFrame:
    """The frames of frames() by joins, for molecules of any size."""
    inc, centre = incidence(bonds, "bond_order"), centres(sites, bonds)
    way = stored(chains(bonds), "ways")
    ahead = lambda p, *on: way.select("mol_id", *on, F.col("head").alias(f"{p}_head"), F.col("last").alias(p), F.col("hops").alias(f"{p}_hops"))
    pair = lambda key: (F.col("s_head") < F.col("t_head")) & (F.col("s_hops") == F.col("t_hops")) & (F.col("s") != F.col("t") if key else F.lit(True))
    bond = ahead("s", "bond_id").join(ahead("t", "bond_id"), ["mol_id", "bond_id"]).where(pair(False)).select("mol_id", F.lit(BOND_LOCUS).alias("locus_kind"), F.col("bond_id").alias("locus_id"), "s", "t")
    double = inc.where(F.col("bond_order") == DOUBLE).groupBy("mol_id", "site_id").agg(F.count("*").alias("d")).where("d = 2").select("mol_id", F.col("site_id").alias("start"))
    axis = ahead("s", "start").join(double, ["mol_id", "start"]).join(ahead("t", "start"), ["mol_id", "start"]).where(pair(True)).select("mol_id", F.lit(AXIS_LOCUS).alias("locus_kind"), F.col("start").alias("locus_id"), "s", "t")
    middle = stored(bond.unionByName(axis), "middles")
    ends = middle.select("mol_id", F.explode(F.array("s", "t")).alias("site_id")).distinct()
    free = inc.where(F.col("bond_order") != DOUBLE).join(ends, ["mol_id", "site_id"])
    few = free.groupBy("mol_id", "site_id").agg(F.count("*").alias("d"), F.array(F.min("nbr"), F.max("nbr")).alias("far")).where("d = 2").select("mol_id", "site_id", "far")
    two = middle.join(few.select("mol_id", F.col("site_id").alias("s"), F.col("far").alias("n1")), ["mol_id", "s"]).join(few.select("mol_id", F.col("site_id").alias("t"), F.col("far").alias("n2")), ["mol_id", "t"])
    rigid = two.select("mol_id", "locus_kind", "locus_id", F.array("s", "t").alias("anchors"), F.concat("n1", "n2").alias("neighbors")).where("size(array_distinct(neighbors)) = 4")
    return centre.unionByName(rigid)


def _many(spark: SparkSession) -> DataFrame:
    """(kind, slots) of the geometries that admit more than one configuration."""
    more = spark.createDataFrame([(k.kind,) for k in rotations.kinds() if len(k.presentations()) > len(k.group)], "kind int")
    return rotations.table(spark).where(F.col("kind") < rotations.BOND).select("kind", "slots").join(F.broadcast(more), "kind")


def kinds_of(frame: DataFrame, geometry: DataFrame) -> DataFrame:
    """Frames with their kind: a site's is its geometry (mol_id, site_id, geometry), if that admits more than one
    configuration and has as many slots as the site neighbours; a bond and an axis have their own."""
    at = geometry.select("mol_id", F.lit(SITE_LOCUS).alias("locus_kind"), F.col("site_id").alias("locus_id"), F.col("geometry").cast("int").alias("kind"))
    at = at.join(F.broadcast(_many(frame.sparkSession)), "kind")
    rigid = F.when(F.col("locus_kind") == BOND_LOCUS, rotations.BOND).when(F.col("locus_kind") == AXIS_LOCUS, rotations.AXIS)
    both = frame.join(at, ["mol_id", "locus_kind", "locus_id"], "left").where(rigid.isNotNull() | (F.size("neighbors") == F.col("slots")))
    return both.select(*frame.columns, F.coalesce(rigid, F.col("kind")).alias("kind"))


def _sub(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def _dot(a: Column, b: Column) -> Column:
    return sum((F.get(a, F.lit(i)) * F.get(b, F.lit(i)) for i in (1, 2)), F.get(a, F.lit(0)) * F.get(b, F.lit(0)))


def _cross(a: Column, b: Column) -> Column:
    g = lambda v, i: F.get(v, F.lit(i))
    return F.array(*(g(a, i) * g(b, j) - g(a, j) * g(b, i) for i, j in ((1, 2), (2, 0), (0, 1))))


def perceive(sites: DataFrame, bonds: DataFrame, geometry: DataFrame, frame: DataFrame | None = None) -> DataFrame:
    """(mol_id, locus_kind, locus_id, kind, neighbors): the configuration of every locus that coordinates fix.

    A centre takes the slot order whose angles differ least in sum from the ideal ones (of equal ones the first),
    mirrored if the handedness of the kind's first spanning slots is the other one.  A bond is read from the sides of
    its ends' first neighbours, an axis from the sense of its twist.  Nothing is fixed where a neighbour
    coincides with its centre or the deciding volume is under 1e-9.
    """
    require(sites, "mol_id", "site_id", "x", "y", "z")
    own = stored(kinds_of(frames(sites, bonds) if frame is None else frame, geometry), "stereo-frames")
    at = sites.select("mol_id", "site_id", F.array(*(F.col(k).cast("double") for k in "xyz")).alias("p"))
    key = ["mol_id", "locus_kind", "locus_id"]
    every = own.select(*key, "kind", F.posexplode(F.concat("anchors", "neighbors")).alias("slot", "site_id")).join(at, ["mol_id", "site_id"])
    # at most eight rows a locus
    got = every.groupBy(*key, "kind").agg(F.array_sort(F.collect_list(F.struct("slot", "site_id", "p"))).alias("v"))
    got = got.withColumn("site", F.transform("v", lambda e: e["site_id"])).withColumn("at", F.transform("v", lambda e: e["p"]))
    return rotations.configurations(_centres(got).unionByName(_rigid(got)))


def _fitted(kind: rotations.Kind, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which, order) of the centres [row, centre and neighbours, 3] of one kind whose coordinates fix a configuration."""
    far = p[:, 1:] - p[:, :1]
    dot = lambda u, v: u[..., 0] * v[..., 0] + u[..., 1] * v[..., 1] + u[..., 2] * v[..., 2]
    length = np.sqrt(dot(far, far))
    at = np.flatnonzero(np.isfinite(length).all(axis=1) & (length > 0).all(axis=1))
    unit = far[at] / length[at][..., None]
    gram = dot(unit[:, :, None], unit[:, None]).reshape(len(at), -1)
    pairs = list(itertools.combinations(range(kind.slots), 2))
    miss = np.zeros((len(at), len(kind.assignments)))
    for (a, b), cosine in zip(pairs, kind.cosines, strict=True):
        miss += np.abs(gram[:, [o[a] * kind.slots + o[b] for o in kind.assignments]] - cosine)
    # of fits that are equal but for rounding the first order counts
    order = np.array(sorted(kind.assignments))[np.argmin(np.round(miss[:, np.lexsort(np.array(kind.assignments).T[::-1])], 9), axis=1)]
    if not kind.chiral:
        return at, order
    x, y, z = (unit[np.arange(len(at)), order[:, i]] for i in kind.triple)
    cross = np.stack([y[:, i] * z[:, j] - y[:, j] * z[:, i] for i, j in ((1, 2), (2, 0), (0, 1))], axis=1)
    volume = dot(x, cross)
    fixed = np.abs(volume) >= TINY
    turned = np.where((np.sign(volume) != kind.sign)[:, None], order[:, list(kind.mirror)], order)
    return at[fixed], turned[fixed]


def _centres(got: DataFrame) -> DataFrame:
    """The centres' slot orders, worked out for all centres of an Arrow batch and a kind at once."""
    out = got.select("mol_id", "locus_kind", "locus_id", "kind", F.col("site").cast("array<bigint>").alias("neighbors"))
    rows = got.where(F.col("locus_kind") == SITE_LOCUS).select("mol_id", "locus_kind", "locus_id", "kind", F.col("site").cast("array<bigint>").alias("site"), F.flatten("at").alias("at"))
    schema = out.schema

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            number, size = (c.to_numpy(zero_copy_only=False) for c in (batch.column("kind"), batch.column("site").value_lengths()))
            for k in rotations.kinds()[: rotations.BOND]:
                part = batch.filter(pa.array((number == k.kind) & (size == k.slots + 1)))
                if not part.num_rows or not k.assignments:
                    continue
                p = part.column("at").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, k.slots + 1, 3)
                site = part.column("site").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                at, order = _fitted(k, p)
                nbrs = np.take_along_axis(site[at], order + 1, axis=1)
                nbrs = pa.ListArray.from_arrays(np.arange(len(at) + 1, dtype=np.int32) * k.slots, nbrs.ravel())
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(pa.array(at)) for c in ("mol_id", "locus_kind", "locus_id", "kind")), nbrs], schema=arrow)

    return rows.mapInArrow(run, schema)


def _rigid(got: DataFrame) -> DataFrame:
    key = ["mol_id", "locus_kind", "locus_id", "kind"]
    rows = got.where((F.col("locus_kind") != SITE_LOCUS) & (F.size("site") == 6))
    a, b, s1, s2, t1, t2 = (F.get("at", F.lit(i)) for i in range(6))
    axis = _sub(b, a)
    side = _dot(_cross(_sub(a, s1), axis), _cross(axis, _sub(t1, b)))
    twist = _dot(_cross(_sub(s1, s2), _sub(t1, t2)), axis)
    rows = rows.withColumn("value", F.when(F.col("locus_kind") == BOND_LOCUS, side).otherwise(twist)).where(F.abs("value") >= TINY)
    put = lambda *order: F.array(*(F.get("site", F.lit(i)) for i in order))
    order = F.when(F.col("value") > 0, put(2, 3, 4, 5)).when(F.col("locus_kind") == BOND_LOCUS, put(2, 3, 5, 4)).otherwise(put(3, 2, 4, 5))
    return rows.select(*key, order.alias("neighbors"))
