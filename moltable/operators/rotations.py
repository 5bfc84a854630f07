"""Stereo kinds as a small table of permutations, and configurations, descriptors and mirrors as Columns over it.

A kind is a coordination geometry (its number), or BOND or AXIS.  Its rotation group is found from its
slot directions: the orders of slots that keep all angles and, where the slots span space, their
handedness.  A configuration is an order of neighbours, two of which are the same if a rotation of the
kind takes one to the other.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import dims
from .coordination import DIRECTIONS

BOND, AXIS = len(dims.GEOMETRIES), len(dims.GEOMETRIES) + 1
SLOTS = 6
#: Two pairs of slots at the ends of a rigid frame: in one plane, or crossed.
ENDS = {BOND: [(-2, 1, 0), (-2, -1, 0), (2, 1, 0), (2, -1, 0)], AXIS: [(-2, 1, 0), (-2, -1, 0), (2, 0, 1), (2, 0, -1)]}


@dataclass(frozen=True)
class Kind:
    """order'[i] = order[p[i]] for a p of `group` is the same configuration, for p = mirror its mirror image."""

    kind: int
    group: list[tuple[int, ...]]
    mirror: tuple[int, ...]
    triple: tuple[int, int, int] | None  # the first three slots that span space
    sign: int
    assignments: list[tuple[int, ...]]  # orders of slots of which no rotation or reflection takes one to another
    cosines: list[float]  # of the pairs of slots

    @property
    def slots(self) -> int:
        return len(self.mirror)

    @property
    def ends(self) -> int:
        return 2 if self.kind in ENDS else 1

    @property
    def chiral(self) -> bool:
        return self.mirror not in self.group

    def presentations(self) -> list[tuple[int, ...]]:
        """Orders that a frame can be given in: all for a centre, those within each end for a bond or an axis."""
        n = self.slots
        return [p for p in itertools.permutations(range(n)) if self.ends == 1 or set(p[:2]) == {0, 1}]

    def descriptor(self, ranks) -> tuple[int, ...]:
        order = [sum(s < r for s in ranks) for r in ranks]
        return min(tuple(order[i] for i in p) for p in self.group)

    def admitted(self, ranks) -> list[tuple[int, ...]]:
        """Of the presentations one for each descriptor that ranks tell apart."""
        seen = {}
        for p in self.presentations():
            seen.setdefault(self.descriptor([ranks[i] for i in p]), p)
        return list(seen.values())


@lru_cache
def kinds() -> list[Kind]:
    out = []
    for k in range(AXIS + 1):
        v = np.array(ENDS[k] if k in ENDS else DIRECTIONS[dims.GEOMETRIES[k][0]], float)
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        n, cos = len(v), v @ v.T
        spans = lambda t: np.linalg.det(v[list(t)])  # noqa: B023, E731
        triple = next((t for t in itertools.combinations(range(n), 3) if abs(spans(t)) > 1e-3), None)
        sign = 0 if triple is None else int(np.sign(spans(triple)))
        every = list(itertools.permutations(range(n)))
        same = [p for p in every if np.allclose(cos[np.ix_(p, p)], cos)]
        proper = [p for p in same if triple is None or spans([p[i] for i in triple]) * sign > 0]
        mirror = next((p for p in same if p not in proper), tuple(range(n)))
        assignments, seen = [], set()
        for p in every:
            if p not in seen:
                assignments.append(p)
                seen.update(tuple(p[i] for i in g) for g in same)
        out.append(Kind(k, proper, mirror, triple, sign, [] if k in ENDS else assignments, [float(cos[a, b]) for a, b in itertools.combinations(range(n), 2)]))
    return out


def table(spark: SparkSession) -> DataFrame:
    """(kind, slots, ends, chiral, group, mirror, triple, sign, cosines, assignments): 15 rows; assignments hold for
    each order the places of its pairs in a flat n x n matrix."""
    rows = []
    for k in kinds():
        pairs = list(itertools.combinations(range(k.slots), 2))
        orders = [(list(p), [p[a] * k.slots + p[b] for a, b in pairs]) for p in k.assignments]
        rows.append((k.kind, k.slots, k.ends, k.chiral, [list(p) for p in k.group], list(k.mirror), list(k.triple or ()), k.sign, k.cosines, orders))
    return spark.createDataFrame(rows, "kind int, slots int, ends int, chiral boolean, group array<array<int>>, mirror array<int>, triple array<int>, sign int, cosines array<double>, assignments array<struct<order:array<int>,take:array<int>>>")


def joined(rows: DataFrame, *columns: str) -> DataFrame:
    """rows (kind, ...) with these columns of the table, which is broadcast."""
    return rows.join(F.broadcast(table(rows.sparkSession).select("kind", *columns)), "kind")


def through(order: Column, values: Column) -> Column:
    """values read in this order."""
    return F.transform(order, lambda i: F.get(values, i))


def least(values: Column, group: Column) -> Column:
    """The least image of values under a group."""
    return F.array_min(F.transform(group, lambda p: through(p, values)))


def relative(ranks: Column) -> Column:
    """How many of the ranks are lower than each; equal ranks share a number."""
    return F.transform(ranks, lambda r: F.size(F.filter(ranks, lambda s: s < r)))


def _padded(order: Column) -> Column:
    return F.slice(F.concat(order, F.array_repeat(F.lit(0), SLOTS)), 1, SLOTS)


def configurations(rows: DataFrame) -> DataFrame:
    """rows (..., kind, neighbors) with neighbors in the least order of the configuration.

    Rows whose kind has another number of slots, or whose neighbours repeat, are no configuration and are left out.
    """
    fit = (F.size("neighbors") == F.col("slots")) & (F.size(F.array_distinct("neighbors")) == F.col("slots"))
    return joined(rows, "slots", "group").where(fit).withColumn("neighbors", least(F.col("neighbors"), F.col("group"))).select(*rows.columns)


def descriptors(rows: DataFrame, ranks: str = "ranks") -> DataFrame:
    """rows (..., kind, ranks) with descriptor and mirror: six numbers, the least image of the ranks' relative order and
    that of the mirror image.  ranks are in the order of the configuration's neighbours; equal ranks are not told apart."""
    both = joined(rows, "group", F.col("mirror").alias("_mirror")).withColumn("_order", relative(F.col(ranks)))
    both = both.withColumn("_own", least(F.col("_order"), F.col("group")))
    far = least(through(F.col("_mirror"), F.col("_own")), F.col("group"))
    return both.select(*rows.columns, _padded(F.col("_own")).alias("descriptor"), _padded(far).alias("mirror"))


def admits(spark: SparkSession) -> DataFrame:
    """(kind, pattern, admitted): number of configurations for each pattern of relative orders, ascending within each end,
    and the orders that give them; pattern joins the numbers by a comma."""
    rows = []
    for k in kinds():
        if k.kind in ENDS:
            patterns = {(0, 1 if a else 0, 0, 1 if b else 0) for a in (0, 1) for b in (0, 1)}
        else:
            patterns = {tuple(sum(s < r for s in x) for r in x) for x in itertools.combinations_with_replacement(range(k.slots), k.slots)}
        for p in sorted(patterns):
            ranks = p if k.ends == 1 else [p[0], p[1], p[2] + 2, p[3] + 2]
            rows.append((k.kind, ",".join(map(str, p)), [list(o) for o in k.admitted(ranks)]))
    return spark.createDataFrame(rows, "kind int, pattern string, admitted array<array<int>>")
