"""Neighbour searches whose cost follows the input: shortest images without trial, pairs that are asked for, blocks of a group."""

from __future__ import annotations

import itertools
import math
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from moltable.operators import geometry, lattice
from moltable.plans import queries

#: the same lattice twice, far from reduced and reduced
FLAT = [4.0, 0.0, 0.0, 1.0, 5.0, 0.0, 9.5, 5.7, 2.0]
PLAIN = [4.0, 0.0, 0.0, 1.0, 5.0, 0.0, 0.5, 0.7, 2.0]


def _points(n: int, groups: int = 2) -> list[tuple]:
    rng = random.Random(7)
    return [(1 + i % groups, i, *(rng.uniform(-6, 6) for _ in range(3))) for i in range(n)]


def _nearest(basis: list[float], d: list[float]) -> float:
    steps = itertools.product(range(-5, 6), range(-4, 5), range(-7, 8))
    return min(sum((d[k] + i * basis[k] + j * basis[3 + k] + m * basis[6 + k]) ** 2 for k in range(3)) for i, j, m in steps)


def test_images_of_thin_and_wide_cells(spark):
    """Cutoffs under half of every height take the rounded image alone (no trial of 27 images), larger ones all of them."""
    rows = _points(40)
    df = spark.createDataFrame(rows, "mol_id long, site_id long, x double, y double, z double")
    cell = df.select("mol_id").distinct().withColumn("cell", F.array(*(F.lit(v) for v in FLAT)))
    best = {(p[0], p[1], q[1]): _nearest(PLAIN, [q[2 + k] - p[2 + k] for k in range(3)]) for p, q in itertools.combinations(rows, 2) if p[0] == q[0]}
    for cutoff in (0.6, 1.5):
        got = {(r.mol_id, r.a, r.b): r.d2 for r in lattice.neighbors(df, cell, cutoff).collect()}
        assert set(got) == {k for k, v in best.items() if v <= cutoff**2} and got
        assert all(math.isclose(v, best[k], abs_tol=1e-9) for k, v in got.items())


def test_pairs_asked_for(spark):
    """neighbors_among finds by sites what `neighbors` finds by cells; a site beyond all cells is no error."""
    rows = [*_points(60), (3, 1, 1e30, 0.0, 0.0), (3, 2, 1e30, 0.0, 0.5), (3, 3, None, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "mol_id long, site_id long, x double, y double, z double")
    every = df.select("mol_id", F.col("site_id").alias("b")).join(df.select("mol_id", F.col("site_id").alias("a")), "mol_id")
    pairs = geometry.neighbors(df, 3.0)
    assert sorted(map(tuple, geometry.neighbors_among(df, every, 3.0).collect())) == sorted(map(tuple, pairs.collect()))
    whole, quick = (sorted(map(tuple, geometry.contains(p, every).collect())) for p in (pairs, geometry.neighbors_among(df, every, 3.0)))
    assert whole == quick and (3, 1, 2, True) in quick


def test_next_points_by_blocks(spark):
    rows = [(g, s) for g in (1, 2, None) for s in (-9, -1, 0, 3, 4, 5, 11, 12, 40)]
    df = spark.createDataFrame(rows, "mol_id long, site_id long")
    plain = df.select("mol_id", F.col("site_id").alias("a"), F.lead("site_id").over(Window.partitionBy("mol_id").orderBy("site_id")).alias("b")).where("b is not null")
    assert sorted(map(str, queries._following(df, 4).collect())) == sorted(map(str, plain.collect()))
