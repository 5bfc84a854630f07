"""Cases that once went wrong: cutoffs of zero and below, endless radii, coordinates far from one."""

from __future__ import annotations

import random

import numpy as np

from pyspark.sql import functions as F

from moltable.functions import tensor
from moltable.model import bound
from moltable.operators import conjugation, geometry, lattice
from moltable.sources import xyz


def test_periodic_neighbors_at_zero_and_below(spark):
    rows = [(1, 1, 0.1, 0.0, 0.0), (1, 2, 2.9, 0.0, 0.0), (1, 3, 3.1, 0.0, 0.0), (1, 4, 1.5, 1.0, 0.0)]
    s = spark.createDataFrame(rows, "mol_id long, site_id long, x double, y double, z double")
    edge = (F.lit(3.0), F.lit(3.0), F.lit(3.0))
    pairs = lambda cutoff: sorted((r.a, r.b) for r in geometry.periodic_neighbors(s, edge, cutoff).collect())
    assert pairs(-0.6) == [] and pairs(0.6) == [(1, 2), (1, 3), (2, 3)]
    exact = spark.createDataFrame([(1, 1, 0.5, 0.0, 0.0), (1, 2, 3.5, 3.0, 0.0), (1, 3, 1.0, 0.0, 0.0)], s.schema)
    assert [(r.a, r.b) for r in geometry.periodic_neighbors(exact, edge, 0.0).collect()] == [(1, 2)]


def test_translations_of_an_endless_radius(spark):
    basis = F.array(*(F.lit(v) for v in (1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0)))
    got = spark.range(1).select(*(F.size(lattice.translations(basis, F.lit(r))).alias(n) for n, r in (("none", float("inf")), ("one", 1.0)))).first()
    assert (got.none, got.one) == (0, 7)


def test_numbers_keep_all_their_digits(spark):
    rng = random.Random(5)
    values = [0.0, -0.0, 1.0, -1.5, 1e-20, -3.5e-17, 1e25, 123456789.125, 1e7, 9999999.5, 0.001, 5e-324, 1.7976931348623157e308, 100.0, -1e15, 0.1 + 0.2]
    values += [rng.choice([-1, 1]) * rng.random() * 10.0 ** rng.randint(-30, 30) for _ in range(300)]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(xyz.number(F.col("v"))).collect()]
    for v, text in zip(values, got, strict=True):
        assert float(text) == v and "E" not in text and not text.endswith((".0", ".")), (v, text)
    assert got[:7] == ["0", "-0", "1", "-1.5", "0." + "0" * 19 + "1", "-0." + "0" * 16 + "35", "1" + "0" * 25]


def test_singular_values_of_degenerate_small_and_huge_matrices(spark):
    rng = np.random.default_rng(7)
    mats = [rng.standard_normal((3, 3)) * 10.0 ** rng.integers(-12, 12) for _ in range(120)]
    mats += [np.diag([1.0, 1e-9, 1e-14]) @ np.linalg.qr(rng.standard_normal((3, 3)))[0] for _ in range(10)]
    mats += [np.zeros((3, 3)), np.eye(3), np.ones((3, 3)), np.diag([0.0, 2.0, 0.0]), np.full((3, 3), 1e300), np.diag([1e-300, 1.0, 1e300]), np.outer([1, 2, 3], [3.0, -1, 0])]
    df = spark.createDataFrame([(i, m.T.ravel().tolist()) for i, m in enumerate(mats)] + [(900, [None] + [1.0] * 8), (901, [float("nan")] + [1.0] * 8), (902, [float("inf")] + [0.0] * 8)], "i int, m array<double>")
    m = tuple(F.get("m", F.lit(k)) for k in range(9))
    got = {r.i: r for r in df.select("i", *(v.alias(f"s{k}") for k, v in enumerate(tensor.singular_values(m))), tensor.is_invertible(m).alias("ok"), *(v.alias(f"v{k}") for k, v in enumerate(tensor.inverse(m)))).collect()}
    for i, a in enumerate(mats):
        own, want = np.array([got[i].s0, got[i].s1, got[i].s2]), np.linalg.svd(a, compute_uv=False)
        assert (np.abs(own - want) <= 1e-13 * max(want[0], 1e-320)).all() and (np.diff(own) <= 0).all(), (i, own, want)
        assert got[i].ok == bool(0 < abs(np.linalg.det(a)) < np.inf) or abs(np.linalg.det(a)) < 1e-12 * want[0] ** 3
    assert all(got[i].s0 is None for i in (900, 901, 902)) and not got[901].ok and got[901].v0 is None


def test_singular_values_of_a_table_are_worked_out_by_batches(spark):
    """One Python node for the three values, no rotation in interpreted lambdas; the last values are the first ones."""
    m = tuple((F.col("id") * (k + 3) % (7 + k)).cast("double") for k in range(9))
    df = spark.range(30_000).select("id", F.array(*m).alias("m"), *(v.alias(f"s{k}") for k, v in enumerate(tensor.singular_values(m))))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "lambdafunction" not in plan
    for r in df.where("id % 4999 = 1").collect():
        assert np.allclose([r.s0, r.s1, r.s2], np.linalg.svd(np.array(r.m).reshape(3, 3), compute_uv=False), rtol=0, atol=1e-12)


def test_pi_electrons_beside_aromatic_orders_by_an_overlay(spark):
    ring = [(1, k, k, k % 6 + 1, 7) for k in range(1, 7)]
    bonds = spark.createDataFrame(ring + [(1, 6 + k, k, 6 + k, 1) for k in range(1, 7)], "mol_id long, bond_id long, a long, b long, bond_order int")
    sites = spark.createDataFrame([(1, k, 6 if k < 7 else 1, 0, 0) for k in range(1, 13)], "mol_id long, site_id long, element int, formal_charge int, radical_electrons int")
    over = spark.createDataFrame([(1, k, 2 if k % 2 else None) for k in (1, 2, 3, 5)] + [(1, 4, 1), (1, 6, 1)], "mol_id long, bond_id long, bond_order int")
    laid = bound(bonds, over, ["mol_id", "bond_id"], "bond_order")
    assert {r.bond_id: r.bond_order for r in laid.collect()} == {1: 2, 2: 7, 3: 2, 4: 1, 5: 2, 6: 1} | {k: 1 for k in range(7, 13)}
    assert laid.columns == bonds.columns and "extra" in bound(bonds, over.withColumn("extra", F.lit(1)), ["mol_id", "bond_id"], "extra").columns
    systems = lambda b: [(r.site_count, r.pi_electrons) for r in conjugation.systems(conjugation.perceive(sites, b)).collect()]
    assert systems(bonds) == [(6, None)]
    assert systems(bound(bonds, over.na.fill(1), ["mol_id", "bond_id"], "bond_order")) == [(6, 6)]


def test_neighbour_relation(spark):
    pairs = spark.createDataFrame([(1, 1, 2), (1, 1, 3)], "mol_id long, a long, b long")
    asked = spark.createDataFrame([(1, 1, 2), (1, 3, 1), (1, 2, 3), (2, 1, 2), (1, 1, 1)], pairs.schema)
    assert sorted(map(tuple, geometry.contains(pairs, asked).collect())) == [(1, 1, 1, False), (1, 1, 2, True), (1, 2, 3, False), (1, 3, 1, True), (2, 1, 2, False)]
    assert sorted(r.nbr for r in geometry.of_site(pairs, spark.createDataFrame([(1, 1), (9, 1)], "mol_id long, site_id long")).collect()) == [2, 3]


def test_translations_are_spread_over_tasks(spark, tmp_path):
    """Lattices of one small file are not one task's work."""
    from moltable.plans import queries

    spark.range(1, 2001).selectExpr("id as p_partkey", "cast(id % 50 as int) as p_size").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    got = queries.translations(spark, str(tmp_path))
    assert got.rdd.getNumPartitions() == 4
    by_edge = {r.a: (r.least, r.most) for r in got.groupBy((5 + (F.col("p_partkey") % 50) % 7).alias("a")).agg(F.min("n").alias("least"), F.max("n").alias("most")).collect()}
    for a, n in by_edge.items():
        want = sum((i * i + j * j + k * k) * a * a <= 144 for i in range(-3, 4) for j in range(-3, 4) for k in range(-3, 4))
        assert n == (want, want)
