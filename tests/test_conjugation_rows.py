"""Conjugated systems of molecules as rows of arrays, against the joins; blocks and localised orders likewise."""

from __future__ import annotations

import random

import pytest

from moltable.operators import conjugation, kernels, spanning

SITE = "mol_id long, site_id long, element int, formal_charge int, radical_electrons int"
BOND = "mol_id long, bond_id long, a long, b long, bond_order int"


def _molecules(spark):
    rng = random.Random(11)
    sites, bonds = [(99, 1, 6, 0, 0)], []
    for m in range(60):
        n = rng.randint(2, 9)
        sites += [(m, i, rng.choice([5, 6, 6, 7, 8]), rng.choice([0, 0, 1, -1]), rng.choice([0, 0, 0, 1])) for i in range(n)]
        pairs = [(i, i + 1) for i in range(n - 1) if rng.random() < 0.9] + [(i, j) for i in range(n) for j in range(i + 2, n) if rng.random() < 0.08]
        bonds += [(m, 100 - k, *rng.sample(p, 2), rng.choice([1, 1, 1, 2, 2, 3, 7] if m % 3 else [1, 1, 2])) for k, p in enumerate(pairs)]
    return spark.createDataFrame(sites, SITE), spark.createDataFrame(bonds, BOND)


@pytest.mark.parametrize("packed", [0, 4])
def test_rows_and_joins_give_the_same_systems(spark, monkeypatch, packed):
    s, b = _molecules(spark)
    rows = lambda: sorted(map(str, conjugation.perceive(s, b).collect()))
    small = rows()
    assert len(small) > 100
    monkeypatch.setattr(conjugation.smallgraphs, "PACKED", packed)
    assert rows() == small


def test_ordinary_molecules_need_no_joins(spark, monkeypatch):
    monkeypatch.setattr(conjugation, "_by_joins", None)
    s = spark.createDataFrame([(1, i, 6, 0, 0) for i in range(1, 5)] + [(1, i, 1, 0, 0) for i in range(5, 11)], SITE)
    chain = [(1, 2, 2), (2, 3, 1), (3, 4, 2), (1, 5, 1), (1, 6, 1), (2, 7, 1), (3, 8, 1), (4, 9, 1), (4, 10, 1)]
    b = spark.createDataFrame([(1, k, *e) for k, e in enumerate(chain)], BOND)
    assert [(r.site_count, r.pi_electrons) for r in conjugation.systems(conjugation.perceive(s, b)).collect()] == [(4, 4)]


def test_blocks_by_rows_and_by_tours_agree_and_use_no_lambdas(spark):
    _, b = _molecules(spark)
    rows = lambda df: sorted(map(tuple, df.select("mol_id", "bond_id", "block").collect()))
    assert rows(spanning.blocks(b)) == rows(spanning.blocks(b, packed=0))
    assert "lambdafunction" not in spanning._packed(b.select("mol_id", "bond_id", "a", "b"))._jdf.queryExecution().executedPlan().toString()


def test_only_molecules_with_aromatic_bonds_go_to_python(spark):
    s, b = _molecules(spark)
    got = kernels.kekulize(kernels.packed(s, b, "element", "formal_charge", "radical_electrons"))
    assert {(r.mol_id, r.bond_id) for r in got.collect()} == {(r.mol_id, r.bond_id) for r in b.where("bond_order = 7").collect()}
    assert "exists" in got._jdf.queryExecution().optimizedPlan().toString()
