"""Colourings of small molecules in batches against the same rounds as joins; forms and isomers of molecules without loci."""

from __future__ import annotations

import itertools
import random

from moltable.operators import stereoforms, symmetry

TETRAHEDRAL = 5


def tables(spark, mols):
    """Molecules {id: (elements, [(a, b, order)])}; sites count from 1."""
    s = [(m, i, e) for m, (z, _) in mols.items() for i, e in enumerate(z, 1)]
    b = [(m, k, *x) for m, (_, bonds) in mols.items() for k, x in enumerate(bonds, 1)]
    return spark.createDataFrame(s, "mol_id long, site_id long, element int"), spark.createDataFrame(b, "mol_id long, bond_id long, a long, b long, bond_order int")


def test_batches_of_colourings_give_the_classes_of_the_joins(spark):
    rng, mols = random.Random(17), {}
    for m in range(1, 13):
        n = rng.randint(1, 9)
        bonds = [(a, b, rng.randint(1, 2)) for a, b in itertools.combinations(range(1, n + 1), 2) if rng.random() < 0.35]
        mols[m] = ([rng.choice([6, 6, 6, 7]) for _ in range(n)], bonds)
    s, b = tables(spark, mols)
    key = symmetry.colours(s)
    small, large = symmetry.ties(s, b), symmetry.ties(s, b, packed=0)
    assert small.large is None and large.large is not None
    got, want = (sorted(map(tuple, df.select("mol_id", "site_id", "colour").collect())) for df in (symmetry.classes(key, small), symmetry.classes(key, large)))
    assert got == want
    # classes of small molecules take no written table
    before = symmetry.stored
    symmetry.stored = None
    try:
        assert len(symmetry.classes(key, small).collect()) == sum(len(z) for z, _ in mols.values())
    finally:
        symmetry.stored = before


def test_forms_without_configurations_and_loci_take_one_colouring(spark):
    mols = {1: ([6, 9, 17, 35, 1], [(1, i, 1) for i in range(2, 6)]), 2: ([6, 6], [(1, 2, 1)]), 3: ([6, 6, 6], [(1, 2, 1), (2, 3, 1), (1, 3, 1)])}
    s, b = tables(spark, mols)
    seen = []
    before = stereoforms.certificates
    stereoforms.certificates = lambda colour, tie: seen.append(colour.select("mol_id", "tag").distinct().groupBy("mol_id").count().collect()) or before(colour, tie)
    try:
        got = {r.mol_id: r for r in stereoforms.forms(s, b, spark.createDataFrame([(1, 0, 1, TETRAHEDRAL, [2, 3, 4, 5])], "mol_id long, locus_kind int, locus_id long, kind int, neighbors array<long>")).collect()}
    finally:
        stereoforms.certificates = before
    assert {r["mol_id"]: r["count"] for r in seen[0]} == {1: 3, 2: 1, 3: 1}
    assert got[1].configured != got[1].mirror
    assert all(got[m].constitution == got[m].configured == got[m].mirror for m in (2, 3))
    isomers = stereoforms.stereoisomers(s, b, spark.createDataFrame([(1, 1, TETRAHEDRAL)], "mol_id long, site_id long, geometry int")).collect()
    assert sorted((r.mol_id, r.locus_id) for r in isomers if r.mol_id == 1) == [(1, 1), (1, 1)]
    assert [(r.mol_id, r.isomer, r.locus_id, r.neighbors) for r in isomers if r.mol_id > 1] in ([(2, 0, None, None), (3, 0, None, None)], [(3, 0, None, None), (2, 0, None, None)])
