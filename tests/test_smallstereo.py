"""Stereochemistry of molecules as rows of arrays against the rounds by joins, and what it costs the driver."""

from __future__ import annotations

import random

import pytest
from conftest import SF
from test_stereo import OCTAHEDRAL, TETRAHEDRAL, butene, configs, cumulene, pair, shapes, tables, triple

from moltable.operators import frames, rotations, stereoforms
from moltable.plans import stereo_queries

RINGS = ([6] * 6 + [1, 9, 1, 9], [(1, 2, 1), (2, 3, 1), (3, 4, 1), (4, 5, 1), (5, 6, 1), (6, 1, 1), (1, 7, 1), (1, 8, 1), (4, 9, 1), (4, 10, 1)])


def molecules(n: int) -> dict:
    """Named molecules, and random ones of many double bonds with some unbound sites."""
    rng = random.Random(9)
    out = {1: pair(), 2: triple(), 3: butene(), 4: cumulene(2), 5: cumulene(3), 6: ([26] + [8] * 4 + [7] * 2, [(1, i, 1) for i in range(2, 8)]), 7: RINGS, 8: ([6, 6], []), 9: ([6] * 4, [(1, 2, 2), (2, 3, 2), (3, 4, 2), (4, 1, 2)])}
    for m in range(10, 10 + n):
        k = rng.randrange(5, 12)
        ends = [(rng.randrange(1, i), i) for i in range(2, k + 1)] + [(a, b) for a in range(1, k + 1) for b in range(a + 1, k + 1) if rng.random() < 0.06]
        out[m] = ([rng.choice([1, 6, 6, 8]) for _ in range(k + rng.randrange(2))], [(*e, rng.choice([1, 1, 2])) for e in sorted(set(ends))])
    return out


def rows(df):
    return sorted((tuple(tuple(v) if isinstance(v, list) else v for v in r) for r in df.collect()), key=repr)


def geometry(spark, mols):
    degree = {}
    for m, (_, bonds) in mols.items():
        for a, b, _ in bonds:
            for i in (a, b):
                degree[m, i] = degree.get((m, i), 0) + 1
    return shapes(spark, [(*at, {3: 3, 4: TETRAHEDRAL, 5: 9, 6: OCTAHEDRAL}[d]) for at, d in degree.items() if 3 <= d <= 6])


def test_rows_of_arrays_give_what_joins_give(spark):
    mols = molecules(40)
    (s, b), geo = tables(spark, mols), geometry(spark, mols)
    frame = rows(frames.frames(s, b))
    assert frame == rows(frames.frames(s, b, packed=0)) and {r[1] for r in frame} == {0, 1, 2}
    own = frames.kinds_of(frames.frames(s, b), geo).collect()
    rng = random.Random(4)
    said = [(r.mol_id, r.locus_kind, r.locus_id, r.kind, rng.sample(r.neighbors, len(r.neighbors)) if r.kind < rotations.BOND else r.neighbors) for r in own if rng.random() < 0.7]
    said.append((8, 0, 1, TETRAHEDRAL, [2, 97, 98, 99]))  # neighbours that are no sites say nothing
    said = configs(spark, said)
    for declared in (None, said):
        got = rows(stereoforms.stereocenters(s, b, geo, declared))
        assert got and got == rows(stereoforms.stereocenters(s, b, geo, declared, packed=0))
    form = rows(stereoforms.forms(s, b, said))
    assert form == rows(stereoforms.forms(s, b, said, packed=6)) == rows(stereoforms.forms(s, b, said, packed=0))
    assert any(r[3] != r[4] for r in form)


def test_isomers_of_rows_are_those_of_joins(spark):
    mols = molecules(6)
    (s, b), geo = tables(spark, mols), geometry(spark, mols)
    got = rows(stereoforms.stereoisomers(s, b, geo))
    assert got == rows(stereoforms.stereoisomers(s, b, geo, packed=6))


def test_many_isomers_are_given_out_in_pieces(spark, monkeypatch):
    """A chain of ten unlike centres: 1,024 isomers of one molecule, 64 sites or so at a time."""
    from moltable.operators import smallstereo

    n = 10
    z = [6] * n + [9, 17, 35, 1] + [1, 8] * (n - 2) + [53, 7]
    side = [(i, n + 4 + 2 * (i - 2) + k, 1) for i in range(2, n) for k in (1, 2)]
    bonds = [(i, i + 1, 1) for i in range(1, n)] + [(1, n + 1, 1), (1, n + 2, 1), (1, n + 4, 1), (n, n + 3, 1), (n, len(z) - 1, 1), (n, len(z), 1)] + side
    mols = {1: (z, bonds)}
    (s, b), geo = tables(spark, mols), geometry(spark, mols)
    counts = []
    for held in (64, smallstereo.HELD):
        monkeypatch.setattr(smallstereo, "HELD", held)
        counts.append(stereoforms.stereoisomers(s, b, geo).select("isomer").distinct().count())
    assert counts == [1024, 1024]


@pytest.mark.parametrize("name", ["stereocenters", "stereo_forms", "stereoisomers"])
def test_stereo_queries_start_few_jobs(spark, name):
    """The driver keeps something of every job and plan: rounds of molecules run in tasks, not as jobs of their own."""
    spark.sparkContext.setJobGroup(name, name)
    try:
        rows = stereo_queries.QUERIES[name](spark, SF).count()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert rows and len(spark.sparkContext.statusTracker().getJobIdsForGroup(name)) < 60
