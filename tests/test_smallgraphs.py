"""Small graphs as rows of arrays give what joins give, and what one can see at a glance."""

from __future__ import annotations

import itertools
import random

import pytest

from moltable.operators import smallgraphs, topology


def _graphs(spark):
    rng = random.Random(3)
    sites, bonds = [(9, 10**12)], []
    for mol in range(1, 9):
        n = rng.randint(1, 9)
        ids = rng.sample(range(-20, 90), n)
        sites += [(mol, i) for i in ids]
        near = [p for p in itertools.combinations(ids, 2) if rng.random() < 0.35]
        bonds += [(mol, k, *p, 1) for k, p in enumerate(near)]
    return spark.createDataFrame(sites, "mol_id long, site_id long"), spark.createDataFrame(bonds, "mol_id long, bond_id long, a long, b long, bond_order int")


def _results(s, b):
    ends = s.crossJoin(s.selectExpr("mol_id m", "site_id other")).where("m = mol_id").selectExpr("mol_id", "site_id a", "other b")
    rows = lambda df: sorted(map(str, df.collect()))
    dist = topology.distances(s, b)
    assert rows(topology.paths_between(s, b, ends)) == rows(topology.shortest_paths(dist, b, ends))
    member = topology.ring_membership(b)
    parts = dist.select("mol_id", "a", "b", "d"), topology.distances(s, b, 2).select("mol_id", "a", "b", "d"), topology.components(s, b), topology.paths_between(s, b, ends), topology.framework(s, b, member), topology.metrics(s, dist)
    return [rows(p) for p in parts]


@pytest.mark.parametrize("packed", [0, 5])
def test_rows_of_arrays_and_joins_agree(spark, monkeypatch, packed):
    s, b = _graphs(spark)
    small = _results(s, b)
    assert all(small)
    monkeypatch.setattr(smallgraphs, "PACKED", packed)
    assert _results(s, b) == small


def test_all_shortest_paths_and_parts(spark, monkeypatch):
    """A ring of four with a tail, cut into pieces of a few rows; a site that is not there has no path."""
    monkeypatch.setattr(smallgraphs, "HELD", 2)
    s = spark.createDataFrame([(1, i) for i in range(1, 7)], "mol_id long, site_id long")
    b = spark.createDataFrame([(1, k, *p, 1) for k, p in enumerate([(1, 2), (2, 3), (3, 4), (4, 1), (3, 5)])], "mol_id long, bond_id long, a long, b long, bond_order int")
    ends = spark.createDataFrame([(1, 1, 5), (1, 6, 6), (1, 1, 6), (1, 1, 7), (2, 1, 1)], "mol_id long, a long, b long")
    got = sorted(tuple(r.path) for r in topology.paths_between(s, b, ends).collect())
    assert got == [(1, 2, 3, 5), (1, 4, 3, 5), (6,)]
    assert sorted((r.site_id, r.component) for r in topology.components(s, b).collect()) == [(1, 1), (2, 1), (3, 1), (4, 1), (5, 1), (6, 6)]
