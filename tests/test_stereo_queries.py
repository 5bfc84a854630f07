"""The registered queries of stereochemistry on the smallest tables."""

from __future__ import annotations

from conftest import SF

from moltable.operators import rotations
from moltable.plans import stereo_queries

TETRAHEDRAL = 5


def test_stereo_perceive_without_molecules_given(spark):
    """By the tables' path alone; tetrahedral centres, bonds and axes are as stereo_perceive_four has them."""
    rows = stereo_queries.stereo_perceive(spark, SF).collect()
    four = {(r.mol_id, r.locus_kind, r.locus_id, r.neighbors) for r in stereo_queries.stereo_perceive_four(spark, SF).collect()}
    got = {(r.mol_id, r.locus_kind, r.locus_id, r.neighbors) for r in rows if r.kind == TETRAHEDRAL or r.kind >= rotations.BOND}
    assert got and got <= four
    assert {r for r in got if r[1] > 0} == {r for r in four if r[1] > 0}
    assert len({(r.mol_id, r.locus_kind, r.locus_id) for r in rows}) == len(rows) > len(got)
