"""Stereo kinds, frames, perception, classes, stereogenic loci, forms and isomers: enumeration as brute force, and named molecules."""

from __future__ import annotations

import itertools
import math
import random

import numpy as np
import pytest

from moltable import dims
from moltable.operators import frames, rotations, stereo, stereoforms, symmetry
from moltable.operators.coordination import DIRECTIONS

TETRAHEDRAL, SQUARE, OCTAHEDRAL = 5, 6, 11


def tables(spark, mols):
    """Molecules {id: (elements, [(a, b, order)], [xyz] or None)}; sites count from 1."""
    s, b = [], []
    for m, (z, bonds, *xyz) in mols.items():
        at = xyz[0] if xyz else [(0.0, 0.0, 0.0)] * len(z)
        s += [(m, i, e, *map(float, at[i - 1])) for i, e in enumerate(z, 1)]
        b += [(m, k, *x) for k, x in enumerate(bonds, 1)]
    return spark.createDataFrame(s, "mol_id long, site_id long, element int, x double, y double, z double"), spark.createDataFrame(b, "mol_id long, bond_id long, a long, b long, bond_order int")


def shapes(spark, rows):
    return spark.createDataFrame(rows, "mol_id long, site_id long, geometry int")


def configs(spark, rows):
    return spark.createDataFrame([(m, k, i, kind, list(n)) for m, k, i, kind, n in rows], "mol_id long, locus_kind int, locus_id long, kind int, neighbors array<long>")


def test_groups_give_the_numbers_of_configurations():
    for k, (_, _, slots, count) in zip(rotations.kinds(), dims.GEOMETRIES, strict=False):
        assert k.slots == slots and math.factorial(slots) // len(k.group) == count
        assert len(k.admitted(range(slots))) == count
        closed = {tuple(p[i] for i in q) for p in k.group for q in k.group}
        assert closed == set(k.group)
    bond, axis = rotations.kinds()[-2:]
    assert (len(bond.group), bond.chiral, len(bond.admitted(range(4)))) == (4, False, 2)
    assert (len(axis.group), axis.chiral, len(axis.admitted(range(4)))) == (4, True, 2)
    assert [k.kind for k in rotations.kinds() if k.chiral] == [3, 5, 7, 8, 9, 10, 11, 12, 14]


def test_descriptors_and_mirrors_against_enumeration(spark):
    rng = random.Random(3)
    rows = [(n, k.kind, [rng.randint(-5, 2) for _ in range(k.slots)]) for n, k in enumerate(rotations.kinds() * 12)]
    got = rotations.descriptors(spark.createDataFrame(rows, "id int, kind int, ranks array<long>")).collect()
    assert len(got) == len(rows)
    for r in got:
        k = rotations.kinds()[r.kind]
        own = k.descriptor(r.ranks)
        assert tuple(r.descriptor) == own + (0,) * (6 - k.slots)
        assert tuple(r.mirror) == k.descriptor([r.ranks[i] for i in k.mirror]) + (0,) * (6 - k.slots)
        for p in k.group:
            assert k.descriptor([r.ranks[i] for i in p]) == own


def turned(rng):
    q, _ = np.linalg.qr(rng.standard_normal((3, 3)))
    return q * np.sign(np.linalg.det(q))


def test_perceive_every_geometry_turned_shuffled_and_shaken(spark):
    rng, mols, geo, want, mirrored = np.random.default_rng(5), {}, [], {}, {}
    m = 0
    for k in rotations.kinds():
        if k.kind >= rotations.BOND or k.kind < 3:
            continue
        ideal = np.array(DIRECTIONS[dims.GEOMETRIES[k.kind][0]], float)
        ideal /= np.linalg.norm(ideal, axis=1, keepdims=True)
        for flip in (1, -1):
            for _ in range(6):
                m += 1
                order = rng.permutation(k.slots)
                spot = (ideal @ turned(rng).T) * flip * rng.uniform(0.8, 1.6, (k.slots, 1)) + rng.normal(0, 0.03, (k.slots, 3))
                xyz = np.zeros((k.slots + 1, 3))
                xyz[1 + order] = spot
                mols[m] = ([6] + [1] * k.slots, [(1, int(i) + 2, 1) for i in range(k.slots)], xyz.tolist())
                geo.append((m, 1, k.kind))
                sites = [int(i) + 2 for i in order]
                sites = sites if flip > 0 else [sites[i] for i in k.mirror]
                want[m] = min([sites[i] for i in p] for p in k.group)
                mirrored[m] = min([[sites[i] for i in k.mirror][i] for i in p] for p in k.group)
    got = {r.mol_id: r for r in frames.perceive(*tables(spark, mols), shapes(spark, geo)).collect()}
    assert {i: r.neighbors for i, r in got.items()} == want
    assert all((want[i] != mirrored[i]) == rotations.kinds()[k].chiral for i, _, k in geo)


def test_perceive_leaves_out_flat_and_coinciding(spark):
    flat = [(0, 0, 0), (1, 0, 0), (0, 1, 0), (-1, 0, 0), (0, -1, 0)]
    both = [(0, 0, 0), (0, 0, 0), (0, 1, 0), (-1, 0, 0), (0, -1, 0)]
    star = [(1, i, 1) for i in range(2, 6)]
    mols = {1: ([6, 1, 1, 1, 1], star, flat), 2: ([6, 1, 1, 1, 1], star, both), 3: ([6, 1, 1, 1, 1], star, flat), 4: ([6], [])}
    got = frames.perceive(*tables(spark, mols), shapes(spark, [(1, 1, TETRAHEDRAL), (2, 1, TETRAHEDRAL), (3, 1, SQUARE), (4, 1, TETRAHEDRAL), (3, 2, TETRAHEDRAL)])).collect()
    assert [(r.mol_id, r.kind, r.neighbors) for r in got] == [(3, SQUARE, [2, 3, 4, 5])]


def cumulene(n, twist=None, extra=0):
    """n double bonds in a row between sites 5 and 5 + n, neighbours 1, 2 and 3, 4; the second pair turned by twist."""
    z = [9, 1, 17, 35] + [6] * (n + 1)
    bonds = [(5, 1, 1), (5, 2, 1), (5 + n, 3, 1), (5 + n, 4, 1)] + [(5 + k, 6 + k, 2) for k in range(n)]
    if twist is None:
        return z, bonds
    c, s = math.cos(twist), math.sin(twist)
    xyz = [(-0.5, 1, 0), (-0.5, -1, 0), (n + 0.5, c, s), (n + 0.5, -c, -s)] + [(k, 0, 0) for k in range(n + 1)]
    return z, bonds, xyz


def test_frames_of_cumulenes_rings_and_branches(spark):
    mols = {n: cumulene(n) for n in range(1, 10)}
    mols[20] = ([6] * 3, [(1, 2, 2), (2, 3, 2), (3, 1, 2)])  # a ring of double bonds has no ends
    mols[21] = ([6] * 8, [(1, 2, 2), (2, 3, 2), (2, 4, 2), (1, 5, 1), (1, 6, 1), (3, 7, 1), (3, 8, 1)])  # a branched chain
    mols[22] = ([6] * 5, [(1, 2, 2), (1, 3, 1), (1, 4, 1), (2, 3, 1), (2, 5, 1)])  # one site at both ends
    mols[23] = ([6] * 5, [(1, 2, 2), (1, 3, 1), (2, 4, 1), (2, 5, 1)])  # an end of one neighbour
    got = {r.mol_id: r for r in frames.frames(*tables(spark, mols)).where("locus_kind > 0").collect()}
    assert sorted(got) == list(range(1, 10))
    for n, r in got.items():
        assert (r.anchors, r.neighbors) == ([5, 5 + n], [1, 2, 3, 4])
        assert (r.locus_kind, r.locus_id) == ((1, 4 + (n + 1) // 2) if n % 2 else (2, 5 + n // 2))


def test_perceive_double_bonds_and_axes(spark):
    mols, want = {}, {}
    for n in range(1, 6):
        for j, twist in enumerate([0.1, math.pi - 0.1, math.pi / 2 + 0.2, -math.pi / 2 + 0.1]):
            m = 10 * n + j
            mols[m] = cumulene(n, twist)
            same = math.cos(twist) > 0 if n % 2 else math.sin(twist) > 0
            k = rotations.kinds()[rotations.BOND if n % 2 else rotations.AXIS]
            sites = [1, 2, 3, 4] if same else [1, 2, 4, 3]
            want[m] = min([sites[i] for i in p] for p in k.group)
    mols[90], mols[91] = cumulene(1, math.pi / 2), cumulene(2, 0)
    got = {r.mol_id: r.neighbors for r in frames.perceive(*tables(spark, mols), shapes(spark, [])).collect()}
    assert got == want


def automorphic(z, bonds):
    """Least site of each orbit, by all permutations."""
    n = len(z)
    edge = {frozenset((a, b)): o for a, b, o in bonds}
    least = list(range(1, n + 1))
    for p in itertools.permutations(range(1, n + 1)):
        if all(z[p[i] - 1] == z[i] for i in range(n)) and all(edge.get(frozenset((p[a - 1], p[b - 1]))) == o for a, b, o in bonds):
            for i in range(n):
                least[p[i] - 1] = min(least[p[i] - 1], i + 1)
    return least


def test_orbits_against_all_permutations(spark):
    rng = random.Random(8)
    mols = {}
    for m in range(60):
        n = rng.randint(1, 6)
        z = [rng.choice([6, 6, 6, 7]) for _ in range(n)]
        mols[m] = (z, [(a, b, rng.choice([1, 1, 2])) for a, b in itertools.combinations(range(1, n + 1), 2) if rng.random() < 0.5])
    ring = lambda n, at=0: [(at + i, at + i % n + 1, 1) for i in range(1, n + 1)]
    mols[100] = ([6] * 6, ring(6))
    mols[101] = ([6] * 6, ring(3) + ring(3, 3) + [(1, 4, 1)])  # two triangles joined, beside a ladder and a hexagon
    mols[102] = ([6] * 6, [(a, b, 1) for a, b in [(1, 2), (2, 3), (3, 1), (4, 5), (5, 6), (6, 4), (1, 4), (2, 5), (3, 6)]])
    mols[103] = ([6] * 6, [(a, b, 1) for a in (1, 2, 3) for b in (4, 5, 6)])
    mols[104] = ([6] * 7, ring(3) + ring(4, 3))  # regular, in two parts: refinement alone sees one class
    got = {}
    for r in symmetry.orbits(*tables(spark, mols)).collect():
        got.setdefault(r.mol_id, {})[r.site_id] = r.orbit
    for m, (z, bonds) in mols.items():
        assert [got[m][i] for i in range(1, len(z) + 1)] == automorphic(z, bonds), m


def star(*, more=(), bonds=()):
    """Site 1 with neighbours 2 to 5."""
    return [6, *more], [(1, i, 1) for i in range(2, 6)] + list(bonds)


def pair(swap=False):
    """Two like centres 1 and 2, each with H, O and C: 3 4 5 at the first, 6 7 8 at the second."""
    return [6, 6, 1, 8, 7, 1, 8, 7], [(1, 2, 1), (1, 3, 1), (1, 4, 1), (1, 5, 1), (2, 6, 1), (2, 7, 1), (2, 8, 1)]


def triple():
    """A centre 2 between the like centres 1 and 3; 2 has H (4) and O (5), the others H, O, N each."""
    return [6, 6, 6, 1, 8, 1, 8, 7, 1, 8, 7], [(1, 2, 1), (2, 3, 1), (2, 4, 1), (2, 5, 1), (1, 6, 1), (1, 7, 1), (1, 8, 1), (3, 9, 1), (3, 10, 1), (3, 11, 1)]


def butene():
    """1 and 2 double, 3 (C) and 4 (H) at the first, 5 (C) and 6 (H) at the second."""
    return [6, 6, 6, 1, 6, 1], [(1, 2, 2), (1, 3, 1), (1, 4, 1), (2, 5, 1), (2, 6, 1)]


def test_stereogenic_loci(spark):
    four, oct_, t = (6, 1, 9, 17, 35), OCTAHEDRAL, TETRAHEDRAL
    spokes = lambda n: [(1, i, 1) for i in range(2, n + 2)]
    ring = [(1, 2, 1), (2, 3, 1), (3, 4, 1), (4, 5, 1), (5, 6, 1), (6, 1, 1), (1, 7, 1), (1, 8, 1), (4, 9, 1), (4, 10, 1)]
    mols = {
        1: (list(four), spokes(4)), 2: ([6, 1, 1, 17, 35], spokes(4)), 3: (list(four), spokes(4)), 4: ([6, 1, 9, 17], spokes(3)), 5: butene(),
        6: ([6, 6, 6, 1, 1, 1], butene()[1]), 7: cumulene(2), 8: ([26] + [8] * 4 + [7] * 2, spokes(6)), 9: ([26] + [8] * 5 + [7], spokes(6)), 10: pair(), 11: triple(), 12: triple(), 13: triple(),
        14: ([6] * 6 + [1, 9, 1, 9], ring), 15: ([6] * 6 + [1, 9, 1, 9], ring), 16: ([6] * 6 + [1, 9, 1, 9], ring), 17: cumulene(3), 18: ([6], []),
    }
    geo = [(m, 1, t) for m in (1, 2, 4, 18)] + [(8, 1, oct_), (9, 1, oct_), (10, 1, t), (10, 2, t)] + [(m, i, t) for m in (11, 12, 13) for i in (1, 2, 3)] + [(m, i, t) for m in (14, 15, 16) for i in (1, 4)]
    declared = [
        (12, 0, 1, t, [2, 6, 7, 8]), (12, 0, 3, t, [2, 10, 9, 11]),  # unlike ends: the middle one counts
        (13, 0, 1, t, [2, 6, 7, 8]), (13, 0, 3, t, [2, 9, 10, 11]),  # like ends: it does not
        (15, 0, 1, t, [2, 6, 7, 8]),
    ]
    got = {}
    for r in stereoforms.stereocenters(*tables(spark, mols), shapes(spark, geo), configs(spark, declared)).collect():
        got.setdefault(r.mol_id, set()).add((r.locus_kind, r.locus_id))
    centre = lambda *i: {(0, k) for k in i}
    assert got == {1: centre(1), 5: {(1, 1)}, 7: {(2, 6)}, 8: centre(1), 10: centre(1, 2), 11: centre(1, 3), 12: centre(1, 2, 3), 13: centre(1, 3), 17: {(1, 6)}}
    alone = stereoforms.stereocenters(*tables(spark, {1: mols[1]}), shapes(spark, geo[:1])).collect()
    assert [(r.mol_id, r.locus_kind, r.locus_id, r.kind) for r in alone] == [(1, 0, 1, t)]
    found = {(r.mol_id, r.locus_id, r.finding) for r in stereoforms.consistency(*tables(spark, {12: mols[12], 2: mols[2]}), shapes(spark, geo), configs(spark, declared[:2] + [(2, 0, 1, t, [2, 3, 4, 5])])).collect()}
    assert found == {(12, 2, "unspecified"), (2, 1, "overspecified")}


def renumbered(mol, rows, rng):
    z, bonds = mol
    p = list(range(1, len(z) + 1))
    rng.shuffle(p)
    new = [0] * len(z)
    for i, e in enumerate(z):
        new[p[i] - 1] = e
    order = list(range(len(bonds)))
    rng.shuffle(order)
    swap = [bonds[i] if rng.random() < 0.5 else (bonds[i][1], bonds[i][0], bonds[i][2]) for i in order]
    at = {old + 1: k + 1 for k, old in enumerate(order)}
    return (new, [(p[a - 1], p[b - 1], o) for a, b, o in swap]), [(k, at[i] if k == 1 else p[i - 1], kind, [p[x - 1] for x in n]) for k, i, kind, n in rows]


def test_forms_relations_and_chirality(spark):
    t, b, x = TETRAHEDRAL, rotations.BOND, rotations.AXIS
    one = ([6, 1, 9, 17, 35], [(1, i, 1) for i in range(2, 6)])
    two_rings = ([6] * 6 + [1, 9, 1, 9], [(1, 2, 1), (2, 3, 1), (3, 4, 1), (4, 5, 1), (5, 6, 1), (6, 1, 1), (1, 7, 1), (1, 8, 1), (4, 9, 1), (4, 10, 1)])
    mid = lambda a, m, c: [(0, 1, t, a), (0, 2, t, m), (0, 3, t, c)]
    ends = ([2, 6, 7, 8], [2, 9, 10, 11], [2, 10, 9, 11])
    cases = {
        "plain": (one, []), "right": (one, [(0, 1, t, [2, 3, 4, 5])]), "left": (one, [(0, 1, t, [3, 2, 4, 5])]),
        "other": (([6, 1, 9, 17, 53], one[1]), [(0, 1, t, [2, 3, 4, 5])]),
        "homo": (pair(), [(0, 1, t, [2, 3, 4, 5]), (0, 2, t, [1, 6, 7, 8])]), "homo2": (pair(), [(0, 1, t, [3, 2, 4, 5]), (0, 2, t, [6, 1, 7, 8])]), "meso": (pair(), [(0, 1, t, [2, 3, 4, 5]), (0, 2, t, [6, 1, 7, 8])]),
        "cis": (butene(), [(1, 1, b, [3, 4, 5, 6])]), "trans": (butene(), [(1, 1, b, [3, 4, 6, 5])]),
        "allene": (cumulene(2), [(2, 6, x, [1, 2, 3, 4])]), "allene2": (cumulene(2), [(2, 6, x, [2, 1, 3, 4])]),
        "r": (triple(), mid(ends[0], [1, 3, 4, 5], ends[2])), "s": (triple(), mid(ends[0], [3, 1, 4, 5], ends[2])),
        "dormant": (triple(), mid(ends[0], [1, 3, 4, 5], ends[1])), "dormant2": (triple(), mid(ends[0], [3, 1, 4, 5], ends[1])),
        "ring": (two_rings, [(0, 1, t, [2, 6, 7, 8]), (0, 4, t, [3, 5, 9, 10])]),
    }
    rng, mols, rows, name = random.Random(6), {}, [], {}
    for m, (key, (mol, conf)) in enumerate(cases.items()):
        for copy in range(2):
            got, own = (mol, conf) if not copy else renumbered(mol, conf, rng)
            mols[2 * m + copy], name[2 * m + copy] = got, (key, copy)
            rows += [(2 * m + copy, *c) for c in own]
    form = {name[r.mol_id]: r for r in stereoforms.forms(*tables(spark, mols), configs(spark, rows)).collect()}
    assert len(form) == 2 * len(cases)
    for key in cases:
        a, c = form[key, 0], form[key, 1]
        assert (a.constitution, a.configured, a.mirror) == (c.constitution, c.configured, c.mirror), key
    chiral = {k for k in cases if form[k, 0].configured != form[k, 0].mirror}
    assert chiral == {"right", "left", "other", "homo", "homo2", "allene", "allene2", "dormant", "dormant2"}
    flat = spark.createDataFrame([(k, r.constitution, r.configured, r.mirror) for (k, c), r in form.items() if not c], "mol_id string, constitution string, configured string, mirror string")
    pairs = [("right", "right"), ("right", "left"), ("homo", "homo2"), ("homo", "meso"), ("cis", "trans"), ("right", "other"), ("allene", "allene2"), ("r", "s"), ("dormant", "dormant2"), ("right", "plain")]
    told = {(r.a, r.b): r.relation for r in stereo.relate(spark.createDataFrame(pairs, "a string, b string"), flat).collect()}
    assert [told[p] for p in pairs] == ["Identical", "Enantiomers", "Enantiomers", "Diastereomers", "Diastereomers", "Unrelated", "Enantiomers", "Diastereomers", "Identical", "Diastereomers"]


def test_numbers_of_stereoisomers(spark):
    t = TETRAHEDRAL
    mols = {1: ([6, 1, 9, 17, 35], [(1, i, 1) for i in range(2, 6)]), 2: pair(), 3: triple(), 4: butene(), 5: cumulene(2), 6: ([26] + [8] * 4 + [7] * 2, [(1, i, 1) for i in range(2, 8)]), 7: ([6, 1, 1, 1, 1], [(1, i, 1) for i in range(2, 6)]), 8: ([6, 6], [])}
    geo = [(1, 1, t), (2, 1, t), (2, 2, t), *((3, i, t) for i in (1, 2, 3)), (6, 1, OCTAHEDRAL), (7, 1, t)]
    got = {}
    for r in stereoforms.stereoisomers(*tables(spark, mols), shapes(spark, geo)).collect():
        got.setdefault(r.mol_id, {}).setdefault(r.isomer, []).append((r.locus_kind, r.locus_id))
    assert {m: len(i) for m, i in got.items()} == {1: 2, 2: 3, 3: 4, 4: 2, 5: 2, 6: 2, 7: 1, 8: 1}
    assert sorted(len(x) for x in got[3].values()) == [2, 2, 3, 3]
    assert list(got[7].values()) == [[(None, None)]]


def test_rounds_by_joins_give_the_colours_of_packed_rounds(spark):
    mols = {1: triple(), 2: ([6] * 6, [(1, 2, 1), (2, 3, 1), (3, 1, 1), (4, 5, 1), (5, 6, 1), (6, 4, 1), (1, 4, 1)]), 3: cumulene(3), 4: ([6, 6, 6], []), 5: ([6] * 7, [(i, i + 1, 1) for i in range(1, 7)])}
    s, b = tables(spark, mols)
    rows = lambda packed: sorted(map(tuple, symmetry.stable(symmetry.colours(s), symmetry.ties(s, b, packed=packed)).select("mol_id", "site_id", "colour").collect()))
    assert rows(1000) == rows(0) == rows(6)
