"""Named molecules, laws, order invariance, and the SQL equivalents on the smallest tables."""

from __future__ import annotations

import itertools
import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from moltable import dims
from moltable.functions import scalar, tensor
from moltable.functions.hashing import combine, mix, resolved, unsigned_mod
from moltable.operators import conjugation, fingerprint, geometry, isomorphism, kernels, lattice, notation, topology, valence
from moltable.sources import xyz

SF = "/root/testdata/sf0.001"
CUBE = [(1, 2), (2, 3), (3, 4), (4, 1), (5, 6), (6, 7), (7, 8), (8, 5), (1, 5), (2, 6), (3, 7), (4, 8)]
GRAPHS = {  # sites, bonds, cycle rank, sizes of ring families
    "single": (1, [], 0, []),
    "chain": (3, [(1, 2), (2, 3)], 0, []),
    "triangle": (3, [(1, 2), (2, 3), (1, 3)], 1, [3]),
    "tadpole": (4, [(1, 2), (2, 3), (1, 3), (1, 4)], 1, [3]),
    "fused": (6, [(1, 2), (2, 3), (3, 4), (1, 4), (3, 5), (5, 6), (4, 6)], 2, [4, 4]),
    "spiro": (5, [(1, 2), (2, 3), (1, 3), (3, 4), (4, 5), (3, 5)], 2, [3, 3]),
    "two_triangles": (6, [(1, 2), (2, 3), (1, 3), (4, 5), (5, 6), (4, 6)], 2, [3, 3]),
    "bridged_square": (6, [(1, 2), (2, 3), (3, 4), (1, 4), (2, 5), (5, 6), (4, 6)], 2, [4, 5]),
    "k4": (4, [(1, 2), (1, 3), (1, 4), (2, 3), (2, 4), (3, 4)], 3, [3, 3, 3, 3]),
    "cube": (8, CUBE, 5, [4] * 6),
    "bicyclo222": (8, [(1, 3), (3, 4), (4, 2), (1, 5), (5, 6), (6, 2), (1, 7), (7, 8), (8, 2)], 2, [6, 6, 6]),
}


def tables(spark, mols, shuffle=None):
    """mols: {mol_id: ([(site, symbol, charge, radicals)], [(a, b, order)])}."""
    z = {s: i + 1 for i, s in enumerate(dims.SYMBOLS)}
    s = [(m, i, z[e], q, r) for m, (atoms, _) in mols.items() for i, e, q, r in atoms]
    b = [(m, k, x, y, o) for m, (_, bonds) in mols.items() for k, (x, y, o) in enumerate(bonds, 1)]
    if shuffle:
        random.Random(shuffle).shuffle(s)
        random.Random(shuffle).shuffle(b)
    return spark.createDataFrame(s, "mol_id long, site_id long, element int, formal_charge int, radical_electrons int"), spark.createDataFrame(b, "mol_id long, bond_id long, a long, b long, bond_order int")


def graphs(spark, shuffle=None):
    return tables(spark, {k: ([(i, "C", 0, 0) for i in range(1, n + 1)], [(a, b, 1) for a, b in bonds]) for k, (n, bonds, _, _) in enumerate(GRAPHS.values())}, shuffle)


@pytest.mark.parametrize("shuffle", [None, 5])
def test_rings_of_named_graphs(spark, shuffle):
    s, b = graphs(spark, shuffle)
    mols = kernels.packed(s, b)
    ring = kernels.rings(mols)
    count = {r.mol_id: r.n for r in ring.groupBy("mol_id").agg(F.count("*").alias("n")).collect()}
    fam: dict[int, list[int]] = {}
    for r in kernels.ring_families(mols).collect():
        fam.setdefault(r.mol_id, []).append(r.size)
    rank = {r.mol_id: r.cycle_rank for r in topology.cycle_rank(s, b, topology.components(s, b)).collect()}
    for k, (_, _, want, sizes) in enumerate(GRAPHS.values()):
        assert (count.get(k, 0), rank[k], sorted(fam.get(k, []))) == (want, want, sizes), list(GRAPHS)[k]
    name = list(GRAPHS).index
    heads = {(r.mol_id, r.site_id) for r in kernels.bridgeheads(ring, b).collect()}
    assert {x for m, x in heads if m == name("bicyclo222")} == {1, 2}
    system = {(r.mol_id, r.system) for r in kernels.ring_systems(ring).collect()}
    assert len([1 for m, _ in system if m == name("two_triangles")]) == 2 and len([1 for m, _ in system if m == name("spiro")]) == 1
    orbit = {(r.mol_id, r.orbit) for r in kernels.orbits(mols).collect()}
    assert len([1 for m, _ in orbit if m == name("cube")]) == 1 and len([1 for m, _ in orbit if m == name("tadpole")]) == 3


def test_blocks_cuts_and_framework(spark):
    s, b = graphs(spark)
    member = topology.ring_membership(b)
    block = topology.blocks(b)
    name = list(GRAPHS).index
    count = {r.mol_id: r.n for r in block.groupBy("mol_id").agg(F.countDistinct("block").alias("n")).collect()}
    assert (count[name("fused")], count[name("spiro")], count[name("tadpole")], count[name("chain")]) == (1, 2, 2, 2)
    cuts = {(r.mol_id, r.site_id) for r in topology.cut_sites(b, block).collect()}
    assert cuts == {(name("chain"), 2), (name("tadpole"), 1), (name("spiro"), 3)}
    role = {(r.mol_id, r.site_id): r.role for r in topology.framework(s, b, member).collect()}
    assert role[(name("tadpole"), 4)] == "SideChain" and role[(name("tadpole"), 1)] == "Ring"


def ring_of(n, orders, atoms=None):
    atoms = atoms or ["C"] * n
    return [(i + 1, e, 0, 0) for i, e in enumerate(atoms)], [(i + 1, (i + 1) % n + 1, o) for i, o in enumerate(orders)]


def with_hydrogens(atoms, bonds, on):
    atoms, bonds = list(atoms), list(bonds)
    for i in on:
        atoms.append((len(atoms) + 1, "H", 0, 0))
        bonds.append((i, len(atoms), 1))
    return atoms, bonds


def test_aromaticity_of_named_molecules(spark):
    benzene = with_hydrogens(*ring_of(6, [1, 2] * 3), range(1, 7))
    pyridine = with_hydrogens(*ring_of(6, [1, 2] * 3, ["N"] + ["C"] * 5), range(2, 7))
    pyrrole = with_hydrogens(*ring_of(5, [1, 2, 1, 2, 1], ["N"] + ["C"] * 4), range(1, 6))
    cyclobutadiene = with_hydrogens(*ring_of(4, [1, 2, 1, 2]), range(1, 5))
    cyclohexane = with_hydrogens(*ring_of(6, [1] * 6), [*range(1, 7)] * 2)
    tropone_atoms, tropone_bonds = ring_of(7, [1, 2, 1, 2, 1, 2, 1])
    tropone = with_hydrogens([*tropone_atoms, (8, "O", 0, 0)], [*tropone_bonds, (1, 8, 2)], range(2, 8))
    naphthalene = ([(i, "C", 0, 0) for i in range(1, 11)], [(1, 2, 2), (2, 3, 1), (3, 4, 2), (4, 5, 1), (5, 6, 2), (6, 1, 1), (5, 7, 1), (7, 8, 2), (8, 9, 1), (9, 10, 2), (10, 6, 1)])
    naphthalene = with_hydrogens(*naphthalene, [1, 2, 3, 4, 7, 8, 9, 10])
    s, b = tables(spark, dict(enumerate([benzene, pyridine, pyrrole, cyclobutadiene, cyclohexane, tropone, naphthalene])))
    got: dict[int, set[int]] = {}
    for r in kernels.aromatic_bonds(kernels.packed(s, b, "element", "formal_charge", "radical_electrons")).collect():
        got.setdefault(r.mol_id, set()).add(r.bond_id)
    assert got == {0: {1, 2, 3, 4, 5, 6}, 1: {1, 2, 3, 4, 5, 6}, 2: {1, 2, 3, 4, 5}, 5: {1, 2, 3, 4, 5, 6, 7}, 6: set(range(1, 12))}


def test_conjugated_systems(spark):
    """Sites, bonds and electrons of the systems of named molecules, and the pairs that sites donate."""
    chain = lambda symbols, orders: ([(i, *a) for i, a in enumerate(symbols, 1)], [(i, i + 1, o) for i, o in enumerate(orders, 1)])
    c = ("C", 0, 0)
    aromatic = ring_of(6, [7] * 6)
    mols = {
        "ethylene": with_hydrogens(*chain([c] * 2, [2]), [1, 1, 2, 2]),
        "butadiene": with_hydrogens(*chain([c] * 4, [2, 1, 2]), [1, 1, 2, 3, 4, 4]),
        "pentadiene": with_hydrogens(*chain([c] * 5, [2, 1, 1, 2]), [1, 1, 2, 3, 3, 4, 5, 5]),
        "radical": with_hydrogens(*chain([c, c, ("C", 0, 1)], [2, 1]), [1, 1, 2, 3, 3]),
        "cation": with_hydrogens(*chain([c, c, ("C", 1, 0)], [2, 1]), [1, 1, 2, 3, 3]),
        "carboxylate": with_hydrogens(*chain([("O", 0, 0), c, ("O", -1, 0)], [2, 1]), [2]),
        "hydrazine": with_hydrogens(*chain([("N", 0, 0)] * 2, [1]), [1, 1, 2, 2]),
        "allene": with_hydrogens(*chain([c] * 3, [2, 2]), [1, 1, 3, 3]),
        "butatriene": with_hydrogens(*chain([c] * 4, [2, 2, 2]), [1, 1, 4, 4]),
        "pentatetraene": with_hydrogens(*chain([c] * 5, [2, 2, 2, 2]), [1, 1, 5, 5]),
        "vinylacetylene": with_hydrogens(*chain([c] * 4, [2, 1, 3]), [1, 1, 2, 4]),
        "diacetylene": with_hydrogens(*chain([c] * 4, [3, 1, 3]), [1, 4]),
        "azide": chain([("N", -1, 0), ("N", 1, 0), ("N", -1, 0)], [2, 2]),
        "nitrile": with_hydrogens(*chain([c, c, c, ("N", 0, 0)], [2, 1, 3]), [1, 1, 2]),
        "cumulated ring": ring_of(3, [2, 2, 2]),
        "benzene": with_hydrogens(*aromatic, range(1, 7)),
        "aniline": with_hydrogens(aromatic[0] + [(7, "N", 0, 0)], aromatic[1] + [(6, 7, 1)], [1, 2, 3, 4, 5, 7, 7]),
        "iron": with_hydrogens(*chain([("Fe", 0, 0), c, c], [1, 2]), [2, 3, 3]),
    }
    four = (1, 2, 3, 4)
    expected = {
        "butadiene": [(four, (1, 2, 3), 4)], "radical": [((1, 2, 3), (1, 2), 3)], "cation": [((1, 2, 3), (1, 2), 2)], "carboxylate": [((1, 2, 3), (1, 2), 4)],
        "butatriene": [(four, (1, 2, 3), 4)], "pentatetraene": [(four, (1, 2, 3), 4), ((2, 3, 4, 5), (2, 3, 4), 4)], "vinylacetylene": [(four, (1, 2, 3), 4)],
        "diacetylene": [(four, (1, 2, 3), 4)] * 2, "azide": [((1, 2, 3), (1, 2), 4)] * 2, "nitrile": [(four, (1, 2, 3), 4)], "cumulated ring": [((1, 2, 3), (1, 2, 3), 6)],
        "benzene": [((1, 2, 3, 4, 5, 6), (1, 2, 3, 4, 5, 6), None)], "aniline": [((1, 2, 3, 4, 5, 6, 7), (1, 2, 3, 4, 5, 6, 7), None)],
    }
    for shuffle in (None, 3):
        s, b = tables(spark, dict(enumerate(mols.values())), shuffle)
        got = conjugation.perceive(s, b)
        at: dict[tuple, list] = {}
        for r in conjugation.members(got).collect():
            at.setdefault((r.mol_id, r.system), []).append(r.site_id)
        inside: dict[tuple, list] = {}
        for r in conjugation.system_bonds(got, b).collect():
            inside.setdefault((r.mol_id, r.system), []).append(r.bond_id)
        found: dict[str, list] = {}
        for r in conjugation.systems(got).collect():
            key = (r.mol_id, r.system)
            assert r.site_count == len(at[key])
            found.setdefault(list(mols)[r.mol_id], []).append((tuple(sorted(at[key])), tuple(sorted(inside[key])), r.pi_electrons))
        assert {k: sorted(v, key=str) for k, v in found.items()} == expected
        given = {(list(mols)[r.mol_id], r.site_id): r.pairs for r in conjugation.donated(got).collect()}
        assert given == {("carboxylate", 3): 1, ("azide", 1): 1, ("azide", 3): 1, ("aniline", 7): 1}
        steric = {(r.mol_id, r.site_id): r.steric_number for r in valence.steric_numbers(s, b, conjugation.donated(got)).collect()}
        assert steric[list(mols).index("carboxylate"), 3] == 3 and steric[list(mols).index("hydrazine"), 1] == 4
    nothing = conjugation.perceive(s.limit(0), b.limit(0))
    assert conjugation.systems(nothing).count() == 0


def test_kekulize(spark):
    benzene = with_hydrogens(*ring_of(6, [7] * 6), range(1, 7))
    naphthalene = ([(i, "C", 0, 0) for i in range(1, 11)], [(a, b, 7) for a, b in [(1, 2), (2, 3), (3, 4), (4, 5), (5, 6), (6, 1), (5, 7), (7, 8), (8, 9), (9, 10), (10, 6)]])
    naphthalene = with_hydrogens(*naphthalene, [1, 2, 3, 4, 7, 8, 9, 10])
    radical = with_hydrogens(*ring_of(5, [7] * 5), range(1, 6))
    s, b = tables(spark, dict(enumerate([benzene, naphthalene, radical])))
    rows = kernels.kekulize(kernels.packed(s, b, "element", "formal_charge", "radical_electrons")).collect()
    double = [sum(r.kekule_order == 2 for r in rows if r.mol_id == m) for m in range(3)]
    assert double == [3, 5, 0] and all(r.kekule_order is None for r in rows if r.mol_id == 2)


def test_matching_against_enumeration():
    rng = random.Random(1)
    for _ in range(300):
        n = rng.choice([2, 4, 6, 8])
        edges = [e for e in itertools.combinations(range(n), 2) if rng.random() < 0.35]
        near = {v: [a + b - v for a, b in edges if v in (a, b)] for v in range(n)}

        def exists(left):
            return not left or any((min(left), w) in edges and exists(left - {min(left), w}) for w in left)  # noqa: B023

        mate = kernels.perfect_matching(near)
        assert (mate is not None) == exists(frozenset(range(n)))
        assert mate is None or all(mate[mate[v]] == v and mate[v] in near[v] for v in range(n))


def test_canonical_forms_do_not_depend_on_numbering(spark):
    rng = random.Random(2)
    mols = {}
    for k in range(6):
        n, bonds, _, _ = list(GRAPHS.values())[k + 4]
        for c in range(3):
            p = list(range(1, n + 1))
            rng.shuffle(p)
            mols[10 * k + c] = ([(i, "C", 0, 0) for i in range(1, n + 1)], [(p[a - 1], p[b - 1], 1) for a, b in bonds])
    form = {r.mol_id: r.form for r in kernels.canonicalize(kernels.packed(*tables(spark, mols), "element")).collect()}
    assert len(set(form.values())) == 6 and all(form[m] == form[m - m % 10] for m in form)


def test_oxidation_states(spark):
    methane = with_hydrogens([(1, "C", 0, 0)], [], [1] * 4)
    carbon_dioxide = ([(1, "C", 0, 0), (2, "O", 0, 0), (3, "O", 0, 0)], [(1, 2, 2), (1, 3, 2)])
    ammonium = with_hydrogens([(1, "N", 1, 0)], [], [1] * 4)
    soft = ([(1, "C", 0, 0), (2, "C", 0, 0)], [(1, 2, 7)])
    s, b = tables(spark, dict(enumerate([methane, carbon_dioxide, ammonium, soft])))
    got = {(r.mol_id, r.site_id): r.oxidation_state for r in valence.oxidation_states(s, b).collect()}
    assert (got[(0, 1)], got[(1, 1)], got[(2, 1)], got[(3, 1)]) == (-4, 4, -3, None)
    assert {r.valence for r in valence.explicit_valence(s, b).where("mol_id = 3").collect()} == {None}
    lone = {(r.mol_id, r.site_id): r.lone_pairs for r in valence.lone_pairs(s, b).collect()}
    assert (lone[(1, 2)], lone[(2, 1)], lone[(3, 1)]) == (2, 0, None)


FORMULAS = {
    "CH3COOH": {(6, 0): 2, (1, 0): 4, (8, 0): 2}, "CuSO4.5H2O": {(29, 0): 1, (16, 0): 1, (8, 0): 9, (1, 0): 10}, "D2O": {(1, 2): 2, (8, 0): 1}, "C6H5[2H]": {(6, 0): 6, (1, 0): 5, (1, 2): 1}, "Db": {(105, 0): 1}, "": {},
}
BAD = {
    "Q": (0, "UnknownSymbol"), "[13Qq]": (3, "UnknownSymbol"), "C0": (1, "ZeroQuantity"), "0H2O": (0, "ZeroQuantity"), "C4294967296": (1, "Overflow"), "5C4000000000": (1, "Overflow"), "C4294967295C": (11, "Overflow"),
    "[C]": (1, "InvalidMassNumber"), "[1C]": (1, "InvalidMassNumber"), "[100000H]": (1, "InvalidMassNumber"), "[13C": (0, "UnclosedBracket"), "h2o": (0, "UnexpectedCharacter"), "Na+K": (3, "UnexpectedCharacter"), "H2 O": (2, "UnexpectedCharacter"),
}


def test_formulas(spark):
    for text, want in FORMULAS.items():
        assert notation.parse_one(text)[0] == want, text
    assert (notation.parse_one("2Na+")[1], notation.parse_one("Na+.Cl-")[1], notation.parse_one("O4S-2")[1]) == (2, 0, -2)
    for text, where in BAD.items():
        with pytest.raises(notation.FormulaError) as e:
            notation.parse_one(text)
        assert (e.value.at, e.value.kind) == where, text
    rows = list(enumerate(["C2H4O2", "CHBrClNO", "H2O4S", "H4N+", "O4S-2", "C6H5[2H]", "BH3"]))
    parsed = notation.parse(spark.createDataFrame(rows, "id long, formula string"))
    comp = parsed.select(F.col("id").alias("mol_id"), F.posexplode("parts").alias("k", "p"), "charge").select("mol_id", F.col("p.element").alias("element"), F.col("p.mass_number").alias("mass_number"), F.col("p.n").alias("n"), F.when(F.col("k") == 0, F.col("charge")).otherwise(0).alias("charge"))
    assert {r.mol_id: r.formula for r in notation.write(comp).collect()} == dict(rows)
    simple = {(r.id, r.element, r.mass_number): r.n for r in notation.parse_simple(spark.createDataFrame([(1, "CuSO4.5H2O"), (2, "D2O")], "id long, formula string")).collect()}
    assert simple == {(1, 29, None): 1, (1, 16, None): 1, (1, 8, None): 9, (1, 1, None): 10, (2, 1, 2): 2, (2, 8, None): 1}


def test_elements():
    assert (dims.symbol(119), dims.name(119), dims.name(190), dims.name(200), dims.name(122)) == ("Uue", "Ununennium", "Unennilium", "Binilnilium", "Unbibium")
    assert [dims.valence_electrons(z) for z in (1, 2, 6, 10, 13, 20, 26, 31, 57, 81, 113, 118, 119)] == [1, 2, 4, 8, 3, 2, None, 3, None, 3, 3, 8, None]
    assert len(dims.SYMBOLS) == len(dims.NAMES) == 118 and len(dims.PAULING) == len(dims.RANKS) == 103


def test_hash_goldens(spark):
    one = spark.range(1).select(F.lit(1).cast("long").alias("one"), F.lit(0).cast("long").alias("zero"), F.lit(-1).cast("long").alias("top"))
    got = resolved(one, lambda d: d.select(mix(F.col("zero")).alias("z"), mix(F.col("one")).alias("m"), combine(F.array(F.col("one"), F.col("one") + 1)).alias("c"), unsigned_mod(F.col("top"), 1000).alias("u"))).first()
    assert [got.z, got.m, got.c % 2**64, got.u] == [0, 0x5692161D100B05E5, 0x64B174495128D35E, (2**64 - 1) % 1000]


MASK = 2**64 - 1


def py_combine(words):
    state = 0x9E3779B97F4A7C15
    for w in words:
        x = state ^ w
        x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & MASK
        x = ((x ^ x >> 27) * 0x94D049BB133111EB) & MASK
        state = x ^ x >> 31
    return state


def test_path_and_circular_fingerprints_against_brute_force(spark):
    s, b = graphs(spark)
    s, b = s.withColumn("seed", F.col("site_id") % 3), b.withColumn("seed", F.col("bond_id") % 2)
    path = {(r.mol_id, r.code % 2**64): r.n for r in fingerprint.path(s, b, 3).collect()}
    circ = {(r.mol_id, r.code % 2**64): r.n for r in fingerprint.circular(s, b, 2).collect()}
    want_path, want_circ = {}, {}
    for m, (n, bonds, _, _) in enumerate(GRAPHS.values()):
        near = {v: [] for v in range(1, n + 1)}
        for k, (x, y) in enumerate(bonds, 1):
            near[x].append((y, k))
            near[y].append((x, k))
        stack = [([v], [v % 3]) for v in near]
        while stack:
            sites, trail = stack.pop()
            if len(sites) > 1 and sites[0] < sites[-1]:
                c = py_combine(min(trail, trail[::-1]))
                want_path[(m, c)] = want_path.get((m, c), 0) + 1
            if len(sites) < 4:
                stack += [([*sites, y], [*trail, k % 2, y % 3]) for y, k in near[sites[-1]] if y not in sites]
        code, ball = {v: py_combine([v % 3]) for v in near}, {v: frozenset() for v in near}
        codes, pool = list(code.values()), {}
        for r in (1, 2):
            new = {v: py_combine([r, code[v], *(w for pair in sorted((k % 2, code[y]) for y, k in near[v]) for w in pair)]) for v in near}
            ball = {v: ball[v].union(*({k} | ball[y] for y, k in near[v])) for v in near}
            code = new
            for v in near:
                if ball[v]:
                    pool[ball[v]] = min(pool.get(ball[v], (9, 0)), (r, code[v]))
        for c in [*codes, *(c for _, c in pool.values())]:
            want_circ[(m, c)] = want_circ.get((m, c), 0) + 1
    assert path == want_path and circ == want_circ


def test_similarity_edge_cases(spark):
    fp = spark.createDataFrame([(1, 10, 2), (1, 11, 1), (2, 10, 1), (3, 99, 4)], "mol_id long, code long, n long")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (4, 5), (1, 4)], "a long, b long")
    got = {(r.a, r.b): (r.tversky, round(r.cosine, 6)) for r in fingerprint.compare(pairs, fp, fp).collect()}
    assert got == {(1, 2): (1 / 3, round(2 / math.sqrt(5), 6)), (1, 3): (0.0, 0.0), (4, 5): (1.0, 1.0), (1, 4): (0.0, 0.0)}
    assert {r.tversky for r in fingerprint.compare(pairs.where("b = 3"), fp, fp, 0.0, 0.0).collect()} == {0.0}


def test_substructure_counts_every_image(spark):
    s, b = graphs(spark)
    triangle = isomorphism.Pattern({1: "", 2: "", 3: ""}, [(1, 2, ""), (2, 3, ""), (1, 3, "")])
    n = {r.mol_id: r.n for r in isomorphism.counts(isomorphism.matches(s, b, triangle)).collect()}
    name = list(GRAPHS).index
    assert (n[name("triangle")], n[name("k4")], n.get(name("cube"), 0)) == (6, 24, 0)


def test_neighbours_against_all_pairs(spark):
    pts = [(1, k + 1, 2.7 * k % 10, 4.3 * k % 10, 6.1 * k % 10) for k in range(60)]
    df = spark.createDataFrame(pts, "mol_id long, site_id long, x double, y double, z double")
    for cutoff in (0.0, 1.5, 3.0, -1.0):
        got = {(r.a, r.b) for r in geometry.neighbors(df, cutoff).collect()}
        assert got == {(p[1], q[1]) for p, q in itertools.combinations(pts, 2) if cutoff >= 0 and sum((p[i] - q[i]) ** 2 for i in (2, 3, 4)) <= cutoff**2}
    edge = (F.lit(10.0), F.lit(10.0), F.lit(4.0))
    near = lambda d, n: d - n * round(d / n)
    got = {(r.a, r.b) for r in geometry.periodic_neighbors(df, edge, 2.5).collect()}
    assert got == {(p[1], q[1]) for p, q in itertools.combinations(pts, 2) if sum(near(p[i] - q[i], n) ** 2 for i, n in ((2, 10), (3, 10), (4, 4))) <= 6.25}


def test_minimum_image_in_an_oblique_cell(spark):
    rng = random.Random(3)
    rows = [tuple(rng.uniform(-30, 30) for _ in range(3)) for _ in range(40)]
    basis = [10.0, 0, 0, 0, 10.0, 0, 0, 9.0, 10.0]
    df = spark.createDataFrame(rows, "x double, y double, z double").withColumn("cell", lattice.reduced(F.array(*map(F.lit, map(float, basis)))))
    got = [r.d2 for r in df.select(lattice.minimum_image(F.col("cell"), (F.col("x"), F.col("y"), F.col("z")))["d2"].alias("d2")).collect()]
    for (x, y, z), d2 in zip(rows, got, strict=True):
        want = min((x + 10 * i) ** 2 + (y + 10 * j + 9 * k) ** 2 + (z + 10 * k) ** 2 for i in range(-5, 6) for j in range(-9, 10) for k in range(-5, 6))
        assert abs(d2 - want) < 1e-9


def test_reduction_of_very_skewed_cells(spark):
    """Lengths after reduction are those of the shortest independent lattice vectors, however skewed the basis is."""
    rng = random.Random(8)
    cells = [([1.0, 0, 0, 0, 1.0, 0, 100.0, 0, 1.0], [1.0, 1.0, 1.0]), ([1.0, 0, 0, 1e6, 2.0, 0, -1e7, 12345.0, 3.0], None)]
    for _ in range(20):
        cells.append(([rng.uniform(-1, 1) * 10 ** rng.randint(0, 3) for _ in range(9)], None))
    df = spark.createDataFrame([(i, [float(v) for v in c]) for i, (c, _) in enumerate(cells)], "k int, cell array<double>")
    got = {r.k: r.m for r in df.select("k", lattice.reduced(F.col("cell")).alias("m")).collect()}
    for k, (cell, want) in enumerate(cells):
        m = np.array(got[k]).reshape(3, 3)
        length = np.sqrt((m * m).sum(1))
        assert (np.diff(length) >= -1e-9).all()
        assert abs(abs(np.linalg.det(m)) / abs(np.linalg.det(np.array(cell).reshape(3, 3))) - 1) < 1e-6
        near = sorted((float(np.linalg.norm(np.array(v) @ m)), v) for v in itertools.product(range(-3, 4), repeat=3) if any(v))
        short = []  # successive minima by enumeration
        for d, v in near:
            if np.linalg.matrix_rank(np.array([*(s for _, s in short), v])) > len(short):
                short.append((d, v))
        assert np.allclose(length, [d for d, _ in short], rtol=1e-9)
        if want:
            assert np.allclose(length, want)
    d2 = df.where("k = 0").withColumn("m", lattice.reduced(F.col("cell"))).select(lattice.minimum_image(F.col("m"), (F.lit(0.0), F.lit(0.0), F.lit(0.9)))["d2"].alias("d")).first().d
    assert abs(d2 - 0.01) < 1e-9


def test_translations_are_all_vectors_in_the_radius(spark):
    rows = [([1.0, 0, 0, 0, 1.0, 0, 0, 0, 1.0], 4.0), ([1.0, 0, 0, 0.9, 0.5, 0, 0.3, 0.2, 2.0], 3.0)]
    got = spark.createDataFrame([([float(v) for v in c], r) for c, r in rows], "cell array<double>, r double").select(lattice.translations(F.col("cell"), F.col("r")).alias("t")).collect()
    for (cell, radius), row in zip(rows, got, strict=True):
        m = np.array(cell).reshape(3, 3)
        want = {v for v in itertools.product(range(-15, 16), repeat=3) if np.linalg.norm(np.array(v) @ m) <= radius}
        assert {(p.i, p.j, p.k) for p in row.t} == want
    assert len(got[0].t) == 257


def test_scalars_and_tensors(spark):
    row = spark.range(1).select(
        scalar.divide(F.lit(1.0), F.lit(0.0)).alias("a"), scalar.divide(F.lit(1.0), F.lit(-0.0)).alias("b"), scalar.minimum(F.lit(float("nan")), F.lit(2.0)).alias("c"), scalar.signum(F.lit(-0.0)).alias("d"),
        scalar.rem_euclid(F.lit(-5.0), F.lit(-3.0)).alias("e"), scalar.round_ties_even(F.lit(2.5)).alias("f"), scalar.ln(F.lit(0.0)).alias("g"), scalar.div_euclid(F.lit(-5.0), F.lit(3.0)).alias("h"),
        tensor.determinant(tensor.multiply(tensor.rotation_x(F.lit(0.3)), tensor.inverse(tensor.rotation_z(F.lit(1.0))))).alias("i"),
    ).first()
    assert list(row)[:8] == [math.inf, -math.inf, 2.0, -1.0, 1.0, 2.0, -math.inf, -2.0] and abs(row.i - 1) < 1e-12


def test_xyz(spark, tmp_path):
    assert list(xyz.frames("\n\n2\nwater\nO 1 2 3\r\nhe 4 5e1 6\n0\n\n")) == [("water", [(8, 1.0, 2.0, 3.0), (2, 4.0, 50.0, 6.0)]), ("", [])]
    for text, where in {"x\n": ("AtomCount", 1), "1\n": ("UnexpectedEof", 2), "1\nc\nO 1 2\n": ("FieldCount", 3), "1\nc\nQq 1 2 3\n": ("ElementSymbol", 3), "1\nc\nO 1 nan 3\n": ("Coordinate", 3), "99999999999\nc\n": ("AtomCountRange", 1)}.items():
        with pytest.raises(xyz.XyzError) as e:
            list(xyz.frames(text))
        assert (e.value.kind, e.value.line) == where
    s = spark.createDataFrame([(7, 1, 8, 1.0, -2.5, 1e-7), (7, 2, 1, 0.0, 12345678.5, 3.0)], "mol_id long, site_id long, element int, x double, y double, z double")
    xyz.write(s, str(tmp_path / "out"))
    back = xyz.read(spark, str(tmp_path / "out" / "part-*"))
    assert [(r.element, r.x, r.y, r.z) for r in back.where("site_id is not null").orderBy("site_id").collect()] == [(8, 1.0, -2.5, 1e-7), (1, 0.0, 12345678.5, 3.0)]


def test_stream_of_xyz_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.xyz").write_text("1\nc\nO 1 2 3\n")
    q = xyz.read_stream(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("xyz_rows").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select count(*) from xyz_rows where element = 8").first()[0] == 1


CHECKED = ["formula_write", "comp_empirical", "formula_roundtrip", "valence_explicit", "oxidation_state", "vsepr", "graph_metrics", "shortest_paths", "ring_membership", "wl_refine", "fp_pair", "sim_search", "substructure_matches", "neighbors", "lattice_volume", "xyz_roundtrip", "stereo_descriptor", "stereo_perceive_four", "stereocenters", "biconnected_blocks", "matrix_scalars"]


@pytest.mark.parametrize("name", CHECKED)
def test_queries_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("lineitem", "orders", "part", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = __spark_entry__.queries()[name](spark, SF)
    want = con.execute(__spark_entry__.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    plain = lambda rows: sorted(tuple(rows_) for rows_ in rows)
    none = lambda r: tuple((v is not None, v) if v is not None else (False, 0) for v in r)
    assert plain(map(none, got.select(*columns).collect())) == plain(map(none, want.fetchall()))


def test_entry_and_names(spark):
    assert __spark_entry__.entry(spark).count() == 1473
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_common_substructure(spark):
    toluene = with_hydrogens([*ring_of(6, [1, 2] * 3)[0], (7, "C", 0, 0)], [*ring_of(6, [1, 2] * 3)[1], (1, 7, 1)], range(2, 7))
    benzene = with_hydrogens(*ring_of(6, [1, 2] * 3), range(1, 7))
    chain = ([(1, "C", 0, 0), (2, "C", 0, 0), (3, "O", 0, 0)], [(1, 2, 1), (2, 3, 1)])
    lone = ([(1, "C", 0, 0)], [])
    s, b = tables(spark, dict(enumerate([toluene, benzene, chain, lone])))
    pairs = spark.createDataFrame([(0, 1), (1, 0), (2, 2), (0, 2), (2, 3)], "a long, b long")
    got = {(r.a, r.b): r.bonds for r in kernels.common_substructure(pairs, kernels.packed(s, b, "element")).collect()}
    assert got == {(0, 1): 11, (1, 0): 11, (2, 2): 2, (0, 2): 1, (2, 3): 0}


def test_common_substructure_of_every_molecule(spark):
    ids = sorted(r.m for r in spark.read.parquet(f"{SF}/lineitem.parquet").select((F.col("l_orderkey") + 1).alias("m")).distinct().collect())
    got = [(r.a, r.b) for r in __spark_entry__.queries()["mcs_size"](spark, SF).collect()]
    assert sorted(got) == list(itertools.pairwise(ids))


def test_components_of_the_whole_network(spark):
    o, li = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("orders", "lineitem"))
    near: dict[int, set[int]] = {}
    for c, s in o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).select("o_custkey", F.col("l_suppkey") + 1000000000).collect():
        near.setdefault(c, set()).add(s)
        near.setdefault(s, set()).add(c)
    want: dict[int, int] = {}
    for x in sorted(near):
        todo = [] if x in want else [x]
        while todo:
            y = todo.pop()
            if y not in want:
                want[y] = x
                todo += near[y]
    got = [(r.site_id, r.component) for r in __spark_entry__.queries()["components_network_whole"](spark, SF).collect()]
    assert sorted(got) == sorted(want.items())


def test_departures_of_ideal_sites(spark):
    from moltable.operators import coordination

    rng = random.Random(4)
    s, b = [], []
    for m, (name, *_) in enumerate(dims.GEOMETRIES):
        slots = list(coordination.DIRECTIONS[name])
        rng.shuffle(slots)
        c, t = math.cos(1.1 + m), math.sin(1.1 + m)
        s.append((m, 1, 1.0, 2.0, 3.0))
        for k, (x, y, z) in enumerate(slots, 2):
            r = rng.uniform(0.8, 2) / math.sqrt(x * x + y * y + z * z)
            s.append((m, k, 1 + r * (c * x - t * y), 2 + r * (t * x + c * y), 3 + r * z))
            b.append((m, k, 1, k))
    s.append((99, 1, 0.0, 0.0, 0.0))
    s += [(99, k, float(k - 2), 0.0, 0.0) for k in (2, 3)]
    b += [(99, k, 1, k) for k in (2, 3)]
    sites = spark.createDataFrame(s, "mol_id long, site_id long, x double, y double, z double")
    got = {(r.mol_id, r.site_id): r for r in coordination.nearest(coordination.departures(sites, spark.createDataFrame(b, "mol_id long, bond_id long, a long, b long"))).collect()}
    assert {m: got[(m, 1)].geometry for m in range(13)} == {m: m for m in range(13)} and (99, 1) not in got
    assert max(got[(m, 1)].departure for m in range(13)) < 1e-6


def test_handedness_and_sides(spark):
    from moltable.operators import stereo

    corner = [(1.0, 1.0, 1.0), (1.0, -1.0, -1.0), (-1.0, -1.0, 1.0), (-1.0, 1.0, -1.0)]
    s = [(0, 1, 0.0, 0.0, 0.0)] + [(0, k + 2, *p) for k, p in enumerate(corner)]
    s += [(1, i, -x, y, z) for _, i, x, y, z in s]
    b = [(m, k, 1, k + 1, 1) for m in (0, 1) for k in range(1, 5)]
    for m, y in ((2, 1.0), (3, -1.0)):
        s += [(m, 1, 0.0, 0.0, 0.0), (m, 2, 1.3, 0.0, 0.0), (m, 3, -0.5, 1.0, 0.0), (m, 4, 1.8, y, 0.0)]
        b += [(m, 1, 1, 2, 2), (m, 2, 1, 3, 1), (m, 3, 2, 4, 1)]
    sites = spark.createDataFrame(s, "mol_id long, site_id long, x double, y double, z double")
    bonds = spark.createDataFrame(b, "mol_id long, bond_id long, a long, b long, bond_order int")
    parity = {r.mol_id: r.parity for r in stereo.tetrahedral(sites, bonds).collect()}
    assert set(parity) == {0, 1} and parity[0] == -parity[1] != 0
    assert {r.mol_id: r.side for r in stereo.double_bonds(sites, bonds).collect()} == {2: 1, 3: -1}
    forms = spark.createDataFrame([(1, "c", "R", "S"), (2, "c", "S", "R"), (3, "c", "m", "m"), (4, "d", "R", "S")], "mol_id long, constitution string, configured string, mirror string")
    pairs = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (1, 4)], "a long, b long")
    assert {r.b: r.relation for r in stereo.relate(pairs, forms).collect()} == {1: "Identical", 2: "Enantiomers", 3: "Diastereomers", 4: "Unrelated"}
    assert {r.mol_id: r.is_chiral for r in stereo.is_chiral(forms).collect()} == {1: True, 2: True, 3: False, 4: True}


def _automorphic(n, bonds, kinds):
    """The least site of each orbit, by trying all permutations."""
    edges = {frozenset((a, b)): o for a, b, o in bonds}
    least = {s: s for s in range(1, n + 1)}
    for p in itertools.permutations(range(1, n + 1)):
        if all(kinds[s - 1] == kinds[p[s - 1] - 1] for s in range(1, n + 1)) and all(edges.get(frozenset(p[x - 1] for x in e)) == o for e, o in edges.items()):
            for s in range(1, n + 1):
                least[s] = min(least[s], p[s - 1])
    return least


def test_canonical_numbering_against_all_permutations():
    rng = random.Random(5)
    for _ in range(150):
        n = rng.randint(1, 6)
        bonds = [(a, b, rng.choice([1, 1, 2])) for a, b in itertools.combinations(range(1, n + 1), 2) if rng.random() < 0.5]
        kinds = [rng.choice([6, 6, 7]) for _ in range(n)]
        rows = lambda m: [{"bond_id": i, "a": a, "b": b, "bond_order": o} for i, (a, b, o) in enumerate(m)]
        graph = lambda m: kernels.Graph([{"site_id": s} for s in range(1, n + 1)], rows(m))
        found = kernels.Labelling(graph(bonds), dict(enumerate(kinds, 1)))
        assert found.orbit == _automorphic(n, bonds, kinds), (bonds, kinds)
        p = rng.sample(range(1, n + 1), n)
        moved = kernels.Labelling(graph([(p[a - 1], p[b - 1], o) for a, b, o in bonds]), {p[s - 1]: kinds[s - 1] for s in range(1, n + 1)})
        assert moved.form == found.form


def test_canonical_numbering_of_a_long_chain_with_hydrogens():
    n = 20
    bonds = [(i, i + 1) for i in range(1, n)]
    for i in range(1, n + 1):
        bonds += [(i, n + len(bonds) - (n - 1) + k + 1) for k in range(3 if i in (1, n) else 2)]
    sites = sorted({s for b in bonds for s in b})
    assert len(sites) == 62
    g = kernels.Graph([{"site_id": s} for s in sites], [{"a": a, "b": b, "bond_order": 1} for a, b in bonds])
    found = kernels.Labelling(g, {s: 6 if s <= n else 1 for s in sites})
    assert len(set(found.orbit.values())) == 20


def test_canonical_ranks_take_the_callers_keys(spark):
    pair = ([(1, "C", 0, 0), (2, "C", 1, 0)], [(1, 2, 1)])
    mols = kernels.packed(*tables(spark, {1: pair}), "element", "formal_charge")
    ranks = lambda *k: {(r.site_id, r.orbit) for r in kernels.canonical_ranks(mols, *k).collect()}
    assert ranks() == {(1, 1), (2, 1)} and ranks("element", "formal_charge") == {(1, 1), (2, 2)}


def test_common_substructure_maps_sites(spark):
    chain = ([(1, "C", 0, 0), (2, "C", 0, 0), (3, "O", 0, 0)], [(1, 2, 1), (2, 3, 1)])
    other = ([(1, "N", 0, 0), (2, "O", 0, 0), (3, "C", 0, 0), (4, "C", 0, 0)], [(2, 3, 1), (3, 4, 1), (1, 4, 1)])
    s, b = tables(spark, {0: chain, 1: other})
    pairs = spark.createDataFrame([(0, 1), (1, 0)], "a long, b long")
    got = {(r.a, r.b): [tuple(m) for m in r.site_map] for r in kernels.common_substructure(pairs, kernels.packed(s, b, "element")).collect()}
    assert got == {(0, 1): [(1, 4), (2, 3), (3, 2)], (1, 0): [(2, 3), (3, 2), (4, 1)]}


def test_principal_axes(spark):
    rng = np.random.default_rng(4)
    rows = [(m, i, *map(float, rng.normal(size=3) * (3, 2, 1))) for m in range(4) for i in range(6)] + [(9, 0, 1.0, 2.0, 3.0), (10, 0, None, 0.0, 0.0)]
    spread = geometry.moments(spark.createDataFrame(rows, "mol_id long, site_id long, x double, y double, z double"))
    got = {r.mol_id: r for r in geometry.principal_axes(spread).collect()}
    assert got[10].moments is None and got[9].moments == [0.0] * 3
    for m in range(4):
        p = np.array([r[2:] for r in rows if r[0] == m])
        frame = np.array(got[m].axes).reshape(3, 3).T
        assert np.allclose(frame @ np.diag(got[m].moments) @ frame.T, np.cov(p.T, bias=True)) and np.isclose(np.linalg.det(frame), 1)
    assert geometry.principal_axes(spread.where("mol_id < 0")).count() == 0


def test_neighbors_in_skewed_cells(spark):
    rng = np.random.default_rng(6)
    base = {1: [[5, 0, 0], [2, 6, 0], [11, 5, 7]], 2: [[1, 0, 0], [0, 1, 0], [100, 0, 1]], 3: [[9, 0, 0], [-4, 8, 0], [1, -3, 9]]}
    place = {m: rng.uniform(-20, 20, (12, 3)) for m in base}
    rows = [(m, i, *map(float, p)) for m, ps in place.items() for i, p in enumerate(ps)]
    df = spark.createDataFrame([*rows, (1, 99, None, 0.0, 0.0), (4, 0, 0.0, 0.0, 0.0)], "mol_id long, site_id long, x double, y double, z double")
    cells = spark.createDataFrame([(m, [float(v) for r in c for v in r]) for m, c in base.items()] + [(4, None)], "mol_id long, cell array<double>")
    for cutoff in (0.4, 2.5, 4.0):
        got = {(r.mol_id, r.a, r.b): r.d2 for r in lattice.neighbors(df, cells, cutoff).collect()}
        want = {}
        for m, c in base.items():
            short = np.array([[1, 0, 0], [0, 1, 0], [0, 0, 1]] if m == 2 else c, float)
            for a, b in itertools.combinations(range(12), 2):
                near = np.round((place[m][b] - place[m][a]) @ np.linalg.inv(short))
                d = place[m][b] - place[m][a] - near @ short
                d2 = min(float(((d + np.array(s) @ short) ** 2).sum()) for s in itertools.product(range(-4, 5), repeat=3))
                if d2 <= cutoff * cutoff:
                    want[m, a, b] = d2
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
