"""Circular codes with stereo descriptors against a plain version, and of mirror images."""

from __future__ import annotations

import random
from itertools import pairwise

import pytest

from moltable.operators import coordination, fingerprint, frames, rotations, smallcircular, valence
from moltable.plans import projection

MASK = 2**64 - 1
SITES = [(i, i % 4) for i in range(1, 9)]
BONDS = [(1, 2), (1, 3), (1, 4), (1, 5), (2, 6), (2, 7), (2, 8), (7, 8)]


def combined(words):
    h = 0x9E3779B97F4A7C15
    for w in words:
        h ^= w & MASK
        h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 & MASK
        h = (h ^ h >> 27) * 0x94D049BB133111EB & MASK
        h ^= h >> 31
    return h


def folded(words):
    h = 0
    for w in words:
        h = ((h << 5 | h >> 59) & MASK ^ w) * 0x517CC1B727220A95 & MASK
    return h


def plain(stereo, radius):
    near = {i: [] for i, _ in SITES}
    for k, (a, b) in enumerate(BONDS, 1):
        near[a].append((b, k))
        near[b].append((a, k))
    code, ball = {i: combined([s]) for i, s in SITES}, {i: frozenset() for i, _ in SITES}
    out, pool = list(code.values()), {}
    for r in range(1, radius + 1):
        new = {}
        for v in near:
            words = [r, code[v], *(w for p in sorted((k % 2, code[y]) for y, k in near[v]) for w in p)]
            if v in stereo:
                kind, nbrs = stereo[v]
                own = rotations.kinds()[kind].descriptor([code[x] for x in nbrs])
                words.append(folded([*({13: [1], 14: [2]}.get(kind) or [0, kind]), 6, *own, *([0] * (6 - len(own)))]))
            new[v] = combined(words)
        ball = {v: ball[v].union(*({k} | ball[y] for y, k in near[v])) for v in near}
        code = new
        for v in near:
            if ball[v]:
                pool[ball[v]] = min(pool.get(ball[v], (99, 0)), (r, code[v]))
    return sorted([*out, *(c for _, c in pool.values())])


def test_codes_with_stereo(spark):
    rng, cases = random.Random(4), {}
    for m in range(12):
        first, second = [2, 3, 4, 5], [1, 6, 7, 8]
        rng.shuffle(first)
        rng.shuffle(second)
        cases[m] = {1: (rng.choice([5, 6, 8, 14]), first), 2: (5, second)} if m else {}
    cases[20], cases[21] = {1: (5, [2, 3, 4, 5])}, {1: (5, [3, 2, 4, 5])}
    s = spark.createDataFrame([(m, i, v) for m in cases for i, v in SITES], "mol_id long, site_id long, seed long")
    b = spark.createDataFrame([(m, k, x, y, k % 2) for m in cases for k, (x, y) in enumerate(BONDS, 1)], "mol_id long, bond_id long, a long, b long, seed long")
    stereo = spark.createDataFrame([(m, i, kind, n) for m, own in cases.items() for i, (kind, n) in own.items()], "mol_id long, site_id long, kind int, neighbors array<long>")
    got = {}
    for r in fingerprint.circular(s, b, 2, stereo).collect():
        got.setdefault(r.mol_id, []).extend([r.code % 2**64] * r.n)
    assert {m: sorted(c) for m, c in got.items()} == {m: plain(own, 2) for m, own in cases.items()}
    assert sorted(got[20]) != sorted(got[21]) and all(x <= y for x, y in pairwise(plain({}, 1)))


@pytest.mark.parametrize("packed", [0, 3])
def test_rows_of_arrays_and_joins_give_the_same_codes(spark, monkeypatch, packed):
    """Sparse site numbers, a bond to no site, a site without bonds, over 64 bonds, null seeds, odd configurations."""
    rng = random.Random(8)
    s, b = [(1, 7, 3), (2, 1, None), (2, 2, 1), (6, 1, 1), (6, 2, 1)], [(2, 1, 1, 2, 1), (6, 1, 1, 2, None)]
    for m, n in ((3, 5), (4, 14), (5, 8)):
        ids = rng.sample(range(-50, 90), n)
        s += [(m, i, rng.randint(-2, 3)) for i in ids]
        b += [(m, 9 * k, x, y, rng.randint(-1, 2)) for k, (x, y) in enumerate((x, y) for x in ids for y in [*ids, 1000] if x < y and rng.random() < 0.85)]
    t = [(5, i, kind, rng.sample([j for m, j, _ in s if m == 5 and j != i], 4)) for (m, i, _), kind in zip(s[-8:], (5, 6, 14, 13, 8, 2, 5, 5), strict=True)]
    t = [*t[:-1], (*t[-1][:3], [t[-1][3][0]] * 4), (5, 999, 5, t[0][3]), (4, s[9][1], 5, [1000, *t[0][3][:3]])]
    sites = spark.createDataFrame(s, "mol_id long, site_id long, seed long")
    bonds = spark.createDataFrame(b, "mol_id long, bond_id long, a long, b long, seed long")
    stereo = spark.createDataFrame(t, "mol_id long, site_id long, kind int, neighbors array<long>")
    rows = lambda: [sorted(map(str, fingerprint.circular(sites, bonds, r, x).collect())) for r, x in ((0, None), (2, None), (2, stereo))]
    small = rows()
    assert all(small) and small[1] != small[2]
    monkeypatch.setattr(smallcircular, "PACKED", packed)
    assert rows() == small


def test_ordinary_molecules_take_no_written_rounds(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "_circular", None)
    s = spark.createDataFrame([(1, i, v) for i, v in SITES], "mol_id long, site_id long, seed long")
    b = spark.createDataFrame([(1, k, x, y, k % 2) for k, (x, y) in enumerate(BONDS, 1)], "mol_id long, bond_id long, a long, b long, seed long")
    assert sorted(r.code % 2**64 for r in fingerprint.circular(s, b, 2).collect() for _ in range(r.n)) == plain({}, 2)


def test_centres_alone_are_those_of_all_loci(spark):
    s, b = projection.molecules(spark, "/root/testdata/sf0.001")
    shape = coordination.perceive(valence.steric_numbers(s, b))
    rows = lambda df: sorted(map(str, df.where("locus_kind = 0").collect()))
    every = rows(frames.perceive(s, b, shape))
    assert every and rows(frames.perceive(s, b, shape, frames.centres(s, b, shape))) == every
