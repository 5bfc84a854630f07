"""Biconnected blocks against a plain depth-first search, and in one large network."""

from __future__ import annotations

import itertools
import random

from moltable.operators import spanning, topology


def plain_blocks(edges):
    """{bond: least bond of its block} by cutting each site: bonds at a site are one block if their far ends stay connected without it."""
    up = {k: k for k in edges}

    def top(k):
        while up[k] != k:
            k = up[k]
        return k

    for site in {x for e in edges.values() for x in e}:
        seen = {}
        for k, e in edges.items():
            if site not in e:
                continue
            start = e[0] if e[1] == site else e[1]
            if start not in seen:
                stack = [start]
                seen[start] = start
                while stack:
                    x = stack.pop()
                    for f in edges.values():
                        if x in f and site not in f:
                            y = f[0] if f[1] == x else f[1]
                            if y not in seen:
                                seen[y] = start
                                stack.append(y)
        for (k, e), (m, f) in itertools.combinations([(k, e) for k, e in edges.items() if site in e], 2):
            x, y = (g[0] if g[1] == site else g[1] for g in (e, f))
            if seen[x] == seen[y]:
                a, b = sorted((top(k), top(m)))
                up[b] = a
    return {k: top(k) for k in edges}


def test_blocks_of_random_graphs(spark):
    rng, rows, want = random.Random(11), [], {}
    for m in range(60):
        n = rng.randint(2, 12)
        pairs = [e for e in itertools.combinations(range(1, n + 1), 2) if rng.random() < rng.choice([0.15, 0.3, 0.6])]
        rng.shuffle(pairs)
        edges = {k: e if rng.random() < 0.5 else e[::-1] for k, e in enumerate(pairs, 1)}
        rows += [(m, k, *e) for k, e in edges.items()]
        want |= {(m, k): b for k, b in plain_blocks(edges).items()}
    bonds = spark.createDataFrame(rows, "mol_id long, bond_id long, a long, b long")
    for packed in (100, 0, 8):
        assert {(r.mol_id, r.bond_id): r.block for r in spanning.blocks(bonds, packed).collect()} == want
    assert spanning.blocks(spark.createDataFrame([], "mol_id long, bond_id long, a long, b long")).count() == 0


def test_blocks_of_one_long_network(spark):
    """A chain of 3,000 squares and triangles that share sites, with bridges between every fifth."""
    edges, at = [], 1
    want = []
    for k in range(3000):
        size = 1 if k % 5 == 4 else 3 + k % 2
        ring = [at, *range(at + 1, at + max(size, 2))]
        own = [(ring[0], ring[1])] if size == 1 else [(ring[i], ring[(i + 1) % size]) for i in range(size)]
        want.append(len(own))
        edges += own
        at = ring[-1]
    rng = random.Random(2)
    p = list(range(at + 1))
    rng.shuffle(p)
    rows = [(7, k, p[a], p[b]) for k, (a, b) in enumerate(edges)]
    bonds = spark.createDataFrame(rows, "mol_id long, bond_id long, a long, b long")
    got = spanning.blocks(bonds)
    assert sorted(r["count"] for r in got.groupBy("block").count().collect()) == sorted(want)
    ring = topology.ring_membership(bonds, got)
    assert ring.where("not in_ring").count() == 600
