"""Colours of ordinary molecules, one colouring to a row of arrays: the rounds of `symmetry` over all rows of an Arrow batch at once.

Rows are (mol_id, tag, s, c, a, b, t): sites in order, their colours, the ends and hashes of the bonds.  Hashes are those
that xxhash64 gives in Columns, so colours equal what the joins of `symmetry` give.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .smallgraphs import HELD, Batch, over

P1, P2, P3, P4, P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
LOW, HALF = np.uint64((1 << 31) - 1), np.uint64(31)


def _turn(x: np.ndarray, k: int) -> np.ndarray:
    return (x << np.uint64(k)) | (x >> np.uint64(64 - k))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * P2
    h = (h ^ (h >> np.uint64(29))) * P3
    return h ^ (h >> np.uint64(32))


def xxhash64(*columns: np.ndarray) -> np.ndarray:
    """The function of the same name over longs, as unsigned numbers."""
    h = np.full(len(columns[0]), 42, np.uint64)
    for c in columns:
        h = (h + P5 + np.uint64(8)) ^ (_turn(c * P2, 31) * P1)
        h = _mixed(_turn(h, 27) * P1 + P4)
    return h


def marked(colour: np.ndarray) -> np.ndarray:
    """xxhash64(colour, 1), where 1 is an int."""
    h = (xxhash64(colour) + P5 + np.uint64(4)) ^ P1
    return _mixed(_turn(h, 23) * P2 + P3)


def _sums(where: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The two sums of `symmetry` by place; doubles hold them exactly."""
    add = lambda x: np.bincount(where, x.astype(np.float64), n).astype(np.uint64)
    return add(h & LOW), add(h >> HALF)


@dataclass
class Graphs:
    """Sites numbered through all rows, in order of row; bonds from both ends, in order of row too."""

    row: np.ndarray
    u: np.ndarray
    v: np.ndarray
    tie: np.ndarray
    rows: int

    def __post_init__(self):
        self.first = np.searchsorted(self.row, np.arange(self.rows + 1))
        self.edge = np.searchsorted(self.row[self.u], np.arange(self.rows + 1)) if len(self.u) else np.zeros(self.rows + 1, np.int64)

    def groups(self, colour: np.ndarray) -> np.ndarray:
        """A number for each colour of each row, in order of row and colour."""
        order = np.lexsort((colour.view(np.int64), self.row))
        r, c = self.row[order], colour[order]
        new = np.ones(len(r), np.int64)
        new[1:] = (r[1:] != r[:-1]) | (c[1:] != c[:-1])
        out = np.empty(len(r), np.int64)
        out[order] = np.cumsum(new) - 1
        return out

    def counts(self, colour: np.ndarray) -> np.ndarray:
        """How many colours each row has."""
        group = self.groups(colour)
        one = np.unique(group, return_index=True)[1]
        return np.bincount(self.row[one], minlength=self.rows)

    def copies(self, row: np.ndarray) -> tuple[Graphs, np.ndarray]:
        """The graphs of these rows anew, and of each site the one that it copies."""
        size, many = np.diff(self.first)[row], np.diff(self.edge)[row]
        new = np.repeat(np.arange(len(row)), size)
        base = np.cumsum(size) - size
        old = np.arange(len(new)) - base[new] + self.first[row][new]
        at = np.repeat(np.arange(len(row)), many)
        e = np.arange(len(at)) - (np.cumsum(many) - many)[at] + self.edge[row][at]
        shift = (base - self.first[row])[at]
        return Graphs(new, self.u[e] + shift, self.v[e] + shift, self.tie[e], len(row)), old

    def stable(self, colour: np.ndarray) -> np.ndarray:
        """Rounds until a row splits no more; a row at rest keeps its colours."""
        out, g, own, c = colour.copy(), self, np.arange(len(colour)), colour
        n = g.counts(c)
        while g.rows:
            new = xxhash64(c, *_sums(g.u, xxhash64(g.tie, c[g.v]), len(c)))
            m = g.counts(new)
            live = np.flatnonzero(m > n)
            h, old = g.copies(live)
            own, c, n, g = own[old], new[old], m[live], h
            out[own] = c
        return out

    def cells(self, colour: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(group of each site, size of each group that is a cell, else 0), as `symmetry` has them."""
        degree = np.bincount(self.u, minlength=len(self.row))
        ringed = np.bincount(self.row, degree, self.rows) >= 2 * np.bincount(self.row[degree > 0], minlength=self.rows)
        group = self.groups(colour)
        size = np.bincount(group[(degree > 1) & ringed[self.row]], minlength=len(group))
        return group, np.where(size > 1, size, 0)

    def marks(self, colour: np.ndarray, pivot: np.ndarray) -> np.ndarray:
        """What each pivot sees when made individual; no more than HELD sites are held at once."""
        out = np.empty(len(pivot), np.uint64)
        cost = np.cumsum(np.diff(self.first)[self.row[pivot]])
        at = 0
        while at < len(pivot):
            end = max(at + 1, int(np.searchsorted(cost, (cost[at - 1] if at else 0) + HELD)))
            each, old = self.copies(self.row[pivot[at:end]])
            own = old == pivot[at:end][each.row]
            last = each.stable(np.where(own, marked(colour[old]), colour[old]))
            out[at:end] = xxhash64(*_sums(each.row, xxhash64(last), each.rows))
            at = end
        return out

    def classes(self, colour: np.ndarray) -> np.ndarray:
        out, g, own, c = colour.copy(), self, np.arange(len(colour)), self.stable(colour)
        while True:
            out[own] = c
            group, size = g.cells(c)
            pivot = np.flatnonzero(size[group])
            if not len(pivot):
                return out
            new = c.copy()
            new[pivot] = xxhash64(c[pivot], g.marks(c, pivot))
            g, old = g.copies(np.flatnonzero(g.counts(new) > g.counts(c)))
            own, c = own[old], g.stable(new[old])

    def certificates(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(lo, hi, k) of each row."""
        last, g, own, c = key.copy(), self, np.arange(len(key)), self.classes(key)
        while True:
            last[own] = c
            group, size = g.cells(c)
            at = np.flatnonzero(size[group])
            if not len(at):
                break
            # of each row the smallest cell, of equal ones that of the least colour; groups are in order of colour
            order = at[np.lexsort((at, group[at], size[group[at]], g.row[at]))]
            rows, one = np.unique(g.row[order], return_index=True)
            new = c.copy()
            new[order[one]] = marked(c[order[one]])
            g, old = g.copies(rows)
            own, c = own[old], g.classes(new[old])
        h = np.concatenate([xxhash64(last, key), xxhash64(last[self.u], last[self.v], self.tie)])
        row = np.concatenate([self.row, self.row[self.u]])
        return *_sums(row, h, self.rows), np.bincount(row, minlength=self.rows)


def _graphs(g: Batch) -> tuple[Graphs, np.ndarray]:
    """The rows of a batch and their colours; bonds to what is no site are left out."""
    place = np.cumsum(g.own) - 1
    both = g.own[g.u] & g.own[g.v]
    u, v = place[g.u[both]], place[g.v[both]]
    tie = g.rows.column("t").flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)[both]
    row = g.row[g.own]
    ends, far, twice = np.concatenate([u, v]), np.concatenate([v, u]), np.concatenate([tie, tie])
    order = np.argsort(row[ends], kind="stable") if len(ends) else np.zeros(0, np.int64)
    colour = g.rows.column("c").flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    return Graphs(row, ends[order], far[order], twice[order], g.rows.num_rows), colour


def _each_site(rows: DataFrame, how: Callable[[Graphs, np.ndarray], np.ndarray]) -> DataFrame:
    def step(g: Batch) -> Iterator[tuple[np.ndarray, list]]:
        graphs, colour = _graphs(g)
        yield graphs.row, [g.rows.column("tag").take(pa.array(graphs.row)), g.site[g.own], how(graphs, colour).view(np.int64)]

    return over(rows, step, "tag long, site_id long, colour long")


def stable(rows: DataFrame) -> DataFrame:
    """(mol_id, tag, site_id, colour)."""
    return _each_site(rows, Graphs.stable)


def classes(rows: DataFrame) -> DataFrame:
    """(mol_id, tag, site_id, colour)."""
    return _each_site(rows, Graphs.classes)


def orbits(rows: DataFrame) -> DataFrame:
    """(mol_id, site_id, orbit): the least site of each class."""

    def step(g: Batch) -> Iterator[tuple[np.ndarray, list]]:
        graphs, colour = _graphs(g)
        group = graphs.groups(graphs.classes(colour))
        site = g.site[g.own]
        yield graphs.row, [site, site[np.unique(group, return_index=True)[1]][group]]

    return over(rows, step, "site_id long, orbit long")


def certificates(rows: DataFrame) -> DataFrame:
    """(mol_id, tag, lo, hi, k)."""

    def step(g: Batch) -> Iterator[tuple[np.ndarray, list]]:
        graphs, colour = _graphs(g)
        lo, hi, k = graphs.certificates(colour)
        yield np.arange(graphs.rows), [g.rows.column("tag"), lo.view(np.int64), hi.view(np.int64), k]

    return over(rows, step, "tag long, lo long, hi long, k long")
