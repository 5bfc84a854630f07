"""Stereochemistry of ordinary molecules, one molecule (or one assignment of it) to a row of arrays: frames, stereogenic
loci, forms and isomers over all rows of an Arrow batch at once.

The rounds are those of `frames` and `stereoforms` as joins, and so are hashes and results.  Rows of colours are those of
`smallcolours` with the bonds' ids `e`, frames with kinds `loci` and declared configurations `said`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import rotations
from .smallcolours import P1, P2, P3, P5, Graphs, _graphs, _mixed, _sums, _turn, xxhash64
from .smallgraphs import HELD, Batch, over

SITE_LOCUS, BOND_LOCUS, AXIS_LOCUS = 0, 1, 2
SAID = "array<struct<locus_kind:int,locus_id:bigint,kind:int,neighbors:array<bigint>>>"
LOCI = "array<struct<locus_kind:int,locus_id:bigint,kind:int,anchors:array<bigint>,neighbors:array<bigint>>>"
GRAPH = "s array<bigint>, c array<bigint>, a array<bigint>, b array<bigint>, e array<bigint>, t array<bigint>, loci " + LOCI


def _lists(size: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(size)]).astype(np.int32), pa.array(values, pa.int64()))


def _spans(first: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of the span, entry) of spans that begin at `first`."""
    back = np.repeat(np.arange(len(many)), many)
    return back, np.arange(len(back)) - (np.cumsum(many) - many)[back] + first[back]


def _numbered(keys: np.ndarray) -> np.ndarray:
    """A number for each row of keys, the same for equal ones."""
    return np.unique(keys, axis=0, return_inverse=True)[1].ravel() if len(keys) else np.zeros(0, np.int64)


def frames(rows: DataFrame, most: int) -> DataFrame:
    """(mol_id, locus_kind, locus_id, anchors, neighbors) of rows (mol_id, s, a, b, e, o): o is 2 for double bonds, 1 for
    others, 0 where the order is not known."""

    def step(g: Batch) -> Iterator[tuple[np.ndarray, list]]:
        nodes = len(g.keys)
        bond, order = (g.rows.column(n).flatten().to_numpy(zero_copy_only=False) for n in ("e", "o"))
        ends, far = np.concatenate([g.u, g.v]), np.concatenate([g.v, g.u])
        way = np.lexsort((far, ends))
        many = np.bincount(ends, minlength=nodes)
        centre = np.flatnonzero(g.own & (many > 1) & (many <= most))
        _, near = _spans(g.first[centre], many[centre])
        one = np.ones(len(centre), np.int64)
        yield g.row[centre], [np.full(len(centre), SITE_LOCUS), g.site[centre], _lists(one, g.site[centre]), _lists(many[centre], g.site[far[way][near]])]

        # arcs are double bonds both ways; each points to the one behind it until its chain ends
        double = np.flatnonzero(order == 2)
        n = len(double)
        start, head = np.concatenate([g.u[double], g.v[double]]), np.concatenate([g.v[double], g.u[double]])
        back = np.concatenate([np.arange(n) + n, np.arange(n)])
        d = np.bincount(start, minlength=nodes)
        out = np.argsort(start, kind="stable")
        first = np.searchsorted(start[out], np.arange(nodes + 1))
        two = np.flatnonzero(d[head] == 2)
        pair = out[first[head[two]][:, None] + np.arange(2)]
        other = np.where(pair[:, 0] == back[two], pair[:, 1], pair[:, 0])
        on = other % n != two % n if n else two > 0
        at, hops = np.arange(2 * n), np.zeros(2 * n, np.int64)
        at[two[on]], hops[two[on]] = other[on], 1
        for _ in range(int(2 * n).bit_length()):
            hops, at = hops + hops[at], at[at]
        ended, last = (d[head] == 1)[at], head[at]

        x, y = np.arange(n), np.arange(n) + n
        mid = np.flatnonzero(d == 2)
        p = out[first[mid][:, None] + np.arange(2)]
        kind = np.repeat([BOND_LOCUS, AXIS_LOCUS], [n, len(mid)])
        locus = np.concatenate([bond[double], g.site[mid]]).astype(np.int64)
        x, y = np.concatenate([x, p[:, 0]]), np.concatenate([y, p[:, 1]])
        turn = head[x] > head[y]
        x, y = np.where(turn, y, x), np.where(turn, x, y)
        keep = ended[x] & ended[y] & (hops[x] == hops[y]) & (head[x] != head[y]) & ((kind == BOND_LOCUS) | (last[x] != last[y]))
        kind, locus, s, t = kind[keep], locus[keep], last[x[keep]], last[y[keep]]
        # the two further neighbours of each end
        free = order == 1
        ends, far = np.concatenate([g.u[free], g.v[free]]), np.concatenate([g.v[free], g.u[free]])
        way = np.lexsort((far, ends))
        first = np.searchsorted(ends[way], np.arange(nodes + 1))
        few = np.diff(first) == 2
        fit = few[s] & few[t]
        kind, locus, s, t = kind[fit], locus[fit], s[fit], t[fit]
        v = np.concatenate([far[way][first[i][:, None] + np.arange(2)] for i in (s, t)], axis=1)
        fit = (np.diff(np.sort(v, axis=1), axis=1) > 0).all(axis=1)
        kind, locus, s, t, v = kind[fit], locus[fit], s[fit], t[fit], v[fit]
        yield g.row[s], [kind, locus, _lists(np.full(len(s), 2), g.site[np.stack([s, t], axis=1)].ravel()), _lists(np.full(len(s), 4), g.site[v].ravel())]

    return over(rows, step, "locus_kind int, locus_id long, anchors array<long>, neighbors array<long>")


@dataclass
class Loci:
    """Frames or configurations of the rows of a batch, in order of row; slots and ends are sites of `Graphs`, -1 for none."""

    row: np.ndarray
    kind: np.ndarray
    slots: np.ndarray
    ends: np.ndarray  # a frame's anchors; the sites where a configuration is heard

    def at(self, which: np.ndarray) -> Loci:
        return Loci(self.row[which], self.kind[which], self.slots[which], self.ends[which])

    def of(self, rows: np.ndarray, old: Graphs, new: Graphs) -> Loci:
        """Those of the rows of `old` that were copied to `new`."""
        first = np.searchsorted(self.row, np.arange(old.rows + 1))
        back, e = _spans(first[rows], np.diff(first)[rows])
        return self._moved(back, e, old, new)

    def _moved(self, row: np.ndarray, e: np.ndarray, old: Graphs, new: Graphs) -> Loci:
        shift = (new.first[row] - old.first[self.row[e]])[:, None]
        move = lambda x: np.where(x < 0, -1, x + shift)
        return Loci(row, self.kind[e], move(self.slots[e]), move(self.ends[e]))


@dataclass
class Names:
    """What the batch calls its loci."""

    row: np.ndarray
    values: pa.StructArray
    locus: np.ndarray  # [n, 3]: row, locus_kind, locus_id


def _read(g: Batch, column: str) -> tuple[Loci, Names]:
    own = g.rows.column(column)
    row = np.repeat(np.arange(len(own)), own.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    values = own.flatten()
    numbers = lambda n: values.field(n).to_numpy(zero_copy_only=False).astype(np.int64)
    what, locus, kind = numbers("locus_kind"), numbers("locus_id"), numbers("kind")
    place = np.cumsum(g.own) - 1

    def sites(of: np.ndarray, value: np.ndarray) -> np.ndarray:
        if not len(value) or not len(g.keys):
            return np.full(len(value), -1)
        at = g.nodes(of, value)
        return np.where(at < 0, -1, place[at])

    def matrix(name: str, width: int) -> np.ndarray:
        size = values.field(name).value_lengths().to_numpy(zero_copy_only=False)
        back, at = _spans(np.zeros(len(size), np.int64), size)
        out = np.full((len(size), width), -1)
        out[back, at] = sites(row[back], values.field(name).flatten().to_numpy(zero_copy_only=False))
        return out

    slots = matrix("neighbors", rotations.SLOTS)
    whole = ((slots >= 0).sum(axis=1) == np.array([k.slots for k in rotations.kinds()])[kind]) if len(kind) else np.zeros(0, bool)
    kind = np.where(whole, kind, -1)  # what has a neighbour that is no site says nothing
    if column == "loci":
        ends = matrix("anchors", 2)
        return Loci(row, kind, slots, ends), Names(row, values, np.stack([row, what, locus], axis=1))
    ends = np.full((len(row), 2), -1)
    alone = what != BOND_LOCUS
    ends[alone, 0] = sites(row[alone], locus[alone])
    # a bond is heard at both its ends
    of = g.row[g.u] if len(g.u) else np.zeros(0, np.int64)
    e = g.rows.column("e").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    both = _numbered(np.concatenate([np.stack([of, e], axis=1), np.stack([row, locus], axis=1)]))
    bond = np.full(len(both), -1)
    bond[both[: len(e)]] = np.arange(len(e))
    at = bond[both[len(e) :]]
    heard = np.flatnonzero(~alone & (at >= 0))
    for end, node in enumerate((g.u, g.v)):
        where = node[at[heard]]
        ends[heard, end] = np.where(g.own[where], place[where], -1)
    ends[~whole] = -1
    return Loci(row, kind, slots, ends), Names(row, values, np.stack([row, what, locus], axis=1))


def _int(h: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The step of xxhash64 over ints."""
    h = (h + P5 + np.uint64(4)) ^ (x.astype(np.uint64) * P1)
    return _mixed(_turn(h, 23) * P2 + P3)


def _least(values: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The least image of each row under a group; entries are slots."""
    image = values[:, group]
    code = (image * 8 ** np.arange(image.shape[2])[::-1]).sum(axis=2)
    return image[np.arange(len(image)), code.argmin(axis=1)]


def _said(conf: Loci, rank: np.ndarray, flip: np.ndarray) -> np.ndarray:
    """The hash of each configuration's kind and descriptor, of the mirror image in the rows to flip."""
    out = np.zeros(len(conf.row), np.uint64)
    for k in rotations.kinds():
        at = np.flatnonzero(conf.kind == k.kind)
        if not len(at):
            continue
        r, group = rank[conf.slots[at, : k.slots]], np.array(k.group)
        own = _least((r[:, None, :] < r[:, :, None]).sum(axis=2), group)
        own = np.where(flip[conf.row[at]][:, None], _least(own[:, list(k.mirror)], group), own)
        h = _int(np.full(len(at), 42, np.uint64), np.full(len(at), k.kind))
        for i in range(rotations.SLOTS):
            h = _int(h, own[:, i] if i < k.slots else np.zeros(len(at), np.int64))
        out[at] = h
    return out


def _heard(conf: Loci, colour: np.ndarray, rank: np.ndarray, flip: np.ndarray) -> np.ndarray:
    """Colours with what the configurations say folded in; a site without any keeps its colour."""
    said = _said(conf, rank, flip)
    who, end = np.nonzero(conf.ends >= 0)
    at = conf.ends[who, end]
    sums = _sums(at, said[who], len(colour))
    return np.where(np.bincount(at, minlength=len(colour)) > 0, xxhash64(colour, *sums), colour)


def _ranked(g: Graphs, conf: Loci, key: np.ndarray, flip: np.ndarray) -> np.ndarray:
    """The place of each site in the order of its colours, round by round, when configurations add no more classes."""
    c = g.classes(key)
    rank = g.groups(c)
    out, own = rank.copy(), np.arange(len(key))
    live, old = np.unique(conf.row), None
    while len(live):
        h, old = g.copies(live)
        conf, flip = conf.of(live, g, h), flip[live]
        g, c, rank, own = h, c[old], rank[old], own[old]
        out[own] = rank
        new = g.classes(_heard(conf, c, rank, flip))
        live = np.flatnonzero(g.counts(new) > g.counts(c))
        order = np.lexsort((new.view(np.int64), rank))
        step = np.ones(len(order), np.int64)
        step[1:] = (rank[order][1:] != rank[order][:-1]) | (new[order][1:] != new[order][:-1])
        rank = np.empty(len(order), np.int64)
        rank[order] = np.cumsum(step)
        c = new
    return out


def _settled(g: Graphs, conf: Loci, key: np.ndarray, flip: np.ndarray | None = None) -> np.ndarray:
    flip = np.zeros(g.rows, bool) if flip is None else flip
    return _heard(conf, key, _ranked(g, conf, key, flip), flip) if len(conf.row) else key


@lru_cache(maxsize=None)
def _orders(kind: int, pattern: int) -> np.ndarray:
    """The orders that a pattern of relative orders, a digit a slot, admits."""
    k = rotations.kinds()[kind]
    p = [pattern >> 3 * i & 7 for i in range(k.slots)]
    return np.array(k.admitted(p if k.ends == 1 else [p[0], p[1], p[2] + 2, p[3] + 2]))


def _patterns(loci: Loci, colour: np.ndarray, degree: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(slots in order of class within each end, pattern, number of orders, whether a tie of neighbours with bonds of their own is left)."""
    slots, n = loci.slots.copy(), len(loci.row)
    pattern, ways, tied = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, bool)
    for k in rotations.kinds():
        at = np.flatnonzero(loci.kind == k.kind)
        if not len(at):
            continue
        v, end = slots[at, : k.slots], np.arange(k.slots) // 2 if k.ends == 2 else np.zeros(k.slots, np.int64)
        v = np.take_along_axis(v, np.lexsort((v, colour.view(np.int64)[v], np.broadcast_to(end, v.shape))), axis=1)
        c, same = colour.view(np.int64)[v], end[:, None] == end
        below = (same & (c[:, None, :] < c[:, :, None])).sum(axis=2)
        like = (same & (c[:, None, :] == c[:, :, None])).sum(axis=2) > 1
        slots[at, : k.slots], tied[at] = v, (like & (degree[v] > 1)).any(axis=1)
        pattern[at] = (below << 3 * np.arange(k.slots)).sum(axis=1)
        kinds, which = np.unique(pattern[at], return_inverse=True)
        ways[at] = np.array([len(_orders(k.kind, int(p))) for p in kinds])[which]
    return slots, pattern, ways, tied


def _realizable(g: Graphs, loci: Loci, colour: np.ndarray, degree: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(which, slots in order of class, pattern, number of orders) of the loci that have more than one configuration.

    Loci whose plain classes tie neighbours with bonds of their own are tried with their anchors made individual, each
    in a copy of its row; no more than HELD sites are held at once.
    """
    flat = g.stable(colour)
    slots, pattern, ways, tied = _patterns(loci, flat, degree)
    left = np.flatnonzero((ways == 1) & tied)
    cost = np.cumsum(np.diff(g.first)[loci.row[left]])
    at = 0
    while at < len(left):
        end = max(at + 1, int(np.searchsorted(cost, (cost[at - 1] if at else 0) + HELD)))
        part = left[at:end]
        h, old = g.copies(loci.row[part])
        own = loci._moved(np.arange(len(part)), part, g, h)
        mark = np.zeros(len(old), np.uint64)
        for place in (1, 0):
            mark[own.ends[own.ends[:, place] >= 0, place]] = place + 1
        got, pattern[part], ways[part], _ = _patterns(own, h.stable(xxhash64(flat[old], mark)), degree[old])
        slots[part] = np.where(got < 0, -1, old[np.maximum(got, 0)])
        at = end
    found = np.flatnonzero(ways > 1)
    return found, slots[found], pattern[found], ways[found]


def _degree(g: Batch) -> np.ndarray:
    return np.bincount(np.concatenate([g.u, g.v]), minlength=len(g.keys))[g.own]


def stereocenters(rows: DataFrame) -> DataFrame:
    """(mol_id, locus_kind, locus_id, kind) of the loci that are stereogenic."""

    def step(g: Batch) -> Iterator[tuple[np.ndarray, list]]:
        graphs, key = _graphs(g)
        (loci, names), (conf, _) = _read(g, "loci"), _read(g, "said")
        found, *_ = _realizable(graphs, loci, _settled(graphs, conf, key), _degree(g))
        yield loci.row[found], [names.locus[found, 1], names.locus[found, 2], loci.kind[found]]

    return over(rows, step, "locus_kind int, locus_id long, kind int")


def forms(rows: DataFrame) -> DataFrame:
    """(mol_id, tag, lo, hi, k, lo1, hi1, k1, lo2, hi2, k2): certificates of the constitution, as configured, and mirrored."""

    def step(g: Batch) -> Iterator[tuple[np.ndarray, list]]:
        graphs, key = _graphs(g)
        conf, _ = _read(g, "said")
        plain = [x.copy() for x in graphs.certificates(key)]
        said = np.unique(conf.row)
        twice = np.concatenate([said, said])
        h, old = graphs.copies(twice)
        cert = h.certificates(_settled(h, conf.of(twice, graphs, h), key[old], np.arange(len(twice)) >= len(said))) if len(said) else None
        out = [plain]
        for i in (0, 1):
            own = [x.copy() for x in plain]
            for x, y in zip(own, cert or (), strict=False):
                x[said] = y[i * len(said) : (i + 1) * len(said)]
            out.append(own)
        signed = [x for lo, hi, k in out for x in (lo.view(np.int64), hi.view(np.int64), k)]
        yield np.arange(graphs.rows), [g.rows.column("tag"), *signed]

    return over(rows, step, "tag long, " + ", ".join(f"lo{i} long, hi{i} long, k{i} long" for i in ("", "1", "2")))


def branches(rows: DataFrame) -> DataFrame:
    """rows with one round of assignments made: a row for each way in which loci that open now can be assigned, with the
    configurations added to `said`; a row of which no locus is open stays, `done`.

    All open loci whose neighbours are all told apart are assigned at once, else the least open one.
    """
    kept = ("s", "c", "a", "b", "e", "t", "loci")

    def step(g: Batch) -> Iterator[tuple[np.ndarray, list]]:
        graphs, key = _graphs(g)
        (loci, names), (conf, given) = _read(g, "loci"), _read(g, "said")
        number = _numbered(np.concatenate([names.locus, given.locus]))
        open_ = np.flatnonzero(~np.isin(number[: len(loci.row)], number[len(loci.row) :]))
        found, slots, pattern, ways = _realizable(graphs, loci.at(open_), _settled(graphs, conf, key), _degree(g))
        found = open_[found]
        row, kind = loci.row[found], loci.kind[found]
        full = ways == np.array([len(k.admitted(range(k.slots))) for k in rotations.kinds()])[kind]
        order = np.lexsort((names.locus[found, 2], names.locus[found, 1], row))
        first = order[np.unique(row[order], return_index=True)[1]]
        alone = np.zeros(len(found), bool)
        alone[first] = True
        now = order[np.where(np.isin(row, row[full]), full, alone)[order]]
        found, slots, pattern, ways, row, kind = found[now], slots[now], pattern[now], ways[now], row[now], kind[now]
        # the ways of each locus, as configurations in their least order
        site = g.site[g.own]
        base = np.cumsum(ways) - ways
        pool = np.zeros((int(ways.sum()), rotations.SLOTS), np.int64)
        for k in rotations.kinds():
            for p in np.unique(pattern[kind == k.kind]):
                at = np.flatnonzero((kind == k.kind) & (pattern == p))
                turns = _orders(k.kind, int(p))
                v = site[slots[at, : k.slots]][:, turns]
                v = v.reshape(-1, k.slots)[:, np.array(k.group)]
                at = (base[at][:, None] + np.arange(len(turns))).ravel()
                pool[at, : k.slots] = v[np.arange(len(v)), np.lexsort(np.moveaxis(v, 2, 0)[::-1], axis=1)[:, 0]]
        size = np.array([k.slots for k in rotations.kinds()])[kind]
        # mixed radix: the branch counts through the ways of its loci, the least locus fastest
        many = [1] * graphs.rows
        radix = []
        for r, w in zip(row.tolist(), ways.tolist(), strict=True):
            radix.append(many[r])
            many[r] *= w
        radix, many = np.array(radix, np.int64), np.array(many, np.int64)
        new = np.bincount(row, minlength=graphs.rows)
        begin, old = np.cumsum(new) - new, np.bincount(conf.row, minlength=graphs.rows)
        start, cost = np.cumsum(old) - old, np.diff(graphs.first) + old + new + 1
        tag = g.rows.column("tag").to_numpy(zero_copy_only=False)
        column = lambda n: given.values.field(n)

        def piece(r: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, list]:
            who, e = _spans(begin[r], new[r])
            way = count[who] // radix[e] % ways[e]
            back, f = _spans(start[r], old[r])
            both = np.argsort(np.concatenate([back, who]), kind="stable")
            flat = pool[base[e] + way]
            nbrs = flat[np.arange(rotations.SLOTS) < size[e][:, None]]
            take = pa.array(f)
            joined = lambda n, x: pa.concat_arrays([column(n).take(take), x]).take(pa.array(both))
            entries = pa.StructArray.from_arrays(
                [
                    joined("locus_kind", pa.array(names.locus[found[e], 1], pa.int32())), joined("locus_id", pa.array(names.locus[found[e], 2], pa.int64())), joined("kind", pa.array(kind[e], pa.int32())),
                    joined("neighbors", _lists(size[e], nbrs).cast(column("neighbors").type)),
                ], ["locus_kind", "locus_id", "kind", "neighbors"],
            )
            said = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(old[r] + new[r])]).astype(np.int32), entries)
            own = np.where(new[r] > 0, xxhash64(tag[r].view(np.uint64), count.view(np.uint64)).view(np.int64), tag[r])
            return r, [own, *(g.rows.column(c).take(pa.array(r)) for c in kept), said, pa.array(new[r] == 0)]

        # no more than HELD sites and configurations are held at once, however many branches a row has
        at, done = 0, 0
        while at < graphs.rows:
            rs, counts, held = [], [], 0
            while at < graphs.rows and held < HELD:
                more = int(min(many[at] - done, max(1, (HELD - held) // cost[at])))
                rs.append(np.full(more, at))
                counts.append(np.arange(done, done + more))
                held, done = held + more * int(cost[at]), done + more
                if done == many[at]:
                    at, done = at + 1, 0
            yield piece(np.concatenate(rs), np.concatenate(counts))

    return over(rows, step, f"tag long, {GRAPH}, said {SAID}, done boolean")
