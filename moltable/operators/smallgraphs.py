"""Graphs of ordinary molecules, one to a row of arrays: steps over all the graphs of an Arrow batch at once.

The nodes of a batch are numbered by molecule and site, so that many graphs are one graph without bonds between them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import stored

#: Molecules of up to so many sites are one row each; larger ones go through joins, with the same results.
PACKED = 200
#: How many distances are held at once.
HELD = 400_000


def split(sites: DataFrame, bonds: DataFrame, *more: DataFrame) -> tuple[DataFrame | None, DataFrame | None]:
    """(rows, large): rows (mol_id, s, a, b, ...) of sites and ends of bonds, each of `more` (mol_id, array) joined by
    molecule, and mol_id of the molecules too large for a row.  None where there are none, or where ids are no whole numbers."""
    size = sites.groupBy("mol_id").agg(F.count("*").alias("n"))
    if not all(isinstance(df.schema[c].dataType, T.IntegralType) for df, c in ((sites, "site_id"), (bonds, "a"), (bonds, "b"))):
        return None, size.select("mol_id")
    large = stored(size.where(F.col("n") > PACKED).select("mol_id"), "large")
    large = None if large.isEmpty() else large
    one, two = (sites, bonds) if large is None else (without(sites, large), without(bonds, large))
    row = one.groupBy("mol_id").agg(F.array_sort(F.collect_list(F.col("site_id").cast("long"))).alias("s"))
    edge = two.groupBy("mol_id").agg(F.collect_list(F.struct(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))).alias("e"))
    row = row.join(edge, "mol_id", "left")
    for df in more:
        row = row.join(df, "mol_id")
    return row.select("mol_id", "s", F.col("e.a").alias("a"), F.col("e.b").alias("b"), *(c for df in more for c in df.columns[1:])), large


def within(df: DataFrame, large: DataFrame) -> DataFrame:
    return df.join(large, "mol_id", "left_semi")


def without(df: DataFrame, large: DataFrame) -> DataFrame:
    return df.join(large, "mol_id", "left_anti")


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(place of the row, value) of all entries of a column of arrays; a null array has none."""
    size = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(column)), size), column.flatten().to_numpy(zero_copy_only=False)


class Batch:
    """The graphs of some rows: nodes in order of row and site (`row`, `site`), bonds from both ends (`near` from `first`)."""

    def __init__(self, rows: pa.RecordBatch):
        self.rows = rows
        (r, s), (ra, a), (rb, b) = (_flat(rows.column(n)) for n in ("s", "a", "b"))
        self.values = np.unique(np.concatenate([s, a, b]))
        key, ka, kb = self._key(r, s), self._key(ra, a), self._key(rb, b)
        self.keys = np.unique(np.concatenate([key, ka, kb]))
        self.row, at = np.divmod(self.keys, max(len(self.values), 1))
        self.site = self.values[at] if len(at) else at
        self.own = np.isin(self.keys, key, assume_unique=False)  # nodes that are sites, not just ends of bonds
        self.start = np.searchsorted(self.row, np.arange(rows.num_rows + 1))  # of each row's nodes
        self.u, self.v = np.searchsorted(self.keys, ka), np.searchsorted(self.keys, kb)
        ends = np.concatenate([self.u, self.v])
        order = np.argsort(ends, kind="stable")
        self.near = np.concatenate([self.v, self.u])[order]
        self.first = np.searchsorted(ends[order], np.arange(len(self.keys) + 1))

    def _key(self, row: np.ndarray, site: np.ndarray) -> np.ndarray:
        return row * len(self.values) + np.searchsorted(self.values, site)

    def nodes(self, row: np.ndarray, site: np.ndarray) -> np.ndarray:
        """Nodes of sites, -1 for what is no site."""
        at = np.minimum(np.searchsorted(self.values, site), max(len(self.values) - 1, 0))
        key = row * len(self.values) + at
        place = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
        return np.where((self.values[at] == site) & (self.keys[place] == key) & self.own[place], place, -1)

    def around(self, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in `node`, neighbour) of all neighbours."""
        many = self.first[node + 1] - self.first[node]
        back = np.repeat(np.arange(len(node)), many)
        return back, self.near[np.repeat(self.first[node], many) + np.arange(len(back)) - np.repeat(np.cumsum(many) - many, many)]

    def hops(self, start: np.ndarray, depth: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(base, far): the hops from start[k] to node v stand at far[base[k] + v], -1 out of reach."""
        low, size = self.start[self.row[start]], np.diff(self.start)[self.row[start]]
        base = np.cumsum(size) - size - low
        far = np.full(int(size.sum()), -1, np.int32)
        who, at, d = np.arange(len(start)), start, 0
        far[base + start] = 0
        while len(at) and (depth is None or d < depth):
            d += 1
            back, to = self.around(at)
            place = base[who[back]] + to
            new, one = np.unique(place, return_index=True)
            free = far[new] < 0
            far[new[free]] = d
            who, at = who[back][one[free]], to[one[free]]
        return base, far

    def components(self) -> np.ndarray:
        """The least node that each is connected with, over bonds between sites."""
        both = self.own[self.u] & self.own[self.v]
        u, v = self.u[both], self.v[both]
        label = np.arange(len(self.keys))
        while True:
            new = label.copy()
            np.minimum.at(new, u, label[v])
            np.minimum.at(new, v, label[u])
            new = new[new]
            if (new == label).all():
                return label
            label = new

    def core(self) -> np.ndarray:
        """Whether a node keeps two bonds when those with fewer are taken off again and again."""
        u, v = self.u, self.v
        while True:
            many = np.bincount(np.concatenate([u, v]), minlength=len(self.keys))
            stay = (many[u] > 1) & (many[v] > 1)
            if stay.all():
                return many > 1
            u, v = u[stay], v[stay]


def over(rows: DataFrame, step: Callable[[Batch], Iterator[tuple[np.ndarray, list]]], ddl: str, square: bool = False) -> DataFrame:
    """mol_id and the columns that step gives (place of the row, [columns]) for batches of rows; square: a batch is cut so
    that the squares of its sizes stay bounded."""
    mol = rows.schema["mol_id"].dataType
    schema = T.StructType([T.StructField("mol_id", mol), *T._parse_datatype_string(ddl).fields])

    def parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        size = batch.column("s").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        cost = np.cumsum(size * size if square else size)
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(cost, (cost[at - 1] if at else 0) + HELD)))
            yield batch.slice(at, end - at)
            at = end

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            for part in parts(batch):
                for row, columns in step(Batch(part)):
                    yield pa.RecordBatch.from_arrays([part.column("mol_id").take(pa.array(row)), *(c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, list(arrow)[1:], strict=True))], schema=arrow)

    return rows.mapInArrow(run, schema)


def components(rows: DataFrame) -> DataFrame:
    """(mol_id, site_id, component)."""

    def step(g: Batch):
        yield g.row[g.own], [g.site[g.own], g.site[g.components()[g.own]]]

    return over(rows, step, "site_id long, component long")


def distances(rows: DataFrame, depth: int | None = None) -> DataFrame:
    """(mol_id, a, b, d)."""

    def step(g: Batch):
        start = np.flatnonzero(g.own)
        base, far = g.hops(start, depth)
        size = np.diff(g.start)[g.row[start]]
        a = np.repeat(start, size)
        b = np.arange(len(far)) - np.repeat(base, size)
        near = far >= 0
        yield g.row[a[near]], [g.site[a[near]], g.site[b[near]], far[near]]

    return over(rows, step, "a long, b long, d int", square=True)


def paths(rows: DataFrame) -> DataFrame:
    """(mol_id, a, b, path): all shortest paths of the pairs that the column `ends` of rows lists."""

    def step(g: Batch):
        ends = g.rows.column("ends")
        row = _flat(ends)[0]
        a, b = (g.nodes(row, ends.flatten().field(n).to_numpy(zero_copy_only=False)) for n in ("a", "b"))
        known = (a >= 0) & (b >= 0)
        a, b = a[known], b[known]
        base, far = g.hops(a)
        left = [(np.flatnonzero(far[base + b] >= 0), b[far[base + b] >= 0][:, None])]
        while left:
            # ways back from b; a wide front is cut, so that what is held stays bounded
            who, way = left.pop()
            if len(who) > HELD:
                left += [(who[::2], way[::2]), (who[1::2], way[1::2])]
                continue
            d = far[base[who] + way[:, 0]]
            end = d == 0
            if end.any():
                own, found = who[end], way[end]
                yield g.row[a[own]], [g.site[a[own]], g.site[b[own]], pa.ListArray.from_arrays(np.arange(len(own) + 1, dtype=np.int32) * found.shape[1], g.site[found].ravel())]
            who, way, d = who[~end], way[~end], d[~end]
            back, to = g.around(way[:, 0])
            nearer = far[base[who[back]] + to] == d[back] - 1
            if nearer.any():
                back, to = back[nearer], to[nearer]
                left.append((who[back], np.column_stack([to, way[back]])))

    return over(rows, step, "a long, b long, path array<long>")


def core(rows: DataFrame) -> DataFrame:
    """(mol_id, site_id) of the sites that are left when sites of fewer than two bonds are taken off again and again."""

    def step(g: Batch):
        kept = g.core()
        yield g.row[kept], [g.site[kept]]

    return over(rows, step, "site_id long")
