"""Work confined to one small graph: Spark packs each molecule into a row and deals the rows out.

A packed molecule is one row of arrays, so a batch holds many molecules and no Python
call is made for each group.  Kernels get the sites and bonds of one molecule.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .. import dims
from ..model import AROMATIC, require


def packed(sites: DataFrame, bonds: DataFrame, *columns: str) -> DataFrame:
    """(mol_id, sites, bonds): arrays of structs, by site_id and bond_id; columns are further site columns."""
    require(bonds, "mol_id", "bond_id", "a", "b", "bond_order")
    s = sites.groupBy("mol_id").agg(F.array_sort(F.collect_list(F.struct("site_id", *columns))).alias("sites"))
    b = bonds.groupBy("mol_id").agg(F.array_sort(F.collect_list(F.struct("bond_id", "a", "b", "bond_order"))).alias("bonds"))
    return s.join(b, "mol_id", "left")


def per_molecule(mols: DataFrame, kernel: Callable[[list[dict], list[dict]], Iterable[tuple]], ddl: str) -> DataFrame:
    """The rows kernel gives for each molecule, with mol_id in front; ddl names the rest."""

    schema = mols.sparkSession.createDataFrame([], f"mol_id long, {ddl}").schema
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                rows = []
                for m in batch.slice(at, 500).to_pylist():
                    rows += [(m["mol_id"], *r) for r in kernel(m["sites"], m["bonds"] or [])]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    return mols.mapInArrow(run, schema)


class Graph:
    """Adjacency of one molecule: at[site] lists (neighbour, number of the bond)."""

    def __init__(self, sites: list[dict], bonds: list[dict]):
        self.sites = [s["site_id"] for s in sites]
        self.bonds = bonds
        self.at: dict[int, list[tuple[int, int]]] = {s: [] for s in self.sites}
        for i, b in enumerate(bonds):
            self.at[b["a"]].append((b["b"], i))
            self.at[b["b"]].append((b["a"], i))

    def levels(self, root: int) -> tuple[dict[int, int], dict[int, list[int]]]:
        """Distance of each site from root, and all its predecessors on shortest paths."""
        far, back, last = {root: 0}, {root: []}, [root]
        while last:
            new = []
            for x in last:
                for y, _ in self.at[x]:
                    if y not in far:
                        far[y], back[y] = far[x] + 1, []
                        new.append(y)
                    if far[y] == far[x] + 1:
                        back[y].append(x)
            last = new
        return far, back

    def bond_mask(self, path: list[int]) -> int:
        mask = 0
        for x, y in zip(path, path[1:], strict=False):
            mask |= 1 << next(i for z, i in self.at[x] if z == y)
        return mask

    def cycles(self) -> list[tuple[int, int]]:
        """(size, bond mask) of cycles made of two shortest paths of equal length from a site, closed by a bond or a site."""
        out = set()
        for root in self.sites:
            far, back = self.levels(root)

            def paths(x: int) -> list[list[int]]:
                return [[root]] if x == root else [p + [x] for y in back[x] for p in paths(y)]  # noqa: B023

            for x in far:
                ends = [(y, [y]) for y, _ in self.at[x] if far.get(y) == far[x] and x < y]
                ends += [(y, [z, y]) for z, _ in self.at[x] if far.get(z) == far[x] + 1 for y in back[z] if x < y]
                for y, way in ends:
                    for p in paths(x):
                        for q in paths(y):
                            if len(set(p) & set(q)) == 1:
                                mask = self.bond_mask(p + way[:-1] + q[:0:-1] + [root])
                                out.add((mask.bit_count(), mask))
        return sorted(out)

    def ring_sites(self, mask: int) -> list[int]:
        """Sites of a cycle from the least one toward its smaller neighbour."""
        near: dict[int, list[int]] = {}
        for i, b in enumerate(self.bonds):
            if mask >> i & 1:
                near.setdefault(b["a"], []).append(b["b"])
                near.setdefault(b["b"], []).append(b["a"])
        start = min(near)
        out, x = [start], min(near[start])
        while x != start:
            out.append(x)
            x = next(y for y in near[x] if y != out[-2])
        return out


class Span:
    """Bond sets spanned over GF(2), by leading bit."""

    def __init__(self):
        self.rows: dict[int, int] = {}

    def rest(self, mask: int) -> int:
        while mask and (lead := mask.bit_length()) in self.rows:
            mask ^= self.rows[lead]
        return mask

    def add(self, mask: int) -> bool:
        mask = self.rest(mask)
        if mask:
            self.rows[mask.bit_length()] = mask
        return bool(mask)


def minimum_basis(g: Graph) -> list[int]:
    span = Span()
    return [mask for _, mask in g.cycles() if span.add(mask)]


def _rings(sites, bonds):
    g = Graph(sites, bonds)
    for k, mask in enumerate(minimum_basis(g)):
        ring = g.ring_sites(mask)
        yield k, len(ring), ring


def rings(mols: DataFrame) -> DataFrame:
    """(mol_id, ring, size, sites): a minimum cycle basis, by size; which of equal cycles are taken is not determined."""
    return per_molecule(mols, _rings, "ring long, size long, sites array<long>")


def relevant_families(g: Graph) -> list[list[int]]:
    """Unique ring families: relevant cycles of one size that overlap and differ by smaller cycles only."""
    out: list[list[int]] = []
    smaller, pending, size = Span(), [], 0
    for n, mask in [*g.cycles(), (1 << 30, 0)]:
        if n != size:
            groups: list[list[int]] = []
            for m in pending:
                near = [f for f in groups if any(m & c and not smaller.rest(m ^ c) for c in f)]
                groups = [f for f in groups if f not in near] + [[m, *(c for f in near for c in f)]]
            out += groups
            for m in pending:
                smaller.add(m)
            pending, size = [], n
        if mask and smaller.rest(mask):
            pending.append(mask)
    return out


def _families(sites, bonds):
    g = Graph(sites, bonds)
    for k, f in enumerate(relevant_families(g)):
        cover = sorted({s for m in f for s in g.ring_sites(m)})
        yield k, f[0].bit_count(), len(f), cover


def ring_families(mols: DataFrame) -> DataFrame:
    """(mol_id, family, size, cycles, sites): size of its rings, how many, and the sites they cover."""
    return per_molecule(mols, _families, "family long, size long, cycles long, sites array<long>")


def ring_systems(ring: DataFrame) -> DataFrame:
    """(mol_id, ring, system): rings that share a site coalesce; a system is named by its least ring."""
    from .topology import components

    at = ring.select("mol_id", "ring", F.explode("sites").alias("s"))
    lead = at.groupBy("mol_id", "s").agg(F.min("ring").alias("b"))
    edge = at.join(lead, ["mol_id", "s"]).where("ring <> b").select("mol_id", F.col("ring").alias("a"), "b").distinct().withColumn("bond_id", F.lit(0))
    part = components(ring.select("mol_id", F.col("ring").alias("site_id")), edge)
    return part.select("mol_id", F.col("site_id").alias("ring"), F.col("component").alias("system"))


def bridgeheads(ring: DataFrame, bonds: DataFrame) -> DataFrame:
    """(mol_id, site_id): of each two basis rings that share two bonds or more, the sites at exactly one shared bond."""
    side = F.explode(F.transform(F.arrays_zip("sites", F.concat(F.slice("sites", 2, F.size("sites")), F.slice("sites", 1, 1)).alias("n")), lambda z: F.struct(F.least(z["sites"], z["n"]).alias("a"), F.greatest(z["sites"], z["n"]).alias("b"))))
    edge = ring.select("mol_id", "ring", side.alias("e")).select("mol_id", "ring", "e.a", "e.b")
    both = edge.join(edge.withColumnRenamed("ring", "ring2"), ["mol_id", "a", "b"]).where("ring < ring2")
    many = both.groupBy("mol_id", "ring", "ring2").agg(F.count("*").alias("k")).where("k > 1").drop("k")
    end = both.join(many, ["mol_id", "ring", "ring2"]).select("mol_id", "ring", "ring2", F.explode(F.array("a", "b")).alias("site_id"))
    return end.groupBy("mol_id", "ring", "ring2", "site_id").agg(F.count("*").alias("k")).where("k = 1").select("mol_id", "site_id").distinct()


def perfect_matching(near: dict[int, list[int]]) -> dict[int, int] | None:
    """Partners of all vertices, or None.  Augmenting paths; an odd cycle met on the way is shrunk to its base."""
    mate: dict[int, int] = {}

    def augment(root: int) -> bool:
        parent: dict[int, int] = {}
        base = {v: v for v in near}
        outer, queue = {root}, [root]

        def common(a: int, b: int) -> int:
            seen = set()
            while True:
                a = base[a]
                seen.add(a)
                if a == root:
                    break
                a = parent[mate[a]]
            while base[b] not in seen:
                b = parent[mate[base[b]]]
            return base[b]

        def shrink(v: int, top: int, child: int, into: set[int]) -> None:
            while base[v] != top:
                into |= {base[v], base[mate[v]]}
                parent[v] = child
                child = mate[v]
                v = parent[mate[v]]

        while queue:
            v = queue.pop(0)
            for w in near[v]:
                if base[v] == base[w] or mate.get(v) == w:
                    continue
                if w == root or w in mate and mate[w] in parent:
                    top, petals = common(v, w), set()
                    shrink(v, top, w, petals)
                    shrink(w, top, v, petals)
                    for x in near:
                        if base[x] in petals:
                            base[x] = top
                            if x not in outer:
                                outer.add(x)
                                queue.append(x)
                elif w not in parent:
                    parent[w] = v
                    if w not in mate:
                        while w is not None:
                            v = parent[w]
                            after = mate.get(v)
                            mate[v], mate[w] = w, v
                            w = after
                        return True
                    outer.add(mate[w])
                    queue.append(mate[w])
        return False

    return mate if all(v in mate or augment(v) for v in sorted(near)) else None


def _demand(site: dict, orders: list[int]) -> bool | None:
    """Whether an atom takes a double bond when its aromatic bonds count as single; None if it can't be aromatic."""
    electrons = dims.valence_electrons(site["element"])
    if electrons is None or any(o > 3 and o != AROMATIC for o in orders):
        return None
    free = electrons - site["formal_charge"] - site["radical_electrons"] - sum(1 if o == AROMATIC else o for o in orders)
    return None if free < 0 else free % 2 == 1


def _kekulize(sites, bonds):
    aromatic = [b for b in bonds if b["bond_order"] == AROMATIC]
    if not aromatic:
        return
    orders: dict[int, list[int]] = {s["site_id"]: [] for s in sites}
    for b in bonds:
        orders[b["a"]].append(b["bond_order"])
        orders[b["b"]].append(b["bond_order"])
    ends = {s for b in aromatic for s in (b["a"], b["b"])}
    want = {s["site_id"]: _demand(s, orders[s["site_id"]]) for s in sites if s["site_id"] in ends}
    near = {s: [] for s, w in want.items() if w}
    for b in aromatic:
        if b["a"] in near and b["b"] in near:
            near[b["a"]].append(b["b"])
            near[b["b"]].append(b["a"])
    mate = None if None in want.values() else perfect_matching(near)
    for b in aromatic:
        yield b["bond_id"], None if mate is None else 2 if mate.get(b["a"]) == b["b"] else 1


def kekulize(mols: DataFrame) -> DataFrame:
    """(mol_id, bond_id, kekule_order) of aromatic bonds: 1 or 2, null where no structure exists.  Needs element, formal_charge,
    radical_electrons in packed sites; which of several structures is given is not determined."""
    mols = mols.where(F.exists("bonds", lambda e: e["bond_order"] == AROMATIC))
    return per_molecule(mols, _kekulize, "bond_id long, kekule_order int")


def _perimeters(g: Graph, basis: list[int]) -> list[tuple[int, int]]:
    """(rim, all bonds) of groups of two or more rings that share sites: the rim has the bonds in an odd number of rings."""
    groups: list[tuple[set[int], list[int]]] = []
    for m in basis:
        own, ring = set(g.ring_sites(m)), [m]
        rest = []
        for s, r in groups:
            if s & own:
                own, ring = own | s, ring + r
            else:
                rest.append((s, r))
        groups = [*rest, (own, ring)]
    out = []
    for _, ring in groups:
        if len(ring) > 1:
            rim = cover = 0
            for m in ring:
                rim, cover = rim ^ m, cover | m
            out.append((rim, cover))
    return out


def _is_cycle(g: Graph, mask: int) -> bool:
    count: dict[int, int] = {}
    for i, b in enumerate(g.bonds):
        if mask >> i & 1:
            for s in (b["a"], b["b"]):
                count[s] = count.get(s, 0) + 1
    return bool(count) and set(count.values()) == {2} and len(g.ring_sites(mask)) == len(count)


def _contribution(g: Graph, site: dict, kinds: dict[int, int], ring_bonds: int) -> int | None:
    """Electrons that a ring atom gives to a pi system, None if it can't belong to one."""
    inside = outside = total = 0
    across = None
    for other, i in g.at[site["site_id"]]:
        order = g.bonds[i]["bond_order"]
        if order not in (1, 2, 3):
            return None
        total += order
        if order > 1:
            if ring_bonds >> i & 1:
                inside += order - 1
            else:
                outside, across = outside + order - 1, other
    if inside + outside > 1:
        return None
    if inside:
        return 1
    if across is not None:
        mine, theirs = (dims.PAULING[z - 1] if z <= len(dims.PAULING) else "-" for z in (site["element"], kinds[across]))
        return 0 if "-" not in (mine, theirs) and float(theirs) > float(mine) else None
    electrons = dims.valence_electrons(site["element"])
    free = None if electrons is None else electrons - site["formal_charge"] - total - site["radical_electrons"]
    if free is None or free < 0:
        return None
    if free // 2 >= 1:
        return 2
    if site["radical_electrons"] >= 1 or len(g.at[site["site_id"]]) > 3:
        return None
    return 0


def _aromatic(sites, bonds):
    g = Graph(sites, bonds)
    basis = minimum_basis(g)
    ring_bonds = 0
    for m in basis:
        ring_bonds |= m
    kinds = {s["site_id"]: s["element"] for s in sites}
    in_ring = {x for i, b in enumerate(bonds) if ring_bonds >> i & 1 for x in (b["a"], b["b"])}
    gives = {s["site_id"]: _contribution(g, s, kinds, ring_bonds) for s in sites if s["site_id"] in in_ring}

    def hueckel(mask: int) -> bool:
        parts = [gives[s] for s in g.ring_sites(mask)]
        return None not in parts and sum(parts) % 4 == 2

    mark = 0
    for m in basis:
        if hueckel(m):
            mark |= m
    for rim, cover in _perimeters(g, basis):
        if _is_cycle(g, rim) and hueckel(rim):
            mark |= cover
    for i, b in enumerate(bonds):
        if mark >> i & 1:
            yield (b["bond_id"],)


def aromatic_bonds(mols: DataFrame) -> DataFrame:
    """(mol_id, bond_id): bonds of rings with 4n + 2 pi electrons, and of fused groups whose outer rim has them.

    Needs localised orders: beside an aromatic order an atom is not aromatic.
    """
    return per_molecule(mols, _aromatic, "bond_id long")


def _refined(g: Graph, colour: dict[int, int]) -> dict[int, int]:
    while True:
        key = {s: (colour[s], sorted((g.bonds[i]["bond_order"], colour[y]) for y, i in g.at[s])) for s in g.sites}
        dense = {k: i for i, k in enumerate(sorted({(c, tuple(e)) for c, e in key.values()}))}
        new = {s: dense[(key[s][0], tuple(key[s][1]))] for s in g.sites}
        if len(dense) == len(set(colour.values())):
            return new
        colour = new


def _dense(values: dict[int, object]) -> dict[int, int]:
    place = {v: i for i, v in enumerate(sorted(set(values.values())))}
    return {s: place[v] for s, v in values.items()}


class Labelling:
    """Canonical numbering of one molecule by individualisation and refinement.

    form is the least (kinds by rank, bonds by ranks) of all leaves, order its sites by rank, orbit the least site that
    an automorphism maps on each.  Two leaves of one form give an automorphism: the search then goes back to where
    their paths part, and a node skips sites that the automorphisms fixing its path map on one already tried.
    """

    def __init__(self, g: Graph, kinds: dict[int, object]):
        self.g, self.kinds = g, kinds
        self.found: list[dict[int, int]] = []
        self.first = self.best = None
        self._search([], _refined(g, _dense(kinds)))
        self.form, self.order, _ = self.best
        self.orbit = self._orbits([])

    def _orbits(self, path: list[int]) -> dict[int, int]:
        """The least site of each site's orbit under the automorphisms found that fix a path."""
        root = {s: s for s in self.g.sites}

        def top(s):
            while root[s] != s:
                s = root[s]
            return s

        for image in self.found:
            if all(image[s] == s for s in path):
                for s, t in image.items():
                    low, high = sorted((top(s), top(t)))
                    root[high] = low
        return {s: top(s) for s in self.g.sites}

    def _search(self, path: list[int], colour: dict[int, int]) -> int:
        """The depth of the node that goes on."""
        cells: dict[int, list[int]] = {}
        for s, c in colour.items():
            cells.setdefault(c, []).append(s)
        cell = min(((len(v), c) for c, v in cells.items() if len(v) > 1), default=None)
        if cell is None:
            return self._leaf(path, sorted(self.g.sites, key=colour.get))
        tried: list[int] = []
        for s in cells[cell[1]]:
            orbit = self._orbits(path) if tried else {}
            if any(orbit[s] == orbit[x] for x in tried):
                continue
            depth = self._search([*path, s], _refined(self.g, {x: 2 * c + (x != s) for x, c in colour.items()}))
            if depth < len(path):
                return depth
            tried.append(s)
        return len(path)

    def _leaf(self, path: list[int], order: list[int]) -> int:
        rank = {s: i for i, s in enumerate(order)}
        form = tuple(self.kinds[s] for s in order), tuple(sorted((*sorted((rank[b["a"]], rank[b["b"]])), b["bond_order"]) for b in self.g.bonds))
        if self.first is None:
            self.first = self.best = form, order, path
            return len(path)
        for known, before, way in (self.first, self.best):
            if known == form:
                self.found.append(dict(zip(before, order, strict=True)))
                return next(i for i, (x, y) in enumerate(zip(way, path, strict=False)) if x != y)
        if form < self.best[0]:
            self.best = form, order, path
        return len(path)


def _kind(site: dict, columns: tuple[str, ...]) -> tuple:
    """A site's values in the order of columns, nulls first."""
    return tuple((site[c] is not None, site[c] if site[c] is not None else 0) for c in columns)


def canonicalize(mols: DataFrame, *columns: str) -> DataFrame:
    """(mol_id, form): equal for molecules that are isomorphic by bond order and the packed site columns given, and only
    for those; by element where none is given."""
    keys = columns or ("element",)

    def kernel(sites, bonds):
        kinds, edges = Labelling(Graph(sites, bonds), {s["site_id"]: _kind(s, keys) for s in sites}).form
        yield (";".join(",".join(str(v) if known else "" for known, v in k) for k in kinds) + "|" + ";".join("-".join(map(str, e)) for e in edges),)

    return per_molecule(mols, kernel, "form string")


def canonical_ranks(mols: DataFrame, *columns: str) -> DataFrame:
    """(mol_id, site_id, rank, orbit): each site's place, from 0, in the canonical numbering by bond order and the packed
    site columns given (element where none is), and the least site that an automorphism of these maps on it."""
    keys = columns or ("element",)

    def kernel(sites, bonds):
        found = Labelling(Graph(sites, bonds), {s["site_id"]: _kind(s, keys) for s in sites})
        for i, s in enumerate(found.order):
            yield s, i, found.orbit[s]

    return per_molecule(mols, kernel, "site_id long, rank long, orbit long")


def _orbits(sites, bonds):
    g = Graph(sites, [b | {"bond_order": 1} for b in bonds])
    yield from Labelling(g, dict.fromkeys(g.sites, 0)).orbit.items()


def orbits(mols: DataFrame) -> DataFrame:
    """(mol_id, site_id, orbit): sites that an automorphism of the bare skeleton maps on each other; named by the least."""
    return per_molecule(mols, _orbits, "site_id long, orbit long")


def _dfs(sites, bonds):
    g = Graph(sites, bonds)
    stack, seen, k = [g.sites[0]], {g.sites[0]}, 0
    while stack:
        x = stack.pop()
        yield x, k
        k += 1
        for y, _ in g.at[x]:
            if y not in seen:
                seen.add(y)
                stack.append(y)


def dfs(mols: DataFrame) -> DataFrame:
    """(mol_id, site_id, position) from each molecule's first site; a neighbour counts as seen once it is on the stack."""
    return per_molecule(mols, _dfs, "site_id long, position long")


def common_bonds(g: Graph, h: Graph, same_site, same_bond) -> tuple[int, tuple[tuple[int, int], ...]]:
    """Bonds of the largest connected set that both graphs share, and the least map of sites that shows one.

    Sets of bonds of g grow by one neighbouring bond at a time; a set goes on with all its embeddings in h,
    each a map of sites, and is dropped when none is left.
    """
    best, shown = 0, ()
    level: dict[int, set[tuple[tuple[int, int], ...]]] = {}
    for i, b in enumerate(g.bonds):
        maps = set()
        for c in h.bonds:
            if same_bond(b, c):
                for x, y in ((c["a"], c["b"]), (c["b"], c["a"])):
                    if same_site(b["a"], x) and same_site(b["b"], y):
                        maps.add(tuple(sorted(((b["a"], x), (b["b"], y)))))
        if maps:
            level[1 << i] = maps
    while level:
        best, shown = best + 1, min(m for maps in level.values() for m in maps)
        after: dict[int, set[tuple[tuple[int, int], ...]]] = {}
        for mask, maps in level.items():
            inside = {s for s, _ in next(iter(maps))}
            for i in {i for s in inside for _, i in g.at[s] if not mask >> i & 1}:
                if mask | 1 << i in after:
                    continue
                b, grown = g.bonds[i], set()
                for m in maps:
                    image = dict(m)
                    for s, t in ((b["a"], b["b"]), (b["b"], b["a"])):
                        if s not in image:
                            continue
                        for y, j in h.at[image[s]]:
                            if same_bond(b, h.bonds[j]) and (image.get(t) == y or t not in image and y not in image.values() and same_site(t, y)):
                                grown.add(tuple(sorted({**image, t: y}.items())))
                        if t in image:
                            break
                if grown:
                    after[mask | 1 << i] = grown
        level = after
    return best, shown


def common_substructure(pairs: DataFrame, mols: DataFrame) -> DataFrame:
    """(a, b, bonds, site_map): maximum connected common substructure of pairs (a, b) of packed molecules: how many
    bonds it has, and which site of a (from) is which of b (to), ascending; no sites where no bond is shared.

    Elements and bond orders must be equal.  Bonds of the smaller molecule are grown; the search is exponential
    in its size in the worst case.
    """
    side = lambda k: mols.select(F.col("mol_id").alias(k), F.col("sites").alias(f"s{k}"), F.col("bonds").alias(f"b{k}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sa", "ba", "sb", "bb")
    ddl = "a long, b long, bonds long, site_map array<struct<from: long, to: long>>"
    schema = to_arrow_schema(pairs.sparkSession.createDataFrame([], ddl).schema)

    def run(batches):
        for batch in batches:
            rows = []
            for m in batch.to_pylist():
                g, h = Graph(m["sa"], m["ba"] or []), Graph(m["sb"], m["bb"] or [])
                kinds, others = ({s["site_id"]: s["element"] for s in m[k]} for k in ("sa", "sb"))
                turned = len(g.bonds) > len(h.bonds)
                if turned:
                    g, h, kinds, others = h, g, others, kinds
                size, shown = common_bonds(g, h, lambda x, y, k=kinds, o=others: k[x] == o[y], lambda p, q: p["bond_order"] == q["bond_order"])
                rows.append((m["a"], m["b"], size, [{"from": x, "to": y} for x, y in sorted((y, x) if turned else (x, y) for x, y in shown)]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return both.mapInArrow(run, ddl)
