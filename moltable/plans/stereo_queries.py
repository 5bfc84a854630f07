"""Registered queries of stereochemistry, with SQL that finds rotation groups, chains and handedness in its own way."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import dims
from ..operators import coordination, frames, rotations, stereoforms, symmetry, valence
from ..storage import stored
from .projection import CTE, bonds, molecules, sites


def _text(c):
    return F.array_join(F.transform(c, lambda v: v.cast("string")), ",")


def _slots(kinds) -> str:
    """Fixed values of the slot directions as a SQL table."""
    rows = []
    for k in kinds:
        v = rotations.ENDS[k] if k in rotations.ENDS else coordination.DIRECTIONS[dims.GEOMETRIES[k][0]]
        rows += [f"({k}, {i}, {float(x)!r}, {float(y)!r}, {float(z)!r})" for i, (x, y, z) in enumerate(v)]
    return f"(SELECT kind, slot, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, CAST(z AS DOUBLE) AS z FROM (VALUES {', '.join(rows)}) v(kind, slot, x, y, z))"


#: All orders of up to six slots; for every kind those that keep its angles, with whether they keep the handedness too.
GROUPS = f""", slots AS {_slots(range(2, rotations.BOND))}
, sizes AS (SELECT kind, CAST(count(*) AS BIGINT) AS n FROM slots GROUP BY kind)
, orders AS (
  SELECT n, [CAST(i AS BIGINT)] AS p FROM (SELECT DISTINCT n FROM sizes), range(6) r(i) WHERE i < n
  UNION ALL SELECT n, list_append(p, i) FROM orders, range(6) r(i) WHERE i < n AND len(p) < n AND NOT list_contains(p, i)
), every AS (SELECT kind, n, p FROM orders JOIN sizes USING (n) WHERE len(p) = n
), cosines AS (SELECT a.kind, a.slot AS i, b.slot AS j, a.x * b.x + a.y * b.y + a.z * b.z AS g FROM slots a JOIN slots b USING (kind) WHERE a.slot < b.slot
), square AS (SELECT kind, i, j, g FROM cosines UNION ALL SELECT kind, j, i, g FROM cosines
), keep AS (
  SELECT e.kind, e.n, e.p FROM every e JOIN cosines c ON c.kind = e.kind JOIN square s ON s.kind = e.kind AND s.i = e.p[c.i + 1] AND s.j = e.p[c.j + 1]
  GROUP BY e.kind, e.n, e.p HAVING max(abs(s.g - c.g)) < 1e-6
), volumes AS (
  SELECT a.kind, a.slot AS i, b.slot AS j, c.slot AS k, a.x * (b.y * c.z - b.z * c.y) + a.y * (b.z * c.x - b.x * c.z) + a.z * (b.x * c.y - b.y * c.x) AS v
  FROM slots a JOIN slots b USING (kind) JOIN slots c USING (kind)
), triples AS (SELECT kind, min((i, j, k)) AS t FROM volumes WHERE abs(v) > 1e-3 AND i < j AND j < k GROUP BY kind
), turns AS (
  SELECT p.kind, p.n, p.p, coalesce(sign(w.v) = sign(v.v), true) AS proper, v.v IS NULL AS flat FROM keep p LEFT JOIN triples t ON t.kind = p.kind
  LEFT JOIN volumes v ON v.kind = p.kind AND (v.i, v.j, v.k) = t.t
  LEFT JOIN volumes w ON w.kind = p.kind AND w.i = p.p[v.i + 1] AND w.j = p.p[v.j + 1] AND w.k = p.p[v.k + 1]
)"""

DESCRIPTORS = (
    CTE
    + GROUPS
    + """, near AS (SELECT i.mol_id, i.site_id, list(s.element ORDER BY i.nbr) AS ranks FROM inc i JOIN sites s ON s.mol_id = i.mol_id AND s.site_id = i.nbr GROUP BY i.mol_id, i.site_id HAVING count(*) BETWEEN 3 AND 6)
, ranked AS (SELECT mol_id, site_id, len(ranks) AS n, list_transform(ranks, lambda r: len(list_filter(ranks, lambda s: s < r))) AS o FROM near)
, seen AS (
  SELECT mol_id, site_id, kind, proper, flat, min(list_transform(p, lambda i: o[i + 1])) AS least FROM ranked JOIN turns USING (n) GROUP BY ALL
)
SELECT a.mol_id, a.site_id, CAST(a.kind AS INT) AS kind, array_to_string(list_concat(a.least, list_transform(range(6 - len(a.least)), lambda z: 0)), ',') AS descriptor,
  array_to_string(list_concat(b.least, list_transform(range(6 - len(b.least)), lambda z: 0)), ',') AS mirror
FROM seen a JOIN seen b ON a.mol_id = b.mol_id AND a.site_id = b.site_id AND a.kind = b.kind AND a.proper AND (b.proper = b.flat) WHERE a.kind <> 2"""
)


def stereo_descriptor(spark, sf_dir: str) -> DataFrame:
    """The neighbours of each site, ascending, read as a configuration of every kind of that many slots, ranked by their elements."""
    s, b = molecules(spark, sf_dir)
    elements = s.select("mol_id", F.col("site_id").alias("nbr"), "element")
    inc = frames.incidence(b).join(elements, ["mol_id", "nbr"])
    near = inc.groupBy("mol_id", "site_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("nbr", "element"))), lambda e: e["element"]).alias("ranks")).where("size(ranks) between 3 and 6")
    kinds = F.broadcast(rotations.table(spark).where(f"kind between 3 and {rotations.BOND - 1}").select("kind", "slots"))
    out = rotations.descriptors(near.join(kinds, F.size("ranks") == F.col("slots")).drop("slots"))
    return out.select("mol_id", "site_id", "kind", _text("descriptor").alias("descriptor"), _text("mirror").alias("mirror"))


FRAMES = """, dbl AS (SELECT mol_id, bond_id, site_id AS start, nbr AS head FROM inc WHERE bond_order = 2)
, ddeg AS (SELECT mol_id, start AS site_id, count(*) AS d FROM dbl GROUP BY ALL)
, many AS (SELECT mol_id, count(*) AS k FROM dbl GROUP BY mol_id)
, walk AS (
  SELECT mol_id, bond_id, start, head, bond_id AS at, head AS last, 0 AS hops FROM dbl
  UNION ALL SELECT w.mol_id, w.bond_id, w.start, w.head, n.bond_id, n.head, w.hops + 1 FROM walk w JOIN ddeg d ON d.mol_id = w.mol_id AND d.site_id = w.last AND d.d = 2
    JOIN dbl n ON n.mol_id = w.mol_id AND n.start = w.last AND n.bond_id <> w.at JOIN many m ON m.mol_id = w.mol_id AND w.hops < m.k
), way AS (SELECT w.* FROM walk w JOIN ddeg d ON d.mol_id = w.mol_id AND d.site_id = w.last AND d.d = 1
), middle AS (
  SELECT s.mol_id, 1 AS locus_kind, s.bond_id AS locus_id, s.last AS s, t.last AS t FROM way s JOIN way t ON s.mol_id = t.mol_id AND s.bond_id = t.bond_id AND s.head < t.head AND s.hops = t.hops
  UNION ALL
  SELECT s.mol_id, 2, s.start, s.last, t.last FROM way s JOIN way t ON s.mol_id = t.mol_id AND s.start = t.start AND s.head < t.head AND s.hops = t.hops AND s.last <> t.last
    JOIN ddeg d ON d.mol_id = s.mol_id AND d.site_id = s.start AND d.d = 2
), far AS (SELECT mol_id, site_id, [min(nbr), max(nbr)] AS n FROM inc WHERE bond_order <> 2 GROUP BY ALL HAVING count(*) = 2
), frames AS (
  SELECT mol_id, 0 AS locus_kind, site_id AS locus_id, [site_id] AS anchors, list(nbr ORDER BY nbr) AS neighbors FROM inc GROUP BY mol_id, site_id HAVING count(*) BETWEEN 2 AND 6
  UNION ALL
  SELECT m.mol_id, m.locus_kind, m.locus_id, [m.s, m.t], list_concat(f.n, g.n) FROM middle m JOIN far f ON f.mol_id = m.mol_id AND f.site_id = m.s JOIN far g ON g.mol_id = m.mol_id AND g.site_id = m.t
  WHERE len(list_distinct(list_concat(f.n, g.n))) = 4
)"""


def stereo_frames(spark, sf_dir: str) -> DataFrame:
    out = frames.frames(*molecules(spark, sf_dir))
    return out.select("mol_id", "locus_kind", "locus_id", _text("anchors").alias("anchors"), _text("neighbors").alias("neighbors"))


def held(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Molecules that many steps read, stored once."""
    s = stored(sites(spark, sf_dir), "sites")
    return s, stored(bonds(s), "bonds")


def perceived(spark, sf_dir: str, *given: DataFrame) -> DataFrame:
    s, b = given or held(spark, sf_dir)
    return frames.perceive(s, b, coordination.perceive(valence.steric_numbers(s, b)))


def stereo_perceive(spark, sf_dir: str) -> DataFrame:
    """Every locus, its geometry by electron domains."""
    return perceived(spark, sf_dir).select("mol_id", "locus_kind", "locus_id", "kind", _text("neighbors").alias("neighbors"))


def stereo_perceive_four(spark, sf_dir: str) -> DataFrame:
    """Tetrahedral centres whatever their domains, double bonds and axes."""
    s, b = molecules(spark, sf_dir)
    frame = frames.frames(s, b)
    shape = frame.where("locus_kind = 0 and size(neighbors) = 4").select("mol_id", F.col("locus_id").alias("site_id"), F.lit(5).alias("geometry"))
    out = frames.perceive(s, b, shape, frame)
    return out.select("mol_id", "locus_kind", "locus_id", _text("neighbors").alias("neighbors"))


PERCEIVE_FOUR = (
    CTE
    + FRAMES
    + """, four AS (SELECT mol_id, locus_kind, locus_id, anchors[1] AS c, anchors[-1] AS d, neighbors AS v FROM frames WHERE locus_kind > 0 OR len(neighbors) = 4)
, placed AS (
  SELECT f.*, c.x AS cx, c.y AS cy, c.z AS cz, d.x - c.x AS ax, d.y - c.y AS ay, d.z - c.z AS az,
    n0.x AS x0, n0.y AS y0, n0.z AS z0, n1.x AS x1, n1.y AS y1, n1.z AS z1, n2.x AS x2, n2.y AS y2, n2.z AS z2, d.x AS dx, d.y AS dy, d.z AS dz, n3.x AS x3, n3.y AS y3, n3.z AS z3
  FROM four f JOIN sites c ON c.mol_id = f.mol_id AND c.site_id = f.c JOIN sites d ON d.mol_id = f.mol_id AND d.site_id = f.d
    JOIN sites n0 ON n0.mol_id = f.mol_id AND n0.site_id = f.v[1] JOIN sites n1 ON n1.mol_id = f.mol_id AND n1.site_id = f.v[2]
    JOIN sites n2 ON n2.mol_id = f.mol_id AND n2.site_id = f.v[3] JOIN sites n3 ON n3.mol_id = f.mol_id AND n3.site_id = f.v[4]
), unit AS (
  SELECT *, sqrt((x0-cx)*(x0-cx) + (y0-cy)*(y0-cy) + (z0-cz)*(z0-cz)) AS l0, sqrt((x1-cx)*(x1-cx) + (y1-cy)*(y1-cy) + (z1-cz)*(z1-cz)) AS l1,
    sqrt((x2-cx)*(x2-cx) + (y2-cy)*(y2-cy) + (z2-cz)*(z2-cz)) AS l2, (x3-cx)*(x3-cx) + (y3-cy)*(y3-cy) + (z3-cz)*(z3-cz) AS l3 FROM placed
), signed AS (
  SELECT *, CASE locus_kind WHEN 0 THEN CASE WHEN least(l0, l1, l2, l3) > 0 THEN -((x0-cx) * ((y1-cy)*(z2-cz) - (z1-cz)*(y2-cy)) + (y0-cy) * ((z1-cz)*(x2-cx) - (x1-cx)*(z2-cz)) + (z0-cz) * ((x1-cx)*(y2-cy) - (y1-cy)*(x2-cx))) / (l0 * l1 * l2) END
    WHEN 1 THEN ((cy-y0)*az - (cz-z0)*ay) * (ay*(z2-dz) - az*(y2-dy)) + ((cz-z0)*ax - (cx-x0)*az) * (az*(x2-dx) - ax*(z2-dz)) + ((cx-x0)*ay - (cy-y0)*ax) * (ax*(y2-dy) - ay*(x2-dx))
    ELSE ((y0-y1)*(z2-z3) - (z0-z1)*(y2-y3)) * ax + ((z0-z1)*(x2-x3) - (x0-x1)*(z2-z3)) * ay + ((x0-x1)*(y2-y3) - (y0-y1)*(x2-x3)) * az END AS value FROM unit
), ordered AS (
  SELECT mol_id, locus_kind, locus_id, CASE WHEN value > 0 THEN v WHEN locus_kind = 1 THEN [v[1], v[2], v[4], v[3]] ELSE [v[2], v[1], v[3], v[4]] END AS w FROM signed WHERE abs(value) >= 1e-9
), even AS (
  SELECT p FROM (VALUES ([1,2,3,4]), ([1,3,4,2]), ([1,4,2,3]), ([2,1,4,3]), ([2,3,1,4]), ([2,4,3,1]), ([3,1,2,4]), ([3,2,4,1]), ([3,4,1,2]), ([4,1,3,2]), ([4,2,1,3]), ([4,3,2,1])) t(p)
)
SELECT mol_id, locus_kind, locus_id, array_to_string(min(list_transform(p, lambda i: w[i])), ',') AS neighbors FROM ordered JOIN even ON locus_kind = 0 OR p IN ([1,2,3,4], [2,1,4,3], [3,4,1,2], [4,3,2,1])
GROUP BY mol_id, locus_kind, locus_id"""
)

#: The shape taken for each number of neighbours where only the graph counts.
SHAPES = {3: 3, 4: 5, 5: 9, 6: 11}


def _shapes(frame: DataFrame) -> DataFrame:
    """(mol_id, site_id, geometry) of sites with three to six neighbours, by their number."""
    n = F.size("neighbors")
    kind = F.coalesce(*(F.when(n == k, g) for k, g in SHAPES.items()))
    return frame.where((F.col("locus_kind") == 0) & n.between(3, 6)).select("mol_id", F.col("locus_id").alias("site_id"), kind.alias("geometry"))


def stereocenters(spark, sf_dir: str) -> DataFrame:
    """Stereogenic loci of the constitution, by elements and bond orders."""
    s, b = held(spark, sf_dir)
    frame = stored(frames.frames(s, b), "frames")
    return stereoforms.stereocenters(s, b, _shapes(frame), frame=frame)


def _round(k: int) -> str:
    """SQL: one round of colour refinement, under every locus at once."""
    key = "mol_id, locus_kind, locus_id"
    return f""", w{k} AS (
  SELECT {key}, site_id, dense_rank() OVER (PARTITION BY {key} ORDER BY c, env) AS c FROM (
    SELECT w.mol_id, w.locus_kind, w.locus_id, w.site_id, any_value(w.c) AS c, coalesce(list_sort(list(i.bond_order * 1000 + f.c) FILTER (f.c IS NOT NULL)), []) AS env
    FROM w{k - 1} w LEFT JOIN inc i ON i.mol_id = w.mol_id AND i.site_id = w.site_id
      LEFT JOIN w{k - 1} f ON f.mol_id = w.mol_id AND f.locus_kind = w.locus_kind AND f.locus_id = w.locus_id AND f.site_id = i.nbr GROUP BY ALL)
)"""


STEREOCENTERS = (
    CTE
    + GROUPS
    + FRAMES
    + f""", loci AS (
  SELECT *, CASE locus_kind WHEN 1 THEN {rotations.BOND} WHEN 2 THEN {rotations.AXIS} ELSE CASE len(neighbors) {" ".join(f"WHEN {n} THEN {g}" for n, g in SHAPES.items())} END END AS kind
  FROM frames WHERE locus_kind > 0 OR len(neighbors) > 2
), w0 AS (
  SELECT l.mol_id, l.locus_kind, l.locus_id, s.site_id, dense_rank() OVER (PARTITION BY l.mol_id, l.locus_kind, l.locus_id ORDER BY coalesce(list_position(l.anchors, s.site_id), 0), s.element) AS c
  FROM loci l JOIN sites s ON s.mol_id = l.mol_id
)"""
    + "".join(map(_round, range(1, 7)))
    + """, near AS (
  SELECT l.mol_id, l.locus_kind, l.locus_id, l.kind, CASE WHEN l.locus_kind > 0 THEN (list_position(l.neighbors, w.site_id) - 1) // 2 ELSE 0 END AS e, w.c FROM loci l
    JOIN w6 w ON w.mol_id = l.mol_id AND w.locus_kind = l.locus_kind AND w.locus_id = l.locus_id AND list_contains(l.neighbors, w.site_id)
), ends AS (SELECT mol_id, locus_kind, locus_id, kind, e, list_sort(list(c)) AS c FROM near GROUP BY ALL
), rigid AS (SELECT mol_id, locus_kind, locus_id, kind FROM ends WHERE locus_kind > 0 GROUP BY ALL HAVING bool_and(c[1] <> c[2])
), centre AS (SELECT mol_id, locus_kind, locus_id, kind, list_transform(c, lambda r: len(list_filter(c, lambda s: s < r))) AS o FROM ends WHERE locus_kind = 0
), shown AS (
  SELECT c.kind, c.o, e.p, min(list_transform(t.p, lambda i: c.o[e.p[i + 1] + 1])) AS least FROM (SELECT DISTINCT kind, o FROM centre) c JOIN every e ON e.kind = c.kind JOIN turns t ON t.kind = c.kind AND t.proper GROUP BY ALL
), manifold AS (SELECT kind, o FROM shown GROUP BY kind, o HAVING count(DISTINCT least) > 1)
SELECT mol_id, locus_kind, locus_id, CAST(kind AS INT) AS kind FROM rigid UNION ALL SELECT mol_id, locus_kind, locus_id, CAST(kind AS INT) AS kind FROM centre JOIN manifold USING (kind, o)"""
)


def stereo_forms(spark, sf_dir: str) -> DataFrame:
    """Identity of every molecule with the configurations that its coordinates fix, and whether it is chiral."""
    s, b = held(spark, sf_dir)
    form = stored(stereoforms.forms(s, b, stored(perceived(spark, sf_dir, s, b), "perceived")), "forms")
    return form.select("mol_id", "constitution", "configured", (F.col("configured") != F.col("mirror")).alias("is_chiral"))


def stereo_consistency_found(spark, sf_dir: str) -> DataFrame:
    """Configurations that coordinates fix against the loci that are stereogenic with them."""
    s, b = held(spark, sf_dir)
    frame, shape = stored(frames.frames(s, b), "frames"), stored(coordination.perceive(valence.steric_numbers(s, b)), "shapes")
    return stereoforms.consistency(s, b, shape, stored(frames.perceive(s, b, shape, frame), "perceived"), frame=frame)


def stereoisomers(spark, sf_dir: str) -> DataFrame:
    """How many stereoisomers each constitution has, its geometries by electron domains."""
    s, b = held(spark, sf_dir)
    got = stereoforms.stereoisomers(s, b, coordination.perceive(valence.steric_numbers(s, b)))
    return got.groupBy("mol_id").agg(F.count_distinct("isomer").alias("isomers"), F.count_distinct("locus_kind", "locus_id").alias("loci"))


def symmetry_orbits(spark, sf_dir: str) -> DataFrame:
    """The symmetry class of every site, by elements and bond orders."""
    return symmetry.orbits(*molecules(spark, sf_dir))


QUERIES = {
    "stereo_descriptor": stereo_descriptor,
    "stereo_frames": stereo_frames,
    "stereo_perceive": stereo_perceive,
    "stereo_perceive_four": stereo_perceive_four,
    "stereocenters": stereocenters,
    "stereo_forms": stereo_forms,
    "stereo_consistency_found": stereo_consistency_found,
    "stereoisomers": stereoisomers,
    "symmetry_orbits": symmetry_orbits,
}
ORACLES = {
    "stereo_descriptor": DESCRIPTORS,
    "stereo_frames": CTE + FRAMES + " SELECT mol_id, locus_kind, locus_id, array_to_string(anchors, ',') AS anchors, array_to_string(neighbors, ',') AS neighbors FROM frames",
    "stereo_perceive_four": PERCEIVE_FOUR,
    "stereocenters": STEREOCENTERS,
}
