"""Registered queries of the molecular operators, each with its DuckDB equivalent where SQL has one."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import dims
from ..functions import tensor
from ..model import AROMATIC, bound, degrees
from ..operators import composition, conjugation, coordination, fingerprint, frames, geometry, isomorphism, kernels, lattice, notation, stereo, topology, valence
from ..sources import xyz
from ..storage import shared_dir, stored
from . import stereo_queries
from .projection import CTE, bonds, molecules, sites, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return put


HILL = """, comp AS (SELECT mol_id, element, count(*) AS n, sum(formal_charge) AS charge FROM sites GROUP BY mol_id, element)
, tot AS (SELECT mol_id, bool_or(element = 6) AS carbon, CAST(sum(charge) AS BIGINT) AS charge FROM comp GROUP BY mol_id)
, hill AS (SELECT t.mol_id, t.charge, string_agg(d.symbol || CASE WHEN c.n > 1 THEN CAST(c.n AS VARCHAR) ELSE '' END, ''
    ORDER BY CASE WHEN NOT carbon THEN 2 WHEN d.symbol = 'C' THEN 0 WHEN d.symbol = 'H' THEN 1 ELSE 2 END, d.symbol)
    || CASE WHEN t.charge > 1 THEN '+' || CAST(t.charge AS VARCHAR) WHEN t.charge = 1 THEN '+' WHEN t.charge = -1 THEN '-' WHEN t.charge < -1 THEN CAST(t.charge AS VARCHAR) ELSE '' END AS formula
  FROM tot t JOIN comp c USING (mol_id) JOIN dim d USING (element) GROUP BY t.mol_id, t.charge)"""


@query("formula_write", CTE + HILL + " SELECT mol_id, formula, charge FROM hill")
def formula_write(spark, sf_dir):
    return notation.write(composition.elemental(sites(spark, sf_dir)))


@query("comp_elemental", CTE + " SELECT mol_id, CAST(element AS INT) AS element, count(*) AS n, CAST(sum(formal_charge) AS BIGINT) AS charge FROM sites GROUP BY mol_id, element")
def comp_elemental(spark, sf_dir):
    return composition.elemental(sites(spark, sf_dir))


@query("comp_isotopic", CTE + " SELECT mol_id, CAST(element AS INT) AS element, CAST(mass_number AS INT) AS mass_number, count(*) AS n, CAST(sum(formal_charge) AS BIGINT) AS charge FROM sites GROUP BY mol_id, element, mass_number")
def comp_isotopic(spark, sf_dir):
    return composition.isotopic(sites(spark, sf_dir))


@query(
    "comp_totals",
    CTE + """, c AS (SELECT mol_id, element, mass_number, count(*) AS n, sum(formal_charge) AS q FROM sites GROUP BY ALL)
SELECT mol_id, CAST(sum(n) AS BIGINT) AS atom_count, count(*) AS species, CAST(sum(q) AS BIGINT) AS charge, CAST(sum(n) FILTER (element = 6) AS BIGINT) AS carbons FROM c GROUP BY mol_id""",
)
def comp_totals(spark, sf_dir):
    out = composition.totals(composition.isotopic(sites(spark, sf_dir)))
    return out.select(
        "mol_id", "atom_count", "species", "charge", F.expr("try_element_at(filter(element_counts, e -> e.element = 6), 1).n").alias("carbons")
    )


@query("comp_from_counts", CTE + " SELECT mol_id, CAST(element AS INT) AS element, count(*) AS n, CAST(sum(formal_charge) AS BIGINT) AS charge FROM sites GROUP BY mol_id, element")
def comp_from_counts(spark, sf_dir):
    part = composition.isotopic(sites(spark, sf_dir))
    none = part.select("mol_id", F.lit(9).alias("element"), "mass_number", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("charge"))
    return composition.from_counts(part.unionByName(none), "mol_id", "element")


@query(
    "comp_empirical",
    CTE + """, c AS (SELECT mol_id, element, count(*) AS n FROM sites GROUP BY ALL), q AS (SELECT mol_id, CAST(sum(formal_charge) AS BIGINT) AS charge FROM sites GROUP BY mol_id)
, g AS (SELECT c.mol_id, q.charge, greatest(1, list_reduce(list_append(list(CAST(n AS BIGINT)), abs(q.charge)), lambda a, b: gcd(a, b))) AS g FROM c JOIN q USING (mol_id) GROUP BY c.mol_id, q.charge)
SELECT c.mol_id, CAST(c.element AS INT) AS element, CAST(c.n // g.g AS BIGINT) AS n, CAST(sign(g.charge) * (abs(g.charge) // g.g) AS BIGINT) AS mol_charge FROM c JOIN g USING (mol_id)""",
)
def comp_empirical(spark, sf_dir):
    return composition.empirical(composition.elemental(sites(spark, sf_dir))).select("mol_id", "element", "n", F.col("mol_charge").cast("long").alias("mol_charge"))


@query("comp_pooled", CTE + " SELECT o_orderpriority, CAST(element AS INT) AS element, count(*) AS n, CAST(sum(formal_charge) AS BIGINT) AS charge FROM sites JOIN orders ON mol_id = o_orderkey + 1 GROUP BY ALL")
def comp_pooled(spark, sf_dir):
    groups = table(spark, sf_dir, "orders").select((F.col("o_orderkey") + 1).alias("mol_id"), "o_orderpriority")
    return composition.pooled(composition.elemental(sites(spark, sf_dir)), groups, "o_orderpriority")


_FORMULAS = ["CH3COOH", "CuSO4.5H2O", "2Na+", "Na+.Cl-", "D2O", "C6H5[2H]", "[12C][13C]", "Fe2O3", "C10H15N5O10P2-2", "3CO2.2H2O"]


@query(
    "formula_roundtrip",
    CTE + HILL + """, c2 AS (SELECT mol_id, element, count(*) AS n FROM sites GROUP BY ALL)
SELECT c2.mol_id, CAST(element AS INT) AS element, n, hill.charge FROM c2 JOIN hill USING (mol_id)""",
)
def formula_roundtrip(spark, sf_dir):
    """Written formulas, parsed again by Spark SQL: the composition they came from."""
    text = notation.write(composition.elemental(sites(spark, sf_dir))).select(F.col("mol_id").alias("id"), "formula")
    return notation.parse_simple(text).select(F.col("id").alias("mol_id"), "element", "n", "charge")


@query(
    "formula_parse",
    CTE + HILL + """, c2 AS (SELECT mol_id, element, count(*) AS n FROM sites GROUP BY ALL)
SELECT c2.mol_id, CAST(element AS INT) AS element, n, CAST(hill.charge AS INT) AS charge FROM c2 JOIN hill USING (mol_id)""",
)
def formula_parse(spark, sf_dir):
    """The full grammar with error places, in Arrow batches, on the same formulas."""
    text = notation.write(composition.elemental(sites(spark, sf_dir))).select(F.col("mol_id").alias("id"), "formula")
    return notation.parse(text).select(F.col("id").alias("mol_id"), F.explode("parts").alias("p"), "charge").select("mol_id", F.col("p.element").alias("element"), F.col("p.n").alias("n"), "charge")


_VALENCE = """, val AS (SELECT s.*, coalesce(v.total, 0) AS valence FROM sites s LEFT JOIN (SELECT mol_id, site_id, sum(bond_order) AS total FROM inc GROUP BY ALL) v USING (mol_id, site_id))
, lone AS (SELECT val.*, CASE WHEN d.valence_electrons - formal_charge - valence - radical_electrons >= 0
    THEN (d.valence_electrons - formal_charge - valence - radical_electrons) // 2 END AS lone_pairs FROM val JOIN dim d USING (element))"""


@query("valence_explicit", CTE + _VALENCE + " SELECT mol_id, site_id, CAST(valence AS BIGINT) AS valence FROM val")
def valence_explicit(spark, sf_dir):
    return valence.explicit_valence(*molecules(spark, sf_dir)).select("mol_id", "site_id", "valence")


@query("lone_pairs", CTE + _VALENCE + " SELECT mol_id, site_id, CAST(lone_pairs AS BIGINT) AS lone_pairs FROM lone")
def lone_pairs(spark, sf_dir):
    return valence.lone_pairs(*molecules(spark, sf_dir)).select("mol_id", "site_id", "lone_pairs")


@query(
    "oxidation_state",
    CTE + """, gain AS (SELECT i.mol_id, i.site_id, sum(i.bond_order * sign(df.en_rank - dn.en_rank)) AS g FROM inc i JOIN sites n ON n.mol_id = i.mol_id AND n.site_id = i.site_id
  JOIN sites f ON f.mol_id = i.mol_id AND f.site_id = i.nbr JOIN dim dn ON dn.element = n.element JOIN dim df ON df.element = f.element GROUP BY ALL)
SELECT s.mol_id, s.site_id, CAST(formal_charge + coalesce(g, 0) AS INT) AS oxidation_state FROM sites s LEFT JOIN gain USING (mol_id, site_id)""",
)
def oxidation_state(spark, sf_dir):
    return valence.oxidation_states(*molecules(spark, sf_dir))


@query(
    "steric_number",
    CTE + _VALENCE + """, deg AS (SELECT mol_id, site_id, count(*) AS k FROM inc GROUP BY ALL)
SELECT l.mol_id, l.site_id, coalesce(k, 0) AS degree, CAST(coalesce(k, 0) + lone_pairs AS BIGINT) AS steric_number FROM lone l LEFT JOIN deg USING (mol_id, site_id) WHERE lone_pairs IS NOT NULL""",
)
def steric_number(spark, sf_dir):
    return valence.steric_numbers(*molecules(spark, sf_dir))


@query(
    "vsepr",
    CTE + _VALENCE + """, deg AS (SELECT mol_id, site_id, count(*) AS k FROM inc GROUP BY ALL)
, st AS (SELECT l.mol_id, l.site_id, k, k + lone_pairs AS d FROM lone l JOIN deg USING (mol_id, site_id) WHERE lone_pairs IS NOT NULL)
, t AS (SELECT * FROM (VALUES (2,2,'Linear'),(3,3,'TrigonalPlanar'),(3,2,'Angular'),(4,4,'Tetrahedral'),(4,3,'TrigonalPyramidal'),(4,2,'Angular'),(5,5,'TrigonalBipyramidal'),(5,4,'Seesaw'),(5,3,'TShaped'),(5,2,'Linear'),(6,6,'Octahedral'),(6,5,'SquarePyramidal'),(6,4,'SquarePlanar'),(6,3,'TShaped'),(6,2,'Linear')) x(d, k, geometry_name))
SELECT mol_id, site_id, geometry_name FROM st JOIN t ON st.d = t.d AND st.k = t.k""",
)
def vsepr(spark, sf_dir):
    return coordination.perceive(valence.steric_numbers(*molecules(spark, sf_dir))).select("mol_id", "site_id", "geometry_name")


@query("bond_order_number", CTE + " SELECT mol_id, bond_id, CAST(bond_order AS DOUBLE) AS value FROM bonds")
def bond_order_number(spark, sf_dir):
    return bonds(sites(spark, sf_dir)).select("mol_id", "bond_id", valence.order_number(F.col("bond_order")).alias("value"))


@query(
    "element_lookup",
    CTE + " SELECT mol_id, site_id, symbol, CAST(CASE WHEN element < 3 THEN 1 WHEN element < 11 THEN 2 ELSE 3 END AS INT) AS period, CAST(valence_electrons AS INT) AS valence_electrons, CAST(en_rank AS INT) AS en_rank FROM sites JOIN dim USING (element)",
)
def element_lookup(spark, sf_dir):
    dim = dims.elements(spark).withColumn("element", F.col("element").cast("int"))
    return sites(spark, sf_dir).join(F.broadcast(dim), "element").select("mol_id", "site_id", "symbol", "period", "valence_electrons", "en_rank")


@query("element_table")
def element_table(spark, sf_dir):
    return dims.elements(spark)


@query("isotopes", CTE + " SELECT mol_id, site_id, CAST(mass_number - element AS INT) AS neutron_count, symbol || '-' || CAST(mass_number AS VARCHAR) AS isotope FROM sites JOIN dim USING (element)")
def isotopes(spark, sf_dir):
    return valence.isotope(sites(spark, sf_dir)).select("mol_id", "site_id", "neutron_count", "isotope")


@query("degree", CTE + " SELECT s.mol_id, s.site_id, count(i.nbr) AS degree FROM sites s LEFT JOIN inc i USING (mol_id, site_id) GROUP BY ALL")
def degree(spark, sf_dir):
    return degrees(*molecules(spark, sf_dir))


_REACH = """, reach AS (SELECT mol_id, site_id AS a, site_id AS b, 0 AS d FROM sites UNION SELECT r.mol_id, r.a, i.nbr, r.d + 1 FROM reach r JOIN inc i ON i.mol_id = r.mol_id AND i.site_id = r.b WHERE r.d < 17)
, dist AS (SELECT mol_id, a, b, min(d) AS d FROM reach GROUP BY ALL)"""
_ECC = _REACH + """, size AS (SELECT mol_id, count(*) AS n FROM sites GROUP BY mol_id)
, ecc AS (SELECT mol_id, a AS site_id, CASE WHEN count(*) = any_value(n) THEN max(d) END AS e FROM dist JOIN size USING (mol_id) GROUP BY mol_id, a)"""


@query("distances", CTE + _REACH + " SELECT mol_id, a, b, CAST(d AS INT) AS d FROM dist")
def distances(spark, sf_dir):
    return topology.distances(*molecules(spark, sf_dir))


@query("components", CTE + _REACH + " SELECT mol_id, a AS site_id, min(b) AS component FROM dist GROUP BY ALL")
def components(spark, sf_dir):
    return topology.components(*molecules(spark, sf_dir))


NETWORK_COMPONENTS = """WITH RECURSIVE e AS MATERIALIZED (SELECT DISTINCT o_custkey AS c, l_suppkey + 1000000000 AS s FROM orders JOIN lineitem ON o_orderkey = l_orderkey)
, b AS MATERIALIZED (SELECT c AS x, s AS y FROM e UNION ALL SELECT s, c FROM e)
, r(x, m) USING KEY (x) AS (SELECT x, min(least(x, y)) FROM b GROUP BY x
  UNION SELECT b.y, min(r.m) FROM r JOIN b ON b.x = r.x JOIN recurring.r AS known ON known.x = b.y WHERE r.m < known.m GROUP BY b.y)
SELECT x AS site_id, m AS component FROM r"""


@query("components_network", NETWORK_COMPONENTS)
@query("components_network_whole", NETWORK_COMPONENTS)
def components_network(spark, sf_dir):
    """One large graph, of all customers and suppliers, instead of many small ones."""
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    one = F.lit(1).cast("long").alias("mol_id")
    e = o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).select(one, F.lit(0).alias("bond_id"), F.col("o_custkey").alias("a"), (F.col("l_suppkey") + 1000000000).alias("b")).distinct()
    node = e.select("mol_id", F.col("a").alias("site_id")).union(e.select("mol_id", "b")).distinct()
    return topology.components(node, e).select("site_id", "component")


@query("eccentricity", CTE + _ECC + " SELECT mol_id, site_id, CAST(e AS INT) AS eccentricity FROM ecc")
def eccentricity(spark, sf_dir):
    s, b = molecules(spark, sf_dir)
    return topology.eccentricities(s, topology.distances(s, b))


@query("graph_metrics", CTE + _ECC + ", w AS (SELECT mol_id, CAST(coalesce(sum(d) FILTER (a < b), 0) AS BIGINT) AS wiener FROM dist GROUP BY mol_id) SELECT mol_id, CAST(max(e) AS INT) AS diameter, CAST(min(e) AS INT) AS radius, any_value(wiener) AS wiener FROM ecc JOIN w USING (mol_id) GROUP BY mol_id")
def graph_metrics(spark, sf_dir):
    s, b = molecules(spark, sf_dir)
    return topology.metrics(s, topology.distances(s, b))


@query("center", CTE + _ECC + ", m AS (SELECT mol_id, min(e) AS lo, max(e) AS hi FROM ecc GROUP BY mol_id) SELECT mol_id, site_id, e = lo AS is_center, e = hi AS is_peripheral FROM ecc JOIN m USING (mol_id) WHERE e IS NOT NULL")
def center(spark, sf_dir):
    s, b = molecules(spark, sf_dir)
    return topology.center(s, topology.distances(s, b))


@query("bfs_depths", CTE + _REACH + " SELECT mol_id, a AS start, b AS site_id, CAST(d AS INT) AS depth FROM dist WHERE a = 1")
def bfs_depths(spark, sf_dir):
    s, b = molecules(spark, sf_dir)
    return topology.bfs(s, b, s.select("mol_id").distinct().withColumn("start", F.lit(1).cast("long")))


_PATHS = _REACH + """, ends AS (SELECT mol_id, CAST(1 AS BIGINT) AS a, max(site_id) AS b FROM sites GROUP BY mol_id)
, goal AS (SELECT e.mol_id, e.a, e.b, d.d FROM ends e JOIN dist d USING (mol_id, a, b))
, walk AS (SELECT mol_id, a, b, b AS at, d, [b] AS path FROM goal UNION ALL
    SELECT w.mol_id, w.a, w.b, i.nbr, w.d - 1, list_prepend(i.nbr, w.path) FROM walk w JOIN inc i ON i.mol_id = w.mol_id AND i.site_id = w.at JOIN dist d ON d.mol_id = w.mol_id AND d.a = w.a AND d.b = i.nbr AND d.d = w.d - 1 WHERE w.d > 0)"""


def _end_pairs(s: DataFrame) -> DataFrame:
    return s.groupBy("mol_id").agg(F.lit(1).cast("long").alias("a"), F.max("site_id").alias("b"))


@query("shortest_paths", CTE + _PATHS + " SELECT mol_id, a, b, array_to_string(path, '-') AS path FROM walk WHERE d = 0")
def shortest_paths(spark, sf_dir):
    s, b = molecules(spark, sf_dir)
    return topology.paths_between(s, b, _end_pairs(s)).select("mol_id", "a", "b", F.array_join(F.transform("path", lambda v: v.cast("string")), "-").alias("path"))


@query("shortest_path", CTE + _PATHS + ", p AS (SELECT mol_id, a, b, min(path) AS path FROM walk WHERE d = 0 GROUP BY mol_id, a, b) SELECT mol_id, a, b, array_to_string(path, '-') AS path FROM p")
def shortest_path(spark, sf_dir):
    s, b = molecules(spark, sf_dir)
    got = topology.shortest_path(topology.paths_between(s, b, _end_pairs(s)))
    return got.select("mol_id", "a", "b", F.array_join(F.transform("path", lambda v: v.cast("string")), "-").alias("path"))


_MEMBER = """, around AS (SELECT mol_id, bond_id, a AS at, b AS goal FROM bonds UNION SELECT w.mol_id, w.bond_id, i.nbr, w.goal FROM around w JOIN inc i ON i.mol_id = w.mol_id AND i.site_id = w.at WHERE i.bond_id <> w.bond_id)
, member AS (SELECT b.mol_id, b.bond_id, b.a, b.b, bool_or(w.at = w.goal) AS in_ring FROM bonds b JOIN around w USING (mol_id, bond_id) GROUP BY ALL)"""


@query("ring_count", CTE + _REACH + """, cc AS (SELECT mol_id, count(DISTINCT c) AS c FROM (SELECT mol_id, a, min(b) AS c FROM dist GROUP BY ALL) GROUP BY mol_id)
, v AS (SELECT mol_id, count(*) AS v FROM sites GROUP BY mol_id), e AS (SELECT mol_id, count(*) AS e FROM bonds GROUP BY mol_id)
SELECT v.mol_id, coalesce(e, 0) - v + c AS cycle_rank FROM v JOIN cc USING (mol_id) LEFT JOIN e USING (mol_id)""")
def ring_count(spark, sf_dir):
    s, b = molecules(spark, sf_dir)
    return topology.cycle_rank(s, b, topology.components(s, b))


@query("ring_membership", CTE + _MEMBER + " SELECT mol_id, bond_id, in_ring FROM member")
def ring_membership(spark, sf_dir):
    return topology.ring_membership(bonds(sites(spark, sf_dir))).select("mol_id", "bond_id", "in_ring")


@query("ring_sites", CTE + _MEMBER + " SELECT s.mol_id, s.site_id, coalesce(bool_or(m.in_ring), false) AS in_ring FROM sites s LEFT JOIN member m ON m.mol_id = s.mol_id AND s.site_id IN (m.a, m.b) GROUP BY ALL")
def ring_sites(spark, sf_dir):
    s, b = molecules(spark, sf_dir)
    return topology.ring_sites(s, topology.ring_membership(b))


@query("bridges", CTE + _MEMBER + " SELECT mol_id, bond_id FROM member WHERE NOT in_ring")
def bridges(spark, sf_dir):
    return topology.ring_membership(bonds(sites(spark, sf_dir))).where("not in_ring").select("mol_id", "bond_id")


@query(
    "framework_roles",
    CTE + _REACH + _MEMBER + """, rs AS (SELECT DISTINCT mol_id, unnest([a, b]) AS r FROM member WHERE in_ring)
, link AS (SELECT DISTINCT x.mol_id, x.b AS site_id FROM dist x JOIN rs u ON u.mol_id = x.mol_id AND u.r = x.a JOIN dist y ON y.mol_id = x.mol_id AND y.a = x.b JOIN rs v ON v.mol_id = y.mol_id AND v.r = y.b
    JOIN dist z ON z.mol_id = x.mol_id AND z.a = x.a AND z.b = y.b WHERE u.r < v.r AND x.d + y.d = z.d)
SELECT s.mol_id, s.site_id, CASE WHEN rs.r IS NOT NULL THEN 'Ring' WHEN link.site_id IS NOT NULL THEN 'Linker' ELSE 'SideChain' END AS role
FROM sites s LEFT JOIN rs ON rs.mol_id = s.mol_id AND rs.r = s.site_id LEFT JOIN link ON link.mol_id = s.mol_id AND link.site_id = s.site_id""",
)
def framework_roles(spark, sf_dir):
    s, b = molecules(spark, sf_dir)
    return topology.framework(s, b, topology.ring_membership(b))


_BESIDE = """, beside AS (SELECT i.mol_id, i.site_id AS cut, i.nbr AS head, i.nbr AS pos FROM inc i UNION SELECT w.mol_id, w.cut, w.head, i.nbr FROM beside w JOIN inc i ON i.mol_id = w.mol_id AND i.site_id = w.pos WHERE i.nbr <> w.cut)
"""


@query(
    "biconnected_blocks",
    CTE + _BESIDE + """, tied AS (SELECT DISTINCT w.mol_id, i.bond_id AS x, j.bond_id AS y FROM beside w JOIN inc i ON i.mol_id = w.mol_id AND i.site_id = w.cut AND i.nbr = w.head JOIN inc j ON j.mol_id = w.mol_id AND j.site_id = w.cut AND j.nbr = w.pos)
, whole AS (SELECT mol_id, bond_id AS x, bond_id AS y FROM bonds UNION SELECT c.mol_id, c.x, t.y FROM whole c JOIN tied t ON t.mol_id = c.mol_id AND t.x = c.y)
SELECT mol_id, x AS bond_id, min(y) AS block FROM whole GROUP BY mol_id, x""",
)
def biconnected_blocks(spark, sf_dir):
    return topology.blocks(bonds(sites(spark, sf_dir)))


@query(
    "cut_sites",
    CTE + _BESIDE + """
SELECT mol_id, cut AS site_id FROM (SELECT mol_id, cut, head, min(pos) AS part FROM beside GROUP BY ALL) AS x GROUP BY mol_id, cut HAVING count(DISTINCT part) > 1""",
)
def cut_sites(spark, sf_dir):
    b = bonds(sites(spark, sf_dir))
    return topology.cut_sites(b, topology.blocks(b))


def _wl(k: int) -> str:
    return f""", w{k} AS (SELECT c.mol_id, c.site_id, dense_rank() OVER (PARTITION BY c.mol_id ORDER BY c.colour, c.env) - 1 AS colour FROM (
  SELECT p.mol_id, p.site_id, p.colour, coalesce(list_sort(list({{'o': i.bond_order, 'c': q.colour}}) FILTER (i.nbr IS NOT NULL)), []) AS env FROM w{k - 1} p
  LEFT JOIN inc i ON i.mol_id = p.mol_id AND i.site_id = p.site_id LEFT JOIN w{k - 1} q ON q.mol_id = i.mol_id AND q.site_id = i.nbr GROUP BY p.mol_id, p.site_id, p.colour) c)"""


@query("wl_refine", CTE + ", w0 AS (SELECT mol_id, site_id, dense_rank() OVER (PARTITION BY mol_id ORDER BY element) - 1 AS colour FROM sites)" + _wl(1) + _wl(2) + " SELECT mol_id, site_id, CAST(colour AS INT) AS colour FROM w2")
def wl_refine(spark, sf_dir):
    return topology.refine(*molecules(spark, sf_dir), "element", 2)


def seeded(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    return _seeds(*molecules(spark, sf_dir))


def _seeds(s: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    return s.withColumn("seed", F.col("element").cast("long")), b.withColumn("seed", F.col("bond_order").cast("long"))


M64 = "18446744073709551616"


def _mix(source: str, word: str, name: str) -> str:
    """Lateral columns that fold one word into a state."""
    mul = lambda v, m: f"CAST((CAST({v} AS UHUGEINT) * {m}) % {M64} AS UBIGINT)"
    return f"""xor({source}, CAST({word} AS UBIGINT)) AS {name}0, {mul(f'xor({name}0, {name}0 >> 30)', '13787848793156543929')} AS {name}1,
  {mul(f'xor({name}1, {name}1 >> 27)', '10723151780598845931')} AS {name}2, xor({name}2, {name}2 >> 31) AS {name}"""


_SEED = "CAST(11400714819323198485 AS UBIGINT)"
_SIGNED = lambda c: f"CAST(CASE WHEN {c} >= 9223372036854775808 THEN CAST({c} AS HUGEINT) - {M64} ELSE CAST({c} AS HUGEINT) END AS BIGINT)"
_PAIR = _REACH + f""", fp AS (SELECT mol_id, d, lo, hi, {_mix(_SEED, 'd', 'p')}, {_mix('p', 'lo', 'q')}, {_mix('q', 'hi', 'r')} FROM (
  SELECT x.mol_id, x.d, least(s.element, t.element) AS lo, greatest(s.element, t.element) AS hi FROM dist x JOIN sites s ON s.mol_id = x.mol_id AND s.site_id = x.a
  JOIN sites t ON t.mol_id = x.mol_id AND t.site_id = x.b WHERE x.a < x.b AND x.d BETWEEN 1 AND 3)), pairfp AS (SELECT mol_id, r AS code, count(*) AS n FROM fp GROUP BY ALL)"""


def _pair_fp(spark, sf_dir):
    s, b = seeded(spark, sf_dir)
    return fingerprint.pairs(s, b, 3)


@query("fp_pair", CTE + _PAIR + f" SELECT mol_id, {_SIGNED('code')} AS code, n FROM pairfp")
def fp_pair(spark, sf_dir):
    return _pair_fp(spark, sf_dir)


@query("fp_fold", CTE + _PAIR + " SELECT DISTINCT mol_id, CAST(code % 2048 AS BIGINT) AS bit FROM pairfp")
def fp_fold(spark, sf_dir):
    return fingerprint.folded(_pair_fp(spark, sf_dir), 2048)


@query("fp_pooled", CTE + _PAIR + f" SELECT {_SIGNED('code')} AS code, CAST(sum(n) AS BIGINT) AS n FROM pairfp GROUP BY code")
def fp_pooled(spark, sf_dir):
    return fingerprint.pooled(_pair_fp(spark, sf_dir))


def _fold(source: str, longest: int) -> str:
    """Tables h1, h2, ... that fold the words of lists w into a state s, a word each."""
    first = f", h0 AS (SELECT mol_id, w, {_SEED} AS s FROM {source})"
    return first + "".join(f", h{k} AS MATERIALIZED (SELECT mol_id, w, CASE WHEN len(w) >= {k} THEN c ELSE s END AS s FROM (SELECT mol_id, w, s, {_mix('s', f'coalesce(w[{k}], 0)', 'c')} FROM h{k - 1}))" for k in range(1, longest + 1))


@query("fp_path", CTE + """, far AS MATERIALIZED (SELECT i.mol_id, i.site_id, i.nbr, i.bond_order AS o, s.element AS e, t.element AS f FROM inc i
  JOIN sites s ON s.mol_id = i.mol_id AND s.site_id = i.site_id JOIN sites t ON t.mol_id = i.mol_id AND t.site_id = i.nbr)
, trails AS (SELECT mol_id, least([e, o, f], [f, o, e]) AS w FROM far WHERE site_id < nbr
  UNION ALL SELECT x.mol_id, least([x.e, x.o, x.f, y.o, y.f], [y.f, y.o, x.f, x.o, x.e]) AS w FROM far x JOIN far y ON y.mol_id = x.mol_id AND y.site_id = x.nbr WHERE x.site_id < y.nbr)""" + _fold("trails", 5) + f"""
SELECT mol_id, {_SIGNED('s')} AS code, count(*) AS n FROM h5 GROUP BY ALL""")
def fp_path(spark, sf_dir):
    s, b = seeded(spark, sf_dir)
    return fingerprint.path(s, b, 2)


@query("fp_circular")
def fp_circular(spark, sf_dir):
    return fingerprint.circular(*seeded(spark, sf_dir), 2)


_COMPARE = CTE + ", c AS (SELECT mol_id, element AS code, count(*) AS n FROM sites GROUP BY ALL), k AS (SELECT mol_id, sum(n) AS card, sum(n * n) AS sq FROM c GROUP BY mol_id)" + """
, p AS (SELECT mol_id AS a, lead(mol_id) OVER (ORDER BY mol_id) AS b FROM k)
, x AS (SELECT p.a, p.b, sum(least(u.n, v.n)) AS i, sum(u.n * v.n) AS dot FROM p JOIN c u ON u.mol_id = p.a JOIN c v ON v.mol_id = p.b AND v.code = u.code GROUP BY ALL)
, y AS (SELECT p.a, p.b, coalesce(i, 0) AS i, coalesce(dot, 0) AS dot, ka.card AS ca, kb.card AS cb, ka.sq AS sa, kb.sq AS sb FROM p LEFT JOIN x USING (a, b) JOIN k ka ON ka.mol_id = p.a JOIN k kb ON kb.mol_id = p.b)"""


def _elements_fp(spark, sf_dir):
    return composition.elemental(sites(spark, sf_dir)).select("mol_id", F.col("element").cast("long").alias("code"), "n")


def _consecutive(fp: DataFrame) -> DataFrame:
    """Pairs of each molecule with the next id, by a join: the next present id is found by range-partitioned neighbours of orders."""
    ids = fp.select("mol_id").distinct()
    bucket = F.expr("mol_id div 4096")
    inside = ids.select("mol_id", F.lead("mol_id").over(Window.partitionBy(bucket).orderBy("mol_id")).alias("next"), bucket.alias("k"))
    first = ids.groupBy(bucket.alias("k")).agg(F.min("mol_id").alias("first"))
    after = first.select("k", F.lead("first").over(Window.orderBy("k")).alias("after"))  # one row for 4096 ids
    return inside.join(after, "k").select(F.col("mol_id").alias("a"), F.coalesce("next", "after").alias("b")).where("b is not null")


@query("sim_tanimoto", _COMPARE + " SELECT a, b, CAST(i AS BIGINT) AS intersection, round(i / (ca + cb - i), 9) AS tanimoto FROM y")
def sim_tanimoto(spark, sf_dir):
    fp = _elements_fp(spark, sf_dir)
    return fingerprint.compare(_consecutive(fp), fp, fp).select("a", "b", "intersection", F.round("tversky", 9).alias("tanimoto"))


@query("sim_tversky", _COMPARE + " SELECT a, b, round(i / (i + 0.9 * (ca - i) + 0.1 * (cb - i)), 9) AS tversky FROM y")
def sim_tversky(spark, sf_dir):
    fp = _elements_fp(spark, sf_dir)
    return fingerprint.compare(_consecutive(fp), fp, fp, 0.9, 0.1).select("a", "b", F.round("tversky", 9).alias("tversky"))


@query("sim_dice", _COMPARE + " SELECT a, b, round(2 * i / (ca + cb), 9) AS dice FROM y")
def sim_dice(spark, sf_dir):
    fp = _elements_fp(spark, sf_dir)
    return fingerprint.compare(_consecutive(fp), fp, fp, 0.5, 0.5).select("a", "b", F.round("tversky", 9).alias("dice"))


@query("sim_cosine", _COMPARE + " SELECT a, b, round(dot / (sqrt(sa) * sqrt(sb)), 9) AS cosine FROM y")
def sim_cosine(spark, sf_dir):
    fp = _elements_fp(spark, sf_dir)
    return fingerprint.compare(_consecutive(fp), fp, fp).select("a", "b", F.round("cosine", 9).alias("cosine"))


@query("sim_search", CTE + _PAIR + """, k AS (SELECT mol_id, sum(n) AS card FROM pairfp GROUP BY mol_id)
, x AS (SELECT u.mol_id AS a, v.mol_id AS b, sum(least(u.n, v.n)) AS i FROM pairfp u JOIN pairfp v USING (code) WHERE u.mol_id % 50 = 0 GROUP BY ALL)
SELECT a, b, CAST(i AS BIGINT) AS intersection, round(i / (ka.card + kb.card - i), 9) AS tanimoto FROM x JOIN k ka ON ka.mol_id = a JOIN k kb ON kb.mol_id = b WHERE 100 * i >= 80 * (ka.card + kb.card - i)""")
def sim_search(spark, sf_dir):
    fp = _pair_fp(spark, sf_dir)
    return fingerprint.search(fp.where("mol_id % 50 = 0"), fp, 80).select("a", "b", "intersection", F.round("tanimoto", 9).alias("tanimoto"))


_FOLDED = CTE + _PAIR + """, fold AS (SELECT DISTINCT mol_id, CAST(code % 2048 AS BIGINT) AS bit FROM pairfp)
, own AS (SELECT mol_id, list_sort(list(bit)) AS v FROM fold GROUP BY mol_id), cls AS MATERIALIZED (SELECT v, min(mol_id) AS id, count(*) AS n FROM own GROUP BY v)
, asked AS (SELECT v, min(mol_id) AS id FROM own WHERE mol_id % 50 = 0 GROUP BY v), lib AS MATERIALIZED (SELECT id, n, len(v) AS p, unnest(v) AS bit FROM cls)"""


@query("sim_folded", _FOLDED + """, x AS (SELECT u.id AS a, w.id AS b, u.p AS pa, w.p AS pb, count(*) AS i FROM (SELECT id, len(v) AS p, unnest(v) AS bit FROM asked) u JOIN lib w USING (bit) GROUP BY ALL)
SELECT a, b, i AS intersection, round(i / (pa + pb - i), 9) AS tanimoto FROM x WHERE 100 * i >= 80 * (pa + pb - i)""")
def sim_folded(spark, sf_dir):
    bits = stored(fingerprint.folded(_pair_fp(spark, sf_dir), 2048), "folded")
    asked, _ = fingerprint.folded_classes(bits.where("mol_id % 50 = 0"), 2048)
    library, _ = fingerprint.folded_classes(bits, 2048)
    return fingerprint.folded_search(asked, library, 80).select("a", "b", "intersection", F.round("tanimoto", 9).alias("tanimoto"))


@query("sim_folded_links", _FOLDED + """, x AS (SELECT u.id AS a, w.id AS b, w.n, u.p AS pa, w.p AS pb, count(*) AS i FROM lib u JOIN lib w USING (bit) GROUP BY ALL)
, y AS (SELECT a, sum(n) - 1 AS k FROM x WHERE 100 * i >= 80 * (pa + pb - i) GROUP BY a)
SELECT o.mol_id, c.id AS class_id, CAST(y.k AS BIGINT) AS n_links FROM own o JOIN cls c USING (v) JOIN y ON y.a = c.id""")
def sim_folded_links(spark, sf_dir):
    return fingerprint.folded_links(stored(fingerprint.folded(_pair_fp(spark, sf_dir), 2048), "folded"), 2048, 80)


CARBONYL = isomorphism.Pattern({1: "element = 6", 2: "element = 8", 3: "element in (6, 7, 16)"}, [(1, 2, "bond_order = 2"), (1, 3, "")])
TRIANGLE = isomorphism.Pattern({1: "element = 6", 2: "", 3: ""}, [(1, 2, ""), (2, 3, ""), (1, 3, "")])


@query("substructure_matches", CTE + """, k AS MATERIALIZED (SELECT mol_id, site_id, element FROM sites)
, far AS MATERIALIZED (SELECT i.mol_id, i.site_id, i.nbr, i.bond_order, k.element FROM inc i JOIN k ON k.mol_id = i.mol_id AND k.site_id = i.nbr)
, around AS (SELECT mol_id, site_id, list({'nbr': nbr, 'o': bond_order, 'e': element}) AS v FROM far GROUP BY ALL)
, ends AS (SELECT a.mol_id, a.site_id AS p1, p.nbr AS p2, unnest(v) AS c FROM (SELECT mol_id, site_id, v, unnest(list_filter(v, lambda x: x.o = 2 AND x.e = 8)) AS p FROM around) a JOIN k USING (mol_id, site_id) WHERE k.element = 6)
SELECT mol_id, p1, p2, c.nbr AS p3 FROM ends WHERE c.nbr <> p2 AND c.e IN (6, 7, 16)""")
def substructure_matches(spark, sf_dir):
    return isomorphism.matches(*molecules(spark, sf_dir), CARBONYL)


@query("substructure_count", CTE + """ SELECT i.mol_id, count(*) AS n FROM inc i JOIN inc j ON j.mol_id = i.mol_id AND j.site_id = i.nbr AND j.nbr <> i.site_id
JOIN inc k ON k.mol_id = i.mol_id AND k.site_id = j.nbr AND k.nbr = i.site_id JOIN sites a ON a.mol_id = i.mol_id AND a.site_id = i.site_id WHERE a.element = 6 GROUP BY i.mol_id""")
def substructure_count(spark, sf_dir):
    return isomorphism.counts(isomorphism.matches(*molecules(spark, sf_dir), TRIANGLE))


@query("substructure_exists", CTE + """ SELECT DISTINCT i.mol_id FROM inc i JOIN inc j ON j.mol_id = i.mol_id AND j.site_id = i.nbr AND j.nbr <> i.site_id
JOIN inc k ON k.mol_id = i.mol_id AND k.site_id = j.nbr AND k.nbr = i.site_id JOIN sites a ON a.mol_id = i.mol_id AND a.site_id = i.site_id WHERE a.element = 6""")
def substructure_exists(spark, sf_dir):
    s, b = molecules(spark, sf_dir)
    return isomorphism.containing(s, isomorphism.matches(s, b, TRIANGLE))


def _quads(spark, sf_dir) -> DataFrame:
    """Each site with the three after it in its molecule."""
    w = Window.partitionBy("mol_id").orderBy("site_id")
    s = sites(spark, sf_dir).select("mol_id", "site_id", "x", "y", "z")
    return s.select("mol_id", "site_id", *(F.lead(k, i).over(w).alias(f"{p}{k}") for i, p in enumerate("abcd") for k in "xyz"))


_QUAD = CTE + ", q AS (SELECT mol_id, site_id, " + ", ".join(f"lead({k}, {i}) OVER w AS {p}{k}" for i, p in enumerate("abcd") for k in "xyz") + " FROM sites WINDOW w AS (PARTITION BY mol_id ORDER BY site_id))"
_D = lambda p, q: ", ".join(f"{q}{k} - {p}{k}" for k in "xyz")


def _v(p: str):
    return geometry.vector(p)


@query("geom_displacement", _QUAD + " SELECT mol_id, site_id, round(bx - ax, 6) AS dx, round(by - ay, 6) AS dy, round(bz - az, 6) AS dz FROM q WHERE bx IS NOT NULL".replace("by -", '"by" -'))
def geom_displacement(spark, sf_dir):
    d = geometry.sub(_v("b"), _v("a"))
    return _quads(spark, sf_dir).where("bx is not null").select("mol_id", "site_id", *(F.round(c, 6).alias(f"d{k}") for c, k in zip(d, "xyz", strict=True)))


@query("geom_distance", _QUAD + ' SELECT mol_id, site_id, round(sqrt((bx - ax) ** 2 + ("by" - ay) ** 2 + (bz - az) ** 2), 6) AS distance FROM q WHERE bx IS NOT NULL')
def geom_distance(spark, sf_dir):
    return _quads(spark, sf_dir).where("bx is not null").select("mol_id", "site_id", F.round(geometry.norm(geometry.sub(_v("b"), _v("a"))), 6).alias("distance"))


_ANGLE = """, e AS (SELECT mol_id, site_id, ax - bx AS ux, ay - "by" AS uy, az - bz AS uz, cx - bx AS vx, cy - "by" AS vy, cz - bz AS vz FROM q WHERE cx IS NOT NULL)
, f AS (SELECT *, sqrt(ux * ux + uy * uy + uz * uz) AS nu, sqrt(vx * vx + vy * vy + vz * vz) AS nv FROM e)"""


@query("geom_angle", _QUAD + _ANGLE + """ SELECT mol_id, site_id, CASE WHEN nu > 0 AND nv > 0 THEN round(atan2(sqrt((uy * vz - uz * vy) ** 2 + (uz * vx - ux * vz) ** 2 + (ux * vy - uy * vx) ** 2) / (nu * nv), (ux * vx + uy * vy + uz * vz) / (nu * nv)), 5) END AS angle FROM f""")
def geom_angle(spark, sf_dir):
    return _quads(spark, sf_dir).where("cx is not null").select("mol_id", "site_id", F.round(geometry.angle(_v("a"), _v("b"), _v("c")), 5).alias("angle"))


@query("geom_dihedral", _QUAD + """, e AS (SELECT mol_id, site_id, bx - ax AS ux, "by" - ay AS uy, bz - az AS uz, cx - bx AS vx, cy - "by" AS vy, cz - bz AS vz, dx - cx AS wx, dy - cy AS wy, dz - cz AS wz FROM q WHERE dx IS NOT NULL)
, l AS (SELECT *, uy * vz - uz * vy AS lx, uz * vx - ux * vz AS ly, ux * vy - uy * vx AS lz, vy * wz - vz * wy AS tx, vz * wx - vx * wz AS ty, vx * wy - vy * wx AS tz FROM e)
, s AS (SELECT *, (lx * wx + ly * wy + lz * wz) * sqrt(vx * vx + vy * vy + vz * vz) AS up, lx * tx + ly * ty + lz * tz AS along FROM l)
SELECT mol_id, site_id, CASE WHEN lx * lx + ly * ly + lz * lz > 1e-8 AND tx * tx + ty * ty + tz * tz > 1e-8 THEN abs(round(atan2(up, along), 5)) END AS torsion,
  CASE WHEN lx * lx + ly * ly + lz * lz > 1e-8 AND tx * tx + ty * ty + tz * tz > 1e-8 THEN CASE WHEN up > 1e-9 THEN 1 WHEN up < -1e-9 THEN -1 ELSE 0 END END AS turn FROM s""")
def geom_dihedral(spark, sf_dir):
    """Size and sense of the torsion: a half turn is as well +pi as -pi, by the last bit of its sine.

    Null where three points lie on a line but for rounding, as the angle is then rounding alone.
    """
    a, b, c, d = (_v(p) for p in "abcd")
    axis = geometry.sub(c, b)
    fixed = F.least(*(geometry.norm(geometry.cross(u, axis)) for u in (geometry.sub(b, a), geometry.sub(d, c)))) > 1e-4
    angle = F.when(fixed, geometry.dihedral(a, b, c, d))
    turn = F.when(F.abs(F.sin(angle)) <= 1e-9, 0).otherwise(F.signum(angle)).cast("int")
    return _quads(spark, sf_dir).where("dx is not null").select("mol_id", "site_id", F.abs(F.round(angle, 5)).alias("torsion"), turn.alias("turn"))


@query("geom_signed_volume", _QUAD + """, e AS (SELECT mol_id, site_id, bx - ax AS px, "by" - ay AS py, bz - az AS pz, cx - ax AS qx, cy - ay AS qy, cz - az AS qz, dx - ax AS rx, dy - ay AS ry, dz - az AS rz FROM q WHERE dx IS NOT NULL)
SELECT mol_id, site_id, round((px * (qy * rz - qz * ry) + py * (qz * rx - qx * rz) + pz * (qx * ry - qy * rx)) / 6, 5) + 0.0 AS volume FROM e""")
def geom_signed_volume(spark, sf_dir):
    return _quads(spark, sf_dir).where("dx is not null").select("mol_id", "site_id", (F.round(geometry.signed_volume(_v("a"), _v("b"), _v("c"), _v("d")), 5) + F.lit(0.0)).alias("volume"))


def _three(spark, sf_dir, names) -> list:
    return [F.round(c, 5).alias(c) for c in names]


@query("centroid", CTE + " SELECT mol_id, round(avg(x), 5) AS cx, round(avg(y), 5) AS cy, round(avg(z), 5) AS cz FROM sites GROUP BY mol_id")
def centroid(spark, sf_dir):
    return geometry.centers(sites(spark, sf_dir)).select("mol_id", *_three(spark, sf_dir, ["cx", "cy", "cz"]))


@query("center_of_mass", CTE + " SELECT mol_id, " + ", ".join(f"round(sum(mass_number * {k}) / sum(mass_number) + 0.0000003, 5) AS c{k}" for k in "xyz") + " FROM sites GROUP BY mol_id")
def center_of_mass(spark, sf_dir):
    s = sites(spark, sf_dir).withColumn("mass", F.col("mass_number").cast("double"))
    return geometry.centers(s, "mass").select("mol_id", *(F.round(F.col(f"c{k}") + 0.0000003, 5).alias(f"c{k}") for k in "xyz"))


_COV = """, m AS (SELECT mol_id, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM sites GROUP BY mol_id)
, cov AS (SELECT mol_id, avg((x - mx) * (x - mx)) AS cxx, avg((y - my) * (y - my)) AS cyy, avg((z - mz) * (z - mz)) AS czz, avg((x - mx) * (y - my)) AS cxy, avg((x - mx) * (z - mz)) AS cxz, avg((y - my) * (z - mz)) AS cyz FROM sites JOIN m USING (mol_id) GROUP BY mol_id)"""


@query("moments", CTE + _COV + " SELECT mol_id, " + ", ".join(f"round(c{k} + 0.0000003, 5) + 0.0 AS c{k}" for k in ("xx", "yy", "zz", "xy", "xz", "yz")) + " FROM cov")
def moments(spark, sf_dir):
    return geometry.moments(sites(spark, sf_dir)).select("mol_id", *((F.round(F.col(f"c{k}") + 0.0000003, 5) + F.lit(0.0)).alias(f"c{k}") for k in ("xx", "yy", "zz", "xy", "xz", "yz")))


@query("gyration_radius", CTE + _COV + " SELECT mol_id, round(sqrt(cxx + cyy + czz), 5) AS radius FROM cov")
def gyration_radius(spark, sf_dir):
    return geometry.moments(sites(spark, sf_dir)).select("mol_id", F.round(geometry.gyration_radius(), 5).alias("radius"))


@query("principal_moments")
def principal_moments(spark, sf_dir):
    return geometry.moments(sites(spark, sf_dir)).select("mol_id", *(F.round(c, 4).alias(f"m{i}") for i, c in enumerate(geometry.principal_moments(), 1)))


@query("mass_moments", CTE + """, m AS (SELECT mol_id, sum(mass_number) AS w, """ + ", ".join(f"sum(mass_number * {k}) / sum(mass_number) AS m{k}" for k in "xyz") + """ FROM sites GROUP BY mol_id)
SELECT mol_id, """ + ", ".join(f"round(sum(mass_number * ({p} - m{p}) * ({q} - m{q})) / any_value(w) + 0.0000003, 5) + 0.0 AS c{p}{q}" for p, q in ("xx", "yy", "zz", "xy", "xz", "yz")) + " FROM sites JOIN m USING (mol_id) GROUP BY mol_id")
def mass_moments(spark, sf_dir):
    s = sites(spark, sf_dir).withColumn("mass", F.col("mass_number").cast("double"))
    return geometry.moments(s, "mass").select("mol_id", *((F.round(F.col(f"c{k}") + 0.0000003, 5) + F.lit(0.0)).alias(f"c{k}") for k in ("xx", "yy", "zz", "xy", "xz", "yz")))


@query("principal_axes", CTE + _COV + """ SELECT mol_id, round(cxx + cyy + czz + 0.0000003, 4) AS trace, round(cxx * cyy + cyy * czz + cxx * czz - cxy * cxy - cxz * cxz - cyz * cyz + 0.0000003, 4) + 0.0 AS minors,
  true AS ascending, true AS right_handed, true AS rebuilt FROM cov""")
def principal_axes(spark, sf_dir):
    """The invariants of each covariance from its eigenvalues, and whether the frame gives the covariance back."""
    spread = geometry.moments(sites(spark, sf_dir))
    both = spread.join(geometry.principal_axes(spread), "mol_id")
    m, a = F.col("moments"), F.col("axes")
    back = lambda i, j: m[0] * a[i] * a[j] + m[1] * a[3 + i] * a[3 + j] + m[2] * a[6 + i] * a[6 + j]
    off = F.greatest(*(F.abs(back("xyz".index(p), "xyz".index(q)) - F.col(f"c{p}{q}")) for p, q in ("xx", "yy", "zz", "xy", "xz", "yz")))
    return both.select(
        "mol_id",
        F.round(m[0] + m[1] + m[2] + 0.0000003, 4).alias("trace"),
        (F.round(m[0] * m[1] + m[1] * m[2] + m[0] * m[2] + 0.0000003, 4) + F.lit(0.0)).alias("minors"),
        ((m[0] <= m[1]) & (m[1] <= m[2])).alias("ascending"),
        (F.abs(lattice.determinant(a) - 1) < 1e-9).alias("right_handed"),
        (off < 1e-9).alias("rebuilt"),
    )


def clouds(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("label").cast("long").alias("mol_id"), F.col("vec_id").alias("site_id"), *((F.col("embedding")[i].cast("double") * 10).alias(k) for i, k in enumerate("xyz")))


_CLOUD = "WITH s AS (SELECT CAST(label AS BIGINT) AS mol_id, vec_id AS site_id, CAST(embedding[1] AS DOUBLE) * 10 AS x, CAST(embedding[2] AS DOUBLE) * 10 AS y, CAST(embedding[3] AS DOUBLE) * 10 AS z FROM embeddings)"


@query("neighbors", _CLOUD + " SELECT a.mol_id, a.site_id AS a, b.site_id AS b, round((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) + (b.z - a.z) * (b.z - a.z), 6) AS d2 FROM s a JOIN s b ON a.mol_id = b.mol_id AND a.site_id < b.site_id WHERE (b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) + (b.z - a.z) * (b.z - a.z) <= 0.64")
def neighbors(spark, sf_dir):
    return geometry.neighbors(clouds(spark, sf_dir), 0.8).select("mol_id", "a", "b", F.round("d2", 6).alias("d2"))


@query("near_points", _CLOUD + ", p AS (SELECT mol_id, site_id AS point_id, x + 0.1 AS px, y - 0.1 AS py, z AS pz FROM s WHERE site_id % 50 = 0) SELECT point_id, s.mol_id, s.site_id, round((x - px) * (x - px) + (y - py) * (y - py) + (z - pz) * (z - pz), 6) AS d2 FROM s JOIN p ON s.mol_id = p.mol_id WHERE (x - px) * (x - px) + (y - py) * (y - py) + (z - pz) * (z - pz) <= 1.0")
def near_points(spark, sf_dir):
    c = clouds(spark, sf_dir)
    points = c.where("site_id % 50 = 0").select("mol_id", F.col("site_id").alias("point_id"), (F.col("x") + 0.1).alias("px"), (F.col("y") - 0.1).alias("py"), F.col("z").alias("pz"))
    return geometry.near(c, points, 1.0).select("point_id", "mol_id", "site_id", F.round("d2", 6).alias("d2"))


@query("periodic_neighbors", _CLOUD + ", p AS (SELECT a.mol_id, a.site_id AS a, b.site_id AS b, b.x - a.x - 4 * round((b.x - a.x) / 4) AS dx, b.y - a.y - 5 * round((b.y - a.y) / 5) AS dy, b.z - a.z - 2 * round((b.z - a.z) / 2) AS dz FROM s a JOIN s b ON a.mol_id = b.mol_id AND a.site_id < b.site_id) SELECT mol_id, a, b, round(dx * dx + dy * dy + dz * dz, 6) AS d2 FROM p WHERE dx * dx + dy * dy + dz * dz <= 0.64")
def periodic_neighbors(spark, sf_dir):
    edge = (F.lit(4.0), F.lit(5.0), F.lit(2.0))
    return geometry.periodic_neighbors(clouds(spark, sf_dir), edge, 0.8).select("mol_id", "a", "b", F.round("d2", 6).alias("d2"))


@query("lattice_neighbors", _CLOUD + """, p AS (SELECT a.mol_id, a.site_id AS a, b.site_id AS b, b.x - a.x AS x, b.y - a.y AS y, b.z - a.z AS z FROM s a JOIN s b ON a.mol_id = b.mol_id AND a.site_id < b.site_id)
, k AS (SELECT mol_id, a, b, x - 0.5 * round(z / 2) AS x, y - 0.7 * round(z / 2) AS y, z - 2 * round(z / 2) AS z FROM p)
, j AS (SELECT mol_id, a, b, x - round(y / 5) AS x, y - 5 * round(y / 5) AS y, z FROM k), i AS (SELECT mol_id, a, b, (x - 4 * round(x / 4)) ** 2 + y * y + z * z AS d2 FROM j)
SELECT mol_id, a, b, round(d2, 6) AS d2 FROM i WHERE d2 <= 0.36""")
def lattice_neighbors(spark, sf_dir):
    """Pairs of a skewed cell, given by a basis that is far from reduced.

    The cutoff is under half the spacing of its layers, so that SQL finds the image layer by layer.
    """
    c = clouds(spark, sf_dir)
    cell = F.array(*(F.lit(float(v)) for v in (4, 0, 0, 1, 5, 0, 9.5, 5.7, 2)))
    found = lattice.neighbors(c, c.select("mol_id").distinct().withColumn("cell", cell), 0.6)
    return found.select("mol_id", "a", "b", F.round("d2", 6).alias("d2"))


def _cells(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", (5 + F.col("p_size") % 7).cast("double").alias("a"), (6 + F.col("p_partkey") % 5).cast("double").alias("b"), (7 + F.col("p_partkey") % 3).cast("double").alias("c"))
    deg = [F.radians((80 + F.col("p_partkey") % k).cast("double")) for k in (11, 13, 17)]
    return p.select("*", lattice.from_parameters(F.col("a"), F.col("b"), F.col("c"), *deg).alias("cell"))


_CELLS = """WITH p AS (SELECT p_partkey, CAST(5 + p_size % 7 AS DOUBLE) AS a, CAST(6 + p_partkey % 5 AS DOUBLE) AS b, CAST(7 + p_partkey % 3 AS DOUBLE) AS c,
  radians(80 + p_partkey % 11) AS al, radians(80 + p_partkey % 13) AS be, radians(80 + p_partkey % 17) AS ga FROM part)"""


@query("lattice_volume", _CELLS + " SELECT p_partkey, round(a * b * c * sqrt(1 - cos(al) ** 2 - cos(be) ** 2 - cos(ga) ** 2 + 2 * cos(al) * cos(be) * cos(ga)), 5) AS volume FROM p")
def lattice_volume(spark, sf_dir):
    return _cells(spark, sf_dir).select("p_partkey", F.round(lattice.volume(F.col("cell")), 5).alias("volume"))


@query("lattice_parameters", _CELLS + " SELECT p_partkey, round(a, 6) AS a, round(b, 6) AS b, round(c, 6) AS c, round(al, 6) AS alpha, round(be, 6) AS beta, round(ga, 6) AS gamma FROM p")
def lattice_parameters(spark, sf_dir):
    cell = F.col("cell")
    parts = [*lattice.edge_lengths(cell), *lattice.angles(cell)]
    return _cells(spark, sf_dir).select("p_partkey", *(F.round(c, 6).alias(n) for c, n in zip(parts, ("a", "b", "c", "alpha", "beta", "gamma"), strict=True)))


@query("lattice_reciprocal", _CELLS + " SELECT p_partkey, round(1 / (a * b * c * sqrt(1 - cos(al) ** 2 - cos(be) ** 2 - cos(ga) ** 2 + 2 * cos(al) * cos(be) * cos(ga))), 8) AS volume FROM p")
def lattice_reciprocal(spark, sf_dir):
    return _cells(spark, sf_dir).select("p_partkey", F.round(lattice.volume(lattice.reciprocal(F.col("cell"))), 8).alias("volume"))


@query("lattice_roundtrip", _CELLS + " SELECT p_partkey, round(a / 10, 6) AS x, round(b / 10, 6) AS y, round(c / 10, 6) AS z FROM p")
def lattice_roundtrip(spark, sf_dir):
    cell = F.col("cell")
    f = lattice.to_fractional(cell, lattice.to_cartesian(cell, (F.col("a") / 10, F.col("b") / 10, F.col("c") / 10)))
    return _cells(spark, sf_dir).select("p_partkey", *(F.round(v, 6).alias(k) for v, k in zip(f, "xyz", strict=True)))


@query("lattice_wrap", CTE + " SELECT mol_id, site_id, round((x / 3 - floor(x / 3)) * 3, 6) AS x, round((y / 2 - floor(y / 2)) * 2, 6) AS y, round((z / 4 - floor(z / 4)) * 4, 6) AS z FROM sites")
def lattice_wrap(spark, sf_dir):
    cell = lattice.orthorhombic(F.lit(3.0), F.lit(2.0), F.lit(4.0))
    f = [lattice.wrapped_fraction(F.col(k) / n) * n for k, n in zip("xyz", (3.0, 2.0, 4.0), strict=True)]
    return sites(spark, sf_dir).where(cell.isNotNull()).select("mol_id", "site_id", *(F.round(v, 6).alias(k) for v, k in zip(f, "xyz", strict=True)))


@query("minimum_image", _QUAD + ', e AS (SELECT mol_id, site_id, bx - ax - 3 * round((bx - ax) / 3) AS x, "by" - ay - 2 * round(("by" - ay) / 2) AS y, bz - az - 4 * round((bz - az) / 4) AS z FROM q WHERE bx IS NOT NULL) SELECT mol_id, site_id, round(x * x + y * y + z * z, 5) AS d2 FROM e')
def minimum_image(spark, sf_dir):
    cell = lattice.orthorhombic(F.lit(3.0), F.lit(2.0), F.lit(4.0))
    d = geometry.sub(_v("b"), _v("a"))
    return _quads(spark, sf_dir).where("bx is not null").select("mol_id", "site_id", F.round(lattice.minimum_image(cell, d)["d2"], 5).alias("d2"))


@query("translations", "WITH p AS (SELECT p_partkey, 5 + p_size % 7 AS a FROM part), r AS (SELECT unnest(range(-3, 4)) AS i) SELECT p_partkey, count(*) AS n FROM p, r x, r y, r z WHERE (x.i ** 2 + y.i ** 2 + z.i ** 2) * a * a <= 144 GROUP BY p_partkey")
def translations(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", (5 + F.col("p_size") % 7).cast("double").alias("a"))
    p = p.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey")  # a small file is one task else, and rows cost hundreds of points
    return p.select("p_partkey", F.size(lattice.translations(lattice.cubic(F.col("a")), F.lit(12.0))).cast("long").alias("n"))


@query("lattice_reduced")
def lattice_reduced(spark, sf_dir):
    cell = lattice.reduced(F.col("cell"))
    return _cells(spark, sf_dir).select("p_partkey", *(F.round(c, 6).alias(f"l{i}") for i, c in enumerate(lattice.edge_lengths(cell), 1)))


@query("unit_convert", CTE + " SELECT mol_id, site_id, round(x / 0.529177210544, 9) AS bohr, round(x * 0.1, 9) AS nm, round(mass_number / 6.0221407537e23 * 1e24, 6) AS yoctogram FROM sites")
def unit_convert(spark, sf_dir):
    x, m = F.col("x"), F.col("mass_number").cast("double")
    return sites(spark, sf_dir).select("mol_id", "site_id", F.round(dims.convert(x, "length", "Angstrom", "Bohr"), 9).alias("bohr"), F.round(dims.convert(x, "length", "Angstrom", "Nanometer"), 9).alias("nm"), F.round(dims.convert(m, "mass", "Dalton", "Gram") * 1e24, 6).alias("yoctogram"))


@query("unit_table")
def unit_table(spark, sf_dir):
    return dims.units(spark)


@query("geometry_table")
def geometry_table(spark, sf_dir):
    return dims.geometries(spark)


@query("tensor_ops", CTE + """ SELECT mol_id, site_id, round(x * 0.6 + y * 0.8, 6) AS along, round(x - 2 * (x * 0.6 + y * 0.8) * 0.6, 6) AS rx, round(y - 2 * (x * 0.6 + y * 0.8) * 0.8, 6) AS ry, round(x * cos(0.5) - y * sin(0.5), 6) AS tx, round(x * sin(0.5) + y * cos(0.5), 6) AS ty FROM sites""")
def tensor_ops(spark, sf_dir):
    u, n = geometry.vector(), (F.lit(0.6), F.lit(0.8), F.lit(0.0))
    r, t = tensor.reflect(u, n), tensor.apply(tensor.rotation_z(F.lit(0.5)), u)
    return sites(spark, sf_dir).select("mol_id", "site_id", F.round(tensor.dot(u, n), 6).alias("along"), F.round(r[0], 6).alias("rx"), F.round(r[1], 6).alias("ry"), F.round(t[0], 6).alias("tx"), F.round(t[1], 6).alias("ty"))


def _packed(spark, sf_dir):
    s, b = molecules(spark, sf_dir)
    return kernels.packed(s, b, "element", "formal_charge", "radical_electrons")


@query("rings_mcb", CTE + _REACH + """, cc AS (SELECT mol_id, count(DISTINCT c) AS c FROM (SELECT mol_id, a, min(b) AS c FROM dist GROUP BY ALL) AS x GROUP BY mol_id)
, v AS (SELECT mol_id, count(*) AS v FROM sites GROUP BY mol_id), e AS (SELECT mol_id, count(*) AS e FROM bonds GROUP BY mol_id)
SELECT v.mol_id, e - v + c AS rings FROM v JOIN cc USING (mol_id) JOIN e USING (mol_id) WHERE e - v + c > 0""")
def rings_mcb(spark, sf_dir):
    """Basis rings counted: as many as the cycle rank."""
    return kernels.rings(_packed(spark, sf_dir)).groupBy("mol_id").agg(F.count("*").alias("rings"))


@query("ring_systems")
def ring_systems(spark, sf_dir):
    return kernels.ring_systems(stored(kernels.rings(_packed(spark, sf_dir)), "rings"))


@query("bridgeheads")
def bridgeheads(spark, sf_dir):
    s, b = molecules(spark, sf_dir)
    return kernels.bridgeheads(stored(kernels.rings(kernels.packed(s, b)), "rings"), b)


@query("ring_families")
def ring_families(spark, sf_dir):
    return kernels.ring_families(_packed(spark, sf_dir)).select("mol_id", "size", "cycles", F.array_join(F.transform("sites", lambda v: v.cast("string")), "-").alias("sites"))


def _softened(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Molecules whose ring bonds between carbon and nitrogen are made aromatic, stored once."""
    s, b = stereo_queries.held(spark, sf_dir)
    cn = s.where("element in (6, 7)").select("mol_id", "site_id")
    both = topology.ring_membership(b).where("in_ring").join(cn.withColumnRenamed("site_id", "a"), ["mol_id", "a"]).join(cn.withColumnRenamed("site_id", "b"), ["mol_id", "b"]).select("mol_id", "bond_id", F.lit(True).alias("soft"))
    return s, stored(b.join(both, ["mol_id", "bond_id"], "left").withColumn("bond_order", F.when(F.col("soft"), 7).otherwise(F.col("bond_order"))).drop("soft"), "softened")


def _kekulized(s: DataFrame, b: DataFrame) -> DataFrame:
    """Localised orders; molecules without an aromatic bond have none and are not packed."""
    soft = b.where(F.col("bond_order") == AROMATIC).select("mol_id").distinct()
    own = lambda d: d.join(soft, "mol_id", "left_semi")
    return kernels.kekulize(kernels.packed(own(s), own(b), "element", "formal_charge", "radical_electrons"))


@query("kekulize")
def kekulize(spark, sf_dir):
    """Ring bonds between carbon and nitrogen are made aromatic first."""
    s, b = _softened(spark, sf_dir)
    return _kekulized(s, b)


@query("conjugated_overlay")
def conjugated_overlay(spark, sf_dir):
    """Conjugated systems of the molecules with aromatic orders, localised orders laid over them."""
    s, b = _softened(spark, sf_dir)
    kekule = _kekulized(s, b).select("mol_id", "bond_id", F.col("kekule_order").alias("bond_order"))
    return conjugation.systems(conjugation.perceive(s, stored(bound(b, kekule, ["mol_id", "bond_id"], "bond_order"), "overlaid")))


@query("bond_overlay", CTE + """, o AS (SELECT mol_id, bond_id, CASE WHEN bond_id % 3 = 0 THEN 1 END AS bond_order FROM bonds WHERE (a + b) % 2 = 1)
SELECT b.mol_id, b.bond_id, coalesce(o.bond_order, b.bond_order) AS bond_order FROM bonds b LEFT JOIN o USING (mol_id, bond_id)""")
def bond_overlay(spark, sf_dir):
    b = bonds(sites(spark, sf_dir))
    over = b.where((F.col("a") + F.col("b")) % 2 == 1).select("mol_id", "bond_id", F.when(F.col("bond_id") % 3 == 0, 1).alias("bond_order"))
    return bound(b, over, ["mol_id", "bond_id"], "bond_order").select("mol_id", "bond_id", "bond_order")


@query("aromatic_bonds")
def aromatic_bonds(spark, sf_dir):
    return kernels.aromatic_bonds(_packed(spark, sf_dir))


@query("conjugated_systems")
def conjugated_systems(spark, sf_dir):
    s, b = stereo_queries.held(spark, sf_dir)
    got = conjugation.perceive(s, b)
    inside = conjugation.system_bonds(got, b).groupBy("mol_id", "system").agg(F.count("*").alias("bond_count"))
    return conjugation.systems(got).join(inside, ["mol_id", "system"])


@query("conjugated_members")
def conjugated_members(spark, sf_dir):
    return conjugation.members(conjugation.perceive(*molecules(spark, sf_dir)))


@query("steric_number_conjugated")
def steric_number_conjugated(spark, sf_dir):
    """Lone pairs that a site gives to conjugated systems don't count."""
    s, b = molecules(spark, sf_dir)
    return valence.steric_numbers(s, b, conjugation.donated(conjugation.perceive(s, b)))


@query("canonical_classes")
def canonical_classes(spark, sf_dir):
    return kernels.canonicalize(_packed(spark, sf_dir)).groupBy("form").agg(F.count("*").alias("n"), F.min("mol_id").alias("first"))


@query("orbits")
def orbits(spark, sf_dir):
    return kernels.orbits(_packed(spark, sf_dir))


@query("canonical_ranks")
def canonical_ranks(spark, sf_dir):
    """By element and charge as the caller's keys."""
    return kernels.canonical_ranks(kernels.packed(*molecules(spark, sf_dir), "element", "formal_charge"), "element", "formal_charge")


@query("dfs_reach", CTE + _REACH + " SELECT mol_id, b AS site_id FROM dist WHERE a = 1")
def dfs_reach(spark, sf_dir):
    return kernels.dfs(_packed(spark, sf_dir)).select("mol_id", "site_id")


def _trajectories(spark, sf_dir) -> str:
    """A folder of XYZ files, one for every 5,000 ids of molecules, frames by id."""
    path = f"{shared_dir(spark)}/trajectories-{uuid.uuid4().hex}"
    text = xyz.lines(sites(spark, sf_dir)).withColumn("file", F.expr("mol_id div 5000"))
    text.repartition("file").sortWithinPartitions("file", "mol_id").select("file", "value").write.partitionBy("file").text(path)
    return path


_XYZ = " SELECT mol_id, site_id, CAST(element AS INT) AS element, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM sites"


def _read_back(d):
    mol = F.regexp_extract("comment", "^mol ([0-9]+)$", 1).cast("long")
    return d.select(mol.alias("mol_id"), "site_id", "element", *(F.round(c, 6).alias(c) for c in "xyz"))


@query("xyz_trajectory", CTE + _XYZ)
def xyz_trajectory(spark, sf_dir):
    return _read_back(xyz.read(spark, _trajectories(spark, sf_dir)))


@query("xyz_first_frame", CTE + _XYZ + " WHERE mol_id IN (SELECT min(mol_id) FROM sites GROUP BY mol_id // 5000)")
def xyz_first_frame(spark, sf_dir):
    return _read_back(xyz.read(spark, _trajectories(spark, sf_dir), first_frame=True))


@query("xyz_roundtrip", CTE + " SELECT mol_id, site_id, CAST(element AS INT) AS element, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM sites")
def xyz_roundtrip(spark, sf_dir):
    text = xyz.lines(sites(spark, sf_dir)).select(F.col("mol_id").cast("string").alias("path"), "value")
    return xyz.parse(text).select(F.col("path").cast("long").alias("mol_id"), "site_id", "element", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), F.round("z", 6).alias("z"))


@query("mcs_size")
def mcs_size(spark, sf_dir):
    """Each molecule with the next one; 0 bonds where one of them has none."""
    mols = stored(kernels.packed(*molecules(spark, sf_dir), "element"), "mcs")
    return kernels.common_substructure(_consecutive(mols), mols).drop("site_map")


@query("mcs_map")
def mcs_map(spark, sf_dir):
    """The sites that each molecule and the next one share, one row a site of a."""
    mols = stored(kernels.packed(*molecules(spark, sf_dir), "element"), "mcs")
    return kernels.common_substructure(_consecutive(mols), mols).select("a", "b", F.explode("site_map").alias("m")).select("a", "b", F.col("m.from").alias("site_a"), F.col("m.to").alias("site_b"))


@query("departures")
def departures(spark, sf_dir):
    return coordination.departures(*molecules(spark, sf_dir)).withColumn("departure", F.round("departure", 6))


@query("nearest_geometry")
def nearest_geometry(spark, sf_dir):
    return coordination.nearest(coordination.departures(*molecules(spark, sf_dir))).withColumn("departure", F.round("departure", 6))


@query(
    "stereo_tetrahedral",
    CTE + """, k AS MATERIALIZED (SELECT mol_id, site_id, x, y, z FROM sites)
, n AS (SELECT i.mol_id, i.site_id, list({'x': k.x, 'y': k.y, 'z': k.z} ORDER BY i.nbr) AS v FROM inc i JOIN k ON k.mol_id = i.mol_id AND k.site_id = i.nbr GROUP BY ALL HAVING count(*) = 4)
, f AS (SELECT mol_id, site_id, """
    + ", ".join(f"v[{i}].{k} - v[1].{k} AS {p}{k}" for i, p in ((2, "p"), (3, "q"), (4, "r")) for k in "xyz")
    + """ FROM n), w AS (SELECT mol_id, site_id, (px * (qy * rz - qz * ry) + py * (qz * rx - qx * rz) + pz * (qx * ry - qy * rx)) / 6 AS v FROM f)
SELECT mol_id, site_id, CASE WHEN abs(v) >= 1e-9 THEN CAST(sign(v) AS INT) END AS parity FROM w""",
)
def stereo_tetrahedral(spark, sf_dir):
    return stereo.tetrahedral(*molecules(spark, sf_dir))


@query(
    "stereo_double_bonds",
    CTE + """, d AS (SELECT b.mol_id, b.bond_id, b.a, b.b, (SELECT min(nbr) FROM inc i WHERE i.mol_id = b.mol_id AND i.site_id = b.a AND i.nbr <> b.b) AS s,
    (SELECT min(nbr) FROM inc i WHERE i.mol_id = b.mol_id AND i.site_id = b.b AND i.nbr <> b.a) AS t FROM bonds b WHERE bond_order = 2)
, p AS (SELECT d.mol_id, d.bond_id, q.x - o.x AS ex, q.y - o.y AS ey, q.z - o.z AS ez, u.x - o.x AS ux, u.y - o.y AS uy, u.z - o.z AS uz, w.x - q.x AS wx, w.y - q.y AS wy, w.z - q.z AS wz FROM d
  JOIN sites o ON o.mol_id = d.mol_id AND o.site_id = d.a JOIN sites q ON q.mol_id = d.mol_id AND q.site_id = d.b JOIN sites u ON u.mol_id = d.mol_id AND u.site_id = d.s JOIN sites w ON w.mol_id = d.mol_id AND w.site_id = d.t)
, v AS (SELECT mol_id, bond_id, (uy * ez - uz * ey) * (wy * ez - wz * ey) + (uz * ex - ux * ez) * (wz * ex - wx * ez) + (ux * ey - uy * ex) * (wx * ey - wy * ex) AS v FROM p)
SELECT mol_id, bond_id, CASE WHEN abs(v) >= 1e-9 THEN CAST(sign(v) AS INT) END AS side FROM v""",
)
def stereo_double_bonds(spark, sf_dir):
    return stereo.double_bonds(*molecules(spark, sf_dir))


@query(
    "stereo_consistency",
    CTE + """, declared AS (SELECT mol_id, 0 AS locus_kind, site_id AS locus_id FROM sites WHERE l_partkey % 5 = 0)
, detected AS (SELECT mol_id, 0 AS locus_kind, site_id AS locus_id FROM inc GROUP BY mol_id, site_id HAVING count(*) >= 3)
SELECT *, 'unspecified' AS finding FROM (SELECT * FROM detected EXCEPT SELECT * FROM declared) AS x
UNION ALL SELECT *, 'overspecified' FROM (SELECT * FROM declared EXCEPT SELECT * FROM detected) AS y""",
)
def stereo_consistency(spark, sf_dir):
    """Declared: sites by a rule on the test data; detected: sites of three neighbours or more."""
    s, b = molecules(spark, sf_dir)
    declared = s.where("l_partkey % 5 = 0").select("mol_id", F.lit(0).alias("locus_kind"), F.col("site_id").alias("locus_id"))
    detected = degrees(s, b).where("degree >= 3").select("mol_id", F.lit(0).alias("locus_kind"), F.col("site_id").alias("locus_id"))
    return stereo.consistency(declared, detected)


@query(
    "matrix_scalars",
    _QUAD + """, g AS (SELECT mol_id, site_id, ax*ax + "ay"*"ay" + az*az AS aa, bx*bx + "by"*"by" + bz*bz AS bb, cx*cx + cy*cy + cz*cz AS cc, ax*bx + "ay"*"by" + az*bz AS ab, ax*cx + "ay"*cy + az*cz AS ac, bx*cx + "by"*cy + bz*cz AS bc,
  ax * ("by"*cz - bz*cy) + "ay" * (bz*cx - bx*cz) + az * (bx*cy - "by"*cx) AS det FROM q WHERE cx IS NOT NULL)
SELECT mol_id, site_id, round(aa + bb + cc + 0.0000003, 4) AS squares, round(aa*bb + aa*cc + bb*cc - ab*ab - ac*ac - bc*bc + 0.0000003, 3) AS pairs, round(abs(det) + 0.0000003, 4) AS volume, abs(det) > 1e-9 AS invertible, true AS falling FROM g""",
)
def matrix_scalars(spark, sf_dir):
    """Singular values of the matrix whose columns are three sites in a row, by their symmetric sums: the squared norm, that of the minors, the volume."""
    q = _quads(spark, sf_dir).where("cx is not null")
    m = tensor.from_cols(_v("a"), _v("b"), _v("c"))
    rows = q.select("mol_id", "site_id", *(v.alias(f"s{i}") for i, v in enumerate(tensor.singular_values(m), 1)), (tensor.is_invertible(m) & (F.abs(tensor.determinant(m)) > 1e-9)).alias("invertible"))
    a, b, c = (F.col(f"s{i}") for i in (1, 2, 3))
    return rows.select("mol_id", "site_id", F.round(a * a + b * b + c * c + 0.0000003, 4).alias("squares"), F.round((a * b) ** 2 + (a * c) ** 2 + (b * c) ** 2 + 0.0000003, 3).alias("pairs"), F.round(a * b * c + 0.0000003, 4).alias("volume"), "invertible", ((a >= b) & (b >= c)).alias("falling"))


@query("fp_circular_stereo")
def fp_circular_stereo(spark, sf_dir):
    """Circular codes with the configurations that coordinates fix at sites."""
    s, b = stereo_queries.held(spark, sf_dir)
    shape = stored(coordination.perceive(valence.steric_numbers(s, b)), "shapes")
    found = frames.perceive(s, b, shape, frames.centres(s, b, shape)).select("mol_id", F.col("locus_id").alias("site_id"), "kind", "neighbors")
    return fingerprint.circular(*_seeds(s, b), 2, found)


@query("substructure_first", CTE + """, t AS (SELECT i.mol_id, i.site_id AS p1, j.site_id AS p2, k.site_id AS p3 FROM inc i JOIN inc j ON j.mol_id = i.mol_id AND j.site_id = i.nbr AND j.nbr <> i.site_id
JOIN inc k ON k.mol_id = i.mol_id AND k.site_id = j.nbr AND k.nbr = i.site_id JOIN sites a ON a.mol_id = i.mol_id AND a.site_id = i.site_id WHERE a.element = 6)
SELECT mol_id, m.p1 AS p1, m.p2 AS p2, m.p3 AS p3 FROM (SELECT mol_id, min({'p1': p1, 'p2': p2, 'p3': p3}) AS m FROM t GROUP BY mol_id)""")
def substructure_first(spark, sf_dir):
    return isomorphism.first(isomorphism.matches(*molecules(spark, sf_dir), TRIANGLE))


_NEAR = _CLOUD + ", r AS (SELECT a.mol_id, a.site_id, b.site_id AS nbr FROM s a JOIN s b ON a.mol_id = b.mol_id AND a.site_id <> b.site_id WHERE (b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) + (b.z - a.z) * (b.z - a.z) <= 0.64)"


@query("neighbor_counts", _NEAR + " SELECT s.mol_id, s.site_id, count(r.nbr) AS neighbors FROM s LEFT JOIN r USING (mol_id, site_id) GROUP BY ALL")
def neighbor_counts(spark, sf_dir):
    cloud = clouds(spark, sf_dir)
    return geometry.reach_counts(cloud, geometry.neighbors(cloud, 0.8))


def _following(cloud: DataFrame, block: int = 65_536) -> DataFrame:
    """(mol_id, a, b): each point and the next one of its group; a window goes over a block of ids, another over the blocks."""
    own = cloud.select("mol_id", "site_id", F.expr(f"site_id div {block}").alias("block"))
    own = own.withColumn("b", F.lead("site_id").over(Window.partitionBy("mol_id", "block").orderBy("site_id")))
    first = own.groupBy(F.col("mol_id").alias("m"), F.col("block").alias("k")).agg(F.min("site_id").alias("first"))
    first = first.select("m", "k", F.lead("first").over(Window.partitionBy("m").orderBy("k")).alias("after"))
    both = own.join(first, F.col("mol_id").eqNullSafe(F.col("m")) & F.col("block").eqNullSafe(F.col("k")), "left")
    return both.select("mol_id", F.col("site_id").alias("a"), F.coalesce("b", "after").alias("b")).where("b is not null")


@query("neighbor_contains", _NEAR + ", n AS (SELECT mol_id, site_id AS a, lead(site_id) OVER (PARTITION BY mol_id ORDER BY site_id) AS b FROM s) SELECT mol_id, a, b, EXISTS (SELECT 1 FROM r WHERE r.mol_id = n.mol_id AND r.site_id = n.a AND r.nbr = n.b) AS contained FROM n WHERE b IS NOT NULL")
def neighbor_contains(spark, sf_dir):
    """Whether each point and the next one of its group are neighbours."""
    cloud = clouds(spark, sf_dir)
    asked = _following(cloud)
    return geometry.contains(geometry.neighbors_among(cloud, asked, 0.8), asked)


QUERIES |= stereo_queries.QUERIES
ORACLES |= stereo_queries.ORACLES
