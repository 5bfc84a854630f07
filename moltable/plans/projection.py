"""Deterministic molecules made of the driver's tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One molecule per order; its lines are the sites."""
    li = table(spark, sf_dir, "lineitem").withColumn("mol_id", F.col("l_orderkey") + 1)
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"]
    li = li.withColumn("site_id", F.row_number().over(Window.partitionBy("mol_id").orderBy(*order)).cast("long"))
    kind = F.col("l_partkey") % 6
    z = F.when(kind == 1, 7).when(kind == 2, 8).when(kind == 3, 1).when(kind == 4, 16).otherwise(6)
    heavy = (F.col("l_partkey") / 6).cast("long") % 2
    mass = z * 2 - F.when(z == 1, 1).otherwise(0) + heavy * F.when((z == 8) | (z == 16), 2).otherwise(1)
    return li.select(
        "mol_id",
        "site_id",
        z.alias("element"),
        mass.cast("int").alias("mass_number"),
        F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "R", -1).otherwise(0).alias("formal_charge"),
        F.when(F.col("l_suppkey") % 23 == 0, 1).otherwise(0).alias("radical_electrons"),
        (F.col("l_quantity") / 10).alias("x"),
        (F.col("l_discount") * 50).alias("y"),
        (F.col("l_tax") * 50).alias("z"),
        "l_partkey",
        "l_suppkey",
    )


def bonds(site: DataFrame) -> DataFrame:
    """A broken chain, triangle closures and six-ring closures: each site looks 1, 2 and 5 sites ahead."""
    w = Window.partitionBy("mol_id").orderBy("site_id")
    at = F.struct("site_id", "l_partkey", "l_suppkey")
    near = site.select("mol_id", at.alias("a"), *(F.lead(at, k).over(w).alias(f"b{k}") for k in (1, 2, 5)))
    near = near.select("mol_id", "a", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"b{k}").alias("b")) for k in (1, 2, 5)))).alias("c"))
    both = F.col("a.l_partkey") + F.col("c.b.l_partkey")
    k = F.col("c.k")
    keep = ((k == 1) & (F.col("a.l_partkey") % 7 != 0)) | ((k == 2) & (both % 5 == 0)) | ((k == 5) & (both % 2 == 0))
    kind = (F.col("a.l_suppkey") + F.col("c.b.l_suppkey")) % 4
    out = near.where(F.col("c.b.site_id").isNotNull() & keep).select("mol_id", F.col("a.site_id").alias("a"), F.col("c.b.site_id").alias("b"), F.when(kind == 0, 2).when(kind == 1, 3).otherwise(1).alias("bond_order"))
    return out.withColumn("bond_id", F.row_number().over(Window.partitionBy("mol_id").orderBy("a", "b")).cast("long"))


def molecules(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Sites and bonds over one shuffle by molecule."""
    site = sites(spark, sf_dir)
    return site, bonds(site)


#: The same tables as common table expressions.
CTE = """
WITH RECURSIVE sites AS (
  SELECT l_orderkey + 1 AS mol_id,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS site_id,
    CASE l_partkey % 6 WHEN 1 THEN 7 WHEN 2 THEN 8 WHEN 3 THEN 1 WHEN 4 THEN 16 ELSE 6 END AS element,
    CASE l_partkey % 6 WHEN 1 THEN 14 + (l_partkey // 6) % 2 WHEN 2 THEN 16 + 2 * ((l_partkey // 6) % 2) WHEN 3 THEN 1 + (l_partkey // 6) % 2
      WHEN 4 THEN 32 + 2 * ((l_partkey // 6) % 2) ELSE 12 + (l_partkey // 6) % 2 END AS mass_number,
    CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN -1 ELSE 0 END AS formal_charge,
    CASE WHEN l_suppkey % 23 = 0 THEN 1 ELSE 0 END AS radical_electrons,
    l_quantity / 10 AS x, l_discount * 50 AS y, l_tax * 50 AS z, l_partkey, l_suppkey
  FROM lineitem
), bonds AS (
  SELECT a.mol_id, row_number() OVER (PARTITION BY a.mol_id ORDER BY a.site_id, b.site_id) AS bond_id, a.site_id AS a, b.site_id AS b,
    CASE (a.l_suppkey + b.l_suppkey) % 4 WHEN 0 THEN 2 WHEN 1 THEN 3 ELSE 1 END AS bond_order
  FROM sites a JOIN sites b ON a.mol_id = b.mol_id AND (
    (b.site_id = a.site_id + 1 AND a.l_partkey % 7 <> 0)
    OR (b.site_id = a.site_id + 2 AND (a.l_partkey + b.l_partkey) % 5 = 0)
    OR (b.site_id = a.site_id + 5 AND (a.l_partkey + b.l_partkey) % 2 = 0))
), inc AS (
  SELECT mol_id, bond_id, a AS site_id, b AS nbr, bond_order FROM bonds
  UNION ALL SELECT mol_id, bond_id, b, a, bond_order FROM bonds
), dim AS (
  SELECT * FROM (VALUES (1, 'H', 1, 69), (6, 'C', 4, 73), (7, 'N', 5, 80), (8, 'O', 6, 82), (16, 'S', 6, 75)) t(element, symbol, valence_electrons, en_rank)
)"""
