"""Coordination geometry: from electron domains, or as the ideal one that a site's neighbours depart from least."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import dims
from ..model import incidence, require

_R = math.sqrt(3) / 2
# Slot directions of the coordination geometries, not normalised.
DIRECTIONS = {
    "Linear": [(0, 0, 1), (0, 0, -1)],
    "Angular": [(1, 1, 1), (1, -1, -1)],
    "TrigonalPlanar": [(1, 0, 0), (-0.5, _R, 0), (-0.5, -_R, 0)],
    "TrigonalPyramidal": [(1, -1, -1), (-1, -1, 1), (-1, 1, -1)],
    "TShaped": [(0, 0, 1), (0, 0, -1), (1, 0, 0)],
    "Tetrahedral": [(1, 1, 1), (1, -1, -1), (-1, -1, 1), (-1, 1, -1)],
    "SquarePlanar": [(1, 0, 0), (0, 1, 0), (-1, 0, 0), (0, -1, 0)],
    "PyramidalizedSquare": [(1, 0, 1), (0, 1, 1), (-1, 0, 1), (0, -1, 1)],
    "Seesaw": [(0, 0, 1), (0, 0, -1), (1, 0, 0), (-0.5, _R, 0)],
    "TrigonalBipyramidal": [(0, 0, 1), (0, 0, -1), (1, 0, 0), (-0.5, _R, 0), (-0.5, -_R, 0)],
    "SquarePyramidal": [(0, 0, 1), (1, 0, 0), (0, 1, 0), (-1, 0, 0), (0, -1, 0)],
    "Octahedral": [(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)],
    "TrigonalPrismatic": [(1, 0, 1), (-0.5, _R, 1), (-0.5, -_R, 1), (1, 0, -1), (-0.5, _R, -1), (-0.5, -_R, -1)],
}


def perceive(steric: DataFrame) -> DataFrame:
    """(mol_id, site_id, geometry, geometry_name) of steric numbers (mol_id, site_id, degree, steric_number); absent where no geometry is named."""
    dim = F.broadcast(dims.vsepr(steric.sparkSession))
    return steric.join(dim, (F.col("steric_number") == F.col("domains")) & (F.col("degree") == F.col("coordination"))).select("mol_id", "site_id", "geometry", "geometry_name")


def departure(observed: np.ndarray, ideal: np.ndarray) -> np.ndarray:
    """Angles by which sets of unit vectors [k, n, 3] depart from ideal ones [n, 3], under the best assignment and rotation.

    The best rotation of an assignment leaves 2 * (n - sum of the singular values of the covariance), the least
    of these negated where only a reflection would fit better.
    """
    n = len(ideal)
    best = np.full(len(observed), np.inf)
    for order in itertools.permutations(range(n)):
        cov = np.einsum("kni,nj->kij", observed[:, order, :], ideal)
        s = np.linalg.svd(cov, compute_uv=False)
        fit = s[:, 0] + s[:, 1] + np.where(np.linalg.det(cov) < 0, -s[:, 2], s[:, 2])
        best = np.minimum(best, 2 * (n - fit))
    return 2 * np.arcsin(np.minimum(np.sqrt(np.maximum(best / n, 0)) / 2, 1))


def departures(sites: DataFrame, bonds: DataFrame) -> DataFrame:
    """(mol_id, site_id, geometry, departure) of sites with 2 to 6 neighbours, for each geometry of that many slots.

    A site is left out if a neighbour coincides with it.  Directions are joined and gathered by site (six
    at most); the fits run in Arrow batches of sites.
    """
    require(sites, "mol_id", "site_id", "x", "y", "z")
    at = sites.select("mol_id", "site_id", "x", "y", "z")
    far = at.select("mol_id", F.col("site_id").alias("nbr"), *(F.col(k).alias(f"{k}2") for k in "xyz"))
    d = incidence(bonds).join(at, ["mol_id", "site_id"]).join(far, ["mol_id", "nbr"]).select("mol_id", "site_id", "nbr", *((F.col(f"{k}2") - F.col(k)).alias(f"d{k}") for k in "xyz"))
    length = F.sqrt(F.col("dx") ** 2 + F.col("dy") ** 2 + F.col("dz") ** 2)
    site = d.withColumn("l", length).groupBy("mol_id", "site_id").agg(F.count("*").alias("n"), F.min("l").alias("least"), F.array_sort(F.collect_list(F.struct("nbr", *((F.col(f"d{k}") / F.when(F.col("l") > 0, F.col("l"))).alias(k) for k in "xyz")))).alias("v"))
    site = site.where("n between 2 and 6 and least > 0").select("mol_id", "site_id", "n", F.flatten(F.transform("v", lambda e: F.array(e["x"], e["y"], e["z"]))).alias("v"))
    schema = pa.schema([("mol_id", pa.int64()), ("site_id", pa.int64()), ("geometry", pa.int32()), ("departure", pa.float64())])
    shapes = []
    for i, (name, *_) in enumerate(dims.GEOMETRIES):
        v = np.array(DIRECTIONS[name], float)
        shapes.append((i, v / np.linalg.norm(v, axis=1, keepdims=True)))

    def run(batches):
        for batch in batches:
            count = np.asarray(batch.column(2))
            for n in np.unique(count):
                part = batch.filter(pa.array(count == n))
                u = part.column(3).flatten().to_numpy(zero_copy_only=False).reshape(-1, n, 3)
                for i, ideal in shapes:
                    if len(ideal) == n:
                        k = pa.array(np.full(part.num_rows, i), pa.int32())
                        yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), k, pa.array(departure(u, ideal))], schema=schema)

    return site.mapInArrow(run, "mol_id long, site_id long, geometry int, departure double")


def nearest(ranked: DataFrame) -> DataFrame:
    """(mol_id, site_id, geometry, departure) of the least departure; equal ones go to the first geometry."""
    least = F.min(F.struct("departure", "geometry"))
    return ranked.groupBy("mol_id", "site_id").agg(least.alias("b")).select("mol_id", "site_id", "b.geometry", "b.departure")
